"""MinHash near-dedup (operator 7): SuperMinHash signatures, banding, verification, union-find grouping.

1.  One pass over the texts takes each text's set of five-word shingles, its size, a 128-bit
    fingerprint of the set and the hashes of the bands of its signature.  In SuperMinHash every
    shingle ranks the slots of the signature by its own random permutation; its j-th slot gets a
    value in [j, j + 1), and a text is done as soon as no later value can be the least of a slot.
2.  Texts with equal sets are one class, stood for by its smallest id.  Only these go on.
3.  In every bucket (band and hash) the smallest id leads; each pair of a leader and a member that
    sizes and parity maps don't rule out is verified on the full sets of both texts.  Leaders of many members are dealt out in blocks.
4.  Links are grouped into components.  Members of one bucket that are then still in different
    components are tested against each other too (see ``grouping``), so no link is lost to the
    choice of leaders.

At similarity 0.75 the 32 bands of 4 slots miss a pair with a chance of 5 in a million.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a null id
has no component and isn't kept; repeated rows are each returned, in one component; an empty table
gives an empty result; further columns are not read.  A document that shares its id with another
counts as a document of its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import id_text, mix64, slices, text_bytes
from inkwell.llm.grouping import link_groups
from inkwell.llm.words import shingles
from inkwell.session import checkpointed

BANDS, ROWS = 32, 4
#: Members that one leader is compared with in one block.
BLOCK = 128
#: Bits of a set's parity map: bit k says whether an odd number of the set's shingles falls on k.
PARITY_BITS = 1024
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>"
_NONE = np.uint64((1 << 64) - 1)
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash signature of each set, a row each; a set without elements keeps the empty value."""
    out = np.full((len(sets), slots), _NONE)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(items):
            break
        draw = mix64(items + np.uint64((j + 1) * _STEP & _MASK))
        pick = j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int16)
        slot = pick.copy()  # the permutation's value there, traced back through the earlier swaps
        for i in range(j - 1, -1, -1):
            slot[swaps[i] == slot] = i
        np.minimum.at(flat, owner * slots + slot, np.uint64(j) << np.uint64(32) | draw & np.uint64(0xFFFFFFFF))
        swaps.append(pick)
        open_sets = (out == _NONE).any(axis=1)
        going = open_sets[owner]
        items, owner, swaps = items[going], owner[going], [s[going] for s in swaps]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(99))
    for batch in batches:
        for part in slices(batch):
            sets = shingles(*text_bytes(part.column(1)))
            rows = signatures(sets).reshape(len(sets), BANDS, ROWS)
            bands = mix64((rows * places).sum(axis=2, dtype=np.uint64) + salts).view(np.int64)
            full = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            words = PARITY_BITS // 64
            maps = np.array([parity(s) for s in sets], np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel(), pa.int64())),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * words).astype(np.int32)), pa.array(maps)),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "parity"],
            )


def parity(items: np.ndarray) -> np.ndarray:
    """The parity map of a set.  Where the maps of two sets differ, the sets differ in a shingle at least."""
    odd = np.bincount((items >> np.uint64(20) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_linked(x: Column, y: Column, percent: int) -> Column:
    """Whether traits (n, parity) of two sets leave it open that 100 * intersection >= percent * union.

    Their sizes must be that near, and they may differ in so many shingles at most:
    (100 - percent) / (100 + percent) of their sizes' sum.
    """
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    differ = sum(F.bit_count(F.get(x["parity"], k).bitwiseXOR(F.get(y["parity"], k))) for k in range(PARITY_BITS // 64))
    return sizes & (differ * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent))


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on a set's elements, not on their order."""
    sums = [mix64(items ^ s).sum(dtype=np.uint64) for s in (np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D))]
    return tuple(int(s.view(np.int64)) for s in sums)


def _compare(percent: int):
    """Streams blocks, sorted by leader and block with the leader's text first, into linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None
        for batch in batches:
            for part in slices(batch, 6):
                a, block, b, set_a, set_b = (part.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
                found = []
                for k, s in enumerate(shingles(*text_bytes(part.column(6)))):
                    if fingerprint(s) != (set_a[k], set_b[k]):
                        continue  # another text under the same id
                    if a[k] == b[k]:
                        key, lead = (a[k], block[k]), s
                    elif key == (a[k], block[k]):
                        small, large = (s, lead) if len(s) < len(lead) else (lead, s)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        shared = int((large[at] == small).sum())
                        if 100 * shared >= percent * (len(s) + len(lead) - shared):
                            found.append((a[k], b[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )

    return run


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose full shingle sets have 100 * intersection >= percent * union."""
    sizes = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = checkpointed(sizes.where("blocks > 1"))  # few; leaders with one block need no row
    dealt = pairs.join(sizes, F.col("a") == F.col("lead"), "left").select(
        "a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), "b"
    )
    dealt = dealt.select("a", "block", F.lit(1).alias("turn"), "b")
    asked = dealt.union(dealt.select("a", "block", F.lit(0).alias("turn"), F.col("a").alias("b")).distinct())
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    prints = classes.join(needed, F.col("rep") == F.col("id"), "left_semi").select("rep", "set_a", "set_b")
    known = texts.join(prints, F.col("doc_id") == F.col("rep")).select("rep", "set_a", "set_b", "text")
    rows = asked.join(known, F.col("b") == F.col("rep")).select("a", "block", "turn", "b", "set_a", "set_b", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "turn")
    return rows.mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every document."""
    texts = id_text(docs, id_col, text_col)
    signed = checkpointed(texts.mapInArrow(_sign, SIGNED))
    classes = checkpointed(
        signed.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
        .where("rep is not null")
    )
    members = classes.select(F.explode("bands").alias("group"), F.col("rep").alias("id"))
    traits = classes.select(F.col("rep").alias("id"), F.struct("n", "parity").alias("traits"))
    near = lambda x, y: may_be_linked(x, y, percent)
    found = link_groups(members, traits, lambda pairs: verify(pairs, classes, texts, percent), near)
    parts = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_a").alias("class_a"), F.col("set_b").alias("class_b"), F.coalesce("component", "rep").alias("part")
    )
    same = (signed["set_a"] == parts["class_a"]) & (signed["set_b"] == parts["class_b"]) & (signed["n_shingles"] > 0)
    component = F.when(signed["doc_id"].isNotNull(), F.coalesce(parts["part"], signed["doc_id"]))
    return (
        signed.join(parts, same, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def without_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, but of each component only the one with the smallest id.

    Rows with a null id stay.  Of rows that repeat an id all stay or none.
    """
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = checkpointed(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__copy")).distinct())
    return docs.join(gone, docs[id_col].cast("long") == gone["__copy"], "left_anti")


def oracle_sql(percent: int = 75) -> str:
    """The same in DuckDB's SQL, counting every pair that shares a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        f"with recursive w as (select doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w "
        "from documents where text is not null and doc_id is not null), "
        "s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else "
        "list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w), "
        "n as materialized (select doc_id, count(*) as n from s group by 1), "
        "shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all), "
        "links as materialized (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id "
        f"where 100 * c >= {percent} * (x.n + y.n - c)), "
        "edges as materialized (select a, b from links union all select b, a from links), "
        "reach(node, root) as (select a, a from edges union select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b), "
        "part as (select node, min(root) as root from reach group by 1) "
        "select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(p.root, d.doc_id) as component_id, "
        "coalesce(p.root, d.doc_id) = d.doc_id as kept from documents d left join n on d.doc_id = n.doc_id left join part p on d.doc_id = p.node"
    )
