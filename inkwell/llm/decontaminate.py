"""Benchmark decontamination (operator 5): size-partitioned MinHash containment search.

Native: DataFrame functions only.  Words are runs of letters and digits, lower-cased; a set holds
the distinct hashes of five words in a row.  An item is found in a document if at least ``percent``
of the item's set is in the document's set, however long the document is.

Search.  Benchmark items are partitioned by the size of their sets (1-8, 9-16, 17-32, ... shingles).
Each partition keeps as many minima of every item as a document that contains the item can't all
lack: with sets of up to ``u`` shingles, ``u - ceil(u * percent / 100) + 1`` least hashes.  Each
partition is searched for with its own bound, the largest of its minima, and its own marks in one
bitmap of all minima; of a document's shingles only those go on that lie under a partition's bound
and on one of its marks.  These are looked up among the minima; every hit makes a candidate, so the
search loses nothing at any size of a document.

Verification.  The sets of candidates' documents are taken once more and counted against the items'
full sets.

The items' minima, and their sets, are each broadcast only if their rows take at most
``broadcast_bytes``; else the join shuffles by hash, after each document's set has been made distinct.
The bitmap has sixteen bits for every minimum, up to ``MOST_BITS``; beyond, more shingles pass it for
nothing.

Defined results: null and empty texts, on either side, have an empty set and match nothing; a text
with fewer than five words has its whole sequence as its only shingle; rows with a null id are left
out; repeated rows and repeated ids of equal texts count once; empty tables give an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import checkpointed

PERCENT = 75
#: Bits of the bitmap of minima at least and at most, and of each of the numbers that hold it.
LEAST_BITS, MOST_BITS, WORD_BITS = 1 << 16, 1 << 20, 32
#: Bytes of rows that are sent to every task, and of a row of minima or of a set.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 48
SMALLEST = 8
"""Upper end of the first size partition; each further one's is twice the one before."""


def shingle_hashes(text: Column) -> Column:
    """The hashes of five words in a row, in order; of the whole sequence if there are fewer words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < 5, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 5),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)),
            )
        ),
    )[0]


def rank(shingle: Column) -> Column:
    """MinHash order: another hash of a shingle's hash, without its sign."""
    return F.xxhash64(shingle, F.lit("order")).bitwiseAND(F.lit((1 << 63) - 1))


def minima(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, part (the size partition's upper end), shingle, rank: the least hashes of every item of items (item_id, shingles)."""
    part = F.lit(SMALLEST) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.size("shingles") / SMALLEST)))).cast("int")
    keep = (part - F.ceil(part * percent / 100) + 1).cast("int")
    ordered = F.array_sort(F.transform("shingles", lambda s: F.struct(rank(s).alias("rank"), s.alias("shingle"))))
    return items.select("item_id", part.alias("part"), F.explode(F.slice(ordered, F.lit(1), keep)).alias("low")).select(
        "item_id", "part", "low.shingle", "low.rank"
    )


def bitmap_bits(minima_rows: int) -> int:
    """Bits of the bitmap of so many minima."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * minima_rows - 1).bit_length()))


def _mark(shingle: Column, part: int | Column, bits: int) -> Column:
    """The bit of the bitmap that stands for a shingle in a size partition."""
    return F.pmod(F.xxhash64(shingle, F.lit(part) if isinstance(part, int) else part), F.lit(bits)).cast("int")


def among_minima(low: DataFrame, shingle: Column, bits: int | None = None) -> Column:
    """Whether a shingle may be one of the minima ``low``: under the bound and on a mark of a size partition."""
    bits = bits or bitmap_bits(low.count())
    bounds = low.groupBy("part").agg(F.max("rank").alias("top")).collect()
    mark = _mark(F.col("shingle"), F.col("part"), bits)
    words = low.groupBy(F.floor(mark / WORD_BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(shingle, part), {bits}) as int) & {WORD_BITS - 1})")).alias("bits")
    )
    held = {r.word: r.bits for r in words.collect()}
    bitmap = F.expr(f"array({', '.join(f'{held.get(k, 0)}L' for k in range(bits // WORD_BITS))})")
    found = F.lit(False)
    for part, top in sorted((r.part, r.top) for r in bounds):
        mark = _mark(shingle, part, bits)
        word = F.get(bitmap, F.shiftright(mark, WORD_BITS.bit_length() - 1))
        found = found | ((rank(shingle) <= top) & (F.getbit(word, mark.bitwiseAND(F.lit(WORD_BITS - 1))) == 1))
    return found


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = PERCENT,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: every benchmark item that a document contains."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.where("doc_id is not null")
    items = benchmark.select(
        benchmark[item_col].cast("long").alias("item_id"),
        F.array_distinct(shingle_hashes(benchmark[item_text_col].cast("string"))).alias("shingles"),
    )
    items = checkpointed(items.where("item_id is not null and size(shingles) > 0").distinct())
    low = checkpointed(minima(items, percent))
    n_low, n_sets = low.count(), items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    small = n_low * ROW_BYTES <= broadcast_bytes
    grams = texts.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("shingle"))
    grams = grams.where(among_minima(low, F.col("shingle"), bitmap_bits(n_low)))
    if not small:
        grams = grams.distinct()
    looked_up = low.select("item_id", "shingle")
    found = grams.join(F.broadcast(looked_up) if small else looked_up, "shingle").select("doc_id", "item_id").distinct()
    found = checkpointed(found)
    suspects = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = items.select("item_id", F.size("shingles").alias("n_item"), F.explode("shingles").alias("shingle"))
    grams = suspects.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("shingle"))
    if n_sets * ROW_BYTES <= broadcast_bytes:
        sets = F.broadcast(sets)
    else:
        grams = grams.distinct()
    shared = grams.join(sets, "shingle").join(found, ["doc_id", "item_id"], "left_semi")
    counted = shared.distinct().groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).select(
        "doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns; a null id stays."""
    found = contained_items(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs[id_col].cast("long") == found["__found"], "left_anti")


def oracle_sql(percent: int = PERCENT) -> str:
    """The same in DuckDB's SQL, counting every item against every document it shares a shingle with."""
    def sets(table: str, key: str) -> str:
        return (
            f"select distinct {key}, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else "
            "list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle "
            f"from (select {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w "
            f"from {table} where {key} is not null and text is not null)"
        )

    return (
        f"with d as ({sets('documents', 'doc_id')}), i as ({sets('benchmark', 'item_id')}), "
        "n as (select item_id, count(*) as n_item from i group by 1) "
        "select doc_id, item_id, count(*) as n_shared, n_item from d join i using (shingle) join n using (item_id) "
        f"group by doc_id, item_id, n_item having count(*) * 100 >= n_item * {percent}"
    )
