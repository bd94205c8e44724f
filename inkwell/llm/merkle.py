"""Merkle dataset manifest (operator 12): parent-preimage paths.

A row is a leaf: the SHA-256 of its columns, each with its length in front of it.  The leaves of a
group (a language) are put in order by id, every ``RUN`` consecutive nodes get a parent, and so on up
to one subroot; the subroots, in the order of their groups, get parents in the same way, up to the
root.  Of every parent its preimage is stored: the concatenated digests of its children, 64
characters each.  From the top down each node joins the preimage of its parent, and so comes to hold
those of all its ancestors.  A leaf's siblings on each level are what is left of a preimage when the
leaf's own 64 characters are excised; a changed leaf is folded up to a root by splicing its digest
into that place, hashing, and going on with the result one level up.

Places are counted without gathering a group: leaves are dealt by range and sorted, a partition's
rows are numbered as they lie, and the rows that earlier partitions have of a group are added.  The
leaves of a parent ride in its row, so that the largest join is that of an eighth of the leaves with
a sixty-fourth of them.  Texts are read once and never shuffled.  Every level is a written table.

Defined results: a null in any hashed column counts as ``-``, which no value gives; a null group is a
group, and the first one; rows with a null id come first in their group and aren't tampered with; of
rows that repeat an id the one with the smaller leaf is first, and equal rows are leaves side by side;
a group of one row has its leaf as subroot, a single group its subroot as root; without siblings a
proof is the digest of the empty text; an empty table gives an empty result.  Further columns are not
read, and their names may be anything.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import number, numbered
from inkwell.session import checkpointed, discard

#: Nodes that have a parent together, and characters of a digest.
RUN, DIGEST = 8, 64
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """SHA-256, as lower-case hex, of the values as texts, each behind its number of UTF-8 bytes; a null is ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered_ids(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(right[k])
    return same


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with node, their place in the order within their group (from 0), and n, the rows of the group.

    Rows that are equal in keys and order are dealt by where they lie, so that they may be in several parts.
    """
    by = [*keys, *order, "lies"]
    dealt = rows.withColumn("lies", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("lies")
    dealt = checkpointed(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = dealt.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("many"), F.min("at").alias("first"))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("many").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, it has its real size, so that it is only broadcast if that is small.
    parts = checkpointed(parts.select(*keys, "part", (earlier - F.col("first")).alias("add"), F.sum("many").over(group).alias("n")))
    found = dealt.join(parts, _same(dealt, parts, keys) & (part == parts["part"]))
    return found.select(*(dealt[c] for c in rows.columns), (F.col("at") + F.col("add")).alias("node"), parts["n"])


def grown(leaves: DataFrame, keys: list[str], carried: list[str]) -> list[DataFrame]:
    """The levels of each group's tree: keys, node, n, digest, and above the leaves the preimage.

    The lowest parents hold their leaves too, with the columns ``carried``, as kids.
    """
    levels, many = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while many > 1:
        below = levels[-1].where("n > 1")
        kid = F.struct((F.col("node") % RUN).cast("int").alias("slot"), "digest", *(carried if len(levels) == 1 else ()))
        runs = below.groupBy(*keys, F.expr(f"node div {RUN}").alias("node"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"))
        runs = runs.agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        parents = runs.withColumn("preimage", F.array_join(F.transform("kids", lambda k: k["digest"]), ""))
        parents = parents.withColumn("digest", F.sha2("preimage", 256))
        levels.append(checkpointed(parents if len(levels) == 1 else parents.drop("kids")))
        many = -(-many // RUN)
    return levels


def tops(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys and digest of the last node of each group."""
    found = [level.where("n = 1").select(*keys, "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def with_paths(levels: list[DataFrame], keys: list[str], carried: list[str], tails: DataFrame, told: list[str]) -> DataFrame:
    """Every leaf: digest, the columns carried and told, and path, its ancestors from the lowest up to the root.

    A step of a path has the slot of the node on the way and the preimage around it.  ``tails`` has,
    for each group, the columns told and the path of the group's last node.
    """
    above = written = None
    for level in reversed(levels[1:]):
        own = ["node", "preimage", *(["kids"] if "kids" in level.columns else [])]
        last = level.where("n = 1")
        found = last.join(tails, _same(last, tails, keys)).select(*(last[c] for c in [*keys, *own]), *told, "path")
        if above is not None:
            inner = level.where("n > 1").withColumn("up", F.expr(f"node div {RUN}"))
            step = F.struct((inner["node"] % RUN).cast("int").alias("slot"), above["preimage"].alias("preimage"))
            both = inner.join(above, _same(inner, above, keys) & (inner["up"] == above["node"]))
            found = found.union(
                both.select(*(inner[c] for c in [*keys, *own]), *(above[c] for c in told), F.concat(F.array(step), above["path"]).alias("path"))
            )
        above = checkpointed(found)
        if written is not None:
            discard(written)
        written = above
    alone = levels[0].where("n = 1")
    leaves = alone.join(tails, _same(alone, tails, keys)).select(alone["digest"], *(alone[c] for c in carried), *told, "path")
    if above is None:
        return leaves
    kids = above.select(F.explode("kids").alias("kid"), "preimage", *told, "path")
    step = F.struct(F.col("kid.slot").alias("slot"), "preimage")
    return leaves.union(kids.select("kid.digest", *(f"kid.{c}" for c in carried), *told, F.concat(F.array(step), "path").alias("path")))


def _around(step: Column) -> tuple[Column, Column]:
    """What stands before and behind the node's own digest in a step's preimage."""
    at = step["slot"] * DIGEST
    return F.substring(step["preimage"], F.lit(1), at), F.substring(step["preimage"], at + DIGEST + 1, F.lit(RUN * DIGEST))


def siblings(path: Column) -> Column:
    """The digests of all siblings on the way to the root, lowest level first, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(*_around(step))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""

    def up(digest: Column, step: Column) -> Column:
        before, behind = _around(step)
        return F.sha2(F.concat(before, digest, behind), 256)

    return F.aggregate(path, leaf, up)


def prove(leaves: DataFrame, carried: list[str], group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Every leaf with its path.

    ``leaves`` has digest, the group, the column that orders it, and the columns ``carried``.  Returns
    digest, carried, subroot, root and path.
    """
    ranked = placed(leaves, [group], [order, "digest"])
    ranked = checkpointed(ranked)
    levels = grown(ranked, [group], carried)
    # The trees' last nodes are the leaves of one tree more.
    subroots = placed(tops(levels, [group]).withColumn("tree", F.lit(0)), ["tree"], [group])
    upper = grown(checkpointed(subroots), ["tree"], [group])
    root = tops(upper, ["tree"]).select("tree", F.col("digest").alias("root"))
    root = root.withColumn("path", F.array().cast("array<struct<slot:int,preimage:string>>"))
    tails = with_paths(upper, ["tree"], [group], root, ["root"]).withColumnRenamed("digest", "subroot")
    return with_paths(levels, [group], carried, checkpointed(tails), ["subroot", "root"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    The tree is that of the documents as they are.  ``folded_root`` is what the leaf gives if the text of
    those that ``tampered_ids`` names is lower-cased, with the siblings as they were, and ``verified``
    whether that is the root.
    """
    columns = [F.col(number(docs, c)) for c in HASHED]
    doc_id, _, lang, _, text = columns
    changed = digest_of(*columns[:-1], lower_ascii(text.cast("string")))
    leaves = numbered(docs).select(
        doc_id.cast("long").alias("doc_id"), lang.cast("string").alias("lang"), digest_of(*columns).alias("digest"),
        F.when(tampered_ids(doc_id) & text.isNotNull(), changed).alias("changed"),
    )
    leaves = checkpointed(leaves)
    proved = prove(leaves, ["doc_id", "changed"])
    discard(leaves)
    return proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("changed", "digest")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a decimal number in SQL: the table of its 256 steps, and the fold of a number's digits over it.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end))"""


def crc_sql(number: str, crc_table: str) -> str:
    """SQL for the CRC-32 of a number's decimal text; ``crc_table`` names the list that CRC_TABLE gives."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(string_split(({number})::varchar, ''), lambda x: ord(x)::bigint)),
        lambda c, b: xor(c >> 8, {crc_table}[(xor(c, b) & 255) + 1])), 4294967295::bigint)"""


def oracle_sql() -> str:
    """The same trees by recursion over levels."""
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = " || ".join(map(part, HASHED[:-1]))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def tree(name: str, of: str) -> str:
        """Nodes (g, level, node, n, digest, slot, preimage) of the trees over ``of`` (g, node, n, digest)."""
        return f"""{name} as (
            select g, 0 as level, node, n, digest from {of}
            union all
            select g, level + 1, node // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(digest, '' order by node))
            from {name} where n > 1 group by g, level, node // {RUN}, n)"""

    def proofs(name: str, tree_name: str, of: str) -> str:
        """For each node of ``of`` its siblings level by level, and its root's digest folded from ``changed``."""
        return f"""{name} as (
            select g, node as leaf, 0 as level, node, n, '' as siblings, changed as fold from {of}
            union all
            select p.g, p.leaf, p.level + 1, p.node // {RUN}, (p.n + {RUN - 1}) // {RUN},
                p.siblings || coalesce((select string_agg(s.digest, '' order by s.node) from {tree_name} s where s.g = p.g
                    and s.level = p.level and s.node // {RUN} = p.node // {RUN} and s.node <> p.node), ''),
                sha256((select string_agg(case when s.node = p.node then p.fold else s.digest end, '' order by s.node)
                    from {tree_name} s where s.g = p.g and s.level = p.level and s.node // {RUN} = p.node // {RUN}))
            from {name} p where p.n > 1)"""

    return f"""
    with recursive crc as materialized (select {CRC_TABLE} as t),
    hashed as materialized (
        select doc_id, lang, sha256({leaf} || {part("text")}) as digest,
            case when {crc_sql("doc_id", "t")} % 3 = 0 and text is not null
                then sha256({leaf} || {part(lower)}) end as altered
        from documents, crc),
    ordered as materialized (
        select *, coalesce(altered, digest) as changed, dense_rank() over (order by encode(lang) nulls first) as g,
            row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as node,
            count(*) over (partition by lang) as n
        from hashed),
    {tree("nodes", "ordered")},
    subroots as materialized (
        select 0 as g, g - 1 as node, count(*) over () as n, digest, digest as changed from nodes where n = 1),
    {tree("uppers", "subroots")},
    {proofs("inner_proofs", "nodes", "ordered")},
    reached as materialized (
        select 0 as g, p.g - 1 as node, s.n, p.g as of_g, p.leaf, p.siblings as below, p.fold as changed
        from inner_proofs p join subroots s on s.node = p.g - 1 where p.n = 1),
    outer_proofs as (
        select of_g, leaf, 0 as level, node, n, below as siblings, changed as fold from reached
        union all
        select p.of_g, p.leaf, p.level + 1, p.node // {RUN}, (p.n + {RUN - 1}) // {RUN},
            p.siblings || coalesce((select string_agg(s.digest, '' order by s.node) from uppers s
                where s.level = p.level and s.node // {RUN} = p.node // {RUN} and s.node <> p.node), ''),
            sha256((select string_agg(case when s.node = p.node then p.fold else s.digest end, '' order by s.node)
                from uppers s where s.level = p.level and s.node // {RUN} = p.node // {RUN}))
        from outer_proofs p where p.n > 1)
    select o.doc_id, o.digest as leaf, s.digest as subroot, u.digest as root, sha256(p.siblings) as proof_sha256,
        p.fold as folded_root, p.fold = u.digest as verified
    from ordered o join outer_proofs p on p.of_g = o.g and p.leaf = o.node and p.n = 1
        join subroots s on s.node = o.g - 1 cross join (select digest from uppers where n = 1) u
    """
