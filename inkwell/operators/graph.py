"""Knowledge-graph operators: triples, merging, degrees, resolution, expansion, deletion, cards.

Edges are rows of (head, relation, tail, ...); lists on them are arrays in first-seen order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import entity_name, joined_all
from inkwell.operators.relational import all_of, containing, given, like
from inkwell.session import checkpointed, discard

KEY = ["head", "relation", "tail"]
#: Limits of expansion: hops and edges.
MAX_HOPS, MAX_EDGES = 10, 500
_ITEM = "array<map<string,string>>"


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


# -- triples


def parse_triples(answers: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, position, head, relation, tail, evidence: the triples of JSON lists of objects.

    ``head_name`` or ``head``, ``relation_predicate`` or ``relation``, ``tail_name`` or ``tail``; names
    are normalised and a triple that lacks one is dropped; long evidence is cut.
    """
    rows = answers.select(*key, F.posexplode(F.from_json(text, _ITEM)).alias("position", "t"))
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("t")[n]), F.lit("")) for n in names])
    evidence = F.coalesce(pick("evidence"), F.lit(""))
    evidence = F.when(F.length(evidence) > 600, F.concat(F.substring(evidence, 1, 600), F.lit("…"))).otherwise(evidence)
    found = rows.select(
        *key, "position",
        entity_name(pick("head_name", "head")).alias("head"),
        pick("relation_predicate", "relation").alias("relation"),
        entity_name(pick("tail_name", "tail")).alias("tail"),
        evidence.alias("evidence"),
    )
    return found.where("head != '' and tail != '' and relation is not null")


def first_seen(value: str, order: list[str]) -> Column:
    """The distinct values of a group in the order in which they came first."""
    items = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))))
    return F.array_distinct(F.transform(items, lambda x: x["v"]))


def merge_triples(triples: DataFrame, order: list[str], lists: list[str], texts: list[str]) -> DataFrame:
    """One row for each (head, relation, tail): lists in first-seen order, texts joined without what others hold."""
    return triples.groupBy(*KEY).agg(
        *[first_seen(c, order).alias(c) for c in lists],
        *[joined_all(first_seen(c, order)).alias(c) for c in texts],
    )


def merge_into(old: DataFrame, new: DataFrame, lists: list[str]) -> DataFrame:
    """Edges of both with each list of ``new`` appended to the old one, as far as it is absent."""
    right = new.select(*KEY, *[F.col(c).alias(f"__{c}") for c in lists])
    both = old.join(right, KEY, "full_outer")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return both.select(*KEY, *[F.array_union(empty(F.col(c)), empty(F.col(f"__{c}"))).alias(c) for c in lists])


def degrees(edges: DataFrame, names: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """name, out_degree, in_degree over distinct edges without loops, within the columns ``by``; names without edges have 0."""
    ends = edges.select(*by, *KEY).where("head != tail and head != '' and tail != ''").distinct()
    sides = ends.select(*by, F.col("head").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        ends.select(*by, "tail", F.lit(0), F.lit(1))
    )
    if names is not None:
        sides = sides.union(names.select(*by, "name", F.lit(0), F.lit(0)))
    return sides.groupBy(*by, "name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def top_entities(edges: DataFrame, n: int) -> DataFrame:
    """The entities with most edges, by degree, then name; n is held within 1 to 50."""
    total = (F.col("out_degree") + F.col("in_degree")).alias("degree")
    return degrees(edges).select("name", total).orderBy(F.desc("degree"), "name").limit(clamp(n, 1, 50))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head").alias("name")).union(edges.select("tail")).distinct()


# -- search


def resolve(words: DataFrame, names: DataFrame) -> DataFrame:
    """word, name: entities equal to a word; for words without one, those that hold it or that it holds.

    words: word; names: name.  Exact matches are an equi join; words that have none meet the names that share a pair of
    characters with them (see ``containing``).
    """
    words, names = checkpointed(words), checkpointed(names)
    exact = words.join(names, F.col("word") == F.col("name")).select("word", "name")
    rest = words.join(exact.select("word").distinct(), "word", "left_anti")
    plain = checkpointed(rest.select("word", entity_name(F.col("word")).alias("w")).where("w != ''"))
    held = containing(names, "name", plain, "w").union(containing(plain, "w", names, "name").select("name", "word", "w"))
    return exact.union(held.select("word", "name")).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int, most: int | None = MAX_EDGES) -> DataFrame:
    """hop, head, relation, tail: edges within ``hops`` of the seeds (name), either way, each at its least hop.

    One join for each hop on the frontier of new nodes; each hop's edges and nodes are written once.  With ``most``
    only the first edges by hop and key are kept.
    """
    near = checkpointed(edges.select(*KEY).distinct())
    frontier = seen = checkpointed(seeds.select("name").distinct())
    found = None
    for hop in range(1, clamp(hops, 1, MAX_HOPS) + 1):
        touched = near.join(frontier, F.col("head") == F.col("name"), "left_semi").union(
            near.join(frontier, F.col("tail") == F.col("name"), "left_semi")
        )
        step = checkpointed(touched.distinct().select(F.lit(hop).alias("hop"), *KEY))
        found = step if found is None else found.union(step)
        frontier = checkpointed(nodes_of(step).join(seen, "name", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    best = found.groupBy(*KEY).agg(F.min("hop").alias("hop")).select("hop", *KEY)
    return best if most is None else best.orderBy("hop", *KEY).limit(clamp(most, 1, MAX_EDGES))


#: Paths of one expansion at most, unless told otherwise.
MAX_PATHS = 200


def hinted(hints: list[str], category: str | None = None) -> Column:
    """Edges whose relation, or one of whose categories, holds one of the hints; all edges without hints."""
    if not hints:
        return F.lit(True)
    fits = [F.col("relation").contains(F.lit(h)) for h in hints]
    if category:
        lists = F.coalesce(category, F.array().cast("array<string>"))
        fits.append(F.exists(lists, lambda c: functools.reduce(lambda a, b: a | b, [c.contains(F.lit(h)) for h in hints])))
    return functools.reduce(lambda a, b: a | b, fits)


def paths(edges: DataFrame, seeds: DataFrame, hops: int, hints: list[str] = (), category: str | None = None, most: int | None = MAX_PATHS) -> DataFrame:
    """hop, seed, path, keys: the paths of up to ``hops`` edges from the seeds (name), either way, none with an edge twice.

    Every edge of a path bears a hint, if there are any, so edges without one are left out before the first hop.  A
    frontier row carries the keys of its edges; each hop is one join on its end, and is written once.  path is
    the keys as one text.  With ``most`` only the first paths by hop, path and seed stay.
    """
    near = edges.where(hinted(list(hints), category)).select(*KEY).distinct()
    near = near.withColumn("key", F.concat_ws("|", *KEY))
    steps = checkpointed(near.select(F.col("head").alias("at"), F.col("tail").alias("to"), "key").union(near.where("head != tail").select("tail", "head", "key")))
    frontier = seeds.select(F.col("name").alias("seed"), F.col("name").alias("end"), F.array().cast("array<string>").alias("keys")).distinct()
    found = None
    for hop in range(1, clamp(hops, 1, MAX_HOPS) + 1):
        gone = frontier.join(steps, F.col("end") == F.col("at")).where(~F.array_contains("keys", F.col("key")))
        frontier = checkpointed(gone.select("seed", F.col("to").alias("end"), F.concat("keys", F.array("key")).alias("keys")))
        step = frontier.select(F.lit(hop).alias("hop"), "seed", F.array_join("keys", ">").alias("path"), "keys")
        found = step if found is None else found.union(step)
        if frontier.isEmpty():
            break
    return found if most is None else found.orderBy("hop", "path", "seed").limit(max(1, most))


def edges_on_paths(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges, with all their columns, that lie on a path of ``paths``."""
    keys = found.select(F.explode("keys").alias("key")).distinct()
    return edges.withColumn("key", F.concat_ws("|", *KEY)).join(keys, "key", "left_semi").drop("key")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 1, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """nodes (name) and links (source, target, relation) around seeds; up to five hops, the first ``most`` links by hop."""
    links = expand(edges, seeds, clamp(hops, 1, 5), most)
    return nodes_of(links), links.select(F.col("head").alias("source"), F.col("tail").alias("target"), "relation")


def full_graph(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (the edges' ends with what entities (name, ...) say of them) and links (source, target, relation)."""
    nodes = nodes_of(edges).join(entities, "name", "left")
    return nodes, edges.select(F.col("head").alias("source"), F.col("tail").alias("target"), "relation")


def edge_list(edges: DataFrame, entity: str | None = None, relation: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Edges with a part of an end's name and of the relation, as far as given, that one of chunks (chunk_id) bears out."""
    fits = all_of(
        given(entity, lambda v: like(F.col("head"), v) | like(F.col("tail"), v)), given(relation, lambda v: like(F.col("relation"), v))
    )
    kept = edges.where(fits)
    if chunks is None:
        return kept
    borne = kept.select(*KEY, F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return kept.join(borne.select(*KEY).distinct(), KEY, "left_semi")


def edges_by_key(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges that keys (head, relation, tail) name exactly."""
    return edges.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def entity_detail(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """name, out_degree, in_degree, relations (sorted, distinct) of each of entities (name)."""
    asked = entities.select("name").distinct()
    out = edges.join(asked, F.col("head") == F.col("name")).select("name", "relation", F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.join(asked, F.col("tail") == F.col("name")).select("name", "relation", F.lit(0), F.lit(1))
    ends = out.union(into).union(asked.select("name", F.lit(None).cast("string"), F.lit(0), F.lit(0)))
    return ends.groupBy("name").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sort_array(F.collect_set("relation")).alias("relations")
    )


def by_hint(edges: DataFrame, hint: str, category: str = "category") -> DataFrame:
    """Edges whose relation holds the hint, or whose category holds it or is held by it; all edges if none does."""
    word = F.lit(hint)
    fits = F.col("relation").contains(word) | F.col(category).contains(word) | word.contains(F.col(category))
    kept = edges.where(fits)
    return edges if kept.isEmpty() else kept


def anchored(edges: DataFrame, chunk_ids: list[str]) -> DataFrame:
    """Edges that some of the chunks bear out."""
    return edges.where(F.arrays_overlap("chunk_ids", F.array(*map(F.lit, chunk_ids))))


def edge_text(edges: DataFrame, most: int = 3, chars: int = 120) -> Column:
    """An edge as a line of a prompt."""
    remarks = F.array_join(F.transform(F.slice("evidence", 1, most), lambda x: F.substring(x, 1, chars)), "；")
    return F.concat(F.format_string("%s -[%s]-> %s", "head", "relation", "tail"), F.when(remarks != "", F.concat(F.lit(": "), remarks)).otherwise(""))


# -- cards


def entity_cards(edges: DataFrame, hints: DataFrame, most: int = 5, chars: int = 400) -> DataFrame:
    """name, summary, vector_text of every entity: joined hints, and its most frequent relations.

    hints: name, position, hint.
    """
    ends = edges.select(F.col("head").alias("name"), "relation").union(edges.select("tail", "relation"))
    counted = ends.groupBy("name", "relation").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), "relation")
    first = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "relation"))).alias("r"))
    told = hints.groupBy("name").agg(joined_all(first_seen("hint", ["position"]), chars).alias("summary"))
    both = listed.join(told, "name", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    relations = F.array_join(F.transform("r", lambda x: x["relation"]), ", ")
    return both.select("name", "summary", F.concat_ws("\n", "name", relations, "summary").alias("vector_text"))


def pending_hints(cards: DataFrame) -> DataFrame:
    """cards (name, hints, merged) with the hints that no summary has yet; the cursor is held within the list."""
    at = F.greatest(F.lit(0), F.least(F.col("merged"), F.size("hints")))
    return cards.select("name", F.slice("hints", at + 1, F.size("hints") - at).alias("pending")).where("size(pending) > 0")


# -- changes


def purge(edges: DataFrame, gone: Callable | Column, column: str = "chunk_ids", keep_unreferenced: bool = False) -> DataFrame:
    """Edges without the references that ``gone`` (a function of one) names; an edge that loses its last one goes.

    With ``keep_unreferenced`` such an edge stays if documents still name it (``doc_ids``).
    """
    left = edges.withColumn(column, F.filter(column, lambda x: ~gone(x)))
    stays = F.size(column) > 0
    return left.where(stays | (F.size("doc_ids") > 0) if keep_unreferenced else stays)


def orphans(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that no edge has."""
    return names.select("name").distinct().join(nodes_of(edges), "name", "left_anti")


def rename(edges: DataFrame, names: DataFrame, lists: list[str], most: int | None = None) -> DataFrame:
    """Edges whose ends are renamed by names (old, new); edges that become one keep all of both lists.

    With ``most`` only the first so many elements of each joined list stay (500 where users look at them one by
    one).  Edges that become loops go.
    """
    head = names.select(F.col("old").alias("head"), F.col("new").alias("__h"))
    tail = names.select(F.col("old").alias("tail"), F.col("new").alias("__t"))
    moved = edges.join(head, "head", "left").join(tail, "tail", "left").select(
        F.coalesce("__h", "head").alias("head"), "relation", F.coalesce("__t", "tail").alias("tail"),
        F.struct("head", "tail").alias("__from"), *lists,
    )
    def flat(c: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct("__from", F.col(c).alias("v"))))
        whole = F.array_distinct(F.flatten(F.transform(items, lambda x: x["v"])))
        return (whole if most is None else F.slice(whole, 1, most)).alias(c)


    return moved.where("head != tail").groupBy(*KEY).agg(*map(flat, lists))


def remove_entities(edges: DataFrame, names: list[str]) -> DataFrame:
    """Edges that touch none of the entities."""
    return edges.where(~F.col("head").isin(names) & ~F.col("tail").isin(names))


def canonical(pairs: DataFrame) -> DataFrame:
    """old, new: for every name of the pairs (a, b) the least name that it reaches.

    In each round a name takes the least label among its neighbours', then its label's own label; so a chain of n names
    needs about log n rounds, and no name gathers its neighbours.  All joins are by merging: written tables look small
    enough to be sent to every task, and each of them would pass the driver in every round.
    """
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = checkpointed(both.select(F.col("a").alias("old")).distinct().select("old", F.col("old").alias("new")))
    while True:
        sent = both.join(label.hint("merge"), F.col("a") == F.col("old")).select(F.col("b").alias("old"), "new")
        # A label tells its own owner too: whoever bears it hears of what the owner's other bearers know.
        told = sent.join(label.select("old", F.col("new").alias("owner")).hint("merge"), "old").select(F.col("owner").alias("old"), "new")
        least = checkpointed(label.union(sent).union(told).groupBy("old").agg(F.min("new").alias("new")))
        jump = least.select(F.col("old").alias("new"), F.col("new").alias("further"))
        after = checkpointed(least.join(jump.hint("merge"), "new").select("old", F.least("new", "further").alias("new")))
        moved = after.join(label.withColumnRenamed("new", "before").hint("merge"), "old").where("new != before")
        done = moved.isEmpty()
        discard(label, least)
        if done:
            return after
        label = after


def apply_deltas(entities: DataFrame, deltas: DataFrame) -> DataFrame:
    """entities (name, out_degree, in_degree, glosses) after a document's deltas: degrees add up, glosses are replaced."""
    new = deltas.select("name", F.col("out_degree").alias("__o"), F.col("in_degree").alias("__i"), F.col("glosses").alias("__g"), F.lit(True).alias("__new"))
    both = entities.join(new, "name", "full_outer")
    add = lambda x, y: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.select(
        "name", add("out_degree", "__o").alias("out_degree"), add("in_degree", "__i").alias("in_degree"),
        F.when(F.col("__new"), F.col("__g")).otherwise(F.col("glosses")).alias("glosses"),
    )


def replace_edge(edges: DataFrame, old: DataFrame, new: DataFrame, lists: list[str]) -> DataFrame:
    """Edges without those that ``old`` names by key, and with ``new`` merged in."""
    return merge_into(edges.join(old.select(*KEY).distinct(), KEY, "left_anti"), new, lists)


def write_cursor(cards: DataFrame, summaries: DataFrame) -> DataFrame:
    """cards (name, hints, merged, summary) whose pending hints went into a new summary (name, summary)."""
    new = summaries.select("name", F.col("summary").alias("__s"))
    joined = cards.join(new, "name", "left")
    merged = F.when(F.col("__s").isNotNull(), F.size("hints")).otherwise(F.col("merged")).alias("merged")
    return joined.select("name", "hints", merged, F.coalesce("__s", "summary").alias("summary"))


def per_container(edges: DataFrame) -> DataFrame:
    """A row for each knowledge base that an edge belongs to; none listed means base 0."""
    bases = F.when(F.size(F.coalesce("kb_ids", F.array().cast("array<int>"))) > 0, F.col("kb_ids")).otherwise(F.array(F.lit(0)))
    return edges.select(F.explode(bases).alias("kb_id"), *[c for c in edges.columns if c != "kb_ids"])


def document_deltas(triples: DataFrame) -> DataFrame:
    """doc, name, out_delta, in_delta, glosses: what each document adds to its entities; loops don't count."""
    rows = triples.where("head != tail and head != '' and tail != ''")
    sides = rows.select("doc", F.col("head").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("head_gloss").alias("g")).union(
        rows.select("doc", "tail", F.lit(0), F.lit(1), "tail_gloss")
    )
    return sides.groupBy("doc", "name").agg(
        F.sum("o").alias("out_delta"), F.sum("i").alias("in_delta"),
        F.sort_array(F.collect_set(F.when(F.trim("g") != "", F.col("g")))).alias("glosses"),
    )
