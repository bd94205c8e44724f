"""Nearest neighbours by rings, the similarity forest, substring joins and paths: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import graph, relational, retrieval
from inkwell.operators.vector_index import VectorIndex


def table(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(int(k), [float(x) for x in row]) for k, row in zip(ids, matrix)], "id long, embedding array<double>")


def nearest(matrix, asked, k):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    out = set()
    for q in asked:
        scores = np.round(unit @ unit[q], 6)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(len(matrix)), -scores))[:k]
        out |= {(q, int(i), r + 1, round(float(scores[i]), 6) + 0.0) for r, i in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies"])
def test_rings_hold_all_neighbours(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 4
    matrix = {
        "clusters": centres[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 8)),
        "uniform": rng.standard_normal((400, 8)),
        "copies": np.repeat(rng.standard_normal((20, 8)), 20, axis=0),
    }[kind]
    vectors = table(spark, matrix)
    index = VectorIndex.build(vectors, "id", block=32)
    asked = list(range(0, len(matrix), 37))
    found, share = index.search(vectors.where(F.col("id").isin(asked)), 9, "id")
    got = {(r.query_id, r.item_id, r.rank, round(r.score, 6) + 0.0) for r in found.collect()}
    assert got == nearest(matrix, asked, 9)
    read = share.first().share
    assert read < 0.4 if kind == "clusters" else read <= 1.0


def test_rings_of_few_vectors(spark):
    few = table(spark, np.eye(3))
    found, _ = VectorIndex.build(few, "id").search(few, 9, "id")
    assert found.count() == 6
    none = few.where("false")
    assert VectorIndex.build(none, "id").search(few, 2, "id")[0].count() == 0


def test_visits_carry_no_vectors(spark):
    """A query's vector isn't repeated for every ring, and packed queries are never broadcast."""
    vectors = table(spark, np.random.default_rng(4).standard_normal((300, 8)))
    index = VectorIndex.build(vectors, "id", block=32)
    asked = vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("v"))
    visits = index._visits(asked)
    assert visits.columns == ["query_id", "centre", "away"] and visits.count() == 300 * len(index.centres)
    rings = index.blocks.select("centre", "ring")
    met = index._scored(visits.join(rings, "centre").select("query_id", "centre", "ring"), asked, 3, False)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [centre" in plan
    assert met.select("query_id").distinct().count() == 300


def test_forest_finds_planted_pairs_and_keeps_buckets_small(spark):
    rng = np.random.default_rng(1)
    largest = []
    for n in (400, 4000):
        matrix = rng.standard_normal((n, 16))
        near = matrix + 0.25 * rng.standard_normal((n, 16))
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        cosine = (unit(matrix) * unit(near)).sum(axis=1)
        planted = {(k, k + 100_000) for k in range(n) if round(cosine[k], 6) >= 0.9}
        both = table(spark, np.concatenate([matrix, near]), [*range(n), *range(100_000, 100_000 + n)])
        pairs, _ = retrieval.similar_pairs(both, "id", 0.9)
        found = {(r.a, r.b) for r in pairs.collect()}
        assert len(planted & found) >= 0.99 * len(planted) and len(planted) > n / 2
        items = both.select(F.col("id").alias("item"), F.col("embedding").alias("v"))
        largest.append(retrieval.sign_buckets(items, 0.9).groupBy("tree", "depth", "prefix").count().agg(F.max("count")).first()[0])
    assert max(largest) <= retrieval.BUCKET_ITEMS


def test_equal_directions_end(spark):
    """Vectors that agree in every sign stay in one bucket, and all their pairs are links."""
    matrix = np.outer(np.arange(1, 101), np.ones(4))
    pairs, members = retrieval.similar_pairs(table(spark, matrix), "id", 0.99)
    assert pairs.count() == 100 * 99 // 2 and members.count() == 100


def test_substring_join(spark):
    names = [f"Customer#{k:09d}" for k in range(400)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*names, "", None, "é", "ab"])], "i long, t string")
    words = spark.createDataFrame([(k, x) for k, x in enumerate([*names[::3], "", None, "é", "b", "ab", "#0000", "zzz", "Customer", "a"])], "j long, w string")
    found = {(r.i, r.j) for r in relational.containing(rows, "t", words, "w").collect()}
    assert found == {(r.i, s.j) for r in rows.collect() for s in words.collect() if r.t and s.w and s.w in r.t}
    own = words.where("w like 'Customer#%'")
    candidates = relational.gram_candidates(rows, "t", own, "w").count()
    assert candidates < 0.1 * 400 * own.count()  # not all pairs
    assert relational.containing(rows, "t", words.where("false"), "w").count() == 0


def test_a_gram_of_many_words_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(relational, "GRAM_WORDS", 4)
    rows = spark.createDataFrame([(k, f"x{k}") for k in range(50)], "i long, t string")
    words = spark.createDataFrame([(k, f"x{k}") for k in range(50)], "j long, w string")
    found = {(r.i, r.j) for r in relational.containing(rows, "t", words, "w").collect()}
    assert found == {(i, j) for i in range(50) for j in range(50) if f"x{j}" in f"x{i}"}


def test_paths(spark):
    edges = [("a", "r", "b"), ("b", "r", "c"), ("c", "s", "a"), ("a", "r", "a"), ("b", "r2", "a"), ("x", "r", "y")]
    table_ = spark.createDataFrame([(*e, ["kin"] if e[1] == "s" else None) for e in edges], "head string, relation string, tail string, category array<string>")
    seeds = spark.createDataFrame([("a",), ("a",), ("nobody",)], "name string")

    def walk(hops, fits):
        out, level = set(), [("a", ())]
        for hop in range(1, hops + 1):
            level = [(o, (*used, k)) for end, used in level for k, (h, r, t) in enumerate(edges) if fits(r) and k not in used for o in ({t} if h == end else set()) | ({h} if t == end else set())]
            out |= {(hop, ">".join("|".join(edges[k]) for k in used)) for _, used in level}
        return out

    got = {(r.hop, r.path) for r in graph.paths(table_, seeds, 4, most=None).collect()}
    assert got == walk(4, lambda r: True)
    got = {(r.hop, r.path) for r in graph.paths(table_, seeds, 4, ["r2", "kin"], "category", most=None).collect()}
    assert got == walk(4, lambda r: r in ("r2", "s"))
    first = graph.paths(table_, seeds, 4, most=5).collect()
    assert [(r.hop, r.path) for r in first] == sorted(walk(4, lambda r: True))[:5]
    on = {(r["head"], r["relation"], r["tail"]) for r in graph.edges_on_paths(table_, graph.paths(table_, seeds, 1)).collect()}
    assert on == {e for e in edges if "a" in (e[0], e[2])}
    assert graph.paths(table_, seeds.where("false"), 3).count() == 0


def test_renaming_keeps_whole_lists(spark):
    rows = spark.createDataFrame([("a", "r", "t", [str(k) for k in range(700)]), ("b", "r", "t", ["x"])], "head string, relation string, tail string, c array<string>")
    names = spark.createDataFrame([("a", "b")], "old string, new string")
    assert len(graph.rename(rows, names, ["c"]).first().c) == 701
    assert len(graph.rename(rows, names, ["c"], most=500).first().c) == 500
