"""Operators of the back office and of retrieval on small fixtures."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import numbers, text
from inkwell.operators import relational as R
from inkwell.operators import retrieval


def test_fusion(spark):
    rows = [("q", "vec", "a", 1), ("q", "vec", "b", 2), ("q", "text", "b", 1), ("q", "text", "c", 2), ("q", "text", None, 3)]
    df = spark.createDataFrame(rows, "q string, channel string, item_id string, rank int")
    assert [r.item_id for r in retrieval.fuse(df, ["q"]).orderBy("rank").collect()] == ["b", "a", "c"]
    twice = spark.createDataFrame([("q", "v", "a", 1), ("q", "v", "a", 9), ("q", "v", "b", 2)], df.schema)
    assert retrieval.fuse(twice, ["q"]).orderBy("rank").first().item_id == "b"


def test_similar_pairs(spark):
    base = [float(k % 5 - 2) + 0.1 * k for k in range(16)]
    rows = [(1, base), (2, base), (3, [x + 0.01 for x in base]), (4, base[::-1]), (5, None)]
    pairs, members = retrieval.similar_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), "id", 0.95)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 3)]
    assert {r.item: r["class"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_similar_pairs_of_copies(spark, tmp_path):
    import duckdb

    from inkwell.plans import catalogue

    base = [float(k % 5 - 2) + 0.1 * k for k in range(16)]
    near, far = [x + 0.01 for x in base], [-x for x in base]
    rows = [(k, [base, near, base, far, base][k % 5]) for k in range(1, 30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r.a, r.b, r.score) for r in catalogue.QUERIES["similar_pairs"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    wanted = sorted(duck.execute(catalogue.ORACLES["similar_pairs"]).fetchall())
    assert len(wanted) > 200 and found == wanted


def test_near_copies_among_near_vectors(spark, tmp_path):
    """Own copies only, each once, where other vectors and equal ones are as near, and ids reach those of copies."""
    import duckdb
    import numpy as np

    from inkwell.plans import catalogue

    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 32))
    matrix = np.concatenate([base[rng.integers(0, 6, 120)] + 0.02 * rng.standard_normal((120, 32)), np.repeat(base[:2], 5, axis=0), np.ones((3, 32))])
    rows = [(k if k % 2 else k + 1_000_000, [float(x) for x in row]) for k, row in enumerate(matrix)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r.a, r.b, r.score) for r in catalogue.QUERIES["near_copies"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert found == sorted(duck.execute(catalogue.ORACLES["near_copies"]).fetchall())


def test_no_pair_is_missed_across_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "JOIN_BLOCK", 64)
    monkeypatch.setattr(retrieval, "STRIPE", 24)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(24)
    matrix = np.concatenate([centre + 0.3 * rng.standard_normal((200, 24)), rng.standard_normal((150, 24))])  # one crowded direction
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    wanted = {(i, j) for i in range(350) for j in range(i + 1, 350) if cosine[i, j] >= 0.9}
    rows = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(matrix)], "id long, embedding array<double>").repartition(3)
    pairs, _ = retrieval.similar_pairs(rows, "id", 0.9)
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 5000


def test_scores_of_observations_are_rounded_as_stored(spark):
    """193.81955 is stored as a little less, 0.03125 exactly: as printf, not as the digits read."""
    hits = spark.createDataFrame([(1, 7, 1, "a", 193.81955), (1, 8, 2, "b", 0.03125), (1, 9, 3, "c", 1234.5)], "q int, item int, rank int, text string, score double")
    found = retrieval.observation(hits, ["q"], "item", "text", "score").first()
    assert found.observation == "\n\n".join(f"[{k}] {x:.4f}\n{t}" for k, t, x in ((7, "a", 193.81955), (8, "b", 0.03125), (9, "c", 1234.5)))


def test_data_scope(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 21)], "user int, dept int")
    depts = spark.createDataFrame([(10, "0"), (20, "0"), (21, "0,20")], "dept_id int, ancestors string")
    seen = lambda *roles, **k: sorted(r.user for r in R.data_scope(rows, "dept", "user", list(roles), 1, 20, depts, **k).collect())
    assert seen({"scope": 3}) == [2] and seen({"scope": 4}) == [2, 3] and seen({"scope": 5}) == [1]
    assert seen({"scope": 2, "depts": [10]}, {"scope": 3}) == [1, 2]
    assert seen() == [] and seen({"scope": 1, "enabled": False}) == [] and seen(admin=True) == [1, 2, 3]


def test_order_clauses_and_conditions():
    with pytest.raises(ValueError):
        R.check_order("a; drop", ["a"])
    with pytest.raises(ValueError):
        R.check_order("b", ["a"])
    with pytest.raises(ValueError):
        R.check_condition("1=1 UNION select 1")
    assert R.check_condition("name = 'android'") == "name = 'android'"


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (3, "C", "z")], "k int, v string, w string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "z")]
    assert sorted(r.k for r in R.upsert(old, new, ["k"], insert=False).collect()) == [1, 2]


def test_texts(spark):
    row = spark.range(1).select(
        text.entity_name(F.lit("ＺＴＥ－９０００")).alias("wide"),
        text.entity_name(F.lit("《Name》  x（note）")).alias("name"),
        text.joined_all(F.array(F.lit("ab"), F.lit("b"), F.lit("abc"), F.lit("d"))).alias("joined"),
        text.hide(F.lit("ABC1234"), 3, 6).alias("plate"),
        text.hide(F.lit("AB"), 3, 6).alias("short"),
        numbers.half_up(F.lit(1.005), 2).cast("string").alias("up"),
        numbers.divide(F.lit(1), F.lit(0)).cast("int").alias("zero"),
        text.snake_case(F.lit("userName")).alias("snake"),
    ).first()
    assert row.wide == "ZTE-9000" and row.name == "Name x" and row.joined == "abc；d"
    assert row.plate == "ABC***4" and row.short == "" and float(row.up) == 1.01 and row.zero == 0 and row.snake == "user_name"
