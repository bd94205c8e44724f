"""Commits, snapshots, keyed state, retries, rate limits: against plain code, and with failures in between."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.sources import sinks
from inkwell.sources.commits import Commits
from inkwell.sources.state import KeyedState
from inkwell.streaming import ingest

SNAPSHOT = "x string, kb_id int"


def snapshot(spark, root):
    return sorted((r.kb_id, r.x) for r in sinks.read_snapshot(spark, root, SNAPSHOT).collect())


def test_commits(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "t"))
    assert commits.latest() == (0, {}) and commits.versions() == []
    for v in (1, 2, 3):
        (tmp_path / "t" / f"d{v}").mkdir(parents=True)
        commits.commit(v, {"d": [f"d{v}"]})
    with pytest.raises(ValueError):
        commits.commit(3, {})
    commits.sweep()
    assert commits.versions() == [2, 3] and commits.latest() == (3, {"d": ["d3"]})
    assert sorted(os.listdir(tmp_path / "t")) == ["_manifests", "d2", "d3"]


def test_a_rebuild_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("n", None)], SNAPSHOT)
    sinks.rebuild_snapshot(rows, root)
    before = sorted(r.x for r in sinks.read_snapshot(spark, root, SNAPSHOT).collect())
    monkeypatch.setattr(Commits, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.rebuild_snapshot(rows.where("kb_id = 2").withColumn("x", F.lit("new")), root, containers=[2, 3])
    monkeypatch.undo()
    assert sorted(r.x for r in sinks.read_snapshot(spark, root, SNAPSHOT).collect()) == before == ["a", "b", "c", "n"]
    sinks.rebuild_snapshot(rows.where("kb_id = 2").withColumn("x", F.lit("new")), root, containers=[2, 3])
    sinks.purge_container(spark, root, None)
    assert snapshot(spark, root) == [(1, "a"), (2, "new")]
    sinks.purge_container(spark, root, 9)
    assert snapshot(spark, root) == [(1, "a"), (2, "new")]
    assert sinks.read_snapshot(spark, str(tmp_path / "none"), SNAPSHOT).count() == 0


def test_tables_change_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], SNAPSHOT)
    b = spark.createDataFrame([("p", 1), ("q", 1), ("r", 2)], SNAPSHOT)
    read = lambda table: sorted((r.kb_id, r.x) for r in sinks.read_snapshot(spark, root, SNAPSHOT, table).collect())
    sinks.rebuild_tables({"a": a, "b": b}, root)
    written, real = [], Commits.new_folder

    def second_fails(self, kind):
        written.append(kind)
        if kind == "b":
            raise OSError("lost")
        return real(self, kind)

    monkeypatch.setattr(Commits, "new_folder", second_fails)
    with pytest.raises(OSError):
        sinks.rebuild_tables({"a": a.where("kb_id = 9"), "b": b}, root, containers=[1])
    monkeypatch.undo()
    assert written == ["a", "b"]
    assert (read("a"), read("b")) == ([(1, "a"), (2, "b"), (3, "c")], [(1, "p"), (1, "q"), (2, "r")])
    sinks.rebuild_tables({"a": a.where("kb_id = 9"), "b": b.where("x = 'q'")}, root, containers=[1])
    assert (read("a"), read("b")) == ([(2, "b"), (3, "c")], [(1, "q"), (2, "r")])
    sinks.purge_container(spark, root, 2)
    assert (read("a"), read("b")) == ([(3, "c")], [(1, "q")])
    sinks.truncate(spark, root, "b")
    sinks.truncate(spark, root, "b")
    assert (read("a"), read("b")) == ([(3, "c")], [])


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_keyed_state_equals_a_plain_one(spark, tmp_path):
    rng, plain = random.Random(1), {}
    state = KeyedState(spark, str(tmp_path / "k"), "k long, v string", ["k"], buckets=4, most=2)
    for number in range(7):
        changed = {rng.randrange(30): (f"v{number}", rng.random() < 0.3) for _ in range(rng.randrange(0, 8))}
        rows = [(k, v, g) for k, (v, g) in changed.items()]
        changes = spark.createDataFrame(rows, "k long, v string, gone boolean")
        for _ in range(2):  # a batch that runs again does nothing
            state.apply(changes, number)
        for k, (v, g) in changed.items():
            plain.pop(k, None)
            if not g:
                plain[k] = v
        assert {r.k: r.v for r in state.read().collect()} == plain
    assert len(state.commits.latest()[1]["deltas"]) <= 2
    with pytest.raises(ValueError):
        state.apply(spark.createDataFrame([(1, "a", False), (1, "b", False)], "k long, v string, gone boolean"), 99)
    assert {r.k: r.v for r in state.read().collect()} == plain


def test_a_change_writes_what_changed(spark, tmp_path):
    root = str(tmp_path / "k")
    state = KeyedState(spark, root, "k long, v string", ["k"])
    state.apply(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(False).alias("gone")), 0)
    whole = size_of(root)
    state.apply(spark.createDataFrame([(5, "new", False)], "k long, v string, gone boolean"), 1)
    assert size_of(root) - whole < whole / 100
    assert state.read().where("k = 5").first().v == "new" and state.read().count() == 200_000


def event(key, action, sha, offset, v=1):
    return json.dumps({"v": v, "action": action, "kbId": 1, "docLogicalKey": key, "contentSha256": sha, "offset": offset})


def lines(spark, *some):
    return spark.createDataFrame([(x,) for x in some], "line string")


def test_registry_retries_and_gives_up(spark, tmp_path):
    def work(_):
        return F.when(F.col("contentSha256").startswith("bad") & (F.col("attempts") < F.substring("contentSha256", 4, 1).cast("int")), "down")

    registry = ingest.Registry(spark, str(tmp_path), work)
    registry.apply(lines(spark, event("a", "UPSERT", "bad1", 1), event("b", "UPSERT", "bad9", 2), event("c", "UPSERT", "x", 3), "{oops", "", event("d", "NOP", "x", 4), event(" ", "UPSERT", "x", 5), event("e", "UPSERT", "x", 6, 2)), 0)
    assert {(r.doc_key, r.content_sha256) for r in registry.read().collect()} == {("c", "x")}
    assert registry.waiting().count() == 2
    registry.apply(lines(spark, event("a", "UPSERT", "newer", 9)), 1)  # overtakes the one that waits
    registry.apply(lines(spark), 2)
    assert {(r.doc_key, r.content_sha256) for r in registry.read().collect()} == {("a", "newer"), ("c", "x")}
    assert sorted((r.reason, r.attempts) for r in registry.dead().collect()) == [("down", 3), ("malformed", 1), ("no key", 1), ("unknown action", 1), ("unknown version", 1)]
    assert registry.waiting().count() == 0


def plain_limit(rows, width):
    out, begin, n = {}, {}, {}
    for k, t, i in sorted(rows):
        if k not in begin or t >= begin[k] + width:
            begin[k], n[k] = t, 0
        n[k] += 1
        out[k, i] = n[k]
    return out


@pytest.mark.parametrize("spread", [40, 2000])
def test_rate_limit_equals_a_plain_loop(spark, spread):
    rng = random.Random(spread)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 9), rng.randrange(-spread, spread), i) for i in range(600)]
    rows += [(7, 5, 1000 + k) for k in range(20)]
    events = spark.createDataFrame(rows, "k long, s long, i long").select("k", F.timestamp_seconds("s").alias("t"), "i")
    found = ingest.rate_limited(events, "k", "t", "i", 10, 3).collect()
    assert {(r.k, r.i): r.nth for r in found} == plain_limit([(k, s, i) for k, s, i in rows], 10)
    assert all(r.allowed == (r.nth <= 3) for r in found) and len(found) == len(rows)
    assert ingest.rate_limited(events.where("false"), "k", "t", "i", 10, 3).count() == 0
