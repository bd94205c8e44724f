"""What bounds the memory and the work of single steps, whatever their input's size."""

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import chunking as C
from inkwell.operators import graph as G
from inkwell.operators import retrieval as R
from inkwell.plans import catalogue
from inkwell.sources import files
from inkwell.streaming import ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_canonical_sends_no_table_to_every_task(spark, monkeypatch):
    plans, write = [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: (plans.append(plan_of(df)), write(df))[1])
    pairs = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.old, r.new) for r in G.canonical(pairs).collect()} == {(k, 1) for k in range(1, 41)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_marked_spans_split_an_answer_once(spark):
    table = spark.createDataFrame([(1, "a\nb", "a\n<<<<CUT>>>>b"), (2, "a\nb", "<think>x</think>a<<<<CUT>>>>b "), (3, "a", "b")], "id int, text string, answer string")
    found = C.marked_spans(table, "id", "text", "answer")
    assert sorted(map(tuple, found.collect())) == [(1, "strict", 0, 2), (1, "strict", 2, 3), (2, "aligned", 0, 1), (2, "aligned", 1, 3)]
    assert plan_of(found).count("split(") == 1


def test_structure_tries_a_pattern_once(spark):
    table = spark.createDataFrame([(1, "# h\n\n| a |\nx")], "id int, text string")
    found = table.select(C.structure(F.col("text")).alias("b"))
    assert [b["kind"] for b in found.first().b] == ["heading", "table", "paragraph"]
    assert plan_of(found).count("{1,6}") == 1


def test_cuts_are_sought_in_small_batches(spark):
    session = spark.newSession()
    table = session.createDataFrame([(1, "word " * 100)], "id int, text string")
    assert C.window_spans(table, "id", "text").count() == 2
    assert session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_dual_path_compares_cards_in_parts(spark, monkeypatch):
    asked = spark.createDataFrame([(q, "alpha beta") for q in range(3)], "query_id long, text string")
    seeds = spark.createDataFrame([(q, q, f"n{q % 2}") for q in range(3)], "query_id long, position long, name string")
    cards = spark.createDataFrame([(0, 0, "- 【关系】x"), (1, 0, "beta")], "query_id long, position long, card string")
    edges = spark.range(60).select(F.concat(F.lit("c"), "id").alias("head"), F.lit("in").alias("relation"), F.concat(F.lit("n"), F.col("id") % 2).alias("tail"), F.when(F.col("id") % 7 == 3, "beta").alias("hint"))
    told = spark.createDataFrame([("n0", "zero")], "name string, summary string")
    run = lambda: sorted(map(tuple, R.dual_path(asked, seeds, cards, edges, told, n=6).collect()))
    whole, parts = run(), []
    plain = DataFrame.repartition
    monkeypatch.setattr(R, "CARDS_OF_TASK", 8)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: (parts.append(n), plain(self, n, *by))[1])
    assert run() == whole and parts == [12]
    # By score, then by list and place; edges at one seed by their ends.
    mine = [c for q, c, _ in sorted(whole, key=lambda r: r[2]) if q == 0]
    assert mine == [*(f"- 【关系】c{k} —[in]→ n0：beta" for k in (10, 24, 38, 52)), "- 【实体】n0：zero", "- 【关系】c0 —[in]→ n0"]


def test_debounced_events_are_dealt(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 5).alias("user_id"), F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(tuple, catalogue.QUERIES["debounce_stream"](spark, str(tmp_path)).collect()))
    counts, plain = [], DataFrame.repartition
    monkeypatch.setattr(ingest, "EVENTS_OF_TASK", 300)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: (counts.append(n), plain(self, n, *by))[1])
    assert sorted(map(tuple, catalogue.QUERIES["debounce_stream"](spark, str(tmp_path)).collect())) == whole and len(whole) == 1000
    assert counts == [4, 4]


def test_reranked_texts_are_not_dealt(spark):
    found = catalogue.QUERIES["rerank_overlap"](spark, "/root/testdata/sf0.001")
    plan = plan_of(found)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_stitched_pages_are_sorted_whole(spark):
    pages = spark.createDataFrame([(1, 0, "| a |\n|---|\n| 1 |"), (1, 1, "| a |\n| 2 |\n\n| a |\n| 3 |")], "d int, p int, t string")
    found = C.stitch_tables(pages, "d", "p", "t")
    assert found.count() == 6
    plan = plan_of(found)
    assert "Sort" in plan and "Generate" in plan and "Join" not in plan and plan.index("Generate") < plan.index("Sort")


def test_small_files_share_tasks(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    cores = spark.sparkContext.defaultParallelism
    for k in range(5 * cores):
        (tmp_path / f"{k}.txt").write_text(f"said {k}")
    found = files.documents(session, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4 * cores
    assert {(r.source_name, r.content) for r in found.collect()} == {(f"{k}.txt", f"said {k}") for k in range(5 * cores)}


def test_tasks_list_folders_of_files(spark, tmp_path, monkeypatch):
    """The driver's plan names no file; what is found is what Spark's own reader finds."""
    from inkwell.sources import folders

    monkeypatch.setattr(folders, "BATCH_FILES", 3)
    for name in ("a.txt", "b c%20é.TXT", "in/d.txt", "in/deep/er/e.txt", "in/k=1/f.txt", "_k=2/g.txt", "_left/h.txt", ".left/i.txt", "in/_j.txt", ".k.txt", "l._COPYING_", "none", *(f"many/{n}.txt" for n in range(20))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    found = files.documents(spark, str(tmp_path))
    assert not any(str(tmp_path) in name for name in found.inputFiles()) and str(tmp_path) not in plan_of(found)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    wanted = sorted(map(tuple, plain.select(F.element_at(F.split("path", "/"), -1), F.col("content").cast("string"), F.sha2("content", 256)).collect()))
    assert sorted(map(tuple, found.select("source_name", "content", "content_sha256").collect())) == wanted and len(wanted) == 27
    assert {r.suffix for r in found.collect()} == {"txt", ""}
    # A pattern, one file and a folder without files are read as well.
    assert files.documents(spark, f"{tmp_path}/*.txt").count() == 1 and files.documents(spark, f"{tmp_path}/in/d.txt").first().content == "in/d.txt"
    assert files.documents(spark, str(tmp_path / "empty")).count() == 0


def test_many_files_are_dealt_over_folders(spark, tmp_path):
    from inkwell.sources import office

    rows = spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    for _ in range(2):  # a known name is written anew, where it was
        office.write_files(rows, str(tmp_path), 5)
    assert len(list(tmp_path.iterdir())) == 5 and len(list(tmp_path.glob("*/*.txt"))) == 50
    assert {(r.source_name, r.content) for r in files.documents(spark, str(tmp_path)).collect()} == {(f"{k}.txt", str(k)) for k in range(50)}
