"""Files, sinks and streams on small inputs."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.sources import files, sinks
from inkwell.streaming import ingest


def _docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    said = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{said}{table}</w:body></w:document>')
    return out.getvalue()


def _xlsx(rows):
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = lambda k, row: "".join(f'<c r="{chr(65 + i)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row))
    body = "".join(f"<row>{cells(k + 1, row)}</row>" for k, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", "utf-8")
    (tmp_path / "b.txt").write_bytes("知识库".encode("gbk"))
    (tmp_path / "c.csv").write_bytes("x, y\n1 ,2".encode("utf-8-sig"))
    (tmp_path / "d.docx").write_bytes(_docx("one", "", "two"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    found = {r.source_name: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert found["a.txt"].content == "héllo"
    assert found["b.txt"].content is not None and found["b.txt"].readable
    assert found["c.csv"].content == "x\ty\n1\t2"
    assert found["d.docx"].content == "one\n\ntwo\n\na\tb"
    assert not found["e.pdf"].readable


def test_spreadsheet(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(_xlsx([["Name", "Age"], ["Ann", "5"], ["Bob", "7"]]))
    found = files.spreadsheet_rows(spark, str(tmp_path / "s.xlsx"), {"Age": "age", "Name": "name", "None": "none"})
    assert sorted(map(tuple, found.collect()), key=str) == [("5", "Ann", None), ("7", "Bob", None)]


def test_dataset_and_checkpoint(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a", "ground_truth": "b"}\n\n{"question": "c"}\n')
    assert files.dataset(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.dataset(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "p.jsonl").write_text('{"question": "a", "n": 1}\n{"question": "a", "n": 2}\n{"question": "b", "n"')
    found = files.checkpoint(spark, str(tmp_path / "p.jsonl"), "question string, n int", "question").collect()
    assert [tuple(r) for r in found if r.question == "a"] == [("a", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "1.5"), ("b", "x"), ("c", "2")], "name string, n string")
    sinks.export_csv(df, str(tmp_path / "csv"), ["n"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert ("total", "3.50") in [tuple(r) for r in rows] and len(rows) == 4
    kb = spark.createDataFrame([(1, "a"), (2, "b")], "kb_id int, x string")
    sinks.rebuild_snapshot(kb, str(tmp_path / "snap"))
    sinks.rebuild_snapshot(kb.where("kb_id = 2").withColumn("x", F.lit("c")), str(tmp_path / "snap"))
    assert sorted((r.kb_id, r.x) for r in sinks.read_snapshot(spark, str(tmp_path / "snap"), "x string, kb_id int").collect()) == [(1, "a"), (2, "c")]
    means = sinks.report(spark.createDataFrame([(0.5,), (float("nan"),), (1.0,)], "m double"), str(tmp_path / "r"), ["m"])
    assert means.first().m == 0.75


def _event(key, action, sha, offset, v=1):
    return json.dumps({"v": v, "action": action, "kbId": 1, "docLogicalKey": key, "contentSha256": sha, "offset": offset})


def test_ingest_stream(spark, tmp_path):
    source, root, marks = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "marks")
    source.mkdir()
    (source / "1.json").write_text("\n".join([_event("a", "UPSERT", "x", 1), _event("b", "UPSERT", "y", 2), _event("a", "UPSERT", "z", 3), _event("q", "UPSERT", "y", 4, v=2), _event("", "UPSERT", "y", 5)]))
    ingest.start_ingest(spark, str(source), root, marks).awaitTermination()
    (source / "2.json").write_text("\n".join([_event("b", "DELETE", None, 6), _event("c", "UPSERT", "w", 7)]))
    ingest.start_ingest(spark, str(source), root, marks).awaitTermination()
    registry = ingest.Registry(spark, root)
    assert sorted(r.reason for r in registry.dead().collect()) == ["no key", "unknown version"]
    assert sorted((r.doc_key, r.content_sha256) for r in registry.read().collect()) == [("a", "z"), ("c", "w")]


def test_debounced_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, at(0)), (1, at(2)), (1, at(10)), (2, at(1)), (3, at(500))]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = ingest.debounced(stream, F.col("k"), "ts", 180, "1 minute")
    run = out.writeStream.format("memory").queryName("debounced").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.key, r.n) for r in spark.table("debounced").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    batch = ingest.islands(df, ["k"], "ts", 180).where("k < 3")
    assert sorted((r.k, r.n) for r in batch.collect()) == got


def test_session_memory_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, k, 1000 * k) for k in range(10)] + [(2, 0, 5), (2, 1, 900_000)], "session long, seq long, at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = ingest.session_memory(stream, 4, 60_000).writeStream.format("memory").queryName("sessions").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("sessions").collect())) == [(1, 9, 4), (2, 1, 1)]


def test_catalogue_scan(spark):
    spark.range(1).createOrReplaceTempView("some_table")
    assert [(r.column, r.type) for r in files.tables(spark, "some_t*").collect()] == [("id", "bigint")]
