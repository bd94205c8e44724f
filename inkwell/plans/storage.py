"""Sources and sinks: each query writes files to a folder that all executors share, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.numbers import exact
from inkwell.operators import graph as G
from inkwell.operators import relational as R
from inkwell.plans.base import Catalogue
from inkwell.session import checkpointed, discard, scratch
from inkwell.sources import files, office, sinks
from inkwell.sources.state import KeyedState
from inkwell.streaming import ingest

catalogue = Catalogue()
query = catalogue.query
_NATIONS = "n_nationkey, n_name, n_regionkey"
#: Files of one folder, on average, where a query writes one for each row.
FILES_OF_FOLDER = 2000


def _ordered(t) -> DataFrame:
    return t("nation").repartition(1, "n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")


@query("""select 'txt' as suffix, string_agg(n_name, chr(10) order by n_nationkey) || chr(10) as content,
sha256(string_agg(n_name, chr(10) order by n_nationkey) || chr(10)) as content_sha256, true as readable from nation group by n_regionkey""")
def text_scan(t):
    """A file for each region."""
    rows = _ordered(t)
    path = scratch(rows.sparkSession)
    rows.select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    return files.documents(rows.sparkSession, path).drop("source_name")


@query("select string_agg(n_nationkey || chr(9) || n_name || ', x', chr(10) order by n_nationkey) as content from nation group by n_regionkey")
def csv_scan(t):
    """Trimmed cells, one with a comma in quotes."""
    rows = _ordered(t)
    path = scratch(rows.sparkSession)
    cells = rows.select("n_regionkey", "n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(", x ")).alias("name"))
    cells.write.partitionBy("n_regionkey").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.csv_documents(rows.sparkSession, path).select("content")


@query("""with said as (select doc_id, [trim(x) for x in string_split(coalesce(text, ''), chr(10)) if trim(x) <> ''] as lines,
coalesce(source, '') || chr(9) || coalesce(lang, '') as line from documents)
select doc_id || '.docx' as source_name, array_to_string(list_append(lines, line), chr(10) || chr(10)) as content, true as readable from said""")
def docx_scan(t):
    """S3: a file for each document; its paragraphs first, then the rows of its table.  Tasks list the folders, some thousand files each."""
    rows = t("documents")
    path = scratch(rows.sparkSession)
    cells = F.array(F.array("source", "lang"))
    written = rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), office.docx(F.split("text", "\n"), cells).alias("content"))
    office.write_files(written, path, 1 + rows.count() // FILES_OF_FOLDER)
    return files.documents(rows.sparkSession, path).select("source_name", "content", "readable")


@query("""select o_orderkey, o_custkey::int as o_custkey, o_orderstatus, o_totalprice::decimal(12,2) as o_totalprice, date_trunc('second', o_orderdate)::timestamp as o_orderdate, o_orderpriority,
null::varchar as o_comment from orders""")
def spreadsheet_import(t):
    """S15, 2.12: typed rows of workbooks, by declared types; titles map to columns, one that no sheet has gives nulls."""
    rows = t("orders")
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    fields = [
        office.Field("o_orderkey", "Order", "bigint(20)", number=True),
        office.Field("o_custkey", "Customer", "int(10)", number=True),
        office.Field("o_orderstatus", "Status", "char(1)", labels="F=done,O=open,P=part"),
        office.Field("o_totalprice", "Price", "decimal(12,2)", number=True),
        office.Field("o_orderdate", "Ordered", "datetime", pattern="yyyy-MM-dd HH:mm:ss"),
        office.Field("o_orderpriority", "Priority", "varchar(15)"),
    ]
    office.export_workbooks(rows, path, fields, ["o_orderkey"], title="Orders", name="orders")
    found = office.read_workbooks(spark, path, [*fields, office.Field("o_comment", "Comment", "varchar(79)")], "orders", 1)
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("select text as question, role as ground_truth, null::varchar as source from conversations where text is not null")
def jsonl_dataset(t):
    """S9"""
    rows = t("conversations")
    path = scratch(rows.sparkSession)
    rows.select(F.col("text").alias("question"), F.col("role").alias("ground_truth")).write.json(path)
    return files.dataset(rows.sparkSession, path)


@query("""select conv_id, max(turn) as turn from conversations group by 1""")
def checkpoint_scan(t):
    """Three appended batches and a half-written line; the last line of each key counts."""
    rows = t("conversations").select("conv_id", "turn")
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    files.append(rows.where("turn < 0").union(rows.groupBy("conv_id").agg((F.min("turn") - 1).alias("turn"))).coalesce(1), path)
    rows.limit(1).select(F.lit('{"conv_id": 1, "tu').alias("value")).write.mode("append").text(path)
    files.append(rows.coalesce(1).sortWithinPartitions("turn"), path)
    return files.checkpoint(spark, path, "conv_id long, turn long", "conv_id")


@query("""select * from (values ('inkwell_nation', 'n_nationkey', 0), ('inkwell_nation', 'n_name', 1), ('inkwell_nation', 'n_regionkey', 2)) as v("table", "column", "position")""")
def catalog_scan(t):
    """S16"""
    rows = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    rows.createOrReplaceTempView("inkwell_nation")
    rows.createOrReplaceTempView("gen_inkwell_nation")
    return files.tables(rows.sparkSession, "*inkwell_nation").select("table", "column", "position")


@query("select vec_id, label from embeddings where label = 3 and vec_id >= 100")
def vector_scroll(t):
    """A filtered scan of a vector table that reads no vectors."""
    return t("embeddings").where("label = 3 and vec_id >= 100").select("vec_id", "label")


@query("select c_custkey, c_name from customer where c_custkey > 40 order by c_custkey limit 25")
def graph_scan_page(t):
    """The page behind the last key of the one before."""
    rows, _ = R.page(t("customer").where("c_custkey > 40").select("c_custkey", "c_name"), [F.asc("c_custkey")], 1, 25)
    return rows


_EVENTS = """ev as (select event_id as off, (user_id % 3)::bigint as kb, 'doc' || user_id % 20 as k, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as action,
'h' || value::int as sha from events)"""


def _events(t) -> DataFrame:
    return t("events").select(
        F.lit(1).alias("v"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("action"), (F.col("user_id") % 3).alias("kbId"),
        F.concat(F.lit("doc"), (F.col("user_id") % 20).cast("string")).alias("docLogicalKey"),
        F.concat(F.lit("h"), F.round("value").cast("int").cast("string")).alias("contentSha256"), F.col("event_id").alias("offset"),
    )


@query(f"""with {_EVENTS.replace("value::int", "round(value)::int")} select kb || ':' || k as key, '{{"v":1,"action":"' || action || '","kbId":' || kb || ',"docLogicalKey":"' || k || '","contentSha256":"' || sha || '","offset":' || off || '}}' as value,
'docs' as topic from ev""")
def produce_events(t):
    """Keyed events of a topic."""
    events = _events(t)
    path = scratch(events.sparkSession)
    sinks.produce(events, path, "docs")
    return events.sparkSession.read.schema("key string, value string, topic string").json(path)


@query(f"""with {_EVENTS.replace("value::int", "round(value)::int")}, last as (select kb, k, arg_max(action, off) as action, arg_max(sha, off) as sha from ev group by 1, 2)
select kb as kb_id, k as doc_key, sha as content_sha256 from last where action = 'UPSERT'""")
def ingest_stream(t):
    """A stream over two batches of files keeps a registry's versions."""
    events = _events(t)
    spark, folder = events.sparkSession, scratch(events.sparkSession)
    for part in ("offset % 3 = 0", "offset % 3 != 0"):
        events.where(part).coalesce(1).write.mode("append").json(f"{folder}/in")
        ingest.start_ingest(spark, f"{folder}/in", f"{folder}/state", f"{folder}/progress").awaitTermination()
    return ingest.Registry(spark, f"{folder}/state").read()


_TRIED = f"""{_EVENTS.replace("value::int", "round(value)::int")}, tried as (select *, off % 50 = 7 as fails, off % 4 + 1 as tries, off % 101 = 0 as broken, off % 103 = 0 as keyless from ev),
out as (select *, case when broken then 'malformed' when keyless then 'no key' when fails and tries > 3 then 'store is down' end as reason,
  case when broken or keyless then 1 when fails then least(tries, 3) else 1 end as attempts from tried),
left_over as (select kb, k, arg_max(action, off) as action, arg_max(sha, off) as sha from out where reason is null group by 1, 2)"""


@query(f"""with {_TRIED} select 'dead' as kind, reason as what, attempts, count(*) as n from out where reason is not null group by all union all
select 'kept', sha, 0, count(*) from left_over where action = 'UPSERT' group by sha""")
def ingest_retries(t):
    """M1: events that fail are tried again, up to three times, before they are given up; malformed ones are given up at once."""
    events = _events(t)
    spark, folder = events.sparkSession, scratch(events.sparkSession)
    k = F.col("offset")
    line = F.to_json(F.struct("v", "action", "kbId", F.when(k % 103 == 0, " ").otherwise(F.col("docLogicalKey")).alias("docLogicalKey"), "contentSha256", "offset"))
    lines = events.select(F.when(k % 101 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("line"))

    def work(rows):
        """An event fails as often as its offset says, less one."""
        fails = (F.col("offset") % 50 == 7) & (F.col("attempts") < F.col("offset") % 4)
        return F.when(fails, "store is down")

    registry = ingest.Registry(spark, folder, work)
    registry.apply(lines, 0)
    registry.apply(lines, 0)  # again, as after a failure: nothing happens
    for number in (1, 2):
        registry.apply(lines.where("false"), number)
    dead = registry.dead().groupBy(F.lit("dead").alias("kind"), F.col("reason").alias("what"), "attempts").agg(F.count("*").alias("n"))
    kept = registry.read().groupBy(F.lit("kept").alias("kind"), F.col("content_sha256").alias("what"), F.lit(0).alias("attempts")).agg(F.count("*").alias("n"))
    return dead.union(kept)


@query("""select c_custkey, case when c_custkey % 5 = 0 then 'new ' || c_name else c_name end as name from customer where c_custkey % 7 <> 3 or c_custkey % 5 = 0""")
def keyed_state(t):
    """K1, K2, K3: base and deltas; changes that set and delete, and the compaction of what they touched."""
    rows = t("customer").select("c_custkey", F.col("c_name").alias("name"))
    spark = rows.sparkSession
    state = KeyedState(spark, scratch(spark), "c_custkey long, name string", ["c_custkey"], most=2)
    state.apply(rows.withColumn("gone", F.lit(False)), 0)
    state.apply(rows.where("c_custkey % 7 = 3").withColumn("gone", F.lit(True)), 1)
    new = rows.where("c_custkey % 5 = 0").withColumn("name", F.concat(F.lit("new "), "name")).withColumn("gone", F.lit(False))
    state.apply(new, 2)
    state.apply(new, 2)
    return state.read()


@query("""select n_regionkey as kb_id, n_nationkey, case when n_regionkey = 2 then 'new' else n_name end as name from nation where n_regionkey not in (1, 3)""")
def snapshot_rebuild(t):
    """K6, K9: one container is rebuilt, one is rebuilt with no rows, one is purged, others stay."""
    rows = t("nation").select(F.col("n_regionkey").alias("kb_id"), "n_nationkey", F.col("n_name").alias("name"))
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    sinks.rebuild_snapshot(rows, path)
    sinks.rebuild_snapshot(rows.where("kb_id = 2").withColumn("name", F.lit("new")), path, containers=[2, 3])
    sinks.purge_container(spark, path, 1)
    return sinks.read_snapshot(spark, path, rows.select("n_nationkey", "name", "kb_id").schema.simpleString()[7:-1].replace(":", " "))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def truncate_table(t):
    """A table is emptied in one commit; rows written after that are all it has."""
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    sinks.rebuild_snapshot(rows, path, "o_orderstatus")
    sinks.truncate(spark, path)
    sinks.rebuild_snapshot(rows.where("o_orderstatus = 'F'"), path, "o_orderstatus")
    return sinks.read_snapshot(spark, path, "o_orderkey long, o_orderstatus string")


_GRAPH = """raw as (select o_orderkey % 4 as kb_id, c_name as head, o_orderstatus as relation, n_name as tail from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
edges as (select *, count(*) as n_chunks from raw where kb_id <> 2 and (kb_id <> 1 or relation = 'F') group by all),
ends as (select kb_id, head as name, 1 as o, 0 as i from edges union all select kb_id, tail, 0, 1 from edges)"""


@query(f"""with {_GRAPH} select kb_id, name, null::varchar as relation, null::varchar as tail, sum(o)::bigint as outward, sum(i)::bigint as inward, null::bigint as n_chunks from ends group by kb_id, name
union all select kb_id, head, relation, tail, null, null, n_chunks from edges""")
def graph_snapshot(t):
    """A graph's entities with their degrees and its edges, in one commit; one base is synced again, one is dropped."""
    c, n = t("customer"), t("nation")
    rows = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select((F.col("o_orderkey") % 4).alias("kb_id"), F.col("c_name").alias("head"), F.col("o_orderstatus").alias("relation"), F.col("n_name").alias("tail"))
    spark, path = rows.sparkSession, scratch(rows.sparkSession)

    def sync(raw, containers=None):
        edges = checkpointed(raw.groupBy("kb_id", *G.KEY).agg(F.count("*").alias("n_chunks")))
        sinks.rebuild_tables({"entities": G.degrees(edges, by=["kb_id"]), "edges": edges}, path, "kb_id", containers)
        discard(edges)

    sync(rows)
    sync(rows.where("kb_id = 1 and relation = 'F'"), [1])
    sinks.purge_container(spark, path, 2)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    entities = sinks.read_snapshot(spark, path, "kb_id long, name string, out_degree long, in_degree long", "entities")
    edges = sinks.read_snapshot(spark, path, "kb_id long, head string, relation string, tail string, n_chunks long", "edges")
    entities = entities.select("kb_id", "name", none("string", "relation"), none("string", "tail"), F.col("out_degree").alias("outward"), F.col("in_degree").alias("inward"), none("long", "n_chunks"))
    return entities.union(edges.select("kb_id", "head", "relation", "tail", none("long", "o"), none("long", "i"), "n_chunks"))


@query("""select c_custkey::varchar as c_custkey, c_name, printf('%.2f', c_acctbal) as c_acctbal from customer
union all select 'total', null, sum(c_acctbal::decimal(30,2))::varchar from customer""")
def csv_export(t):
    """Sheets of at most 500 rows, a row of totals behind them."""
    rows = t("customer").select("c_custkey", "c_name", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"))
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    sinks.export_csv(rows, path, ["c_acctbal"], 500)
    return spark.read.schema("c_custkey string, c_name string, c_acctbal string").option("header", True).csv(path)


@query("""with c as (select *, round(c_acctbal * 100)::bigint as cents from customer),
r as (select *, abs(cents) // 10 + case when abs(cents) % 10 > 5 or (abs(cents) % 10 = 5 and abs(cents) // 10 % 2 = 1) then 1 else 0 end as tenths from c),
total as (select sum(cents)::bigint as n from c)
select c_custkey::varchar as "Key", case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else '' end as "Segment",
case when c_acctbal < 0 then chr(9) else '' end || c_acctbal::varchar || ' u' as "Balance",
case when cents < 0 and tenths > 0 then '-' else '' end || tenths // 10 || case when tenths % 10 = 0 then '' else '.' || tenths % 10 end as "Rounded",
case when c_nationkey % 5 = 0 then 'none' else c_nationkey::varchar end as "Nation", upper(left(c_name, 3)) || '<&>' as "Name" from r
union all select '合计', '', regexp_replace(regexp_replace(case when n < 0 then '-' else '' end || abs(n) // 100 || '.' || lpad((abs(n) % 100)::varchar, 2, '0'), '0+$', ''), '[.]$', ''), '', '', '' from total""")
def spreadsheet_export(t):
    """K19, 2.14: cells by each column's rules, sheets of at most 500 rows, a row of totals behind the last."""
    rows = t("customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", exact(F.col("c_acctbal")).cast("decimal(12,2)").alias("rounded"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("nation"), "c_name",
    )
    path = scratch(rows.sparkSession)
    fields = [
        office.Field("c_custkey", "Key", number=True),
        office.Field("c_mktsegment", "Segment", labels="BUILDING=b,MACHINERY=m"),
        office.Field("c_acctbal", "Balance", suffix=" u", total=True),
        office.Field("rounded", "Rounded", scale=1),
        office.Field("nation", "Nation", default="none"),
        office.Field("c_name", "Name", handler=lambda name: F.concat(F.upper(F.left(name, F.lit(3))), F.lit("<&>"))),
    ]
    office.export_workbooks(rows, path, fields, ["c_custkey"], 500)
    return files.spreadsheet_rows(rows.sparkSession, path, {f.title: f.title for f in fields})


@query("select round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from labels")
def eval_report(t):
    """The rows and their means; NaN doesn't count."""
    rows = t("labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    rows = rows.union(rows.limit(1).select(F.lit(-1).cast("long"), F.lit(float("nan")), F.lit(None).cast("double")))
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    sinks.report(rows, path, ["quality", "toxic"])
    return spark.read.schema("quality double, toxic double").json(f"{path}/summary")


@query("""select p_partkey as card_id, case when p_partkey % 3 = 0 then 'new ' || p_name else p_name end as text from part where p_partkey % 5 <> 0 or p_partkey % 3 = 0""")
def card_upsert(t):
    """Known cards get a new text, unknown ones are added."""
    rows = t("part").select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("text"))
    new = rows.where("card_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return R.upsert(rows.where("card_id % 5 != 0"), new, ["card_id"])


@query("""select doc_id, source, [length(text) / 1000.0, length(replace(text, ' ', '')) / 1000.0] as embedding from documents""")
def re_embed(t):
    """Keys and payload stay, vectors are computed anew by another embedder."""
    return sinks.re_embed(
        t("documents").select("doc_id", "source", "text", F.array(F.lit(0.0)).alias("embedding")), "text",
        lambda text: F.array(F.length(text) / 1000.0, F.length(F.replace(text, F.lit(" "), F.lit(""))) / 1000.0),
    ).drop("text")
