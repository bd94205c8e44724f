"""Message-driven and evaluation queries over events, conversations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import evaluation as E

from inkwell.operators.model_tasks import json_tasks as json_tasks_of
from inkwell.plans.base import Catalogue
from inkwell.plans.retrieval import VECTOR_SQL, _vector_hits
from inkwell.session import scratch
from inkwell.streaming import ingest

catalogue = Catalogue()
query = catalogue.query


@query("""select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by all""")
def last_writer(t):
    """M5"""
    rows = t("events").select("user_id", "event_type", "value", "event_id")
    return ingest.last_per_key(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@query("""with b as (select user_id, ts, case when ts > lag(ts) over w + interval 3600 seconds or lag(ts) over w is null then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
k as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from b)
select user_id, min(ts) as started, max(ts) as ended, count(*) as n, max(ts) + interval 3600 seconds as fires from k group by user_id, k""")
def debounce_islands(t):
    """M6"""
    return ingest.islands(t("events").select("user_id", "ts"), ["user_id"], "ts", 3600)


@query("""with recursive w(user_id, s) as (select user_id, min(ts) from events group by 1 union all
select w.user_id, min(e.ts) from w join events e on e.user_id = w.user_id and e.ts >= w.s + interval 24 hours group by w.user_id, w.s),
hits as (select e.user_id, e.event_id, max(w.s) as s, e.ts from events e join w on w.user_id = e.user_id and w.s <= e.ts group by all)
select user_id, event_id, row_number() over (partition by user_id, s order by ts, event_id) as nth,
row_number() over (partition by user_id, s order by ts, event_id) <= 3 as allowed from hits""")
def first_hit_rate_limit(t):
    """Windows begin with a key's first hit, not with the clock."""
    return ingest.rate_limited(t("events"), "user_id", "ts", "event_id", 86_400, 3)


@query("""with e as (select event_id as "offset", user_id % 3 as kb_id, 'd' || user_id as doc_key, case when event_id % 7 = 0 then 'DELETE' when event_id % 11 = 0 then 'NOP' else 'UPSERT' end as action,
sha256(event_type) as h, case when event_id % 13 = 0 then 2 else 1 end as v from events),
last as (select kb_id, doc_key, arg_max(action, "offset") as action, arg_max(h, "offset") as h from e where v = 1 and action <> 'NOP' group by 1, 2)
select kb_id, doc_key, h as content_sha256 from last where action = 'UPSERT'""")
def ingest_registry(t):
    """The registry after all events, starting from nothing."""
    k = F.col("event_id")
    action = F.when(k % 7 == 0, "DELETE").when(k % 11 == 0, "NOP").otherwise("UPSERT")
    events = t("events").select(
        F.when(k % 13 == 0, 2).otherwise(1).alias("v"), action.alias("action"), (F.col("user_id") % 3).alias("kbId"),
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("docLogicalKey"), F.sha2("event_type", 256).alias("contentSha256"), k.alias("offset"),
    )
    empty = events.sparkSession.createDataFrame([], ingest.REGISTRY)
    return ingest.apply_events(empty, events)


@query("""select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3""")
def last_n_messages(t):
    """W6, W7, M8"""
    return ingest.last_messages(t("conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("""with u as (select conv_id, arg_max(text, turn) as said from conversations where role = 'user' group by 1)
select c.conv_id, case when said is null or trim(said) = '' then '新会话' when length(said) > 20 then substr(said, 1, 20) || '...' else said end as title
from (select distinct conv_id from conversations) c left join u using (conv_id)""")
def session_titles(t):
    """W8"""
    return ingest.session_titles(t("conversations"), "conv_id", "turn", "role", "text")


@query("""select distinct user_id, event_type from events where value > 50 and (user_id, event_type) not in (select (user_id, event_type) from events where value > 99)""")
def newly_queued(t):
    """M7"""
    return ingest.newly_queued(t("events").where("value > 99"), t("events").where("value > 50"), ["user_id", "event_type"])


@query("""select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def event_windows(t):
    """Extension: tumbling windows over the stream's table."""
    rows = t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query(f"""with {VECTOR_SQL}, r as (select query_id, rank, q.label = i.label as same from vec join embeddings q on q.vec_id = query_id join embeddings i on i.vec_id = item_id where rank <= 10)
select query_id, round(count(*) filter (where same) / 10, 6) as precision, round(coalesce(1.0 / min(rank) filter (where same), 0), 6)::double as reciprocal_rank from r group by 1""")
def precision_at_k(t):
    """Labels of the vectors stand for relevance."""
    label = t("embeddings").select(F.col("vec_id").alias("item_id"), "label")
    asked = label.select(F.col("item_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = _vector_hits(t).join(label, "item_id").join(asked, "query_id")
    return E.precision_at_k(hits, "query_id", "rank", F.col("label") == F.col("wanted"), 10)


@query("""with p as (select *, lag(event_type) over (partition by user_id order by event_id) as p from events)
select user_id, string_agg(event_type, '>' order by event_id) as sequence from p where p is null or p <> event_type group by 1""")
def folded_sequences(t):
    """E6"""
    return E.folded_sequence(t("events"), "user_id", "event_id", "event_type")


@query("""select conv_id, n::integer as n, attempt::integer as attempt, greatest(1, round_even(n * (1 - 0.35::double * (attempt - 1)), 0))::integer as kept
from (select conv_id, count(*) as n from conversations group by 1), range(1, 4) b(attempt)""")
def context_trim(t):
    """The turns of a conversation that each further attempt keeps."""
    rows = t("conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.withColumn("kept", E.trimmed_count(F.col("n"), F.col("attempt")))


@query("""with r as (select conv_id, role from conversations), runs as (select 'same' as run, conv_id as q from r union all select 'fewer', conv_id from r where role = 'user' union all select 'other', conv_id + 1 from r)
select run, run = 'same' as valid, count(*) as n from runs group by 1""")
def judged_cache(t):
    """Cached judgements hold for a run that asked the same questions as often."""
    asked = t("conversations").select(F.col("conv_id").alias("q"))
    runs = {"same": asked, "fewer": t("conversations").where("role = 'user'").select(F.col("conv_id").alias("q")), "other": asked.select((F.col("q") + 1).alias("q"))}
    out = None
    for name, run in runs.items():
        row = run.agg(F.lit(name).alias("run"), F.lit(E.same_questions(asked, run, "q")).alias("valid"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@query("""with b as (select user_id, ts, case when ts > lag(ts) over w + interval 3600 seconds or lag(ts) over w is null then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
k as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from b)
select user_id, min(ts) as started, max(ts) + interval 3600 seconds as fires, count(*) as n from k group by user_id, k""")
def debounce_stream(t):
    """M6 as a stream: each run of events of a user fires once, an hour of quiet after its last one."""
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    parts = max(1, -(-rows.count() // ingest.EVENTS_OF_TASK))
    # A moment long after all others moves the watermark over every run.
    end = rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts")
    for part in (rows.repartition(parts), end.coalesce(1)):
        part.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(f"{folder}/in")
    # Dealt once more, as Spark reads several files in one task, which holds a run for each of its events.
    fired = ingest.debounced(stream.repartition(parts), F.col("user_id"), "ts", 3600, "1 day")
    run = fired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("key >= 0").select(
        F.col("key").alias("user_id"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "fires")), "n"
    )


@query("""select conv_id as session, max(turn) as newest, least(4, count(*)) as kept from conversations where turn is not null group by 1""")
def session_memory_stream(t):
    """M8 as a stream: the last turns that a session's state holds."""
    rows = t("conversations").where("turn is not null").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (F.col("turn") * 1000 + 1_700_000_000_000).alias("at"))
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    held = ingest.session_memory(stream, 4, 3_600_000)
    run = held.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("session", "newest", F.col("kept").cast("long").alias("kept"))


@query("""select case when item_id % 7 = 3 then 'failed' else 'answered' end as outcome, case when item_id % 7 = 3 then 3 else 1 + item_id % 3 end as tries, count(*) as n,
sum(case when item_id % 7 = 3 then 0 else length(text) end)::bigint as chars from benchmark group by all""")
def json_tasks(t):
    """2.14: a model's answers as typed rows; answers that don't fit are asked for again, up to three times."""

    def answer(prompt: str, attempt: int) -> str:
        """Stands for a model: some prompts are answered at the second or third try, some never."""
        number, chars = map(int, prompt.split())
        if number % 7 == 3 or attempt <= number % 3:
            return '```json\n{"chars": "many"' if attempt % 2 else '{"other": 1}'
        return '<think>{"chars": 0}</think> Here: ```json\n{"chars": %d}\n```' % chars

    rows = t("benchmark").select("item_id", F.concat_ws(" ", F.col("item_id").cast("string"), F.length("text").cast("string")).alias("prompt"))
    found = json_tasks_of(rows, "item_id", "prompt", answer, "chars long")
    outcome = F.when(F.col("answer").isNull(), "failed").otherwise("answered").alias("outcome")
    return found.groupBy(outcome, F.col("tries").cast("long").alias("tries")).agg(F.count("*").alias("n"), F.coalesce(F.sum("answer.chars"), F.lit(0)).alias("chars"))


@query("""select item_id from benchmark where text not in (select text from documents)""")
def still_to_run(t):
    """E1, J18"""
    return E.still_to_run(t("benchmark"), t("documents").select("text"), "text").select("item_id")
