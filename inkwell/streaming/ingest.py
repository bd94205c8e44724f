"""Message-driven processing: document events, debouncing, sessions, rate limits, work queues.

Streams read files of JSON events; a Kafka topic with the same columns takes their place where the
connector is installed.  Each has a batch form with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators.relational import remove, upsert
from inkwell.session import checkpointed, discard
from inkwell.sources.state import KeyedState

EVENT = "v int, action string, kbId long, docLogicalKey string, contentSha256 string, offset long"
REGISTRY = "kb_id long, doc_key string, content_sha256 string"
#: Seconds of quiet before a changed container is synchronised.
QUIET = 180
#: Events that a task of a stream takes at once.
EVENTS_OF_TASK = 500_000


def valid_events(events: DataFrame) -> DataFrame:
    """kb_id, doc_key, action, content_sha256, offset of events of version 1 with a key and a known action."""
    return events.where("v = 1 and trim(docLogicalKey) != '' and action in ('UPSERT', 'DELETE')").select(
        F.col("kbId").alias("kb_id"), F.col("docLogicalKey").alias("doc_key"), "action", F.col("contentSha256").alias("content_sha256"), "offset"
    )


def last_per_key(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last event of each key; summed up before the shuffle, so a hot key costs a row for each task."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__e")).select(*key, "__e.*")


def apply_events(registry: DataFrame, events: DataFrame) -> DataFrame:
    """The registry (kb_id, doc_key, content_sha256) after a batch of raw events; unchanged content changes nothing."""
    last = last_per_key(valid_events(events), ["kb_id", "doc_key"], "offset")
    keys = ["kb_id", "doc_key"]
    left = remove(registry, last.where("action = 'DELETE'"), keys)
    return upsert(left, last.where("action = 'UPSERT'").select(*registry.columns), keys)


#: Times that an event is tried before it is given up.
ATTEMPTS = 3
DEAD = "line string, reason string, attempts int"
_PENDING = "line string, attempts int"


def judged(lines: DataFrame) -> DataFrame:
    """line, attempts, e (the event), reason: why a line can't be applied, null if it can be."""
    parsed = lines.withColumn("e", F.from_json("line", EVENT, {"mode": "PERMISSIVE"}))
    e = F.col("e")
    reason = (
        F.when(F.get_json_object("line", "$").isNull(), "malformed")
        .when(e["v"].isNull() | (e["v"] != 1), "unknown version")
        .when(F.coalesce(F.trim(e["docLogicalKey"]), F.lit("")) == "", "no key")
        .when(~F.coalesce(e["action"].isin("UPSERT", "DELETE"), F.lit(False)), "unknown action")
    )
    return parsed.withColumn("reason", reason)


class Registry:
    """The documents' registry in folder ``root``, its events that wait to be tried again, and those given up.

    A batch of lines is one commit: the registry's delta (its bytes follow the batch), the events that failed so far
    with their attempts, and the ones that are malformed, invalid or failed ``attempts`` times, with the reason.
    ``work`` maps events (the columns of EVENT, attempts) to a column that says why an event failed, null if it
    didn't.  A later event of the same key overtakes one that waits.
    """

    def __init__(self, spark: SparkSession, root: str, work: Callable[[DataFrame], Column] | None = None, attempts: int = ATTEMPTS) -> None:
        self.spark, self.work, self.attempts = spark, work, attempts
        self.state = KeyedState(spark, f"{root}/registry", f"{REGISTRY}, offset long", ["kb_id", "doc_key"])

    def read(self) -> DataFrame:
        return self.state.read().drop("offset")

    def _table(self, names: list[str], schema: str) -> DataFrame:
        paths = [self.state.commits.path(n) for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def dead(self) -> DataFrame:
        """line, reason, attempts of the events that were given up."""
        return self._table(self.state.commits.latest()[1].get("dead", []), DEAD)

    def waiting(self) -> DataFrame:
        """line, attempts of the events that are tried again with the next batch."""
        return self._table(self.state.commits.latest()[1].get("pending", []), _PENDING)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Applies lines (line) as change ``number``."""
        commits = self.state.commits
        content = commits.latest()[1]
        if number <= content.get("number", -1):
            return
        lines = batch.select("line", F.lit(0).alias("attempts")).union(self.waiting())
        rows = judged(lines.where("trim(line) != ''"))
        if self.work is not None:
            failure = self.work(rows.select("e.*", "attempts", "reason"))
            failed = rows.select("line", "attempts", "e", "reason", "e.*").withColumn("failure", F.when(F.col("reason").isNull(), failure))
            rows = failed.select("line", "attempts", "e", "reason", "failure")
        else:
            rows = rows.withColumn("failure", F.lit(None).cast("string"))
        rows = checkpointed(rows.withColumn("attempts", F.col("attempts") + 1))
        # What was applied already with a higher offset isn't undone by an event that had to wait.
        good = rows.where("reason is null and failure is null").select("e.*")
        last = last_per_key(valid_events(good), ["kb_id", "doc_key"], "offset")
        known = self.state._latest(content)
        if known is not None:
            newer = known.select(F.col("kb_id").alias("k"), F.col("doc_key").alias("d"), F.col("offset").alias("o"))
            last = last.join(newer, (F.col("kb_id") == F.col("k")) & (F.col("doc_key") == F.col("d")) & (F.col("offset") < F.col("o")), "left_anti")
        over = F.col("attempts") >= self.attempts
        dead = rows.where("reason is not null or failure is not null").where(F.col("reason").isNotNull() | over)
        dead = dead.select("line", F.coalesce("reason", "failure").alias("reason"), "attempts")
        waiting = rows.where(F.col("reason").isNull() & F.col("failure").isNotNull() & ~over).select("line", "attempts")
        beside = {"dead": [*content.get("dead", []), commits.new_folder("dead")], "pending": [commits.new_folder("pending")]}
        dead.write.parquet(commits.path(beside["dead"][-1]))
        waiting.write.parquet(commits.path(beside["pending"][0]))
        changes = last.select("kb_id", "doc_key", "content_sha256", "offset", (F.col("action") == "DELETE").alias("gone"))
        self.state.apply(changes, number, beside=beside)
        discard(rows)


def start_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, work: Callable[[DataFrame], Column] | None = None) -> StreamingQuery:
    """Reads the lines that are new under ``source`` and keeps the registry under ``root``; see ``Registry``."""
    registry = Registry(spark, root, work)
    lines = spark.readStream.text(source).withColumnRenamed("value", "line")
    return lines.writeStream.foreachBatch(registry.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def islands(events: DataFrame, by: list[str], at: str, quiet: int = QUIET) -> DataFrame:
    """by, started, ended, n, fires: runs of events with no longer pause than ``quiet`` seconds; each fires once after it."""
    order = Window.partitionBy(*by).orderBy(at)
    begins = F.coalesce(F.col(at) > F.lag(at).over(order) + F.expr(f"interval {quiet} seconds"), F.lit(True))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("__b", begins.cast("int")).withColumn("__k", F.sum("__b").over(so_far))
    found = numbered.groupBy(*by, "__k").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
    return found.select(*by, "started", "ended", "n", (F.col("ended") + F.expr(f"interval {quiet} seconds")).alias("fires"))


def debounced(events: DataFrame, by: Column, at: str, quiet: int = QUIET, late: str = "1 hour") -> DataFrame:
    """The same on a stream with session windows: a row when the watermark has passed a run's quiet time."""
    timed = events.withWatermark(at, late)
    return timed.groupBy(F.session_window(at, f"{quiet} seconds").alias("w"), by.alias("key")).agg(F.count("*").alias("n")).select(
        "key", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n"
    )


def rate_limited(events: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """key, order column, nth, allowed: hits within windows that begin with a key's first hit after the last window.

    Every hit points at the first one that a window begun by it leaves out.  That one lies in the next stretch of
    ``seconds`` of its key, or is the first behind it, so the pointers need only windows over (key, stretch).  The
    starts of windows are the hits that a key's first one reaches; they are marked by doubling: after the pointers of
    2^k windows have been followed, the first 2^(k+1) starts are known, all of them new ones.  A stretch has one start at
    most, so the key with most stretches tells how often to double; no key is one task's work.
    """
    width = seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("id"))
    rows = rows.where("key is not null and at is not null and id is not null")
    rows = rows.withColumn("cell", F.floor(F.col("at") / width))
    # Only the first hit at each moment can begin a window.
    moments = checkpointed(rows.groupBy("key", "cell", "at").agg(F.min("id").alias("id")))
    firsts = moments.groupBy("key", "cell").agg(F.min("at").alias("first"))
    later = Window.partitionBy("key").orderBy("cell")  # a row for each stretch that has hits
    firsts = firsts.select(
        "key", "cell", "first", F.lead("first").over(later).alias("then"), F.lead("cell").over(later).alias("then_cell"), F.row_number().over(later).alias("nth")
    )
    firsts = checkpointed(firsts)
    longest = firsts.agg(F.max("nth")).head()[0] or 1
    targets = moments.select("key", (F.col("cell") + 1).alias("cell"), (F.col("at") + width).alias("at"), F.col("at").alias("of"))
    both = targets.union(moments.select("key", "cell", "at", F.lit(None).cast("long")))
    ahead = Window.partitionBy("key", "cell").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    met = both.withColumn("next", F.min(F.when(F.col("of").isNull(), F.col("at"))).over(ahead)).where("of is not null")
    # Without a hit in the next stretch, behind the moment, it is the first one of a later stretch.
    own = firsts.select("key", F.col("cell").alias("c"), F.col("then").alias("t1"), F.col("then_cell").alias("c1"))
    after = firsts.select("key", F.col("cell").alias("c2"), F.col("then").alias("t2"))
    met = met.withColumn("c", F.col("cell") - 1).join(own, ["key", "c"], "left").join(after.withColumnRenamed("c2", "cell"), ["key", "cell"], "left")
    beyond = F.when(F.col("c1") > F.col("cell"), F.col("t1")).otherwise(F.col("t2"))
    jump = checkpointed(met.select("key", F.col("of").alias("at"), F.coalesce("next", beyond).alias("next")).where("next is not null"))
    starts = firsts.where("nth = 1").select("key", F.col("first").alias("at"))
    known = 1
    while known < longest:
        starts = starts.union(_followed(starts, jump))
        if 2 * known < longest:
            twice = checkpointed(_longer(jump))
            starts = starts.union(_followed(starts, twice))
            jump = checkpointed(_longer(twice)) if 4 * known < longest else twice
        starts, known = checkpointed(starts), 4 * known
    begun = starts.select("key", F.floor(F.col("at") / width).alias("cell"), F.col("at").alias("begin"))
    mine = begun.withColumnRenamed("begin", "b0")
    last = begun.select("key", (F.col("cell") + 1).alias("cell"), F.col("begin").alias("b1"))
    placed = rows.join(mine, ["key", "cell"], "left").join(last, ["key", "cell"], "left")
    begin = F.when(F.col("b0") <= F.col("at"), F.col("b0")).otherwise(F.col("b1"))
    nth = F.row_number().over(Window.partitionBy("key", "begin").orderBy("at", "id")).cast("long")
    found = placed.withColumn("begin", begin).withColumn("nth", nth)
    return found.select(F.col("key").alias(key), F.col("id").alias(order), "nth", (F.col("nth") <= most).alias("allowed"))


def _followed(starts: DataFrame, jump: DataFrame) -> DataFrame:
    """Where pointers lead from some moments (key, at)."""
    return starts.join(jump, ["key", "at"]).select("key", F.col("next").alias("at"))


def _longer(jump: DataFrame) -> DataFrame:
    """Pointers (key, at, next) followed twice."""
    return jump.join(jump.select("key", F.col("at").alias("next"), F.col("next").alias("far")), ["key", "next"]).select("key", "at", F.col("far").alias("next"))


def last_messages(turns: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last ``most`` turns of every session."""
    back = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= most).drop("__n")


def session_titles(turns: DataFrame, by: str, order: str, role: str, text: str, untitled: str = "新会话") -> DataFrame:
    """by, title: the last user message cut to 20 characters, or ``untitled``."""
    said = F.max_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order)))
    short = F.when(F.length("said") > 20, F.concat(F.substring("said", 1, 20), F.lit("..."))).otherwise(F.col("said"))
    found = turns.groupBy(by).agg(said.alias("said"))
    return found.select(by, F.coalesce(F.when(F.trim("said") != "", short), F.lit(untitled)).alias("title"))


def session_memory(turns: DataFrame, most: int, ttl_ms: int) -> DataFrame:
    """Stream of turns (session, seq, at in milliseconds) into (session, newest, kept): the turns held after each batch.

    A turn that comes more than ``ttl_ms`` after the session's last one begins anew; a session that the watermark is
    that far beyond is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else ([], 0)
        held = list(held)
        for frame in frames:
            for seq, at in sorted(zip(frame["seq"].tolist(), frame["at"].tolist())):
                held = (held if at - last <= ttl_ms else [])[1 - most :] + [seq]
                last = at
        state.update((held, last))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": [key[0]], "newest": [held[-1]], "kept": [len(held)]})

    timed = turns.withColumn("__at", F.timestamp_millis("at")).withWatermark("__at", f"{ttl_ms} milliseconds")
    return timed.groupBy("session").applyInPandasWithState(
        step, "session long, newest long, kept long", "seqs array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def newly_queued(pending: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Distinct asked keys that aren't pending."""
    return asked.select(*key).distinct().join(pending.select(*key).distinct(), key, "left_anti")
