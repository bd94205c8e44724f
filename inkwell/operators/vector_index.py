"""Exact nearest neighbours by clusters: what can't hold a neighbour isn't read.

Vectors are unit vectors, and their distance is the angle between them, which obeys the triangle inequality.
An index deals all of them to the nearest of some centres (fitted on a bounded sample), sorts each
cluster by the angle to its centre and cuts it into blocks; so a block is a ring around its centre.  No vector
of a ring is nearer to a query than the query is to the ring.

A search first reads, for every query, the nearest rings until they hold ``k`` vectors; the k-th score found
there is a bound.  Then it reads the rings that may hold a better one, and no others.  Scores are cosines of 6
places and ties go by id, as in ``retrieval.vector_topk``, whose rows it returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.retrieval import ranked
from inkwell.session import checkpointed, folder_exists

#: Vectors that centres are fitted on at most, centres at most, rounds of fitting, vectors compared at a time there, vectors of a
#: block, queries packed together.
SAMPLE, MOST_CENTRES, ROUNDS, STRIPE, BLOCK, PACK = 20_000, 1024, 6, 2048, 1024, 256
_BLOCKS = "centre int, ring int, low double, high double, n int, ids array<long>, values array<double>"
#: What rounding to 6 places, and to doubles, may change of a score.
SLACK = 2e-6


def _matrix(column: pa.Array) -> np.ndarray:
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def fit_centres(sample: np.ndarray, many: int, seed: int = 3) -> np.ndarray:
    """Centres of a sample of unit vectors: rounds of assignment and mean, by the angle."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(many, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(sample[at : at + STRIPE] @ centres.T, axis=1) for at in range(0, len(sample), STRIPE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-300), centres)
    return centres


class VectorIndex:
    """Rings of all vectors, stored in the shared folder."""

    def __init__(self, blocks: DataFrame, centres: np.ndarray) -> None:
        self.blocks, self.centres = blocks, centres

    @classmethod
    def build(cls, vectors: DataFrame, item_id: str, vector: str = "embedding", block: int = BLOCK) -> VectorIndex:
        """An index of all rows with an id and a vector."""
        rows = vectors.where(F.col(item_id).isNotNull() & F.col(vector).isNotNull())
        rows = rows.select(F.col(item_id).cast("long").alias("item_id"), F.col(vector).cast("array<double>").alias("v"))
        n = rows.count()
        # The sample is bounded; what is read of it doesn't depend on how rows lie.
        # Rows whose hash is too large to be among the first are left out before the sort, which takes place in one task.
        low = rows.where(F.xxhash64("item_id") < -(1 << 63) + (2 * SAMPLE << 64) // n) if n > 2 * SAMPLE else rows
        sample = low.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        spark = rows.sparkSession
        if not n:
            return cls(spark.createDataFrame([], _BLOCKS), np.zeros((0, 0)))
        centres = fit_centres(_matrix(sample), max(1, min(MOST_CENTRES, int(np.sqrt(n)))))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1))
                    nearest = np.argmax(x @ centres.T, axis=1)
                    angle = np.arccos(np.clip((x * centres[nearest]).sum(axis=1), -1, 1))
                    offsets = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
                    unit = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(angle), unit], names=["item_id", "centre", "angle", "v"])

        placed = checkpointed(rows.mapInArrow(place, "item_id long, centre int, angle double, v array<double>"))
        # Quantiles of the angle, not a window, cut a cluster into rings, so that a large one isn't gathered.
        sized = placed.groupBy("centre").agg(F.count("*").alias("many"), F.percentile_approx("angle", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
        rings = placed.join(sized, "centre").withColumn("ring", F.when(F.col("many") > block, ring).otherwise(0))
        share = F.ceil(F.col("many") / (64 * block)).cast("int")  # a ring of a very large cluster is dealt into several blocks
        rings = rings.withColumn("ring", (F.col("ring") * 65_536 + F.pmod(F.xxhash64("item_id"), F.greatest(share, F.lit(1)))).cast("int"))
        held = F.collect_list(F.struct("item_id", "v"))
        blocks = rings.groupBy("centre", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").cast("int").alias("n"), held.alias("held"))
        blocks = blocks.select("centre", "ring", "low", "high", "n", F.col("held.item_id").alias("ids"), F.flatten("held.v").alias("values"))
        return cls(checkpointed(blocks), centres)

    def _visits(self, queries: DataFrame) -> DataFrame:
        """query_id, centre, away: the angle between every query and every centre."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PACK):
                    part = batch.slice(at, PACK)
                    if not len(centres):
                        return
                    away = _angles(_matrix(part.column(1)), centres)
                    n, m = away.shape
                    taken = pa.array(np.repeat(np.arange(n), m))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(taken), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(away.ravel())],
                        names=["query_id", "centre", "away"],
                    )

        return queries.mapInArrow(run, "query_id long, centre int, away double")

    def _scored(self, visits: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """query_id, item_id, score of the best k of each visited block; visits: query_id, centre, ring, asked: query_id, v."""
        share = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-visits.select("query_id").distinct().count() // PACK))))
        packed = visits.join(asked, "query_id").groupBy("centre", "ring", share.alias("share")).agg(F.collect_list(F.struct("query_id", "v")).alias("q"))  # about PACK at most
        # Never sent to all tasks by way of the driver: a query's vector is there once for each ring, whatever size its table seems to have.
        met = packed.hint("merge").join(self.blocks.select("centre", "ring", "ids", "values"), ["centre", "ring"])
        met = met.select(F.col("q.query_id").alias("q_ids"), F.flatten("q.v").alias("q_values"), "ids", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    q_ids, q_values, ids, values = (c[row].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                    asked = q_values.reshape(len(q_ids), -1)
                    asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
                    scores = np.round(asked @ values.reshape(len(ids), -1).T, 6)
                    if not same:
                        scores[q_ids[:, None] == ids[None, :]] = -np.inf
                    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    found = np.take_along_axis(scores, best, 1).ravel()
                    ok = found > -np.inf
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q_ids, best.shape[1])[ok]), pa.array(ids[best].ravel()[ok]), pa.array(found[ok])], names=["query_id", "item_id", "score"]
                    )

        return met.mapInArrow(run, "query_id long, item_id long, score double")

    def search(self, queries: DataFrame, k: int, query_id: str, vector: str = "embedding", include_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """The k nearest items of every query (query_id, item_id, score, rank), and the share of all vectors that was read."""
        asked = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull())
        asked = asked.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
        asked = checkpointed(asked)
        rings = checkpointed(self.blocks.select("centre", "ring", "low", "high", "n"))
        away = checkpointed(self._visits(asked))
        nearest = F.greatest(F.lit(0.0), F.col("away") - F.col("high"), F.col("low") - F.col("away"))
        order = Window.partitionBy("query_id").orderBy("nearest", "centre", "ring")
        # Of a query only the clusters near it take part in the first pass, as many as hold enough vectors.
        held = rings.groupBy("centre").agg(F.sum("n").alias("many"))
        close = away.join(held, "centre").withColumn("before", F.sum("many").over(Window.partitionBy("query_id").orderBy("away", "centre").rowsBetween(Window.unboundedPreceding, -1)))
        close = close.where(F.coalesce("before", F.lit(0)) <= k).drop("many", "before")
        first = close.join(rings, "centre").withColumn("nearest", nearest)
        first = first.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) <= k)
        first = checkpointed(first.select("query_id", "centre", "ring", "n"))
        found = checkpointed(self._scored(first, asked, k, include_self))
        bar = ranked(found, k, ["query_id"], "score", "item_id").where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("bar"))
        left = away.join(bar, "query_id", "left").join(rings, "centre").where(F.cos(nearest) >= F.coalesce("bar", F.lit(-2.0)))
        left = checkpointed(left.select("query_id", "centre", "ring", "n").join(first.select("query_id", "centre", "ring"), ["query_id", "centre", "ring"], "left_anti"))
        more = self._scored(left, asked, k, include_self)
        read = first.select("n").union(left.select("n")).agg(F.sum("n").alias("read"))
        whole = rings.agg(F.sum("n").alias("all"))
        share = read.crossJoin(whole).select((F.col("read") / (F.col("all") * asked.count())).alias("share"))  # one row each
        return ranked(found.union(more), k, ["query_id"], "score", "item_id"), share


_built: dict[tuple, VectorIndex] = {}


def vector_index_of(spark: SparkSession, vectors: DataFrame, item_id: str) -> VectorIndex:
    """The index of a stored table, built once in a session for each state of its files."""
    from inkwell.operators.text_index import state_of

    key = (spark.sparkContext.applicationId, item_id, state_of(vectors))
    if key not in _built or not folder_exists(spark, getattr(_built[key].blocks, "inkwell_path", "")):
        _built[key] = VectorIndex.build(vectors, item_id)
    return _built[key]
