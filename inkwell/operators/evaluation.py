"""Evaluation: runs to do, context trimming, cache validity, label-based metrics, sequence differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def still_to_run(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return questions.join(done.select(key).distinct(), key, "left_anti")


def trimmed_count(n: Column, attempt: Column) -> Column:
    """Contexts to keep at the n-th attempt: 35 percent less each time, one at least."""
    return F.greatest(F.lit(1), F.bround(n * (1 - 0.35 * (attempt - 1)), 0).cast("int"))


def same_questions(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two runs have the same questions as often."""
    left, right = a.select(key), b.select(key)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def precision_at_k(hits: DataFrame, query: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """query, precision, reciprocal_rank over the first k hits."""
    first = hits.where(F.col(rank) <= k)
    return first.groupBy(query).agg(
        F.round(F.sum(F.when(relevant, 1).otherwise(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.min(F.when(relevant, F.col(rank))), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def folded_sequence(events: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """by, sequence: a run's kinds of events in order, repeats in a row counted once."""
    w = Window.partitionBy(by).orderBy(order)
    changed = events.withColumn("__p", F.lag(kind).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(kind)))
    items = F.array_sort(F.collect_list(F.struct(order, kind)))
    return changed.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x[kind]), ">").alias("sequence"))


def missing_keys(expected: Column, actual: Column) -> Column:
    return F.array_sort(F.array_except(expected, actual))
