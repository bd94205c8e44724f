"""Connected components of an edge table, as Spark jobs.

Each task first joins its own edges with union-find and keeps a spanning star of each tree.  Then
large-star and small-star rounds run until no edge changes.  As soon as what is left fits one task
(``TASK_EDGES``, some megabytes), at first or after any round, the same union-find ends it.  No node
gathers its neighbours: a round needs only each node's smallest neighbour.  Each round's edges are
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import checkpointed, discard

#: Edges that a task's union-find holds before it hands on their stars and starts anew.
FOREST_EDGES = 500_000
#: Edges of the tasks' trees that are joined by one more task; beyond, by rounds over all tasks.
TASK_EDGES = 200_000


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def out() -> pd.DataFrame:
        found = [(root(x), x) for x in parent]
        return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                low, high = min(a, b), max(a, b)
                parent[high] = low
                parent.setdefault(low, low)
        if len(parent) > FOREST_EDGES:
            yield out()
            parent.clear()
    yield out()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches, itself included) for every node of edges a, b.

    Null ends and loops are left out; repeated edges count once; without edges the result is empty.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    edges = checkpointed(edges.mapInPandas(_stars, "a long, b long").where("a != b").distinct())
    before = _state(edges)
    while True:
        if before[0] <= TASK_EDGES:
            done = edges
            edges = checkpointed(edges.coalesce(1).mapInPandas(_stars, "a long, b long"))
            discard(done)
            break
        both = edges.union(edges.select("b", "a"))
        low = checkpointed(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        down = checkpointed(down.distinct())
        least = checkpointed(down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = down.join(least, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct("m", F.col("b").alias("v")), F.struct("m", F.col("a").alias("v")))).alias("e")
        )
        done = edges
        edges = checkpointed(small.select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a != b").distinct())
        discard(done, low, down, least)
        after = _state(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.union(edges.select("a", "a").distinct())
