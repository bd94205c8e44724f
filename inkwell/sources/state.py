"""Keyed state as a base and deltas: a change writes what changed, not the table.

Keys are dealt into hash buckets.  A change is a delta, a folder with the rows of the keys that it sets or
deletes, and one commit (see ``commits``) adds it to the manifest.  Reading takes the last row of each key
over base and deltas.  When ``most`` deltas have gathered, the buckets that they touch are written anew and
become base; the others keep their files.  A change that is applied again under its number does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.commits import Commits

BUCKETS, MOST_DELTAS = 16, 8


class KeyedState:
    """The state in folder ``root``: rows of ``schema`` (a DDL text), one for each value of the columns ``keys``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = BUCKETS, most: int = MOST_DELTAS) -> None:
        self.spark, self.schema, self.keys, self.buckets, self.most = spark, schema, keys, buckets, most
        self.commits = Commits(spark, root)

    def _stored(self, folder: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, __gone boolean, __version long, __bucket int").parquet(self.commits.path(folder))
        return rows if buckets is None else rows.where(F.col("__bucket").isin(buckets))

    def _latest(self, content: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The last row of each key, deleted ones too, of some buckets."""
        base: dict[str, list[int]] = {}
        for bucket, folder in content.get("base", {}).items():
            if buckets is None or int(bucket) in buckets:
                base.setdefault(folder, []).append(int(bucket))
        parts = [self._stored(folder, some) for folder, some in base.items()]
        parts += [self._stored(d["folder"], buckets) for d in content.get("deltas", [])]
        if not parts:
            return None
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.union(more)
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__version").alias("__last")).select(*self.keys, "__last.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of the last commit, or of an earlier one that is still kept."""
        content = self.commits.latest()[1] if version is None else self.commits.read(version)
        rows = self._latest(content)
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.where("not __gone").select(*columns)

    def apply(self, changes: DataFrame, number: int, gone: str = "gone", beside: dict | None = None) -> None:
        """Sets the rows of changes, or deletes them where the column ``gone`` holds; a key occurs once.

        ``number`` names the change (as a micro-batch's id does).  ``beside`` is kept in the manifest, under the
        same commit.
        """
        version, content = self.commits.latest()
        if number <= content.get("number", -1):
            return
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = changes.select(*columns, F.coalesce(F.col(gone), F.lit(False)).alias("__gone"), F.lit(version + 1).cast("long").alias("__version"), bucket.alias("__bucket"))
        folder = self.commits.new_folder("delta")
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(self.commits.path(folder))
        touched = sorted(int(n.removeprefix("__bucket=")) for n in self.commits.names(folder) if n.startswith("__bucket="))
        repeated = self._stored(folder).groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise ValueError(f"change {number} has a key more than once")
        deltas = [*content.get("deltas", []), *([{"folder": folder, "buckets": touched}] if touched else [])]
        new = {"number": number, "base": content.get("base", {}), "deltas": deltas, **(beside or {k: v for k, v in content.items() if k not in ("number", "base", "deltas")})}
        if len(deltas) > self.most:
            new = self._compacted(new)
        self.commits.commit(version + 1, new)
        self.commits.sweep()

    def _compacted(self, content: dict) -> dict:
        buckets = sorted({b for d in content["deltas"] for b in d["buckets"]})
        folder = self.commits.new_folder("base")
        live = self._latest(content, buckets).where("not __gone")
        live.repartition("__bucket").write.partitionBy("__bucket").parquet(self.commits.path(folder))
        there = {n.removeprefix("__bucket=") for n in self.commits.names(folder) if n.startswith("__bucket=")}
        kept = {b: f for b, f in content["base"].items() if int(b) not in buckets}
        return {**content, "base": {**kept, **{b: folder for b in there}}, "deltas": []}
