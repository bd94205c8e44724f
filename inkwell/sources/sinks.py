"""Sinks: states of tables in versions, snapshots by container, exports, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.commits import Commits


def _folder_name(spark: SparkSession, value: object) -> str:
    """How a partition's folder names a value."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))


def rebuild_snapshot(df: DataFrame, root: str, by: str = "kb_id", containers: list | None = None) -> None:
    """Replaces the containers that ``df`` has rows of, and empties those of ``containers`` without rows; others stay."""
    rebuild_tables({"rows": df}, root, by, containers)


def rebuild_tables(tables: dict[str, DataFrame], root: str, by: str = "kb_id", containers: list | None = None) -> None:
    """Replaces, in each table, the containers that its rows are of, and empties those of ``containers`` without rows.

    It is one commit over all tables: rows go into new folders, and readers see them, and all that is gone, with the
    manifest that is written last; a failure before that leaves every table as it was, so none is ahead of another.
    """
    commits = Commits(next(iter(tables.values())).sparkSession, root)
    version, content = commits.latest()
    held = dict(content.get("tables", {}))
    for table, df in tables.items():
        folder = commits.new_folder(table)
        df.withColumn("__container", F.col(by).cast("string")).write.partitionBy("__container").parquet(commits.path(folder))
        gone = {_folder_name(df.sparkSession, container) for container in containers or ()}
        kept = {name: path for name, path in held.get(table, {}).items() if name not in gone}
        new = [name for name in commits.names(folder) if name.startswith("__container=")]
        held[table] = kept | {name.removeprefix("__container="): f"{folder}/{name}" for name in new}
    commits.commit(version + 1, {"tables": held})
    commits.sweep()


def purge_container(spark: SparkSession, root: str, container: object) -> None:
    """Drops one container of all tables in one commit."""
    commits = Commits(spark, root)
    version, content = commits.latest()
    name = _folder_name(spark, container)
    held = {table: {k: v for k, v in paths.items() if k != name} for table, paths in content.get("tables", {}).items()}
    commits.commit(version + 1, {"tables": held})
    commits.sweep()


def truncate(spark: SparkSession, root: str, table: str = "rows") -> None:
    """Drops all rows of one table in one commit; its files go with the next commits but one."""
    commits = Commits(spark, root)
    version, content = commits.latest()
    commits.commit(version + 1, {"tables": content.get("tables", {}) | {table: {}}})
    commits.sweep()


def read_snapshot(spark: SparkSession, root: str, schema: str, table: str = "rows") -> DataFrame:
    """The rows of all containers of a table, as of the last commit."""
    commits = Commits(spark, root)
    paths = [commits.path(folder) for folder in commits.latest()[1].get("tables", {}).get(table, {}).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def produce(events: DataFrame, path: str, topic: str) -> None:
    """Appends events (kbId, docLogicalKey, ...) to a topic of JSON lines as key ``kb:logicalKey`` and value."""
    key = F.concat(F.col("kbId").cast("string"), F.lit(":"), F.col("docLogicalKey"))
    value = F.to_json(F.struct(*events.columns))
    events.select(key.alias("key"), value.alias("value"), F.lit(topic).alias("topic")).write.mode("append").partitionBy("topic").json(path)


def re_embed(rows: DataFrame, text: str, embedder: Callable[[Column], Column], vector: str = "embedding") -> DataFrame:
    """``rows`` with their vectors computed anew from a text column; keys and payload stay."""
    return rows.withColumn(vector, embedder(F.col(text)))


def export_csv(df: DataFrame, path: str, totals: list[str] | None = None, sheet_rows: int = 65_536) -> None:
    """Rows with a header, and a last row of totals over the columns named; cells that aren't numbers count as 0.

    Files hold at most ``sheet_rows`` rows, as sheets do.
    """
    rows = df.select(*[F.col(c).cast("string") for c in df.columns], F.lit(0).alias("__last"))
    if totals:
        total = df.agg(*[
            F.sum(F.coalesce(F.expr(f"try_cast(`{c}` as decimal(30,2))"), F.lit(0))).cast("string").alias(c) if c in totals
            else F.lit("total" if c == df.columns[0] else None).cast("string").alias(c)
            for c in df.columns
        ])
        rows = rows.union(total.select("*", F.lit(1)))
    rows.orderBy("__last").drop("__last").write.mode("overwrite").option("header", True).option("maxRecordsPerFile", sheet_rows).csv(path)


def report(metrics: DataFrame, path: str, numbers: list[str]) -> DataFrame:
    """Writes the rows, and returns the mean of each metric without NaN."""
    metrics.write.mode("overwrite").json(f"{path}/rows")
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    summary = metrics.agg(*[F.round(F.avg(clean(c)), 6).alias(c) for c in numbers if not c.startswith("_")])
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary
