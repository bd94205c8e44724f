"""Session helpers: table loading, and where intermediate results are cut from their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it comes in fewer parts than there are cores, as a file of one row group does.

    For scans whose rows cost much more to work on than to send; a table of many parts stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts of a scan of files that one task reads, and tasks for each core that are left at least.
PARTS_OF_TASK, TASKS_OF_CORE = 32, 4


def gathered(df: DataFrame) -> DataFrame:
    """``df``, several parts of it to a task, if it comes in many more parts than there are cores.

    For scans of small files: Spark counts 4 MB for opening one, so that a part holds a few dozen of them at most, and a
    task's own cost is several times that of its files.
    """
    parts = df.rdd.getNumPartitions()
    return df.coalesce(max(-(-parts // PARTS_OF_TASK), TASKS_OF_CORE * df.sparkSession.sparkContext.defaultParallelism))


#: Rows that Spark hands to Python at once, unless the session says otherwise.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python in small batches from now on, if nothing else was set.

    A batch is held whole on both sides, and at Spark's default of 10,000 rows that is tens of megabytes
    of texts for every task.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which every executor shares.

    Where that is unset, as in tests, a session whose tasks run in its own process gets a temporary one.
    On a cluster no folder of one machine would do, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, and nothing that a lost executor takes along.

    A written table, unlike ``checkpoint()``, has its real size as its statistics.  A checkpoint keeps
    the estimate of the plan behind it, in which each join multiplies its sides' sizes; over the rounds
    of an iteration that number grows until the driver has no memory left for it.  ``codec`` names the
    files' compression where it isn't the session's.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.inkwell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``checkpointed`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "inkwell_path", None)
        if path:
            delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is; nothing happens if there is none."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, in whatever store it is; an empty path is none."""
    if not path:
        return False
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/inkwell-{uuid.uuid4().hex}"
