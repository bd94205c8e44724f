"""Folders of many files: tasks list them and read them, so that the driver holds no names of files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import TASKS_OF_CORE, checkpointed, gathered

#: Files and bytes that one task reads, where there is more than enough for all cores; rows and bytes handed on at once.
FILES_OF_TASK, BYTES_OF_TASK, BATCH_FILES, BATCH_BYTES = 4096, 128 << 20, 10_000, 8 << 20


def store_of(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return store, root.rstrip("/")


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass a name over."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store, folder: str) -> Iterator[tuple[str, int, bool]]:
    """Path, size and whether it is a folder, of what lies in a folder; one that is local isn't held whole."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for x in entries:
                try:
                    yield x.path, x.stat().st_size, x.is_dir()
                except FileNotFoundError:  # gone meanwhile
                    continue
    else:
        for x in store.get_file_info(fs.FileSelector(folder)):
            yield x.path, x.size or 0, x.type == fs.FileType.Directory


def _list_folders(where: str):
    """Folders (path) of the store of ``where`` into what they hold: path, size, folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(where)
        found: list[tuple[str, int, bool]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["path", "size", "folder"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in _entries(store, folder):
                    if not _hidden(entry[0].rsplit("/", 1)[-1]):
                        found.append(entry)
                    if len(found) == BATCH_FILES:
                        yield out()
                        found = []
        if found:
            yield out()

    return run


def _qualified(spark: SparkSession, path: str) -> str | None:
    """A folder's path with its scheme, if tasks can open its store themselves; None for a file, a pattern, or another store."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.getFileStatus(where).isDirectory():
        return None
    named = files.makeQualified(where).toString()
    try:
        store_of(named)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return named


def files_under(spark: SparkSession, where: str) -> DataFrame:
    """path (within its store), size of every file in a folder and those in it, but for names that Spark passes over.

    The folders of one depth are listed at once, each by one task, and what they hold is written.
    """
    found = None
    folders = spark.createDataFrame([(store_of(where)[1] or "/",)], "path string")
    cores, many = TASKS_OF_CORE * spark.sparkContext.defaultParallelism, 1
    while many:
        held = checkpointed(folders.repartition(min(many, cores)).mapInArrow(_list_folders(where), "path string, size long, folder boolean"))
        files, folders = held.where("not folder").select("path", "size"), held.where("folder").select("path")
        found = files if found is None else found.union(files)
        many = folders.count()
    return found


def read_files(spark: SparkSession, path: str, work: Callable[[str, bytes], Iterable[tuple]], schema: str, suffix: str = "", batch: int = 1000) -> DataFrame:
    """The rows of ``schema`` that ``work`` makes of the name and bytes of every file under a path whose name ends with ``suffix``.

    Tasks list folders and read files.  Where the path is a pattern or one file, or its store is known to Spark only,
    Spark's own reader does both, for which the driver lists all files.
    """
    where = _qualified(spark, path)
    ends = lambda df: df.where(F.lower("path").endswith(suffix)) if suffix else df
    if where is None:
        files = gathered(ends(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")))
    else:
        files = ends(files_under(spark, where))
        many, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        tasks = max(TASKS_OF_CORE * spark.sparkContext.defaultParallelism, -(-many // FILES_OF_TASK), -(-size // BYTES_OF_TASK))
        files = files.select("path").repartition(max(1, min(many, tasks)))
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = None if where is None else store_of(where)[0]
        rows: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({name: pd.Series(x, dtype=object) for name, x in zip(names, zip(*rows))})

        for part in parts:
            for at, raw in zip(part["path"], repeat(b"") if store is not None else part["content"]):
                if store is not None:
                    with store.open_input_stream(at, compression=None) as file:
                        raw = file.read()
                size += len(raw)
                for row in work(at.rsplit("/", 1)[-1], raw):
                    rows.append(row)
                    if len(rows) == batch:
                        yield out()
                        rows, size = [], 0
                if rows and size >= BATCH_BYTES:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return files.mapInPandas(run, schema)
