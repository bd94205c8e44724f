"""Rows that a model answers with JSON: called in the tasks, checked against a schema, asked again a bounded number of times."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_THOUGHTS, _FENCE = re.compile(r"<think>.*?</think>", re.S | re.I), re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
_FITS = {T.LongType: int, T.IntegerType: int, T.StringType: str, T.DoubleType: (int, float), T.BooleanType: bool}


def fitting(text: str, schema: T.StructType) -> dict | None:
    """The object in an answer, if it has every field of the schema with a value of its type; thoughts and fences are left out."""
    plain = _THOUGHTS.sub("", text or "")
    fence = _FENCE.search(plain)
    try:
        found = json.loads(fence[1] if fence else plain.strip())
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    for field in schema.fields:
        value, kind = found.get(field.name), _FITS.get(type(field.dataType))
        if value is None or kind and (not isinstance(value, kind) or isinstance(value, bool) and kind is not bool):
            return None
    return {f.name: found[f.name] for f in schema.fields}


def json_tasks(rows: DataFrame, key: str, prompt: str, answer: Callable[[str, int], str], schema: str, attempts: int = 3) -> DataFrame:
    """key, answer (a struct of ``schema``; null if none fitted), tries, failure: what a model says to each row's prompt.

    ``answer`` takes a prompt and the number of the attempt, from 1.  An answer that isn't an object of the schema, or a
    call that fails, is tried again, up to ``attempts`` times in all; then the row says why.  A batch of rows is
    answered at a time; a null prompt isn't asked.
    """
    kind = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("answer", kind), T.StructField("tries", T.IntegerType()), T.StructField("failure", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tries, failures = [], [], []
            for text in batch.column(1).to_pylist():
                value, n, failure = None, 0, "no prompt" if text is None else None
                while text is not None and value is None and n < attempts:
                    n += 1
                    try:
                        value = fitting(answer(text, n), kind)
                        failure = None if value is not None else "no object of the schema"
                    except Exception as error:  # whatever a model's client raises
                        failure = f"{type(error).__name__}: {error}"
                found.append(value)
                tries.append(n)
                failures.append(failure)
            columns = [batch.column(0), pa.array(found, arrow.field("answer").type), pa.array(tries, pa.int32()), pa.array(failures, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select(F.col(key), F.col(prompt).cast("string")).mapInArrow(run, out).withColumnRenamed("key", key)
