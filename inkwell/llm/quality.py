"""Quality classifier (operator 6): a factorisation machine.

The inputs of a text are its hashed words (a sparse vector of damped counts, scaled to length 1) and
a few structure statistics: shares of upper-case, digits, marks and long runs, word lengths,
repetition, lines, and its size as metadata.  The machine adds to a linear score the pairwise
interactions of all inputs through low-rank factors; by the sum-of-squares identity
``2 sum_{i<j} <v_i, v_j> x_i x_j = sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``
this takes time linear in the inputs.

Training takes at most ``max_rows`` labelled documents, those with the smallest hashes of their
ids, with one text each (of rows that repeat an id the one with the least hash); only their sparse
inputs reach the driver.  Whole texts enter with the same code in training and scoring, and the
examples are ordered by their inputs, so the machine doesn't depend on how rows are partitioned.

Defined results: a null or empty text is scored by its statistics (all zero); a null id stays null
and counts as held out; a null label teaches nothing, and of several labels of one id the least
counts; repeated rows give repeated rows; an empty table gives an empty result; without labelled
rows of both kinds every score is the share of label 1 (1.0 without any).  Further columns are not
read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import number, numbered, slices, small_batches, text_bytes
from inkwell.llm.words import words

BUCKETS, FACTORS = 1 << 15, 8
#: Labelled documents that a machine is fitted on at most; each has BUCKETS different words at most.
MAX_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.08, 1e-5
STATISTICS = (
    "upper digit mark bar newline high_byte word_length long_words short_words distinct repeated capital_words size lines"
).split()
_KIND = np.zeros((256, 6), np.float32)
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;'-|"], 2] = 1
_KIND[ord("|"), 3] = 1
_KIND[10, 4] = 1
_KIND[128:, 5] = 1


def inputs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: where its words begin among (bucket, value), these, and its row of statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, hashes, first = words(raw, offsets)
    many = np.diff(first)
    owner = np.repeat(np.arange(n), many)
    buckets = (hashes >> np.uint64(49)).astype(np.int64)
    keys, counts = np.unique(owner * BUCKETS + buckets, return_counts=True)
    of = keys // BUCKETS
    values = np.log1p(counts).astype(np.float32)
    length = np.sqrt(np.bincount(of, values**2, minlength=n))
    values /= np.maximum(length[of], 1e-9)
    stats = np.zeros((n, len(STATISTICS)), np.float32)
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(_KIND[:, k][raw], dtype=np.float64)])
        stats[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
    per_word = np.maximum(many, 1)
    width = ends - starts
    share = lambda flags: np.bincount(owner, flags, minlength=n) / per_word
    stats[:, 6] = share(width) / 10
    stats[:, 7] = share(width > 14)
    stats[:, 8] = share(width < 3)
    stats[:, 9] = np.bincount(of, minlength=n) / per_word
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    stats[:, 10] = share(repeated)
    begin = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    stats[:, 11] = share((begin >= 65) & (begin <= 90))
    stats[:, 12] = np.log1p(size) / 10
    stats[:, 13] = np.log1p(stats[:, 4] * size) / 5
    return np.searchsorted(of, np.arange(n + 1)), keys % BUCKETS, values, stats


class Machine:
    """Bias, linear weights and factors; the statistics' weights follow those of the word buckets."""

    def __init__(self, seed: int = 7) -> None:
        size = BUCKETS + len(STATISTICS)
        self.bias = 0.0
        self.linear = np.zeros(size, np.float32)
        self.factors = (np.random.default_rng(seed).standard_normal((size, FACTORS)) * 0.05).astype(np.float32)

    def parts(self, first: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple:
        """All inputs (the words', then the statistics') as flat arrays, their rows, and the rows' factor sums."""
        n = len(stats)
        rows = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), stats.shape[1])])
        at = np.concatenate([at, np.tile(np.arange(stats.shape[1]) + BUCKETS, n)])
        x = np.concatenate([x, stats.ravel()])
        weighed = self.factors[at] * x[:, None]
        sums = np.stack([np.bincount(rows, weighed[:, f], minlength=n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (weighed**2).sum(axis=1), minlength=n)
        score = self.bias + np.bincount(rows, self.linear[at] * x, minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        return rows, at, x, weighed, sums, score

    def score(self, first: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(first, at, x, stats)[-1], -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Adaptive gradient steps on the log-loss; both labels weigh the same in all."""
        share = labels.mean() if len(labels) else 1.0
        if share in (0.0, 1.0):
            self.bias, self.factors[:] = (30.0 if share else -30.0), 0
            return
        weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        past = [np.full_like(self.linear, 1e-3), np.full_like(self.factors, 1e-3), 1e-3]
        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for chosen in np.array_split(order.permutation(len(labels)), -(-len(labels) // BATCH)):
                some = [examples[k] for k in chosen]
                first = np.concatenate([[0], np.cumsum([len(e[0]) for e in some])])
                rows, at, x, weighed, sums, score = self.parts(
                    first, np.concatenate([e[0] for e in some]), np.concatenate([e[1] for e in some]), np.stack([e[2] for e in some])
                )
                slope = weigh[chosen] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[chosen]) / len(chosen)
                where, of = np.unique(at, return_inverse=True)
                pull = (slope[rows] * x).astype(np.float32)
                line = np.bincount(of, pull) + DECAY * self.linear[where]
                bend = pull[:, None] * (sums[rows] - weighed)
                bend = np.stack([np.bincount(of, bend[:, f]) for f in range(FACTORS)], axis=1) + DECAY * self.factors[where]
                past[0][where] += line**2
                past[1][where] += bend**2
                past[2] += slope.sum() ** 2
                self.linear[where] -= RATE * line / np.sqrt(past[0][where])
                self.factors[where] -= RATE * bend / np.sqrt(past[1][where])
                self.bias -= RATE * slope.sum() / np.sqrt(past[2])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            first, at, x, stats = inputs(*text_bytes(part.column(1)))
            offsets = pa.array(first.astype(np.int32))
            every = pa.array((np.arange(len(stats) + 1) * stats.shape[1]).astype(np.int32))
            columns = [
                pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32))),
                pa.ListArray.from_arrays(every, pa.array(stats.ravel())),
            ]
            yield pa.RecordBatch.from_arrays([part.column(2), *columns], names=["quality", "at", "x", "stats"])


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> Machine:
    """A machine fitted on at most ``max_rows`` documents with a label (columns doc_id, quality of ``labels``)."""
    known = numbered(labels).select(
        F.col(number(labels, "doc_id")).cast("long").alias("labelled"), F.col(number(labels, "quality")).cast("int").alias("quality")
    )
    known = known.where("quality is not null and labelled is not null").groupBy("labelled")
    chosen = known.agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows)
    text = F.coalesce(F.col(number(docs, text_col)).cast("string"), F.lit(""))
    texts = numbered(small_batches(docs)).select(F.col(number(docs, id_col)).cast("long").alias("doc_id"), text.alias("text"))
    rows = texts.join(chosen, F.col("doc_id") == F.col("labelled")).groupBy("labelled")
    rows = rows.agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("least"), F.min("quality").alias("quality"))
    rows = rows.select("labelled", "least.t", "quality")
    schema = "quality int, at array<int>, x array<float>, stats array<float>"
    found = rows.mapInArrow(_examples, schema).toArrow()
    flat = lambda name: [np.asarray(v.values) for v in found.column(name)]
    order = sorted(range(found.num_rows), key=lambda k, s=flat("stats"), a=flat("at"): (s[k].tobytes(), a[k].tobytes()))
    at, x, stats = flat("at"), flat("x"), flat("stats")
    machine = Machine()
    machine.fit([(at[k], x[k], stats[k]) for k in order], found.column("quality").to_numpy()[order].astype(np.float64))
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> Column:
    """The probability of label 1 of each document's text, as a column to use over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [shared.value.score(*inputs(*text_bytes(p.column(0)))) for p in slices(batch, 0)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(F.coalesce(small_batches(docs)[text_col].cast("string"), F.lit("")))


def keep(docs: DataFrame, machine: Machine, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text is scored ``least`` or more.

    Whole rows pass through the task in batches, so none waits in a queue for its score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                scores = shared.value.score(*inputs(*text_bytes(part.column(part.num_columns - 1))))
                yield part.filter(pa.array(scores >= least)).select(list(range(part.num_columns - 1)))

    text = F.coalesce(F.col(number(docs, text_col)).cast("string"), F.lit("")).alias("text")
    return numbered(small_batches(docs)).select("*", text).mapInArrow(run, docs.schema)
