"""Language ID (operator 9): multilingual mixture inference.

Each language is a distribution over byte trigrams, counted over all training texts in Spark.  A
text's words come from a mixture of languages: expectation-maximisation estimates the proportions
from the words' trigram likelihoods, of which none counts as less than ``exp(-SPREAD)`` of the word's
best, so that one odd word doesn't rule out a language.  The languages are then ranked by proportion, the mixture is
refitted to the first one, two, ... and at last all of them, and the set with the best likelihood
after a penalty for each language is kept.  No word is likelier than under its best language, so a
text for which the penalty alone outweighs that set's gain needs no larger one.  The prediction is
the set's largest language, its score its proportion.

The model is languages x 2**15 counts, so its size does not depend on the number of texts.

Defined results: a text that is null or has no letter, or any text if nothing was learned, is
``und`` with score 0; a null id stays null and counts as held out; rows whose lang is null teach
nothing; repeated rows count and are returned as often as they occur; an empty table gives an empty
result; of the further columns only lang is read, for learning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import id_text, slices, small_batches, text_bytes

BUCKETS = 1 << 15
ROUNDS = 10
#: What each further language must add to the log-likelihood, times the log of the number of words.
PENALTY = 3.0
#: How far a word's log-likelihoods may lie under its best language's.
SPREAD = 8.0
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double, languages string"
_FOLD = np.full(256, 32, np.uint8)  # what isn't a letter counts as a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the trigram around every letter's byte, where words begin among these, and each word's text."""
    n = len(raw)
    folded = np.full(n + 2, 32, np.uint8)
    folded[1:-1] = _FOLD[raw]
    ink = np.flatnonzero(folded[1:-1] != 32)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.where(first[ink], 32, folded[ink]).astype(np.uint32)
    after = np.where(first[ink + 1], 32, folded[ink + 2]).astype(np.uint32)
    mixed = (before << 16 | folded[ink + 1].astype(np.uint32) << 8 | after) * np.uint32(0x9E3779B1)
    starts = np.flatnonzero(before == 32)
    owner = np.searchsorted(offsets, ink[starts], "right") - 1
    return (mixed >> np.uint32(17)).astype(np.int32), starts, owner


def learn(docs: DataFrame, lang: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages of the training rows, and the log-probability of every bucket in each (BUCKETS x languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = part.column(2).dictionary_encode()
                names = langs.dictionary.to_pylist()
                codes = langs.indices.to_numpy(zero_copy_only=False)
                grams, starts, owner = trigrams(*text_bytes(part.column(1)))
                of = np.repeat(codes[owner], np.diff(np.append(starts, len(grams))))
                for k, name in enumerate(names):
                    got = np.bincount(grams[of == k], minlength=BUCKETS)
                    counts[name] = counts.get(name, 0) + got
        for name, got in counts.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = small_batches(docs).where(lang.isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang")
    )
    found = (
        rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.full((BUCKETS, len(names)), 0.5)
    if names:
        column = {name: k for k, name in enumerate(names)}
        counts[found.column("bucket").to_numpy(), [column[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _fit(likes: np.ndarray, owner: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text, and the texts' log-likelihoods (against each word's best)."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    many = np.diff(np.append(first, len(owner)))[:, None]
    for _ in range(rounds):
        part = share[owner] * likes
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / many
    return share, np.add.reduceat(np.log((share[owner] * likes).sum(axis=1)), first)


def infer(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages chosen for each text (rows of zeros: no letters), and the texts that have letters."""
    n, langs = len(offsets) - 1, model.shape[1]
    out = np.zeros((n, langs))
    grams, starts, owner = trigrams(raw, offsets)
    if not len(starts) or not langs:
        return out, np.zeros(0, np.int64)
    likes = np.stack([np.add.reduceat(model[:, k][grams], starts) for k in range(langs)], axis=1)
    likes = np.exp(np.maximum(likes - likes.max(axis=1, keepdims=True), -SPREAD))
    texts, first, owner = np.unique(owner, return_index=True, return_inverse=True)
    full = np.ones((len(texts), langs), np.float32)
    share, _ = _fit(likes, owner, first, full, ROUNDS)
    ranked = np.argsort(-share, axis=1, kind="stable")
    words = np.diff(np.append(first, len(owner)))
    best = np.full(len(texts), -np.inf)
    for size in range(1, langs + 1):
        # Log-likelihoods are at most 0, so no larger set is better than its penalty.
        tried = np.flatnonzero(best < -PENALTY * (size - 1) * np.log(words + 1))
        if not len(tried):
            break
        allowed = np.zeros((len(tried), langs), np.float32)
        np.put_along_axis(allowed, ranked[tried, :size], 1, axis=1)
        here = np.isin(owner, tried) if len(tried) < len(texts) else slice(None)
        at = np.searchsorted(tried, owner[here])
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        fitted, like = _fit(likes[here], at, begin, allowed, 1 if size == 1 else ROUNDS // 2)
        like -= PENALTY * (size - 1) * np.log(words[tried] + 1)
        better = like > best[tried]
        best[tried[better]] = like[better]
        out[texts[tried[better]]] = fitted[better]
    return out, texts


def predict(docs: DataFrame, names: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages (name:proportion, largest first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                share, _ = infer(*text_bytes(part.column(1)), shared.value)
                share[~pc.match_substring_regex(part.column(1), r"\p{L}").to_numpy(zero_copy_only=False)] = 0
                top = share.argmax(axis=1) if names else np.zeros(len(share), int)
                score = share.max(axis=1) if names else np.zeros(len(share))
                listed = [
                    ",".join(f"{names[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) for row in share
                ]
                langs = [names[k] if s > 0 else UNKNOWN for k, s in zip(top.tolist(), score.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(listed, pa.string())],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, PREDICTED)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))
