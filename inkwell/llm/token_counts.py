"""Token counts (operator 4): whole-token shortcut.

Most words of a text are single tokens.  Which vocabulary strings encode alone as one token is
proved once, on the driver, by encoding each of them; the resulting set is bounded by the
vocabulary and is broadcast.  A task then cuts its texts into pre-tokens (see ``pretokens``),
counts those in the set as one each, and has only the rest merged by the tokenizer, whose counts
a bounded per-worker cache keeps.  There is no shuffle, but that a table in fewer parts than there are
cores is dealt over all of them first.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated
rows give repeated rows; an empty table gives an empty result; further columns are not read.
A very long text is worked on in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.common import id_text, slices
from inkwell.llm.pretokens import SPACE, check_model, load, parts, pretokens
from inkwell.session import spread

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
        T.StructField("n_whole", T.LongType()),
    ]
)
#: Words whose counts a worker keeps.
CACHE_WORDS = 400_000
_workers: dict[str, tuple] = {}


def whole_tokens(model_path: str) -> frozenset[str]:
    """Words (without their space sign) that the model encodes as exactly one token."""
    sp = load(model_path)
    check_model(sp)
    words = [p[1:] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p[:1] == SPACE and SPACE not in p[1:]]
    alone = {w for w, ids in zip(words, sp.encode(words, num_threads=1)) if w and len(ids) == 1}
    return frozenset(alone | ({""} if sp.piece_to_id(SPACE) != sp.unk_id() else set()))  # "": a space sign alone


def count_words(words: list[str], sp, cache: dict[str, int]) -> int:
    """Tokens of the words; the cache gets the counts of those it lacks."""
    lacking = list(set(words).difference(cache))
    if lacking:
        cache.update(zip(lacking, map(len, sp.encode(lacking, num_threads=1))))
    return sum(map(cache.__getitem__, words))


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text as the SentencePiece library counts them.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and n_whole, how many
    pre-tokens the shortcut counted.
    """
    shortcut = docs.sparkSession.sparkContext.broadcast(whole_tokens(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _workers:
            _workers[model_path] = (load(model_path), {})
        sp, cache = _workers[model_path]
        whole = shortcut.value
        for batch in batches:
            for piece in slices(batch):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                tokens, direct = [], []
                for text in piece.column(1).to_pylist():
                    n = alone = 0
                    for part in parts(text.replace(SPACE, " ")):
                        words = pretokens(part)
                        if not words and text:
                            words = [""]
                        rest = [w for w in words if w not in whole]
                        alone += len(words) - len(rest)
                        n += count_words(rest, sp, cache)
                    direct.append(alone)
                    tokens.append(n + alone)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pc.cast(pc.binary_length(piece.column(1)), pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                        pa.array(direct, pa.int64()),
                    ],
                    names=SCHEMA.names,
                )

    return spread(id_text(docs, id_col, text_col)).mapInArrow(run, SCHEMA)
