"""The training-data pipeline over ``documents``: each stage's rows are written and read again.

All stages but the last return the columns of documents.

1.  quality classifier: documents with a score under 0.7 go;
2.  line dedup: lines within the edits that their length allows of an earlier line are cut out; a
    document of which only blank lines are left goes;
3.  MinHash near-dedup: of each component of near copies the document with the smallest id stays;
4.  benchmark decontamination: documents that contain a benchmark item go;
5.  SentencePiece encoding and decoding: doc_id, n_tokens and token_ids of what is left, decoded_sha256
    and round_trip.

Defined results: a null text is scored as an empty one, keeps no lines to cut, has no copies and no
items, and is encoded to no ids; a row with a null id may be rejected for its text, but its lines are
neither compared nor cut; of equal lines, and of copies, those with the smallest id stay, and rows that
repeat an id are one document; whole texts of any length are worked on; an empty table gives an empty
result; further columns come through all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, line_dedup, near_dedup, quality, sentencepiece_codec
from inkwell.llm.queries import PIECES, quality_machine
from inkwell.session import checkpointed, discard, table

LEAST_SCORE = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on the labels outside of the held-out fold."""
    return quality.keep(docs, quality_machine(spark, sf_dir), LEAST_SCORE)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones."""
    kept, _ = line_dedup.dedup_lines(docs)
    return kept


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; of rows with one id, all if they hold the component's smallest id."""
    return near_dedup.without_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, and whether they decode to its text."""
    decoded = sentencepiece_codec.recode(docs, public_tokenizers.path(PIECES))
    digest = F.sha2("decoded", 256)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        digest.alias("decoded_sha256"),
        (digest == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", keep_one_of_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("SentencePiece encoding", encode_pieces),
]
#: The classifier and the encoder have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared checkpoint folder, and deleted once the next
    one's are."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
            discard(before)
    return docs
