"""The registered queries of the numbered operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import (
    audio,
    decontaminate,
    html_text,
    language_id,
    line_dedup,
    merkle,
    near_dedup,
    periodic_runs,
    quality,
    secret_scan,
    sentencepiece_codec,
    token_counts,
    url_filter,
)
from inkwell.session import checkpointed, discard, table

PIECES = "piece_bpe_32k.model"


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = checkpointed(audio.store(table(spark, sf_dir, "documents")), "zstd")
    patched = checkpointed(audio.features(stored, tensors=True), "zstd")
    discard(stored)
    found = audio.read_patches(patched)
    seconds = F.aggregate("segments", F.lit(0.0), lambda t, s: t + s["end_s"] - s["start_s"])
    feature = F.format_string(
        "frames=%d;patches=%d;segments=%d;active_s=%.3f;mean_db=%.2f;end_s=%.3f;tensors=%s",
        "n_frames", "patches_read", F.size("segments"), seconds, "mean_db", "end_s", "tensors_sha256",
    )
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    decoded = sentencepiece_codec.recode(table(spark, sf_dir, "documents"), path)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_machine(spark: SparkSession, sf_dir: str) -> quality.Machine:
    """Fitted on labels whose fold isn't the held-out one."""
    labels = table(spark, sf_dir, "labels")
    return quality.train(
        table(spark, sf_dir, "documents"), labels.where(~language_id.held_out(labels["doc_id"], 4, 2))
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), quality.score(docs, quality_machine(spark, sf_dir)).alias("score")
    )
    return scored.select(
        "doc_id",
        language_id.held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(docs["doc_id"], 5, 0)
    names, model = language_id.learn(docs.where(~out), docs["lang"])
    found = language_id.predict(docs, names, model)
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "languages"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counted = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_lines", "n_compared", "n_removed", "n_short", F.sha2("text", 256).alias("text_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_audio,
        op2_url_filter,
        op3_sentencepiece,
        op4_token_counts,
        op5_decontaminate,
        op6_quality,
        op7_near_dedup,
        op8_html_text,
        op9_language_id,
        op10_line_dedup,
        op11_secrets,
        op12_merkle,
        op13_periodic_runs,
    )
}
ORACLES = {
    "op2_url_filter": url_filter.oracle_sql(),
    "op5_decontaminate": decontaminate.oracle_sql(),
    "op7_near_dedup": near_dedup.oracle_sql(),
    "op11_secrets": secret_scan.oracle_sql(),
    "op12_merkle": merkle.oracle_sql(),
    "op13_periodic_runs": periodic_runs.oracle_sql(),
}
