"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, line_dedup, media, ngram_join, packing, passages, pii, sql, suffix_dedup, token_orc, toxicity
from .common import cut, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file that the token queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_learned"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chat.format_chats(rows, chat.fit(rows)).withColumn("held_out", chat.held_out(F.coalesce("conv_id", F.lit(0))))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_orc.crc32_of_ids(token_orc.read_token_orc(spark, path))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the bytes that go, whether a run of over 50 words stands in another document too: such a run may be under 400 bytes long."""
    docs = table(spark, sf_dir, "documents")
    rows = suffix_dedup.dedup(docs, marks=passages.sharing(docs))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("marked").alias("shares_passage"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    # media with PCM at half the rate, for narrow-band use, and at twice the rate, every sample and those between, as one table; each sample is written once
    stored = cut(media.with_layers(media.store(table(spark, sf_dir, "documents"))), level=9)
    rows = media.payload_features(stored)
    tail = F.crc32(F.expr("substring(payload, -16, 16)"))
    return rows.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_pack, op4_chat, op5_ngram_join, op6_token_orc, op7_suffix_dedup, op8_audio, op9_decontamination, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """Of queries without learning, tokenizers or binary formats; the others are tested against brute force."""
    return {"op5_ngram_join": sql.NGRAM_JOIN, "op10_line_dedup": sql.LINE_DEDUP}
