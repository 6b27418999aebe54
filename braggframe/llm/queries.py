"""The queries of this subpackage: each applies its operator to a whole table and derives the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, lines, media, ngram_join, oracle, packing, pieces, quality, sharding, warc

SHARDS = 24
CAPACITY, END_ID = 1024, 2
#: Labelled documents that the references of the quality rules are fitted on.
REFERENCE_ROWS = 8000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(_table(spark, sf_dir, "documents")).drop("n_links")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduped_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    hard = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], said.schema)
    return chat.formatted_chats(said.unionByName(hard), vocabulary("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.vector_shards(_table(spark, sf_dir, "documents"), SHARDS, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.piece_coded(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), full=False)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), CAPACITY, END_ID)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted_pages(_table(spark, sf_dir, "pages"))


def references(spark: SparkSession, sf_dir: str) -> quality.References:
    """Fitted on labelled good documents, REFERENCE_ROWS at most: those of the smallest doc_id."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").orderBy("doc_id").limit(REFERENCE_ROWS)
    return quality.fitted(_table(spark, sf_dir, "documents").join(F.broadcast(good), "doc_id", "left_semi"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents"), ["doc_id"], references=references(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_chat_format, op4_sharding, op5_sentencepiece, op6_best_fit, op7_html_extraction, op8_quality_rules, op9_warc, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql(REFERENCE_ROWS)
