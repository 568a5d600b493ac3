"""Queries and SQL of the text operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, collocations, linededup, neardup, packing, quality, repeats, resampling, sharding, syncmers, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", F.round("host_rate", 9).alias("host_rate"), F.array_join("strict_rules", ",").alias("strict_rules"), "host_verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(_table(spark, sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join_documents(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_lines_removed")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"), written=True)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scored.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_warc": op4_warc,
        "op5_fingerprints": op5_fingerprints,
        "op6_bpe_transducer": op6_bpe_transducer,
        "op7_sharding": op7_sharding,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_token_files": op9_token_files,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_repeats": op12_repeats,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op4_warc": warc.ORACLE, "op8_near_duplicates": neardup.ORACLE, "op10_line_dedup": linededup.ORACLE, "op11_collocations": collocations.ORACLE, "op13_resampling": resampling.ORACLE}
