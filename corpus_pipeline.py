"""The corpus pipeline: documents to packed training sequences.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, neardup, packing, quality, toxicity
from tidemark.llm.common import col, discard_scratch, fresh, materialize, scratch_mark


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the host-level rules reject. Null texts fail, null hosts are one host; an empty table stays empty, repeated rows share
    their fate, very long texts are measured whole, other columns stay."""
    return quality.filter_documents(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of 0.5 or more. Labels of the held-out fold are not learned from. Null and empty
    texts stay, repeated rows share their fate, very long texts are scored whole; an empty table stays empty."""
    (score,) = fresh(docs, "score")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, score=score).where(F.col(score) < 0.5).drop(score)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that spread over many sites out of the texts, and count n_chars anew. Null texts stay null, every row stays,
    whatever its length or copies; an empty table stays empty."""
    cleaned = linededup.dedup_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each group of near duplicates. Texts without words (null, empty) are one
    group; rows of one id share their fate, rows without an id stay; an empty table stays empty."""
    return neardup.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; one row a piece, with its ids. Null texts are the end token alone, repeated
    rows are packed each on its own, very long texts fill windows of their own; an empty table gives no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate_lines),
    ("near duplicates", near_duplicates),
    ("packing", pack_sequences),
]

#: A trained network and a tokenizer are in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written, and read by the next. A stage's scratch
    folders and its input go once its result is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard_scratch(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
