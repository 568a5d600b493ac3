"""The registered queries and the pipeline over small tables."""

import corpus_pipeline
import pytest
from comparing import differences, duck
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import registry

#: What the contract asks of each query's columns, at least.
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3": "doc_id held_out score predicted", "op4": "page_id payload_bytes payload_digest record_type refers_to",
    "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "doc_id size text_crc32 law shard slot grown_shard", "op8": "doc_id class_id n_links", "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id text",
    "op11": "lang rank phrase a l r n score", "op12": "doc_id n_bytes n_removed n_spans kept_sha256", "op13": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    assert not differences(registry.queries()[name](spark, f"{DATA}/sf0.01"), registry.oracle_sql()[name], duck(f"{DATA}/sf0.01"))


@pytest.mark.parametrize("name", registry.queries())
def test_columns_and_rows(spark, name):
    out = registry.queries()[name](spark, f"{DATA}/sf0.001")
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    source = "pages" if name.startswith("op4") else "documents"
    n = spark.read.parquet(f"{DATA}/sf0.001/{source}.parquet").count()
    if name.startswith("op11"):
        assert {r.lang for r in out.select("lang").distinct().collect()} == {r.lang for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("lang").distinct().collect()}
    else:
        assert out.count() >= n if name.startswith("op2_") else out.count() == n


def test_pipeline_keeps_columns_and_decisions(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("score", F.lit("own")).withColumn("gone", F.lit(0))
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0.4 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.select("doc_id").distinct().count() == docs.count()


def test_empty_tables_go_through(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
