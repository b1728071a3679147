"""Every registered query runs at sf0.001; the SQL oracles agree with Spark on a sample of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, canon

SF = "/root/testdata/sf0.001"
CHECK = ["bm25_documents", "rag_answers", "rag_answers_rerank", "knn_embeddings", "text_functions",
         "trim_documents", "html_text", "topic_terms", "topic_coherence", "index_stats", "rag_answers_subqueries",
         "knn_blocked", "bm25_blocked", "knn_cosine", "knn_dot", "knn_dirty", "embedding_quality", "reduce_counts",
         "index_counters", "strip_think", "reducer_staleness", "topic_representatives", "stream_index", "recursive_invariants",
         "chunk_metadata", "topic_summary_texts", "topic_labels", "rag_answers_direct", "mixed_chunks",
         "json_texts", "prompts", "file_kinds", "store_rows", "context_sizes", "reducer_parameters", "reducer_model", "feedback_weights",
         "topic_phrases", "phrase_labels", "ingest_twice", "knn_index", "kmeans_nearest", "topics_hierarchy", "bm25_index"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", CHECK)
def test_oracle(spark, con, name):
    s = entry.queries()[name](spark, SF).toPandas()
    d = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert canon(s) == canon(d)


def test_stream_equals_batch(spark):
    a = entry.queries()["stream_index"](spark, SF).select("id").collect()
    b = entry.queries()["fixed_chunks"](spark, SF).select("id").collect()
    assert sorted(r.id for r in a) == sorted(r.id for r in b)
