"""Canonical schemas of the engine's tables."""

from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("reduced_embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.StringType()),
])

QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_text", T.StringType()),
])

SUBQ_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("sub_idx", T.IntegerType()),
    T.StructField("sub_query", T.StringType()),
])

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("sub_idx", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("metadata", T.StringType()),
])

ANALYSIS_SCHEMA = T.StructType([
    T.StructField("clarified_intent", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("sub_queries", T.ArrayType(T.StringType())),
    T.StructField("key_terms", T.ArrayType(T.StringType())),
    T.StructField("context_needed", T.StringType()),
])

TOPIC_SCHEMA = T.StructType([
    T.StructField("topic_id", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("coherence", T.DoubleType()),
    T.StructField("representative_docs", T.ArrayType(T.StringType())),
])

MODEL_META_SCHEMA = T.StructType([
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("n_components", T.IntegerType()),
    T.StructField("n_neighbors", T.IntegerType()),
    T.StructField("min_dist", T.DoubleType()),
    T.StructField("document_count", T.LongType()),
    T.StructField("model_version", T.LongType()),
])
