"""Registered queries that prove smaller operators row by row, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..operators import reduce as rd
from ..options import DEFAULTS
from ..session import scratch_path
from ..sources.files import is_text
from ..sources.store import ChunkStore
from . import tables
from .catalog import register, sql_clean


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------------------------------------ P7, H13, M9: texts

@register("json_texts", """
SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 2 THEN '' ELSE coalesce(text, '') END) AS text_sha256 FROM documents
""")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document given as a record by either key, as a record without a text, and as it is."""
    kind = F.col("doc_id") % 4
    record = (F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("chunk_text"), F.lit("no").alias("text"))))
              .when(kind == 1, F.to_json(F.struct("source", "text"))).when(kind == 2, F.to_json(F.struct("source", "lang")))
              .otherwise(F.col("text")))
    # a record whose first key is null falls back to the second: those documents are given without it
    record = F.when((kind == 0) & F.col("text").isNull(), F.lit("{}")).otherwise(record)
    return tables.documents(spark, sf_dir).select("doc_id", F.sha2(tx.text_of(record), 256).alias("text_sha256"))


_HEAD, _TAIL = tx.REWRITE_PROMPT.split("{query}")


@register("prompts", f"""
SELECT conv_id, turn,
       sha256({literal(tx.ANSWER_INSTRUCTIONS)} || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10)
              || 'Question: ' || role) AS answer_prompt,
       sha256({literal(_HEAD)} || text || {literal(_TAIL)}) AS rewrite_prompt,
       sha256(CASE WHEN turn % 2 = 0 OR text = '' THEN text ELSE 'Summary: ' || role || chr(10) || chr(10)
              || 'Detailed Information:' || chr(10) || text || chr(10) END) AS summary_context
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H13 + M9: prompts of the answer and of the rewriting model, and the context with and without a summary, from every
    turn of ``conversations``."""
    c = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                            F.coalesce("text", F.lit("")).alias("text"))
    summary = F.when(F.col("turn") % 2 != 0, F.col("role"))
    return c.select("conv_id", "turn", F.sha2(tx.instructed_prompt(F.col("text"), F.col("role")), 256).alias("answer_prompt"),
                    F.sha2(tx.rewrite_prompt(F.col("text")), 256).alias("rewrite_prompt"),
                    F.sha2(cx.summary_context(F.col("text"), summary), 256).alias("summary_context"))


# -------------------------------------------------------------------------------------------------- S3, S4: file kinds

KIND_EXTENSIONS = ("md", "PDF", "exe", "", "jpeg", "log")

@register("file_kinds", f"""
WITH f AS (SELECT doc_id, text, doc_id % 6 AS kind, substr(hex(encode(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(1) || chr(0)
                  ELSE '' END)), 1, 16384) AS sample FROM documents),
c AS (SELECT *, regexp_extract_all(sample, '..') AS bytes FROM f)
SELECT doc_id, kind IN (0, 1, 5) OR (len(bytes) > 0 AND NOT list_contains(bytes, '00')
       AND len(list_filter(bytes, lambda b: regexp_matches(b, '^(09|0A|0D|[2-6].|7[0-9A-E])$'))) / len(bytes) > 0.9) AS is_text,
       kind IN (0, 1, 5) AS supported
FROM c
""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4: whether every document is text, by its extension (known ones in any case, others, none) or its first bytes."""
    path = F.lit("/x/file")
    for i, e in enumerate(KIND_EXTENSIONS):
        path = F.when(F.col("doc_id") % len(KIND_EXTENSIONS) == i, F.lit(f"/x/file.{e}" if e else "/x/file")).otherwise(path)
    tail = F.when(F.col("doc_id") % 7 == 0, F.lit("\x01\x00")).otherwise(F.lit(""))
    content = F.concat(F.coalesce("text", F.lit("")), tail).cast("binary")
    ext = F.lower(F.concat(F.lit("."), tx.file_type(path)))
    return tables.documents(spark, sf_dir).select("doc_id", is_text(content, path).alias("is_text"),
                                                  ext.isin(list(tx.SUPPORTED_EXTENSIONS)).alias("supported"))


# ------------------------------------------------------------------------------------------------ S6, S8, P2: the store

@register("store_rows", """
WITH r AS (SELECT 'v' || vec_id::VARCHAR AS id, vec_id % 7 <> 0 AS given FROM embeddings)
SELECT id, false AS existed_before, true AS exists_after, 0::BIGINT AS added_again, 0::BIGINT AS rows_before
FROM (SELECT * FROM r ORDER BY id LIMIT 400) WHERE given
""")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S8 + P2: vectors of ``embeddings`` appended to a store that was not there, every seventh without its vector; the
    rows with a vector among the first 400 by id (the limit is the feature and comes before the filter)."""
    store = ChunkStore(spark, scratch_path(spark, "store-rows"))
    before, rows = store.exists(), store.read().count()
    e = tables.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.lit("t").alias("chunk_text"), F.lit("/f").alias("file_path"),
        F.col("vec_id").alias("chunk_index"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"),
        F.lit(None).cast("array<float>").alias("reduced_embedding"), F.lit("{}").alias("metadata"))
    store.add(e)
    again = store.add(e.where(F.lit(False)))
    return store.with_embeddings(400).select("id", F.lit(before).alias("existed_before"), F.lit(store.exists()).alias("exists_after"),
                                             F.lit(again).cast("long").alias("added_again"), F.lit(rows).cast("long").alias("rows_before"))


# ---------------------------------------------------------------------------------------------------- M7, A12: packing

@register("context_sizes", f"""
WITH d AS (SELECT doc_id // 5 AS query_id, doc_id, 'doc_' || doc_id::VARCHAR || '.txt' AS name, coalesce(text, '') AS text FROM documents),
p AS (SELECT query_id, doc_id, length(text) AS size, {literal(tx.SOURCE_HEADER)} || name || chr(10) || {sql_clean('text')} AS part FROM d)
SELECT query_id, sum(size)::BIGINT AS original_size,
       (sum(length(part)) + (count(*) - 1) * {len(tx.SOURCE_JOINER)})::BIGINT AS repacked_size,
       CASE WHEN sum(size) > 0 THEN round(100.0 * (sum(length(part)) + (count(*) - 1) * {len(tx.SOURCE_JOINER)}) / sum(size), 1) END AS ratio_pct
FROM p GROUP BY query_id
""")
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + A12: every five documents packed as one context without a limit, and the size before and after."""
    d = tables.documents(spark, sf_dir)
    docs = d.select(F.floor(F.col("doc_id") / 5).alias("query_id"), (F.col("doc_id") % 5).alias("pos"),
                    F.concat(F.lit("/s/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
                    F.coalesce("text", F.lit("")).alias("chunk_text"))
    queries = docs.select("query_id").distinct().withColumn("clarified_intent", F.lit("any"))
    return cx.compression(docs, cx.repack(docs, queries, 1 << 30)).select("query_id", "original_size", "repacked_size", "ratio_pct")


# ----------------------------------------------------------------------------- H11, H12, M10, S13, S14, E5: the reducer

@register("reducer_parameters", """
WITH g AS (SELECT lang, source, count(*) AS n, max(n_chars) % 200 + 2 AS dims FROM documents GROUP BY lang, source),
a AS (SELECT *, CASE WHEN 15 >= n THEN greatest(3, (n - 1) // 2) ELSE 15 END AS nn, CASE WHEN 64 >= n THEN least(2, n - 1) ELSE 64 END AS c FROM g)
SELECT lang, source, n::BIGINT AS n, dims::BIGINT AS dims, greatest((dims * 0.1)::DOUBLE // 1, 50)::BIGINT AS optimal,
       (CASE WHEN c >= dims THEN least(dims // 2, 50) ELSE c END)::BIGINT AS n_components, nn::BIGINT AS n_neighbors
FROM a
""")
def reducer_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11 + H12: parameters of a reducer for the size of each language and source of ``documents`` (few groups)."""
    groups = tables.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), (F.max("n_chars") % 200 + 2).alias("dims"))
    found = [(r["lang"], r["source"], r["n"], r["dims"], rd.optimal_dimensions(r["dims"]), *rd.adjust_parameters(r["n"], r["dims"], 64, 15))
             for r in groups.collect()]
    return spark.createDataFrame(found, "lang string, source string, n long, dims long, optimal long, n_components long, n_neighbors long")


@register("reducer_model", """
SELECT true AS missing_before, count(*)::BIGINT AS document_count, count(*)::BIGINT AS valid_count, max(len(embedding))::BIGINT AS input_dims,
       (CASE WHEN max(len(embedding)) <= 64 THEN max(len(embedding)) // 2 ELSE 64 END)::BIGINT AS n_components,
       15::BIGINT AS n_neighbors, 1::BIGINT AS version, count(*)::BIGINT AS processed, true AS same_after_load
FROM embeddings
""")
def reducer_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + M11 + E5 + S13 + S14: a reducer fitted on ``embeddings``, saved with its metadata and loaded; the loaded one
    gives the same vectors."""
    from .jobs import train_reducer
    path = scratch_path(spark, "reducer")
    before = rd.Reducer.load(path) is None
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    own = train_reducer(e, path)
    again = rd.Reducer.load(path)
    a, b = own.transform_column(e), again.transform_column(e)
    same = a.join(b.select("id", F.col("reduced_embedding").alias("other")), "id").agg(
        F.bool_and(F.col("reduced_embedding") == F.col("other")).alias("same_after_load"), F.count("other").alias("processed"))
    m = again.meta
    return same.select(F.lit(before).alias("missing_before"), *[F.lit(int(m[k])).cast("long").alias(k) for k in (
        "document_count", "valid_count", "input_dims", "n_components", "n_neighbors")], F.lit(again.version).cast("long").alias("version"),
        "processed", "same_after_load")
