"""Registered queries: one per operator of the inventory, each over the driver's tables, with its SQL oracle.

Each query is a function ``(spark, sf_dir) -> DataFrame``; ``ORACLE_SQL`` holds the equivalent DuckDB SQL over the
same tables (registered as views by name). Column names are aliased identically on both sides; integers are BIGINT,
reals DOUBLE, rounded to 6 places where they are computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..options import DEFAULTS
from . import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# Shared SQL fragments (DuckDB).
SQL_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def sql_tokens(x: str) -> str:
    return SQL_TOKENS.format(x=x)


# ------------------------------------------------------------------------------------------------------ J2, K2, W1

BM25_SQL = f"""
WITH docs AS (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM docs),
post AS (SELECT id, dl, term, count(*) AS tf
         FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY id, dl, term),
qt AS (SELECT DISTINCT query_id, term
       FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark)),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT q.query_id, p.id,
              round(sum(ln(1.0::DOUBLE + (st.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))
                        * p.tf * 2.2::DOUBLE
                        / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / st.avgdl))), 6) AS score
       FROM qt q JOIN post p ON p.term = q.term JOIN dfs d ON d.term = q.term CROSS JOIN st
       GROUP BY q.query_id, p.id)
SELECT query_id, id AS doc_id, score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
WHERE rank <= 20
"""


@register("bm25_documents", BM25_SQL)
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 20 documents for every benchmark question."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    qs = tables.benchmark_questions(spark, sf_dir)
    hits = search.bm25_search(docs, qs, 20, opts=DEFAULTS)
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------------------------------ E3 flagship: answers

def chunk_table(spark: SparkSession, sf_dir: str, opts=None, materialize: bool = True):
    """Chunk table over ``documents`` (fixed windows unless opts say otherwise), written as Parquet to the shared
    scratch folder when it is read several times: each read takes only the columns it needs."""
    from ..operators.chunks import build_chunk_table
    from ..session import scratch_path
    opts = opts or SQL_CHUNKING
    t = build_chunk_table(tables.document_files(spark, sf_dir), opts)
    if not materialize:
        return t
    path = scratch_path(spark, "chunks")
    t.write.parquet(path)
    return spark.read.schema(t.schema).parquet(path)


# The SQL-checked queries use the separator-free splitter (fixed windows of 512 with overlap 50), the form SQL can
# express; the recursive splitter is checked by invariants (tests) and by its own rows-only query.
SQL_CHUNKING = DEFAULTS.with_(separators=("",))

SQL_BLANK = r"(text IS NULL OR length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) = 0)"

SQL_CHUNKS = rf"""
docs AS (SELECT doc_id, '/' || source || '/doc_' || doc_id::VARCHAR || '.txt' AS file_path, text
         FROM documents WHERE NOT {SQL_BLANK}),
ch0 AS (SELECT file_path, text,
               unnest(range(0, (1 + ceil(greatest(length(text) - 512, 0) / 462.0))::BIGINT)) AS i FROM docs),
ch AS (SELECT sha256(file_path || '|' || i::VARCHAR || '|' || substring(text, (i * 462 + 1)::BIGINT, 512)) AS id,
              substring(text, (i * 462 + 1)::BIGINT, 512) AS chunk_text, file_path, i::BIGINT AS chunk_index
       FROM ch0)"""


def sql_hash_embed(src: str, key: str, text: str, dim: int, name: str) -> str:
    """CTEs ``{name}`` (key, vec DOUBLE[dim]) of the hashed embedding: same tokens, md5 buckets and signs, float32
    rounding of the normalised values, null (no row) for texts without tokens."""
    return rf"""
{name}_t AS (SELECT {key} AS k, unnest({sql_tokens(text)}) AS t FROM {src}),
{name}_b AS (SELECT k, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS b,
                    CASE WHEN (('0x' || substr(md5(t), 9, 1))::INT % 2) = 0 THEN 1 ELSE -1 END AS s FROM {name}_t),
{name}_v AS (SELECT k, b, sum(s)::DOUBLE AS v FROM {name}_b GROUP BY k, b),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS nrm FROM {name}_v GROUP BY k HAVING sqrt(sum(v * v)) > 0),
{name}_g AS (SELECT n.k, g.b, coalesce((v.v / n.nrm)::FLOAT::DOUBLE, 0.0) AS x
             FROM {name}_n n CROSS JOIN range(0, {dim}) g(b) LEFT JOIN {name}_v v ON v.k = n.k AND v.b = g.b),
{name} AS (SELECT k, list(x ORDER BY b) AS vec FROM {name}_g GROUP BY k)"""


SQL_CLEAN = r"trim(regexp_replace(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g'), '\.{{4,}}', '...', 'g'))"


def sql_clean(x: str) -> str:
    return SQL_CLEAN.format(x=x)


RERANK_SQL = r"""
dd AS (SELECT r.*, q.query_text,
              row_number() OVER (PARTITION BY r.query_id, sha256(coalesce(r.chunk_text, '')) ORDER BY r.pos) AS dup
       FROM ranked0 r JOIN qs q USING (query_id)),
dterms AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(query_text), '[^a-zA-Z0-9_]+'),
                                               lambda t: length(t) >= 3)) AS terms FROM dd WHERE dup = 1),
rs AS (SELECT *, CASE WHEN len(terms) > 0
                      THEN len(list_filter(terms, lambda t: contains(lower(coalesce(chunk_text, '')), t)))
                           / len(terms)
                      ELSE 0.0 END AS rerank_score FROM dterms),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS npos FROM rs),
ranked AS (SELECT * EXCLUDE (pos, npos), npos AS pos FROM rr WHERE npos <= 6),"""

# The question as it is: what analysis gives without a rewriter.
SQL_PLAIN = {"clarified": "query_text", "need": "'moderate'", "subs": "[query_text]"}


def rag_sql(questions: str, rerank: bool = False, analysis: dict = SQL_PLAIN, top_k: int = 3, chars: int = 8000) -> str:
    """DuckDB SQL of the answer job; ``questions`` selects (query_id, query_text), ``analysis`` holds the expressions of
    the clarified question, the context need and the sub-queries."""
    ranked = RERANK_SQL if rerank else "ranked AS (SELECT * FROM ranked0),"
    return rf"""
WITH {SQL_CHUNKS},
qs AS ({questions}),
an AS (SELECT query_id, query_text, {analysis["clarified"]} AS clarified, {analysis["need"]} AS need,
              {analysis["subs"]} AS subs FROM qs),
sq AS (SELECT query_id, sub_idx, sub_query, query_id::VARCHAR || ':' || sub_idx::VARCHAR AS qk
       FROM (SELECT query_id, unnest(subs) AS sub_query, generate_subscripts(subs, 1) - 1 AS sub_idx FROM an)),
{sql_hash_embed('ch', 'id', 'chunk_text', 256, 'cv')},
{sql_hash_embed('sq', 'qk', 'sub_query', 256, 'qv')},
vd AS (SELECT q.k AS qk, c.k AS id, round(list_distance(q.vec, c.vec), 6) AS distance
       FROM qv q CROSS JOIN cv c),
vh AS (SELECT qk, id, distance, row_number() OVER (PARTITION BY qk ORDER BY distance, id) AS rank FROM vd),
cdoc AS (SELECT id, {sql_tokens('chunk_text')} AS t FROM ch),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM cdoc),
post AS (SELECT id, dl, term, count(*) AS tf
         FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM cdoc) GROUP BY id, dl, term),
qt AS (SELECT DISTINCT qk, term FROM (SELECT qk, unnest({sql_tokens('sub_query')}) AS term FROM sq)),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
fsc AS (SELECT q.qk, p.id,
               round(sum(ln(1.0::DOUBLE + (st.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))
                         * p.tf * 2.2::DOUBLE
                         / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / st.avgdl))), 6) AS score
        FROM qt q JOIN post p ON p.term = q.term JOIN dfs d ON d.term = q.term CROSS JOIN st
        GROUP BY q.qk, p.id),
fh AS (SELECT qk, id, row_number() OVER (PARTITION BY qk ORDER BY score DESC, id) AS rank FROM fsc),
hits AS (SELECT query_id, id, rank, distance, ((sub_idx * 2) * 100 + rank)::BIGINT AS seq
         FROM vh JOIN sq USING (qk) WHERE rank <= 20
         UNION ALL
         SELECT query_id, id, rank, 0.1::DOUBLE + 0.05::DOUBLE * (rank - 1), ((sub_idx * 2 + 1) * 100 + rank)::BIGINT
         FROM fh JOIN sq USING (qk) WHERE rank <= 20),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (20.0::DOUBLE + 100.0::DOUBLE * distance)) AS score,
                 min(seq) AS seq, arg_min(distance, seq) AS distance FROM hits GROUP BY query_id, id),
ranked0 AS (SELECT f.*, c.chunk_text, c.file_path, c.chunk_index,
                  row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 9) DESC, f.seq, f.id) AS pos
           FROM fused f JOIN ch c ON c.id = f.id),
{ranked}
ctx AS (SELECT ranked.* FROM ranked JOIN an USING (query_id)
        WHERE pos <= least({top_k}, CASE need WHEN 'extensive' THEN 5 WHEN 'moderate' THEN 4 ELSE 3 END)),
grp AS (SELECT query_id, coalesce(file_path, 'unknown') AS src, min(pos) AS fpos,
               string_agg(CASE WHEN coalesce(chunk_text, '') <> '' THEN chunk_text END, ' ... ' ORDER BY pos) AS j
        FROM ctx GROUP BY 1, 2),
parts AS (SELECT query_id, fpos, 'Source: ' || regexp_extract(src, '([^/]*)/*$', 1) || chr(10)
                 || {sql_clean("coalesce(j, '')")} AS part FROM grp),
packed0 AS (SELECT query_id,
                   string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY fpos) AS full
            FROM parts GROUP BY query_id),
sl AS (SELECT p.query_id, q.clarified AS query_text,
              list_filter(string_split(regexp_replace(p.full, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'),
                                       chr(1)), lambda s: s <> '') AS l
       FROM packed0 p JOIN an q USING (query_id) WHERE length(p.full) > {chars}),
sents AS (SELECT query_id, query_text, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM sl),
scored AS (SELECT query_id, s, pos,
                  len(list_filter(list_filter(string_split_regex(lower(query_text), '[^a-zA-Z0-9_]+'),
                                              lambda t: length(t) >= 3), lambda t: contains(lower(s), t))) AS score
           FROM sents),
run AS (SELECT *, sum(length(s)) OVER (PARTITION BY query_id ORDER BY score DESC, pos
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM scored),
trimmed AS (SELECT query_id, string_agg(s, ' ' ORDER BY score DESC, pos) AS t FROM run WHERE total <= {chars}
            GROUP BY query_id),
packed AS (SELECT p.query_id, CASE WHEN length(p.full) > {chars} THEN coalesce(t.t, '') ELSE p.full END AS context
           FROM packed0 p LEFT JOIN trimmed t USING (query_id)),
srcs AS (SELECT query_id, string_agg(file_path || '#' || chunk_index::VARCHAR, ';' ORDER BY pos) AS sources,
                count(*) AS n_sources FROM ctx WHERE file_path IS NOT NULL GROUP BY query_id),
conf AS (SELECT query_id, round(greatest(1.0 - avg(distance) / 2.0, 0.0) * 100.0, 1) AS confidence
         FROM ranked WHERE pos <= {top_k} GROUP BY query_id),
cst AS (SELECT query_id, count(*) AS n_candidates, count(DISTINCT file_path) AS unique_sources
        FROM ranked0 GROUP BY query_id)
SELECT q.query_id, q.query_text AS query, q.clarified,
       CASE WHEN coalesce(c.n_candidates, 0) > 0
            THEN 'Based on the retrieved information:' || chr(10) || chr(10)
                 || substring(coalesce(p.context, ''), 1, 501) || '...'
            ELSE 'No relevant documents found in the database.' END AS answer,
       CASE WHEN coalesce(c.n_candidates, 0) > 0 THEN coalesce(s.sources, '') ELSE '' END AS sources,
       coalesce(s.n_sources, 0)::BIGINT AS n_sources,
       coalesce(f.confidence, 0.0)::DOUBLE AS confidence,
       coalesce(c.n_candidates, 0)::BIGINT AS n_candidates,
       coalesce(c.unique_sources, 0)::BIGINT AS unique_sources,
       len(q.subs)::BIGINT AS n_sub_queries
FROM an q LEFT JOIN packed p USING (query_id) LEFT JOIN srcs s USING (query_id)
     LEFT JOIN conf f USING (query_id) LEFT JOIN cst c USING (query_id)
"""


BENCH_Q = "SELECT item_id AS query_id, text AS query_text FROM benchmark"
CONV_Q = ("SELECT conv_id * 1000 + turn AS query_id, text AS query_text FROM conversations "
          "WHERE role = 'user'")


@register("rag_answers", rag_sql(BENCH_Q))
def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer every benchmark question (rewriting fallback, hybrid retrieval, fusion, packing, answer)."""
    from .query import answer_questions
    chunks = chunk_table(spark, sf_dir, SQL_CHUNKING)
    return answer_questions(chunks, tables.benchmark_questions(spark, sf_dir), SQL_CHUNKING)


@register("rag_answers_rerank", rag_sql(BENCH_Q, rerank=True))
def rag_answers_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with re-ranking on: duplicate texts dropped (A5), default pair scorer (M5), best top_k*2 kept (K4)."""
    from .query import answer_questions
    opts = SQL_CHUNKING.with_(enable_reranking=True)
    chunks = chunk_table(spark, sf_dir, opts)
    return answer_questions(chunks, tables.benchmark_questions(spark, sf_dir), opts)


@register("rag_answers_conversations", rag_sql(CONV_Q))
def rag_answers_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 over the user turns of ``conversations`` (J7: a second, larger question batch)."""
    from .query import answer_questions
    chunks = chunk_table(spark, sf_dir, SQL_CHUNKING)
    return answer_questions(chunks, tables.conversation_questions(spark, sf_dir), SQL_CHUNKING)


@register("rag_answers_direct", rag_sql(BENCH_Q, analysis=SQL_PLAIN | {"need": "'general'"}, top_k=4))
def rag_answers_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with rewriting off (M4): context need 'general', three documents although ``top_k`` is four."""
    from .query import answer_questions
    opts = SQL_CHUNKING.with_(enable_rewriting=False, top_k=4)
    return answer_questions(chunk_table(spark, sf_dir, opts), tables.benchmark_questions(spark, sf_dir), opts)


# Sub-queries are the clauses of three words or more, after the whole question unless it is one of them.
SQL_STRIPPED = r"regexp_replace({x}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r\x00]+$', '', 'g')"
SQL_CLAUSES = (r"list_filter(list_transform(string_split_regex(query_text, '[.,;:!?]+'), lambda x: "
               + SQL_STRIPPED.format(x="x") + r"), lambda x: len(string_split_regex(x, '[ \t\n\x0B\f\r]+')) >= 3)")
SQL_BY_CLAUSE = {
    "clarified": sql_clean("query_text"),
    "need": f"CASE WHEN len({SQL_CLAUSES}) >= 6 THEN 'extensive' WHEN len({SQL_CLAUSES}) >= 3 THEN 'moderate' ELSE 'minimal' END",
    "subs": f"CASE WHEN list_contains({SQL_CLAUSES}, query_text) THEN {SQL_CLAUSES} "
            f"ELSE list_concat([query_text], {SQL_CLAUSES}) END",
}


@register("rag_answers_subqueries", rag_sql(BENCH_Q, analysis=SQL_BY_CLAUSE, top_k=4, chars=1200))
def rag_answers_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with a rewriter that asks for each clause of a question (M3, U1, U2, A4, W2 over several sub-queries), context
    needs on both sides of ``top_k`` (P13) and a budget that contexts exceed (H10, M8)."""
    from ..operators.fusion import ClauseRewriter
    from .query import answer_questions
    opts = SQL_CHUNKING.with_(top_k=4, max_context_tokens=300)
    chunks = chunk_table(spark, sf_dir, opts)
    return answer_questions(chunks, tables.benchmark_questions(spark, sf_dir), opts, rewriter=ClauseRewriter())


# ----------------------------------------------------------------------------------------------- E2, P11: search

SEARCH_SQL = rf"""
WITH {SQL_CHUNKS},
qs AS ({BENCH_Q}),
{sql_hash_embed('ch', 'id', 'chunk_text', 256, 'cv')},
{sql_hash_embed('qs', 'query_id', 'query_text', 256, 'qv')},
vd AS (SELECT q.k AS query_id, c.k AS id, round(list_distance(q.vec, c.vec), 6) AS distance FROM qv q CROSS JOIN cv c),
vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM vd QUALIFY rank <= 5)
SELECT vh.query_id, vh.rank::BIGINT AS rank, vh.id, ch.file_path, ch.chunk_index, vh.distance,
       regexp_replace(substring(ch.chunk_text, 1, 201), '[ \t\n\x0B\f\r]+', ' ', 'g') || '...' AS preview
FROM vh JOIN ch USING (id)
"""


@register("search_chunks", SEARCH_SQL)
def search_chunks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest chunks of every benchmark question, with a preview."""
    from .query import search_chunks
    chunks = chunk_table(spark, sf_dir, SQL_CHUNKING)
    return search_chunks(chunks, tables.benchmark_questions(spark, sf_dir), 5, SQL_CHUNKING)


# ------------------------------------------------------------------------------------------- J1, W1, K1, H16: kNN

KNN_SQL = """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
                  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
           FROM embeddings a CROSS JOIN embeddings b
           WHERE len(a.embedding) > 0 AND len(a.embedding) = len(b.embedding))
SELECT query_id, neighbor_id, distance, rank::BIGINT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
WHERE rank <= 10
"""


@register("knn_embeddings", KNN_SQL)
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector in ``embeddings`` (the neighbour graph), exact L2."""
    e = tables.table(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), "embedding")
    qs = e.select(F.col("vec_id").alias("query_id"), "embedding")
    r = search.knn_search(items, qs, 10, opts=DEFAULTS)
    return r.select("query_id", F.col("id").alias("neighbor_id"), "distance", F.col("rank").cast("long").alias("rank"))


def _knn_sql(distance: str, src: str = "embeddings", extra: str = "TRUE", pre: str = "", key: str = "vec_id") -> str:
    return f"""
WITH {pre} d AS (SELECT a.{key} AS query_id, b.{key} AS neighbor_id, round({distance}, 6) + 0.0 AS distance
           FROM {src} a CROSS JOIN {src} b
           WHERE len(a.embedding) > 0 AND len(a.embedding) = len(b.embedding) AND {extra})
SELECT query_id, neighbor_id, distance, rank::BIGINT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
WHERE rank <= 10
"""


def _knn(spark: SparkSession, sf_dir: str, frame: DataFrame | None = None, **kw) -> DataFrame:
    e = frame if frame is not None else tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    r = search.knn_search(e, e.withColumnRenamed("id", "query_id"), 10, **kw)
    return r.select("query_id", F.col("id").alias("neighbor_id"), "distance", F.col("rank").cast("long").alias("rank"))


@register("knn_blocked", _knn_sql("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def knn_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with blocks of queries against blocks of items, as for query sets beyond the broadcast bound."""
    return _knn(spark, sf_dir, opts=DEFAULTS.with_(knn_broadcast_bytes=64 << 10, knn_items_per_block=150))


@register("knn_cosine", _knn_sql("1.0::DOUBLE - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + H16: cosine distance."""
    return _knn(spark, sf_dir, metric="cosine")


@register("knn_dot", _knn_sql("-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + H16: negative dot product."""
    return _knn(spark, sf_dir, metric="dot")


@register("bm25_blocked", BM25_SQL)
def bm25_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with small blocks of rows and of questions, as for large question sets."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    hits = search.bm25_search(docs, tables.benchmark_questions(spark, sf_dir), 20,
                              opts=DEFAULTS.with_(bm25_rows_per_block=90, bm25_queries_per_block=16))
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


# --------------------------------------------------------------------------------------- H1 (fixed), W3, S5, H7

FIXED_CHUNKS_SQL = rf"""
WITH {SQL_CHUNKS},
tot AS (SELECT file_path, count(*) AS total_chunks FROM ch GROUP BY file_path)
SELECT id, file_path, chunk_index, total_chunks, length(chunk_text)::BIGINT AS chunk_size,
       regexp_extract(file_path, '([^/]*)/*$', 1) AS file_name,
       coalesce(nullif(lower(regexp_extract(regexp_extract(file_path, '([^/]*)/*$', 1), '^.+\.([^.]+)$', 1)), ''),
                'unknown') AS file_type
FROM ch JOIN tot USING (file_path)
"""


@register("fixed_chunks", FIXED_CHUNKS_SQL)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (separator-free form) + W3 + S5: every chunk of every non-blank document, with its metadata fields."""
    from ..operators.chunks import chunk_files
    from ..functions.text import basename, file_type
    c = chunk_files(tables.document_files(spark, sf_dir), SQL_CHUNKING)
    return c.select("id", "file_path", "chunk_index", "total_chunks", "chunk_size",
                    basename(F.col("file_path")).alias("file_name"), file_type(F.col("file_path")).alias("file_type"))


@register("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (recursive separators, the indexing default): chunk rows of every document (invariants in tests)."""
    from ..operators.chunks import chunk_files
    c = chunk_files(tables.document_files(spark, sf_dir), DEFAULTS)
    return c.select("id", "file_path", "chunk_index", "total_chunks", "chunk_size")


MIXED_SQL = rf"""
WITH {SQL_CHUNKS},
inl AS (SELECT text, unnest(range(0, (1 + ceil(greatest(length(text) - 512, 0) / 462.0))::BIGINT)) AS i
        FROM benchmark WHERE NOT {SQL_BLANK}),
every AS (SELECT id, file_path, chunk_index, length(chunk_text) AS n FROM ch
          UNION ALL
          SELECT sha256('inline_text|' || i::VARCHAR || '|' || substring(text, (i * 462 + 1)::BIGINT, 512)), 'inline_text', i,
                 length(substring(text, (i * 462 + 1)::BIGINT, 512)) FROM inl)
SELECT id, file_path, chunk_index::BIGINT AS chunk_index, n::BIGINT AS chunk_size FROM every
"""


@register("mixed_chunks", MIXED_SQL)
def mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts (``benchmark``) and records with a path in their metadata (``documents``) chunked as one input."""
    from ..operators.chunks import chunk_mixed
    texts = tables.table(spark, sf_dir, "benchmark").select("text")
    records = tables.document_files(spark, sf_dir).select("text", F.to_json(F.struct("file_path")).alias("metadata"))
    return chunk_mixed(spark, texts=texts, docs=records, opts=SQL_CHUNKING).select("id", "file_path", "chunk_index", "chunk_size")


RECURSIVE_SQL = f"""
SELECT doc_id, true AS substrings, true AS sized, true AS from_start, true AS to_end, true AS enough
FROM documents WHERE NOT {SQL_BLANK}
"""


@register("recursive_invariants", RECURSIVE_SQL)
def recursive_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (recursive separators): per document, whether its chunks are substrings of at most the chunk size, start and
    end with the text, and are long enough together to cover it."""
    from ..functions.chunking import chunk_array
    from ..functions.text import is_blank
    d = tables.documents(spark, sf_dir).where(~is_blank(F.col("text")))
    d = d.select("doc_id", "text", chunk_array(F.col("text"), DEFAULTS.chunk_size, DEFAULTS.chunk_overlap,
                                               DEFAULTS.separators).alias("c"))
    return d.select("doc_id", F.forall("c", lambda x: F.instr(F.col("text"), x) > 0).alias("substrings"),
                    F.forall("c", lambda x: F.length(x).between(1, DEFAULTS.chunk_size)).alias("sized"),
                    F.col("text").startswith(F.element_at("c", 1)).alias("from_start"),
                    F.col("text").endswith(F.element_at("c", -1)).alias("to_end"),
                    (F.aggregate("c", F.lit(0), lambda n, x: n + F.length(x)) >= F.length("text")).alias("enough"))


METADATA_SQL = rf"""
WITH {SQL_CHUNKS},
tot AS (SELECT file_path, count(*) AS total_chunks FROM ch GROUP BY file_path)
SELECT id, CASE WHEN file_path LIKE '/src3/%' THEN 0 ELSE 6 END::BIGINT AS n_fields,
       CASE WHEN file_path NOT LIKE '/src3/%' THEN regexp_extract(file_path, '([^/]*)/*$', 1) END AS file_name,
       CASE WHEN file_path NOT LIKE '/src3/%' THEN chunk_index::VARCHAR || '/' || total_chunks::VARCHAR END AS place
FROM ch JOIN tot USING (file_path)
"""


@register("chunk_metadata", METADATA_SQL)
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from every chunk's metadata JSON; the chunks of one source have none."""
    from ..functions.text import metadata_fields
    from ..operators.chunks import chunk_files
    c = chunk_files(tables.document_files(spark, sf_dir), SQL_CHUNKING)
    m = metadata_fields(F.when(~F.col("file_path").startswith("/src3/"), F.col("metadata")))
    c = c.select("id", m.alias("m"))
    return c.select("id", F.size("m").cast("long").alias("n_fields"), F.col("m")["file_name"].alias("file_name"),
                    F.concat_ws("/", F.col("m")["chunk_index"], F.col("m")["total_chunks"]).alias("p")) \
        .select("id", "n_fields", "file_name", F.when(F.col("p") != "", F.col("p")).alias("place"))


# ------------------------------------------------------------------------------------ A1, A2, E6: index statistics

STATS_SQL = rf"""
WITH {SQL_CHUNKS},
emb AS (SELECT * FROM ch WHERE len({sql_tokens('chunk_text')}) > 0)
SELECT count(*)::BIGINT AS total_chunks,
       (count(DISTINCT file_path) + max(CASE WHEN file_path IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_files,
       count(*)::BIGINT AS with_embeddings,
       0::BIGINT AS with_reduced_embeddings,
       round(avg(length(chunk_text)))::BIGINT AS avg_chunk_size,
       round(sum(length(chunk_text)) / 1024.0 / 1024.0, 2)::DOUBLE AS total_size_mb,
       256::BIGINT AS embedding_dims
FROM emb
"""


@register("index_stats", STATS_SQL)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the chunk table built from ``documents``."""
    from ..sources.store import stats
    return stats(chunk_table(spark, sf_dir, SQL_CHUNKING, materialize=False)).drop("reduced_dims")


# ----------------------------------------------------------------------------- H2-H4, H9, P1, P11: text functions

TEXT_SQL = rf"""
SELECT doc_id,
       CASE WHEN {SQL_BLANK} THEN 1 ELSE 0 END::BIGINT AS is_blank,
       md5({sql_clean('text')}) AS clean_md5,
       length({sql_clean('text')})::BIGINT AS clean_len,
       len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)),
                       lambda s: s <> ''))::BIGINT AS n_sentences,
       len(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda t: length(t) >= 3))::BIGINT
           AS n_query_terms,
       len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: length(w) > 3))::BIGINT AS n_key_terms,
       CASE WHEN length(text) > 100 THEN substring(text, 1, 101) || '...' ELSE text END AS sample,
       regexp_replace(substring(text, 1, 201), '[ \t\n\x0B\f\r]+', ' ', 'g') || '...' AS preview
FROM documents
"""


@register("text_functions", TEXT_SQL)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 clean, H3 query terms, H4 sentences, H9 key terms, P1 blank test, P11 previews -- per document."""
    from ..functions import text as tx
    d = tables.documents(spark, sf_dir)
    t = F.col("text")
    return d.select("doc_id", tx.is_blank(t).cast("long").alias("is_blank"), F.md5(tx.clean_text(t)).alias("clean_md5"),
                    F.length(tx.clean_text(t)).cast("long").alias("clean_len"),
                    F.size(tx.split_sentences(t)).cast("long").alias("n_sentences"),
                    F.size(tx.query_terms(t)).cast("long").alias("n_query_terms"),
                    F.size(tx.fallback_key_terms(t)).cast("long").alias("n_key_terms"),
                    tx.topic_sample(t).alias("sample"), tx.preview(t).alias("preview"))


TRIM_SQL = rf"""
WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS q FROM documents WHERE NOT {SQL_BLANK}),
sl AS (SELECT doc_id, q, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'),
                                                 chr(1)), lambda s: s <> '') AS l FROM d),
sents AS (SELECT doc_id, q, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM sl),
scored AS (SELECT doc_id, s, pos,
                  len(list_filter(list_filter(string_split_regex(lower(q), '[^a-zA-Z0-9_]+'), lambda t: length(t) >= 3),
                                  lambda t: contains(lower(s), t))) AS score FROM sents),
run AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM scored),
t AS (SELECT doc_id, string_agg(s, ' ' ORDER BY score DESC, pos) AS trimmed FROM run WHERE total <= 500 GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(t.trimmed, '')) AS trimmed_md5, length(coalesce(t.trimmed, ''))::BIGINT AS trimmed_len
FROM d LEFT JOIN t USING (doc_id)
"""


@register("trim_documents", TRIM_SQL)
def trim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 (H3, H4, H5, W4): every document trimmed to 500 characters most relevant to its own first line."""
    from ..operators.context import trim_to_relevant
    from ..functions.text import is_blank
    d = tables.documents(spark, sf_dir).where(~is_blank(F.col("text")))
    q = F.element_at(F.split(F.col("text"), "\n"), 1)
    tr = trim_to_relevant(F.col("text"), q, 500)
    return d.select("doc_id", F.md5(tr).alias("trimmed_md5"), F.length(tr).cast("long").alias("trimmed_len"))


THINK_SQL = r"""
WITH t AS (SELECT conv_id, turn, text, length(text) % 4 AS form FROM conversations),
a AS (SELECT conv_id, turn, CASE form WHEN 0 THEN '<think>' || role_hint || chr(10) || 'x</think>' || chr(10) || text || ' <think></think>'
                                      WHEN 1 THEN '  ' || text || '<think>open'
                                      WHEN 2 THEN text || '</think>'
                                      ELSE text END AS x
      FROM (SELECT *, substring(text, 1, 20) AS role_hint FROM t))
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'),
                          '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r\x00]+$', '', 'g')) AS answer_md5
FROM a
"""


@register("strip_think", THINK_SQL)
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 over every turn of ``conversations``, given blocks, open and closing tags by the turn's length."""
    from ..functions.text import strip_think_tags
    t, form = F.col("text"), F.length("text") % 4
    x = (F.when(form == 0, F.concat(F.lit("<think>"), F.substring(t, 1, 20), F.lit("\nx</think>\n"), t, F.lit(" <think></think>")))
         .when(form == 1, F.concat(F.lit("  "), t, F.lit("<think>open")))
         .when(form == 2, F.concat(t, F.lit("</think>"))).otherwise(t))
    c = tables.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(strip_think_tags(x)).alias("answer_md5"))


SUMMARY_CLEAN_SQL = r"""
WITH t AS (SELECT conv_id, turn, CASE length(text) % 5 WHEN 0 THEN ' Summary: ' || text WHEN 1 THEN 'topic:' || chr(10) || text
                  WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE text END AS x, 'Documents about ' || role || ' and turn' AS f
           FROM conversations),
w AS (SELECT *, regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r\x00]+$', '', 'g') AS y FROM t),
l AS (SELECT *, CASE WHEN y = '' THEN 'Related documents'
                     ELSE regexp_replace(split_part(y, chr(10), 1), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r\x00]+$', '', 'g') END AS z FROM w),
c AS (SELECT *, regexp_replace(regexp_replace(z, '(?i)^(Summary:|Topic:|Documents:)', ''),
                               '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r\x00]+$', '', 'g') AS v FROM l)
SELECT conv_id, turn, CASE WHEN v IS NULL OR v = '' THEN f ELSE v END AS summary FROM c
"""


@register("topic_summary_texts", SUMMARY_CLEAN_SQL)
def topic_summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H14 over the turns of ``conversations`` as model answers: with prefixes, blank and failed ones."""
    from ..functions.text import clean_topic_summary
    t, form = F.col("text"), F.length("text") % 5
    x = (F.when(form == 0, F.concat(F.lit(" Summary: "), t)).when(form == 1, F.concat(F.lit("topic:\n"), t))
         .when(form == 2, F.lit("  ")).when(form == 3, F.lit(None)).otherwise(t))
    c = tables.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", clean_topic_summary(x, F.array(F.col("role"), F.lit("turn"))).alias("summary"))


# --------------------------------------------------------------------------------------------------- S2: HTML text

HTML_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h,
        '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
        '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
        '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM b),
d0 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
        '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'),
        '&middot;?', '·', 'g') AS h FROM c),
d AS (SELECT page_id, regexp_replace(replace(replace(h, '&#39;', ''''), '&apos;', ''''), '&amp;?', '&', 'g') AS h FROM d0),
e AS (SELECT page_id, trim(regexp_replace(h, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM d)
SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS text_len, substring(t, 1, 80) AS head FROM e
"""


@register("html_text", HTML_SQL)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page in ``pages``."""
    from ..sources.files import html_to_text
    from ..util import small_batches
    small_batches(spark)
    p = tables.table(spark, sf_dir, "pages")
    t = html_to_text(F.col("html"))
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("text_len"),
                    F.substring(t, 1, 80).alias("head"))


# ---------------------------------------------------------------------------------------- A8, P3, P4: quality

# The vectors of ``embeddings``, those of some labels made missing, short, or given a null, NaN or infinite element, so
# that every class of vector occurs.
DIRTY_SQL = """dirty AS (SELECT vec_id, CASE label % 10 WHEN 3 THEN NULL WHEN 4 THEN []::DOUBLE[]
    WHEN 5 THEN list_concat((embedding::DOUBLE[])[2:], ['nan'::DOUBLE]) WHEN 6 THEN list_concat((embedding::DOUBLE[])[2:], ['inf'::DOUBLE])
    WHEN 7 THEN list_concat((embedding::DOUBLE[])[2:], [NULL::DOUBLE]) WHEN 8 THEN (embedding::DOUBLE[])[2:]
    ELSE embedding::DOUBLE[] END AS embedding FROM embeddings)"""


def dirty_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding array<double>) as ``DIRTY_SQL``."""
    e, v = F.col("label") % 10, F.col("embedding").cast("array<double>")
    rest = F.slice(v, 2, F.size(v))
    bad = (F.when(e == 3, F.lit(None)).when(e == 4, F.array().cast("array<double>"))
           .when(e == 5, F.concat(rest, F.array(F.lit(float("nan"))))).when(e == 6, F.concat(rest, F.array(F.lit(float("inf")))))
           .when(e == 7, F.concat(rest, F.array(F.lit(None).cast("double")))).when(e == 8, rest).otherwise(v))
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bad.alias("embedding"))


QUALITY_SQL = f"""
WITH {DIRTY_SQL},
c AS (SELECT embedding AS e,
                  CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'missing'
                       WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL)) THEN 'invalid'
                       WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x))) THEN 'nan'
                       WHEN list_bool_or(list_transform(embedding, lambda x: isinf(x))) THEN 'infinite'
                       ELSE 'valid' END AS c FROM dirty),
dims AS (SELECT len(e) AS d, count(*) AS n FROM c WHERE c <> 'missing' GROUP BY 1 ORDER BY n DESC, d LIMIT 1)
SELECT count(*)::BIGINT AS total, count_if(c = 'missing')::BIGINT AS missing, count_if(c = 'invalid')::BIGINT AS invalid,
       count_if(c = 'nan')::BIGINT AS nan, count_if(c = 'infinite')::BIGINT AS infinite,
       count_if(c = 'valid')::BIGINT AS valid, (SELECT d FROM dims)::BIGINT AS common_dim
FROM c
"""


@register("embedding_quality", QUALITY_SQL)
def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + P3 + P4: vector quality counts and the most common dimension, every class of bad vector occurring."""
    from ..operators import reduce as rd
    e = dirty_embeddings(spark, sf_dir)
    dim = rd.most_common_dim(e)
    return rd.quality_counts(e).withColumn("common_dim", F.lit(dim).cast("long"))


_FINITE = ("NOT list_bool_or(list_transform({x}.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))")


@register("knn_dirty", _knn_sql("list_distance(a.embedding, b.embedding)", "dirty",
                                f"{_FINITE.format(x='a')} AND {_FINITE.format(x='b')}", DIRTY_SQL + ","))
def knn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + P3 over vectors of every class: missing, empty, short, with null, NaN and infinite elements."""
    return _knn(spark, sf_dir, dirty_embeddings(spark, sf_dir))


# A11 over a model trained on the documents of all but two languages.
STALE_SQL = """
WITH c AS (SELECT round(100.0 * count_if(lang IN ('en', 'fr')) / count(*), 1)::DOUBLE AS coverage FROM documents)
SELECT coverage AS coverage_percentage, 100.0 - coverage AS staleness_percentage, 100.0 - coverage > 30 AS needs_retraining,
       CASE WHEN 100.0 - coverage > 30 THEN 'Model covers only ' || coverage::VARCHAR || '% of documents'
            ELSE 'Model is up to date' END AS reason FROM c
"""


@register("reducer_staleness", STALE_SQL)
def reducer_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on a model trained on the documents of two languages, over all documents."""
    from ..operators.reduce import staleness
    d = tables.table(spark, sf_dir, "documents")
    trained = d.where(F.col("lang").isin("en", "fr")).agg(F.count(F.lit(1)).alias("document_count"))
    return staleness(trained, d)


# -------------------------------------------------------------------------------------------- P5, K6: paging

PAGE_SQL = """
SELECT vec_id AS id, len(embedding)::BIGINT AS dims, label::BIGINT AS label
FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100
"""


@register("embedding_page", PAGE_SQL)
def embedding_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5/K6: the page of 50 vectors after the first 100, by id (paging is the feature here)."""
    from ..sources.store import page
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return page(e, "id", 50, 100).select("id", F.size("embedding").cast("long").alias("dims"),
                                         F.col("label").cast("long").alias("label"))


# -------------------------------------------------------------------------------------------- P6, J5: by ids

BY_IDS_SQL = """
SELECT doc_id, n_chars, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
"""


@register("documents_by_ids", BY_IDS_SQL)
def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id appears in ``labels`` (a semi-join)."""
    from ..sources.store import by_ids
    d = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "n_chars", "lang")
    ids = tables.table(spark, sf_dir, "labels").select("doc_id")
    return by_ids(d, ids).select(F.col("id").alias("doc_id"), "n_chars", "lang")


# ------------------------------------------------------------------------------------- S9, J3: update vectors

UPDATE_SQL = """
WITH t AS (SELECT vec_id AS id, embedding, NULL::FLOAT[] AS reduced_embedding FROM embeddings),
u AS (SELECT vec_id AS id, embedding[1:8] AS reduced_embedding FROM embeddings WHERE label < 5),
m AS (SELECT t.id, t.embedding, coalesce(u.reduced_embedding, t.reduced_embedding) AS reduced_embedding
      FROM t LEFT JOIN u USING (id))
SELECT id, len(embedding)::BIGINT AS dims, coalesce(len(reduced_embedding), 0)::BIGINT AS reduced_dims,
       round(list_sum(reduced_embedding::DOUBLE[]), 6) AS reduced_sum
FROM m
"""


@register("reduced_update", UPDATE_SQL)
def reduced_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set reduced vectors for the vectors of labels 0-4 (the first 8 components); the rest keep theirs."""
    from ..sources.store import update_reduced
    e = tables.table(spark, sf_dir, "embeddings")
    t = e.select(F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("array<float>").alias("reduced_embedding"))
    u = e.where(F.col("label") < 5).select(F.col("vec_id").alias("id"),
                                           F.slice("embedding", 1, 8).alias("reduced_embedding"))
    m = update_reduced(t, u)
    s = F.aggregate("reduced_embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return m.select("id", F.size("embedding").cast("long").alias("dims"),
                    F.when(F.col("reduced_embedding").isNotNull(), F.size("reduced_embedding")).otherwise(0)
                    .cast("long").alias("reduced_dims"),
                    F.round(s, 6).alias("reduced_sum"))


# --------------------------------------------------------------------------------------- A5: duplicate removal

DEDUP_SQL = """
SELECT doc_id, sha256(coalesce(text, '')) AS text_hash
FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1
"""


@register("dedup_documents", DEDUP_SQL)
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: drop exact duplicate texts by SHA-256, the first (smallest id) wins."""
    from ..operators.fusion import dedup_texts
    d = tables.documents(spark, sf_dir)
    return dedup_texts(d, "text", ["doc_id"]).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)
                                                     .alias("text_hash"))


# ----------------------------------------------------------------------------------- A7: indexing counters

COUNTERS_SQL = rf"""
WITH {SQL_CHUNKS},
emb AS (SELECT * FROM ch WHERE len({sql_tokens('chunk_text')}) > 0)
SELECT (SELECT count(*) FROM documents WHERE source <> 'src3')::BIGINT AS files_processed,
       (SELECT count(*) FROM emb WHERE file_path NOT LIKE '/src3/%')::BIGINT AS chunks_created,
       (SELECT count(*) FROM documents WHERE source = 'src3')::BIGINT AS errors
"""


@register("index_counters", COUNTERS_SQL)
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 over all documents, those of one source given as files that failed: files processed (blank ones included),
    chunks created (embedded), errors."""
    from .jobs import index_counters as counters
    files = tables.document_files(spark, sf_dir)
    failed = F.when(F.col("file_path").startswith("/src3/"), F.lit("unsupported format"))
    return counters(files.withColumn("error", failed), SQL_CHUNKING)


# ------------------------------------------------------------------------- M16, W6, M17, A10: topics by language

TOPIC_TOKENS = "list_filter(" + sql_tokens("text") + ", lambda t: length(t) >= 3)"

LANG_TERMS_CTE = f"""
tok AS (SELECT lang AS topic_id, unnest({TOPIC_TOKENS}) AS term FROM documents),
tc AS (SELECT topic_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
tw AS (SELECT topic_id, sum(tf) AS words FROM tc GROUP BY 1),
tft AS (SELECT term, sum(tf) AS ft FROM tc GROUP BY 1),
ta AS (SELECT avg(words)::DOUBLE AS a FROM tw),
tsc AS (SELECT tc.topic_id, tc.term, round(tc.tf / tw.words * ln(1.0 + ta.a / tft.ft), 9) AS score
        FROM tc JOIN tw USING (topic_id) JOIN tft USING (term) CROSS JOIN ta),
top AS (SELECT topic_id, term, score, term_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS term_rank FROM tsc)
        WHERE term_rank <= 10)"""

LANG_COH_CTE = f"""
cdocs AS (SELECT doc_id AS d, text FROM documents),
pres AS (SELECT DISTINCT d, term FROM (SELECT d, unnest({TOPIC_TOKENS}) AS term FROM cdocs)
         WHERE term IN (SELECT term FROM top)),
dfreq AS (SELECT term, count(*) AS df FROM pres GROUP BY term),
pairs AS (SELECT x.topic_id, x.term AS a, y.term AS b FROM top x JOIN top y ON x.topic_id = y.topic_id AND x.term < y.term),
co AS (SELECT p.topic_id, p.a, p.b, count(*) AS dab
       FROM pairs p JOIN pres pa ON pa.term = p.a JOIN pres pb ON pb.term = p.b AND pb.d = pa.d GROUP BY 1, 2, 3),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
pj AS (SELECT p.topic_id, co.dab, da.df AS da, db.df AS db FROM pairs p LEFT JOIN co USING (topic_id, a, b)
       LEFT JOIN dfreq da ON da.term = p.a LEFT JOIN dfreq db ON db.term = p.b),
coh AS (SELECT topic_id,
               round((avg(CASE WHEN coalesce(dab, 0) = 0 THEN -1.0
                               WHEN dab = nd.n THEN 1.0
                               ELSE ln((dab / nd.n) / ((da / nd.n) * (db / nd.n))) / (-ln(dab / nd.n)) END) + 1.0)
                     / 2.0, 6) AS coherence
        FROM pj CROSS JOIN nd GROUP BY topic_id)"""

TERMS_SQL = f"""WITH {LANG_TERMS_CTE}
SELECT topic_id, term, round(score, 6) AS score, term_rank::BIGINT AS term_rank FROM top"""


def _lang_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir)
    return d.select(F.col("lang").alias("topic_id"), F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"))


@register("topic_terms", TERMS_SQL)
def topic_terms_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16 + W6: the 10 top class-TF-IDF terms of every language group of ``documents`` (given assignment)."""
    from ..operators.topics import topic_terms
    t = topic_terms(_lang_topics(spark, sf_dir), 10)
    return t.select("topic_id", "term", F.round("score", 6).alias("score"), "term_rank")


LABELS_SQL = f"""WITH {LANG_TERMS_CTE}
SELECT topic_id, string_agg(term, ', ' ORDER BY term_rank) FILTER (WHERE term_rank <= 3) AS label FROM top GROUP BY topic_id"""


@register("topic_labels", LABELS_SQL)
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term label of every language group of ``documents``."""
    from ..operators.topics import label_from_terms, terms_array, topic_terms
    arr = terms_array(topic_terms(_lang_topics(spark, sf_dir), 10))
    return arr.select("topic_id", label_from_terms(F.col("terms")).alias("label"))


COHERENCE_SQL = f"""WITH {LANG_TERMS_CTE},
{LANG_COH_CTE}
SELECT topic_id, coherence FROM coh"""


@register("topic_coherence", COHERENCE_SQL)
def topic_coherence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NPMI coherence (0..1) of the top terms of every language group of ``documents``."""
    from ..operators.topics import coherence, topic_terms
    docs = _lang_topics(spark, sf_dir)
    terms = topic_terms(docs, 10).checkpoint()
    return coherence(docs.select("id", "chunk_text"), terms)


SUMMARY_SQL = f"""WITH {LANG_TERMS_CTE},
{LANG_COH_CTE},
sz AS (SELECT lang AS topic_id, count(*) AS size FROM documents GROUP BY 1),
t AS (SELECT sz.topic_id, sz.size, coh.coherence,
             CASE WHEN sz.size >= 20 THEN 'major' WHEN sz.size >= 10 THEN 'medium' ELSE 'minor' END AS tier
      FROM sz LEFT JOIN coh USING (topic_id))
SELECT count(*)::BIGINT AS total_topics, sum(size)::BIGINT AS total_documents,
       round(sum(size) / count(*), 1) AS average_size,
       CASE WHEN max(coherence) > 0 THEN round(avg(coherence) * 100.0, 1) END AS average_coherence_pct,
       count_if(tier = 'major')::BIGINT AS major_topics, count_if(tier = 'medium')::BIGINT AS medium_topics,
       count_if(tier = 'minor')::BIGINT AS minor_topics,
       coalesce(sum(CASE WHEN tier = 'major' THEN size END), 0)::BIGINT AS major_documents,
       coalesce(sum(CASE WHEN tier = 'medium' THEN size END), 0)::BIGINT AS medium_documents,
       coalesce(sum(CASE WHEN tier = 'minor' THEN size END), 0)::BIGINT AS minor_documents
FROM t"""


@register("topic_summary", SUMMARY_SQL)
def topic_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + P12: summary block of the language topics (sizes, coherence, tiers)."""
    from ..operators.topics import coherence, summary_stats, topic_terms
    docs = _lang_topics(spark, sf_dir)
    terms = topic_terms(docs, 10).checkpoint()
    coh = coherence(docs.select("id", "chunk_text"), terms)
    sizes = docs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    return summary_stats(sizes.join(coh, "topic_id", "left"))


# ------------------------------------------------------------------------ P12, W7, W5: topics by vector label

TIERS_SQL = """
SELECT label::BIGINT AS topic_id, count(*)::BIGINT AS size,
       CASE WHEN count(*) >= 20 THEN 'major' WHEN count(*) >= 10 THEN 'medium' ELSE 'minor' END AS tier,
       row_number() OVER (ORDER BY count(*) DESC, label)::BIGINT AS size_rank
FROM embeddings GROUP BY label
"""


@register("topic_tiers", TIERS_SQL)
def topic_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 + W7: size, tier and size order of the label groups of ``embeddings`` (few rows: one per topic)."""
    from pyspark.sql import Window
    from ..functions.text import size_tier
    e = tables.table(spark, sf_dir, "embeddings")
    t = e.groupBy(F.col("label").cast("long").alias("topic_id")).agg(F.count(F.lit(1)).cast("long").alias("size"))
    w = Window.orderBy(F.desc("size"), F.asc("topic_id"))  # one row per topic: a single ordered partition is fine
    return t.select("topic_id", "size", size_tier(F.col("size")).alias("tier"),
                    F.row_number().over(w).cast("long").alias("size_rank"))


REPS_SQL = """
WITH el AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, i, avg(x::DOUBLE) AS x FROM el GROUP BY 1, 2),
cl AS (SELECT label, list(x ORDER BY i) AS c FROM cen GROUP BY 1),
d AS (SELECT e.label, e.vec_id, round(list_distance(e.embedding::DOUBLE[], cl.c), 6) AS distance
      FROM embeddings e JOIN cl USING (label))
SELECT label::BIGINT AS topic_id, vec_id AS id, distance, rep_rank::BIGINT AS rep_rank
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rep_rank FROM d)
WHERE rep_rank <= 3
"""


@register("topic_representatives", REPS_SQL)
def topic_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 vectors nearest their label group's centroid in ``embeddings``."""
    from ..operators.topics import representatives
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("topic_id"),
                                                         F.col("vec_id").alias("id"), "embedding")
    return representatives(e, 3)


@register("topics_kmeans")
def topics_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster the chunk vectors of ``documents`` with k-means and describe every topic."""
    from .jobs import topics_job
    chunks = chunk_table(spark, sf_dir, DEFAULTS)
    _, topics = topics_job(chunks, DEFAULTS)
    from ..operators.topics import chart_rows
    return chart_rows(topics).select("id", "label", "size", F.array_join("terms", " ").alias("terms"), "coherence",
                                     F.size("samples").cast("long").alias("n_samples"))


# ---------------------------------------------------------------------------------- M10, M11, A9: the reducer

REDUCE_COUNTS_SQL = f"""
WITH {DIRTY_SQL},
c AS (SELECT coalesce(len(embedding), 0) = 0 AS none,
             coalesce(embedding IS NOT NULL AND len(embedding) = (
                  SELECT d FROM (SELECT len(embedding) AS d, count(*) AS n FROM dirty
                                 WHERE len(embedding) > 0 GROUP BY 1 ORDER BY n DESC, d LIMIT 1))
                  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false) AS ok
      FROM dirty)
SELECT count_if(ok)::BIGINT AS processed, count_if(none)::BIGINT AS skipped,
       count_if(NOT ok AND NOT none)::BIGINT AS errors FROM c
"""


@register("reduce_counts", REDUCE_COUNTS_SQL)
def reduce_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + M11 + A9: fit the reducer on vectors of every class and apply it; processed / skipped / error counts."""
    from ..operators import reduce as rd
    e = dirty_embeddings(spark, sf_dir)
    r = rd.fit(e, "embedding", DEFAULTS)
    return rd.apply_counts(r.transform_column(e))


@register("reduced_vectors")
def reduced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced vector of every row of ``embeddings`` (PCA, parameters adjusted by H12)."""
    from ..operators import reduce as rd
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    r = rd.fit(e, "embedding", DEFAULTS)
    out = r.transform_column(e)
    return out.select("id", F.size("reduced_embedding").cast("long").alias("reduced_dims"),
                      F.round(F.aggregate("reduced_embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"))


# ------------------------------------------------------------------------------------- X2, J6, S6: streaming ingest

STREAM_SQL = rf"""
WITH {SQL_CHUNKS}
SELECT id, file_path, chunk_index, length(chunk_text)::BIGINT AS chunk_size
FROM ch WHERE len({sql_tokens('chunk_text')}) > 0
"""


@register("stream_index", STREAM_SQL)
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index ``documents`` through the streaming ingest into a fresh store; the chunk rows it holds equal the
    batch index."""
    from ..session import scratch_path
    from ..sources.store import ChunkStore
    from ..streaming.ingest import run_ingest
    src = f"{sf_dir.rstrip('/')}/documents*.parquet"  # a glob: the stream source watches a folder pattern
    schema = tables.table(spark, sf_dir, "documents").schema
    store = ChunkStore(spark, scratch_path(spark, "stream-store"))
    run_ingest(spark, src, schema, store, SQL_CHUNKING)
    return store.read().select("id", "file_path", "chunk_index", F.length("chunk_text").cast("long").alias("chunk_size"))


@register("rag_answers_reduced")
def rag_answers_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + M13 + E5: fit the reducer on the chunk vectors, store reduced vectors, answer on the reduced column."""
    from ..operators import reduce as rd
    from .query import answer_questions
    chunks = chunk_table(spark, sf_dir, SQL_CHUNKING)
    r = rd.fit(chunks, "embedding", SQL_CHUNKING, n_components=64)
    reduced = r.transform_column(chunks).checkpoint()
    return answer_questions(reduced, tables.benchmark_questions(spark, sf_dir), SQL_CHUNKING, reducer=r)


@register("topics_density")
def topics_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 'density' method over ``embeddings``: topic id per vector (-1 = outlier)."""
    from ..operators.topics import cluster
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cluster(e, "embedding", DEFAULTS.with_(clustering_method="density")).select("id", "topic_id")


@register("rag_answers_recursive")
def rag_answers_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with the indexing defaults (recursive separator splitter): the pipeline as a user runs it."""
    from .query import answer_questions
    chunks = chunk_table(spark, sf_dir, DEFAULTS)
    return answer_questions(chunks, tables.benchmark_questions(spark, sf_dir), DEFAULTS)
