"""Registered queries of feedback terms and topic phrases, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, search
from . import tables
from .catalog import BM25_SQL, LANG_TERMS_CTE, TOPIC_TOKENS, _lang_topics, register, sql_tokens

FEEDBACK_SQL = f"""
WITH first AS ({BM25_SQL}),
fb AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM first WHERE rank <= 5),
tok AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)),
words AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok GROUP BY doc_id, dl, term),
model AS (SELECT query_id, term, round(sum(p * tf / dl), 9) AS w FROM fb JOIN words USING (doc_id) GROUP BY query_id, term),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS rk FROM model) WHERE rk <= 10),
fed AS (SELECT query_id, term, w / sum(w) OVER (PARTITION BY query_id) AS fed FROM kept),
q AS (SELECT item_id AS query_id, list_distinct({sql_tokens('text')}) AS t FROM benchmark),
own AS (SELECT query_id, unnest(t) AS term, 1.0::DOUBLE / len(t) AS own FROM q)
SELECT query_id, term, round(CASE WHEN query_id IN (SELECT query_id FROM kept)
                             THEN 0.5 * coalesce(own, 0) + 0.5 * coalesce(fed, 0) ELSE own END, 6) AS weight
FROM own FULL JOIN fed USING (query_id, term)
"""


@register("feedback_weights", FEEDBACK_SQL)
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 (relevance feedback): the weighted words of every benchmark question, from its five best ``documents``."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    questions = tables.benchmark_questions(spark, sf_dir)
    return feedback.feedback_terms(docs, questions, search.bm25_search(docs, questions, 20), 5, 10, 0.5)


_X = "(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0.0 END)"


def _entropy(*counts: str) -> str:
    return "(" + " + ".join(_X.format(f"({c})") for c in counts) + " - " + _X.format("(" + " + ".join(counts) + ")") + ")"


PHRASES_CTE = f"""
texts AS MATERIALIZED (SELECT lang AS topic_id, {TOPIC_TOKENS} AS t FROM documents),
pair AS (SELECT topic_id, unnest(list_zip(t, t[2:])) AS p FROM texts WHERE len(t) > 1),
n2 AS MATERIALIZED (SELECT topic_id, p[1] AS a, p[2] AS b, count(*)::DOUBLE AS n FROM pair WHERE p[2] IS NOT NULL GROUP BY ALL),
s2 AS (SELECT *, sum(n) OVER (PARTITION BY topic_id, a) AS na, sum(n) OVER (PARTITION BY topic_id, b) AS nb,
              sum(n) OVER (PARTITION BY topic_id) AS nn FROM n2),
k AS (SELECT topic_id, a, b, n, n AS k11, na - n AS k12, nb - n AS k21, nn - na - nb + n AS k22
      FROM s2 WHERE n >= 3 AND n * nn > na * nb),
scored AS MATERIALIZED (SELECT topic_id, a, b, n::BIGINT AS n,
                  round(2 * ({_entropy('k11', 'k12', 'k21', 'k22')} - {_entropy('k11 + k12', 'k21 + k22')}
                        - {_entropy('k11 + k21', 'k12 + k22')}), 4) AS score FROM k),
sides AS (SELECT *, a AS w FROM scored UNION ALL SELECT *, b FROM scored WHERE a <> b),
firsts AS (SELECT topic_id, a, b, n, score, count(*) AS wins FROM (
             SELECT *, row_number() OVER (PARTITION BY topic_id, w ORDER BY score DESC, a, b) AS rk FROM sides) WHERE rk = 1 GROUP BY ALL),
phrases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, a, b) AS phrase_rank
                           FROM firsts WHERE wins = CASE WHEN a = b THEN 1 ELSE 2 END) WHERE phrase_rank <= 3)"""


@register("topic_phrases", f"""
WITH {PHRASES_CTE}
SELECT topic_id, a || ' ' || b AS phrase, n, score, phrase_rank::BIGINT AS phrase_rank FROM phrases
""")
def topic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 (phrases): the three pairs of neighbouring words most typical of every language group of ``documents``."""
    return feedback.topic_phrases(_lang_topics(spark, sf_dir))


@register("phrase_labels", f"""
WITH {LANG_TERMS_CTE}, {PHRASES_CTE},
held AS (SELECT topic_id, a AS term FROM phrases UNION SELECT topic_id, b FROM phrases),
every AS (SELECT topic_id, a || ' ' || b AS x, phrase_rank AS r FROM phrases
          UNION ALL SELECT topic_id, term, 1000 + term_rank FROM top ANTI JOIN held USING (topic_id, term))
SELECT topic_id, string_agg(x, ', ' ORDER BY r) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY r) AS k FROM every) WHERE k <= 3 GROUP BY topic_id
""")
def phrase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 (quality label without a hook): phrases, filled up with terms, of every language group of ``documents``."""
    from ..operators.topics import topic_terms
    topics = _lang_topics(spark, sf_dir)
    return feedback.phrase_labels(topics, topic_terms(topics, 10))
