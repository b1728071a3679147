"""Exact duplicate removal by a tree merge of digest runs (DataFrame operations only).

A *run* is a set of ``(digest, verification, smallest id, rows)`` entries, one entry per distinct text. The leaves are
made by a map-side combined aggregation, so a text that fills a third of the table enters the tree as a handful of
entries. In every round the runs ``r`` with the same ``r div fan_in`` exchange their entries (hash of run and digest),
meet in digest order and are merged: equal entries become one that retains the smallest identifier and the summed row
count. After ``log_fan_in(runs)`` rounds one run is left; it is spread over all tasks by digest, never held by one.

The sort key is a 64-bit digest; an entry is *verified* against the SHA-256 and the byte length of the whole
normalised text at every level, so two texts whose short digests collide are never merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
KEYS = ["digest", "text_sha256", "n_bytes"]


def normalised(text):
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def tree_merge(entries: DataFrame, runs: int, fan_in: int = 8) -> DataFrame:
    """Merge ``entries`` (run, digest, text_sha256, n_bytes, keep_id, group_size) of ``runs`` runs into one run."""
    n = runs
    while n > 1:
        entries = (entries
                   .withColumn("run", (F.col("run") / fan_in).cast("int"))
                   .repartition("run", "digest")
                   .sortWithinPartitions("run", *KEYS, "keep_id")
                   .groupBy("run", *KEYS)
                   .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
        n = -(-n // fan_in)
    return entries.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8,
                runs: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after white-space normalisation. Of equal texts the row with the smallest id stays.
    Defined cases: null text = empty text (all empty texts are one group); null ids sort after every other id, and a
    group that has only null ids keeps one of its rows with ``keep_id`` null; rows repeated with the same id and text
    count each in ``group_size`` and exactly one of them is kept; an empty table gives an empty result; further columns
    of the input, whatever their names, are not read. ``runs`` (default: the next power of ``fan_in`` from
    ``spark.sql.shuffle.partitions``) is the number of leaf runs.
    """
    if runs is None:
        runs, wanted = fan_in, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while runs < wanted:
            runs *= fan_in
    norm = normalised(F.col(text_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
            .select("doc_id", F.xxhash64("_norm").alias("digest"), F.sha2("_norm", 256).alias("text_sha256"),
                    F.octet_length("_norm").alias("n_bytes"))
            .groupBy("doc_id", *KEYS).agg(F.count(F.lit(1)).alias("copies")))
    leaves = (rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
              .groupBy("run", *KEYS)
              .agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    groups = tree_merge(leaves, runs, fan_in)
    # ids are unique within a group here: `rows` has one row per (id, text), so only row 1 of the keeper is kept
    joined = rows.join(groups, KEYS)
    return (joined.select("doc_id", "keep_id", "group_size", "text_sha256",
                          F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_nth"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
                    "text_sha256"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), r AS (
  SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS rn,
         min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
