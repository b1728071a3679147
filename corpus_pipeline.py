"""Corpus cleaning pipeline over ``documents``: STAGES, run(spark, sf_dir) and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``:

1. ``toxicity`` drops documents that score 0.5 or more (trained on ``labels`` of the stage's documents);
2. ``line_dedup`` deletes aligned common blocks from later documents (``text`` and ``n_chars`` change); a document of
   which this leaves no word is a copy and goes, one that had no word before stays;
3. ``jaccard_join`` keeps one document of each near-duplicate group;
4. ``decontamination`` drops documents that hold a window like a ``benchmark`` item;
5. ``byte_bpe`` returns (doc_id, lang, source, n_chars, n_tokens, ids, text_sha256), the last from the decoded ids.

Null columns, empty and repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import bpe_encode
from skein.llm.decontaminate import without_contaminated
from skein.llm.jaccard_join import one_of_each
from skein.llm.line_dedup import line_dedup
from skein.llm.toxicity import train, without_toxic
from skein.session import scratch_path

#: No SQL: the first stage decides by a trained model.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, train(docs, _table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = line_dedup(docs, keep=tuple(others))
    copied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~copied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(docs, ranks, public_tokenizers.PATTERN, keep=("lang", "source", "n_chars"),
                      with_bytes=True).select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to and reread from the shared scratch folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
