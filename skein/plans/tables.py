"""Map the driver's tables onto the engine's inputs.

``documents`` stand for files (``file_path = /<source>/doc_<doc_id>.txt``, so paths are unique and one document's
chunks group together), ``benchmark`` texts and the user turns of ``conversations`` are questions, ``embeddings`` are
chunk vectors (``id = vec_id``), ``pages`` are HTML files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import ensure_parallel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_path, text) from ``documents``."""
    d = ensure_parallel(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id",
                    F.concat(F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                             F.lit(".txt")).alias("file_path"),
                    "text")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text) from ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                    F.col("text").alias("query_text"))


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions: query_id = conv_id * 1000 + turn."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_parallel(table(spark, sf_dir, "documents"), "doc_id")
