"""Small execution helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 256 << 20) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows and ``max_bytes`` bytes of texts and arrays.

    The check is a bounded count (``limit(max_rows + 1)``): a scan stops after that many rows, but what must run before
    a row comes out (an aggregation, a join) runs in full, so pass derived frames materialised. Beyond the bound the
    frame is returned as is and Spark plans a shuffle join (AQE may still pick a broadcast from runtime sizes, and
    splits skewed partitions).
    """
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    wide += [F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0)) * 8 for f in df.schema.fields
             if isinstance(f.dataType, ArrayType)]
    size = F.coalesce(F.sum(sum(wide[1:], wide[0]).cast("long")), F.lit(0)) if wide else F.lit(0)
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("size")).first()
    if row["n"] <= max_rows and row["size"] <= max_bytes:
        return F.broadcast(df), True
    return df, False


def default_parallelism(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def ensure_parallel(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over all cores when it arrived in fewer input partitions than the session's parallelism.

    Large inputs arrive in many splits and pass through untouched (no shuffle); a small table stored as one row group
    would otherwise run every row-local step (tokenising, chunking, embedding) in a single task. Hashing on ``key``
    keeps each row's later per-key aggregations co-partitioned.
    """
    target = default_parallelism(df)
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark) -> None:
    """Rows reach Python in batches of at most so many rows and bytes, whatever the size of a partition. A batch, its Python
    objects and what is made of them are in memory at once, and Spark's 10,000 texts or vectors are too many for that.
    Smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def path_exists(spark, path: str) -> bool:
    """Whether a file, folder or pattern matches anything, in any store that Spark reads."""
    return bool(matching(spark, path))


def matching(spark, pattern: str) -> list[str]:
    """The paths a pattern matches; only "nothing there" is an empty list, any other trouble is raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back: cuts the lineage as ``checkpoint()`` does.

    For the state of loops: a checkpoint keeps the estimated size of the plan that made it, which joins multiply from round
    to round, until planning alone takes minutes and no side looks small enough for a broadcast; a table's size is known.
    """
    from .session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
