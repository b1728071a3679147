"""The chunk table on Parquet (CHUNK_SCHEMA), one folder per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNK_SCHEMA
from ..util import matching


class ChunkStore:
    """A chunk table under ``root/v<number>``: appends are Parquet appends to the newest version, the reduced-vector
    update writes the whole table as the next version. The newest version that was written completely (Spark's
    ``_SUCCESS``) is the table, so an update that fails half-way leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- locating the current version -----------------------------------------------------------------------------
    def version(self) -> int | None:
        """Number of the newest complete version, None for a store that has none yet."""
        done = [p.rsplit("/", 2)[1] for p in matching(self.spark, f"{self.root}/v*/_SUCCESS")]
        return max((int(v[1:]) for v in done if v[1:].isdigit()), default=None)

    def exists(self) -> bool:
        """S8."""
        return self.version() is not None

    # -- reads ----------------------------------------------------------------------------------------------------
    def read(self) -> DataFrame:
        """S7 full scan; S8: a missing store reads as an empty table."""
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], CHUNK_SCHEMA)
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.root}/v{v}")

    def embeddings_page(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """P5/K6: (id, embedding, reduced_embedding) ordered by id, with offset and limit."""
        return page(self.read().select("id", "embedding", "reduced_embedding"), "id", limit, offset)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """Rows whose id is in ``ids`` (one column ``id``)."""
        return by_ids(self.read(), ids)

    def with_embeddings(self, limit: int | None = None) -> DataFrame:
        """Rows with a non-empty embedding; the optional limit applies before the filter (ordered by id)."""
        df = self.read()
        if limit is not None:
            df = df.orderBy("id").limit(limit)
        return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))

    # -- writes ---------------------------------------------------------------------------------------------------
    def add(self, chunks: DataFrame) -> int:
        """Append rows (metadata already JSON); returns their number. No rows are no write; vectors of another
        length than the stored ones, or of several lengths, are refused."""
        return self._append(self._typed(chunks).checkpoint())

    @staticmethod
    def _typed(chunks: DataFrame) -> DataFrame:
        return chunks.select(*[F.col(f.name).cast(f.dataType) for f in CHUNK_SCHEMA.fields])

    def _append(self, rows: DataFrame) -> int:
        """Append checkpointed rows of the store's types."""
        size = F.when(F.size("embedding") > 0, F.size("embedding"))
        new = rows.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("a"), F.max(size).alias("b")).first()
        if not new["n"]:
            return 0
        stored = self.read().where(F.size("embedding") > 0).select(F.size("embedding").alias("d")).first()
        lengths = {new["a"], new["b"], stored["d"] if stored else None} - {None}
        if len(lengths) > 1:
            raise ValueError(f"embeddings of different lengths in one store: {sorted(lengths)}")
        v = self.version()
        rows.write.mode("append").parquet(f"{self.root}/v{1 if v is None else v}")
        return int(new["n"])

    def add_new(self, chunks: DataFrame) -> DataFrame:
        """Append only chunks whose content id is not stored yet; returns the rows that were new.

        The new rows are materialised before the append, so a replayed batch adds nothing."""
        known = self.read().select("id")
        new = self._typed(chunks.dropDuplicates(["id"]).join(known, "id", "left_anti")).checkpoint()
        self._append(new)
        return new

    def update_reduced(self, updates: DataFrame) -> None:
        """Set reduced_embedding by id, keep every other row and field as it was; one new version."""
        v = self.version()
        if v is not None:
            update_reduced(self.read(), updates).write.mode("overwrite").parquet(f"{self.root}/v{v + 1}")


def page(df: DataFrame, order_col: str, limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(order_col)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def update_reduced(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Left join on id; an update's vector wins, rows without one keep theirs."""
    u = updates.select("id", F.col("reduced_embedding").alias("_new"))
    cols = [c for c in table.columns]
    return (table.join(u, "id", "left")
            .withColumn("reduced_embedding", F.coalesce(F.col("_new"), F.col("reduced_embedding")))
            .select(*cols))


def stats(chunks: DataFrame) -> DataFrame:
    """A2 (with A1): one row of index statistics.

    total_chunks, unique_files (a null path counts as one value), with_embeddings, with_reduced_embeddings,
    avg_chunk_size (rounded), total_size_mb (characters / 1024^2, 2 places), embedding_dims, reduced_dims.
    """
    nonempty = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    return chunks.agg(
        F.count(F.lit(1)).cast("long").alias("total_chunks"),
        (F.countDistinct("file_path") + F.max(F.col("file_path").isNull().cast("int"))).cast("long")
        .alias("unique_files"),
        F.count_if(nonempty("embedding")).cast("long").alias("with_embeddings"),
        F.count_if(nonempty("reduced_embedding")).cast("long").alias("with_reduced_embeddings"),
        F.round(F.avg(F.length("chunk_text"))).cast("long").alias("avg_chunk_size"),
        F.round(F.coalesce(F.sum(F.length("chunk_text")), F.lit(0)) / 1024.0 / 1024.0, 2).alias("total_size_mb"),
        F.max(F.when(nonempty("embedding"), F.size("embedding"))).cast("long").alias("embedding_dims"),
        F.max(F.when(nonempty("reduced_embedding"), F.size("reduced_embedding"))).cast("long").alias("reduced_dims"))
