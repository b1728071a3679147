"""J6/X2 over files that change: an index that reads only what a batch may touch, and retires chunks of earlier states.

Everything is dealt to ``n_buckets`` folders by a hash of the file's path. Each ingest is a *generation*: the chunks of its new
and changed files, then a ledger of those files (path, hash of the text, number of chunks), then a Bloom filter of their paths
for each bucket it touched. A file's state is its latest ledger row; only chunks of that generation are live, so chunks of an
earlier state need no delete. A batch asks the Bloom filters first and reads the ledger of only those buckets that may hold one
of its paths; files whose hash is the known one are neither cut nor embedded. Ledgers count once their folder is complete, so a
batch that failed half-way left chunks that no ledger names, and a replayed one changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import build_chunk_table
from ..options import DEFAULTS, Options
from ..schemas import CHUNK_SCHEMA
from ..util import matching, written

HASHES = 7           # of a path in a Bloom filter
BITS_PER_FILE = 10   # with seven hashes: below one false answer in a hundred
LEDGER = "file_path string, file_hash string, n_chunks long, gen long, bucket int"
BLOOM = "bucket int, bits binary"


def file_hash(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class FileIndex:
    """Chunks of files under ``root``; ``n_buckets`` is fixed by the first ingest's caller and must stay the same."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 64):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets
        self.last: dict[str, int] = {}

    # -- state ----------------------------------------------------------------------------------------------------
    def generations(self) -> list[int]:
        """Numbers of the ingests that were completed."""
        done = matching(self.spark, f"{self.root}/blooms/gen=*/_SUCCESS")
        return sorted(int(p.rsplit("/", 2)[1].split("=")[1]) for p in done)

    def _table(self, name: str, schema: str) -> DataFrame:
        there = {p.rstrip("/").rsplit("=", 1)[1] for p in matching(self.spark, f"{self.root}/{name}/gen=*")}
        paths = [f"{self.root}/{name}/gen={g}" for g in self.generations() if str(g) in there]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest row of each file: (file_path, file_hash, n_chunks, gen, bucket); of the given buckets alone."""
        rows = self._table("files", LEDGER)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets)) if buckets else rows.where(F.lit(False))
        latest = rows.groupBy("bucket", "file_path").agg(F.max_by(F.struct("file_hash", "n_chunks", "gen"), "gen").alias("r"))
        return latest.select("file_path", "r.file_hash", "r.n_chunks", "r.gen", "bucket")

    def live(self) -> DataFrame:
        """The chunk table now (CHUNK_SCHEMA) with ``gen``, the ingest that wrote the file's chunks."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK_SCHEMA.fields) + ", gen long, bucket int"
        chunks = self._table("chunks", schema)
        now = self.ledger().where("n_chunks > 0").select("bucket", "file_path", "gen")
        return chunks.join(now, ["bucket", "file_path", "gen"], "left_semi").drop("bucket")

    # -- Bloom filters --------------------------------------------------------------------------------------------
    def _places(self, path) -> F.Column:
        return F.array(*[F.xxhash64(path, F.lit(i)) for i in range(HASHES)])

    def _blooms(self, files: DataFrame) -> DataFrame:
        def build(rows: pd.DataFrame) -> pd.DataFrame:
            size = max(64, BITS_PER_FILE * len(rows)) // 8 * 8
            bits = np.zeros(size, np.uint8)
            bits[np.concatenate(rows["at"].to_numpy()).astype(np.int64).view(np.uint64) % np.uint64(size)] = 1
            return pd.DataFrame({"bucket": rows["bucket"][:1], "bits": [np.packbits(bits).tobytes()]})

        return files.select("bucket", self._places(F.col("file_path")).alias("at")).groupBy("bucket").applyInPandas(build, BLOOM)

    def maybe_known(self, files: DataFrame) -> DataFrame:
        """(bucket): the buckets whose filters say that they may hold a path of ``files`` (bucket, file_path)."""
        def ask(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            at = np.stack(rows["at"].to_numpy()).astype(np.int64).view(np.uint64) if len(rows) else np.zeros((0, HASHES), np.uint64)
            for raw in filters["bits"]:
                bits = np.unpackbits(np.frombuffer(raw, np.uint8))
                if len(at) and bits[at % np.uint64(len(bits))].all(1).any():
                    return pd.DataFrame({"bucket": rows["bucket"][:1]})
            return pd.DataFrame({"bucket": rows["bucket"][:0]})

        asked = files.select("bucket", self._places(F.col("file_path")).alias("at"))
        return asked.groupBy("bucket").cogroup(self._table("blooms", BLOOM + ", gen long").groupBy("bucket")).applyInPandas(
            ask, "bucket int")

    # -- ingest ---------------------------------------------------------------------------------------------------
    def ingest(self, files: DataFrame, opts: Options = DEFAULTS, embedder=None) -> dict[str, int]:
        """Index ``files`` (file_path, text), a path once at most of each state; returns counts of new, changed and unchanged
        files and of buckets whose ledger was read. A path given several times counts with its largest text hash."""
        gens = self.generations()
        gen = (gens[-1] if gens else 0) + 1
        own = files.where(F.col("file_path").isNotNull()).select("file_path", "text", file_hash(F.col("text")).alias("file_hash"))
        own = own.groupBy("file_path").agg(F.max_by(F.struct("text", "file_hash"), "file_hash").alias("r")).select(
            "file_path", "r.text", "r.file_hash", F.pmod(F.xxhash64("file_path"), F.lit(self.n_buckets)).cast("int").alias("bucket"))
        own = written(own, "ingest-batch")
        hit = [r["bucket"] for r in self.maybe_known(own.select("bucket", "file_path")).distinct().collect()] if gens else []
        known = self.ledger(hit).select("file_path", F.col("file_hash").alias("old_hash"), "bucket")
        met = written(own.join(known, ["bucket", "file_path"], "left").where(
            F.col("old_hash").isNull() | (F.col("old_hash") != F.col("file_hash"))), "ingest-new")
        counts = met.agg(F.count_if(F.col("old_hash").isNull()).alias("new"), F.count("old_hash").alias("changed")).first()
        self.last = {"new": counts["new"], "changed": counts["changed"], "buckets_read": len(hit),
                     "unchanged": own.count() - counts["new"] - counts["changed"]}
        if counts["new"] + counts["changed"] == 0:
            return self.last
        chunks = build_chunk_table(met.select("file_path", "text"), opts, embedder).select(
            *[F.col(f.name).cast(f.dataType) for f in CHUNK_SCHEMA.fields],
            F.pmod(F.xxhash64("file_path"), F.lit(self.n_buckets)).cast("int").alias("bucket"))
        # a run that failed may have left chunks of this number: they are overwritten, no ledger names them
        place = f"{self.root}/chunks/gen={gen}"
        chunks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        n = (self.spark.read.schema("file_path string, bucket int").parquet(place).groupBy("file_path")
             .agg(F.count(F.lit(1)).alias("n_chunks")))
        rows = met.join(n, "file_path", "left").select("file_path", "file_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "bucket")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/files/gen={gen}")
        self._blooms(met.select("bucket", "file_path")).write.mode("overwrite").parquet(f"{self.root}/blooms/gen={gen}")
        return self.last

    def remove(self, paths: DataFrame) -> int:
        """Retire all chunks of the files in ``paths`` (file_path): a ledger row without a text. Returns how many were live."""
        gens = self.generations()
        gone = written(self.ledger().where("n_chunks > 0").join(paths.select("file_path").distinct(), "file_path", "left_semi")
                       .select("file_path", F.lit("").alias("file_hash"), F.lit(0).cast("long").alias("n_chunks"), "bucket"), "ingest-gone")
        n = gone.count()
        if n:
            gen = gens[-1] + 1
            gone.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/files/gen={gen}")
            self._blooms(gone.select("bucket", "file_path")).write.mode("overwrite").parquet(f"{self.root}/blooms/gen={gen}")
        return n
