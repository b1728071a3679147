"""Incremental indexing as a Structured Streaming job.

New document files arriving in a folder are read as a stream; every micro-batch is chunked, embedded and appended to
the chunk store with an anti-join on the content id (J6), so a batch replayed after a failure adds nothing twice. The
stream's checkpoint lives in the shared checkpoint folder; ``trigger(availableNow=True)`` processes what is there and
stops, so the same code serves a scheduled job and a continuous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import build_chunk_table
from ..options import DEFAULTS, Options
from ..session import scratch_path
from ..sources.file_index import FileIndex
from ..sources.store import ChunkStore
from ..util import ensure_parallel


def document_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of documents (doc_id, text, source, ...) as a stream; ``max_files`` bounds a micro-batch (default:
    all new files at once, so the store is read once per run and not once per file)."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def to_files(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                                F.lit(".txt")).alias("file_path"), "text")


def run_ingest(spark: SparkSession, source: str, schema, store: ChunkStore | FileIndex, opts: Options = DEFAULTS,
               checkpoint: str | None = None, embedder=None, max_files: int | None = None) -> None:
    """Index everything available under ``source`` into ``store``, then stop. A ``FileIndex`` also replaces the chunks of
    files whose text has changed and skips those it knows."""
    checkpoint = checkpoint or scratch_path(spark, "ingest-checkpoint")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        files = ensure_parallel(to_files(batch), "file_path")
        if isinstance(store, FileIndex):
            store.ingest(files, opts, embedder)
        else:
            store.add_new(build_chunk_table(files, opts, embedder))

    q = (document_stream(spark, source, schema, max_files).writeStream.foreachBatch(each_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
