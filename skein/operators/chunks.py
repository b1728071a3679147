"""E1 building blocks: files -> chunk rows -> embedded chunk rows (the chunk table).

Row-local all the way (no shuffle): blank texts are dropped (P1), each text is split (H1), exploded with its position
(W3), given a deterministic content id and JSON metadata (S5), and embedded (M1/M2; rows whose embedding is null are
skipped, as the reference skips failed embeddings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import recursive_chunks
from ..functions.embedding import HashingEmbedder
from ..functions.text import basename, file_type, is_blank
from ..options import DEFAULTS, Options
from ..util import small_batches


def chunk_id(file_path, chunk_index, chunk_text):
    """sha256 of path|index|text: the same chunk gets the same id on every run and task retry."""
    return F.sha2(F.concat_ws("|", file_path, chunk_index.cast("string"), chunk_text), 256)


def chunk_files(files: DataFrame, opts: Options = DEFAULTS, *, path_col: str = "file_path",
                text_col: str = "text", extra_metadata: dict | None = None) -> DataFrame:
    """(id, chunk_text, file_path, chunk_index, total_chunks, chunk_size, metadata) per chunk."""
    small_batches(files.sparkSession)
    src = files.where(~is_blank(F.col(text_col)))
    # cut in one pass over a text, with separators or without: a window cut by ``substring`` walks there from the text's start
    arr = src.select(F.col(path_col).alias("file_path"),
                     recursive_chunks(F.col(text_col), opts.chunk_size, opts.chunk_overlap, opts.separators).alias("_c"))
    rows = arr.select("file_path", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("_i", "chunk_text"))
    rows = rows.withColumn("chunk_index", F.col("_i").cast("long")).drop("_i")
    meta_fields = [F.col("file_path"), basename(F.col("file_path")).alias("file_name"),
                   file_type(F.col("file_path")).alias("file_type"), F.col("chunk_index"),
                   F.col("total_chunks").cast("long").alias("total_chunks"),
                   F.length("chunk_text").cast("long").alias("chunk_size")]
    for k, v in (extra_metadata or {}).items():
        meta_fields.append(F.lit(v).alias(k))
    return rows.select(
        chunk_id(F.col("file_path"), F.col("chunk_index"), F.col("chunk_text")).alias("id"),
        "chunk_text", "file_path", "chunk_index",
        F.col("total_chunks").cast("long").alias("total_chunks"),
        F.length("chunk_text").cast("long").alias("chunk_size"),
        F.to_json(F.struct(*meta_fields)).alias("metadata"))


def embed_chunks(chunks: DataFrame, embedder=None, opts: Options = DEFAULTS, *, text_col: str = "chunk_text",
                 out_col: str = "embedding", keep_null: bool = False) -> DataFrame:
    """Add the embedding column; rows whose embedding is null are dropped unless ``keep_null``."""
    small_batches(chunks.sparkSession)
    embedder = embedder or HashingEmbedder(opts.embedding_dim)
    out = chunks.withColumn(out_col, embedder.embed(F.col(text_col)))
    return out if keep_null else out.where(F.col(out_col).isNotNull())


def build_chunk_table(files: DataFrame, opts: Options = DEFAULTS, embedder=None, **kw) -> DataFrame:
    """Chunk table rows in CHUNK_SCHEMA order (reduced_embedding null)."""
    ch = embed_chunks(chunk_files(files, opts, **kw), embedder, opts)
    return ch.select("id", "chunk_text", "file_path", "chunk_index", "embedding",
                     F.lit(None).cast("array<float>").alias("reduced_embedding"), "metadata")


def chunk_mixed(spark, paths: DataFrame | None = None, texts: DataFrame | None = None,
                docs: DataFrame | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """Chunk a mixed input -- files by path (read as text), raw texts, and {text, metadata} records -- as one
    ``unionByName`` of typed inputs. Raw texts get the path 'inline_text' as the reference's index_text does."""
    parts = []
    if paths is not None:
        from ..sources.files import extract_text
        # the folders (few) are listed by Spark, and the wanted files (many) joined to what they hold
        wanted = paths.select(F.regexp_replace(F.col(paths.columns[0]), "^file:", "").alias("_p")).distinct()
        folders = [r[0] for r in wanted.select(F.regexp_replace("_p", "/[^/]*$", "")).distinct().collect()]
        if folders:
            files = spark.read.format("binaryFile").load(folders).withColumn("_p", F.regexp_replace("path", "^file:/*", "/"))
            parts.append(extract_text(files.join(wanted, "_p", "left_semi")).select("file_path", "text"))
    if texts is not None:
        parts.append(texts.select(F.lit("inline_text").alias("file_path"), F.col(texts.columns[0]).alias("text")))
    if docs is not None:
        path = F.coalesce(F.get_json_object(F.col("metadata"), "$.file_path"), F.lit("inline_text"))
        parts.append(docs.select(path.alias("file_path"), F.col("text")))
    if not parts:
        return spark.createDataFrame([], "id string, chunk_text string, file_path string, chunk_index long, "
                                         "total_chunks long, chunk_size long, metadata string")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return chunk_files(u, opts)
