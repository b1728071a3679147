"""Collect files, extract text, test for text, file metadata -- as Spark reads, not a driver walk."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from ..util import small_batches


def extension(path) -> Column:
    """Lower-case extension with the dot ('' when none)."""
    ext = tx.file_type(path)
    return F.when(ext == "unknown", F.lit("")).otherwise(F.concat(F.lit("."), ext))


def collect_files(spark: SparkSession, path: str, all_supported: bool = False) -> DataFrame:
    """A file gives itself, a directory is read recursively; only the collected extensions are kept.

    Returns binaryFile rows (path, modificationTime, length, content). Reading is split across tasks by Spark.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    exts = [e.lstrip(".") for e in (tx.SUPPORTED_EXTENSIONS if all_supported else tx.GLOB_EXTENSIONS)]
    return df.where(tx.file_type(F.col("path")).isin(exts))


def is_text(content, path) -> Column:
    """S3: known extension, else the first 8 KB has no NUL byte and is over 90% printable ASCII (tab, CR, LF,
    0x20-0x7E); an empty sample is not text."""
    sample = F.substring(content, 1, 8192)
    s = F.decode(sample, "ISO-8859-1")
    n = F.length(s)
    printable = F.length(F.regexp_replace(s, r"[^\t\n\r\x20-\x7E]", ""))
    by_content = (n > 0) & ~F.contains(s, F.lit("\u0000")) & (printable / n > 0.9)
    return extension(path).isin(list(tx.SUPPORTED_EXTENSIONS)) | by_content


def extract_text(files: DataFrame) -> DataFrame:
    """S2 (plain text): (file_path, text, file_name, file_type, file_size, file_modified, error).

    Text formats must be UTF-8 (a file that isn't has a null text and an error); HTML is reduced to
    its visible text (``html_to_text``); formats that need a
    document parser (PDF, Office) yield a null text and an error, which the index job counts (A7).
    """
    small_batches(files.sparkSession)
    path = F.regexp_replace(F.col("path"), "^file:", "")
    ft = tx.file_type(path)
    raw = F.col("content").cast("string")  # the bytes as they are; checked below
    good = F.is_valid_utf8(raw)
    textual = ft.isin([e.lstrip(".") for e in tx.PLAIN_TEXT_EXTENSIONS] + ["csv", "json", "xml"])
    page = ft.isin("html", "htm")
    text = F.when(good & textual, raw).when(good & page, html_to_text(raw))
    error = F.when(~(textual | page), F.lit("unsupported format")).when(~good, F.lit("not UTF-8 text"))
    return files.select(path.alias("file_path"), text.alias("text"), tx.basename(path).alias("file_name"),
                        ft.alias("file_type"), F.col("length").alias("file_size"),
                        F.col("modificationTime").alias("file_modified"), error.alias("error"))


@F.pandas_udf(StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """HTML character references, named and numeric, as a browser decodes them; null stays null."""
    return text.map(html.unescape, na_action="ignore")


def html_to_text(page) -> Column:
    """S2 (HTML): drop comments, script/style/noscript blocks and tags, decode character references, collapse
    whitespace, strip."""
    h = page if isinstance(page, Column) else F.col(page)
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    h = F.translate(decode_references(h), "\u00a0", " ")
    return F.trim(F.regexp_replace(h, f"{tx.WS}+", " "))
