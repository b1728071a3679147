"""H1: split text into overlapping chunks.

Two forms:

* ``fixed_windows`` -- the separator-free form: windows of ``size`` characters with step ``size - overlap``, as a pure
  Spark SQL expression (``sequence`` + ``substring``).
* ``recursive_chunks`` -- the recursive separator splitter. It is sequential inside one document but independent
  across documents, so it runs as an Arrow-batched pandas UDF, one document per call, and Spark spreads the
  documents over tasks. Contract: take the first separator that occurs in the text; cut after every occurrence
  (a piece keeps its trailing separator, so each chunk is an exact substring); pack pieces left to right while the
  chunk stays within ``size``; on overflow emit the chunk and keep the longest tail of whole pieces that is at most
  ``overlap`` long (and leaves room for the next piece); a piece longer than ``size`` is split again with the
  remaining separators; the empty separator means fixed windows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fixed_windows(text, size: int, overlap: int) -> Column:
    """array<string> of windows; empty array for null or empty text."""
    text = _c(text)
    step = max(size - overlap, 1)
    n = F.lit(1) + F.ceil(F.greatest(F.length(text) - F.lit(size), F.lit(0)) / F.lit(step)).cast("int")
    return (F.when(text.isNull() | (F.length(text) == 0), F.array().cast("array<string>"))
            .otherwise(F.transform(F.sequence(F.lit(0), n - 1),
                                   lambda i: F.substring(text, i * step + 1, size))))


def _windows(lo: int, hi: int, size: int, overlap: int) -> list[tuple[int, int]]:
    step = max(size - overlap, 1)
    n = 1 + math.ceil(max(hi - lo - size, 0) / step)
    return [(lo + i * step, min(lo + i * step + size, hi)) for i in range(n)]


def split_offsets(text: str, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", "")) -> list[tuple[int, int]]:
    """Chunk boundaries (start, end) of ``text``; see the module docstring for the contract."""
    if not text:
        return []

    def rec(lo: int, hi: int, seps: tuple[str, ...]) -> list[tuple[int, int]]:
        sep, rest = "", ()
        for i, s in enumerate(seps):
            if s == "" or text.find(s, lo, hi) != -1:
                sep, rest = s, tuple(seps[i + 1:])
                break
        if sep == "":
            return _windows(lo, hi, size, overlap)
        pieces, a = [], lo
        while True:
            p = text.find(sep, a, hi)
            if p == -1:
                if a < hi:
                    pieces.append((a, hi))
                break
            pieces.append((a, p + len(sep)))
            a = p + len(sep)
        out: list[tuple[int, int]] = []
        cur: list[tuple[int, int]] = []
        for a, b in pieces:
            if b - a > size:
                if cur:
                    out.append((cur[0][0], cur[-1][1]))
                    cur = []
                out.extend(rec(a, b, rest))
                continue
            if cur and b - cur[0][0] > size:
                out.append((cur[0][0], cur[-1][1]))
                while cur and (cur[-1][1] - cur[0][0] > overlap or b - cur[0][0] > size):
                    cur.pop(0)
            cur.append((a, b))
        if cur:
            out.append((cur[0][0], cur[-1][1]))
        return out

    return rec(0, len(text), tuple(separators))


def split_text(text: str, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", "")) -> list[str]:
    return [text[a:b] for a, b in split_offsets(text, size, overlap, separators)]


@lru_cache(maxsize=None)
def _recursive_udf(size: int, overlap: int, separators: tuple[str, ...]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if not isinstance(t, str) else split_text(t, size, overlap, separators) for t in texts],
                         dtype=object)
    # called nondeterministic so that Spark runs it once: what it infers of an exploded column would run it again, as a filter
    return chunks.asNondeterministic()


def recursive_chunks(text, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", "")) -> Column:
    """array<string> of chunks by the recursive splitter."""
    return _recursive_udf(int(size), int(overlap), tuple(separators))(_c(text))


def chunk_array(text, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", "")) -> Column:
    """Pick the SQL form when the separator list is only the empty separator."""
    if tuple(separators) in ((), ("",)):
        return fixed_windows(text, size, overlap)
    return recursive_chunks(text, size, overlap, separators)
