"""Find-and-apply rounds between document blocks and hash buckets.

Documents are dealt once, by a hash of their id, to *blocks* of bounded size; a block is read by one task at a time.
What blocks must learn about each other travels as packed rows through *buckets* (hashes of keys): a block sends each
bucket one row with each of its distinct keys once -- so a key that a third of all documents share reaches its bucket
once per block, not once per document -- and gets one row back. All rounds are grouped Arrow functions over ordinary
shuffles in one plan: the exchange of the texts is planned once and reused by every round that reads them, and any lost
part is recomputed from its lineage. Both counts follow ``spark.sql.shuffle.partitions``, which is to grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "block int, bucket int, data binary"
ROW_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
NULL_ID = -(2**63)  # order of a null id: before all others


def counts(df: DataFrame, per_partition: int = 2) -> int:
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal(docs: DataFrame, n: int, id_col: str, text_col: str, keep: dict | None = None) -> DataFrame:
    """(block, doc_id, text) and ``keep`` with null texts as empty ones; documents without an id are dealt by text."""
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(
        F.xxhash64(F.col(id_col).cast("long")))
    return docs.select(F.pmod(spread, F.lit(n)).cast("int").alias("block"),
                       F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[c.alias(name) for name, c in (keep or {}).items()])


def rows(block, buckets, data) -> pa.Table:
    """Packed rows; ``block`` or ``buckets`` may be one number."""
    n = len(data)
    full = lambda x: np.broadcast_to(np.asarray(x, np.int32), n)
    return pa.table([pa.array(full(block)), pa.array(full(buckets)), pa.array(data, pa.binary())], schema=ROW_ARROW)


def in_order(table: pa.Table, extra=()) -> tuple[pa.Table, np.ndarray]:
    """The documents of a block by (id, text), nulls first, and their ids; rows that repeat an id stay apart."""
    table = table.select(["block", "doc_id", "text", *extra])
    ids = table["doc_id"].fill_null(NULL_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(same):
        text = table["text"]
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py().encode())))
    if len(order) and np.any(order[1:] < order[:-1]) or table["text"].num_chunks > 1:
        table = table.take(order).combine_chunks()
    return table, ids[order]


def rounds(docs: DataFrame, find, resolve, cut, decide, apply, schema: str) -> DataFrame:
    """``find(block)`` -> rows for buckets; ``resolve(bucket)`` -> rows for blocks; ``cut(block, replies)`` -> rows for
    buckets; ``decide(bucket)`` -> rows for blocks; ``apply(block, replies)`` -> the result, of ``schema``.

    ``docs`` comes from :func:`deal`.
    """
    asked = docs.groupBy("block").applyInArrow(find, ROW)
    answered = asked.groupBy("bucket").applyInArrow(resolve, ROW)
    sent = docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(cut, ROW)
    decided = sent.groupBy("bucket").applyInArrow(decide, ROW)
    return docs.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(apply, schema)


class Packer:
    """Arrays in one binary value: ``pack`` in some order, ``unpack`` in the same."""

    def __init__(self, data: bytes = b""):
        self.parts: list[bytes] = []
        self.data, self.at = data, 0

    def put(self, x: np.ndarray) -> Packer:
        raw = np.ascontiguousarray(x)
        self.parts += [np.int64(raw.size).tobytes(), raw.tobytes()]
        return self

    def get(self, dtype) -> np.ndarray:
        n = int(np.frombuffer(self.data, np.int64, 1, self.at)[0])
        x = np.frombuffer(self.data, dtype, n, self.at + 8)
        self.at += 8 + x.nbytes
        return x

    def bytes(self) -> bytes:
        return b"".join(self.parts)

    def squeezed(self) -> bytes:
        raw = self.bytes()
        return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def of_squeezed(cls, data: bytes) -> Packer:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return cls(pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def pieces(batches, column: int, size: int = 1 << 20):
    """Slices of record batches with about ``size`` bytes of text, one row at least, so that passes stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
