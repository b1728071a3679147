"""Byte-level BPE by a global distinct-word shuffle.

Texts are split into pre-tokens (the matches of the tokenizer's pattern). A block of documents keeps each distinct
pre-token once and its documents as sequences of word numbers, that is, positions. Each distinct word of a block goes to
the bucket of its hash, where every distinct word of the whole corpus is encoded exactly once; the ids are joined back to
the blocks that asked, and each document's ids are put together by position. What is shuffled is a block's vocabulary
there and back and the packed positions, never a row per token. Decoding joins ids with the token-byte table, whose size
is the fixed vocabulary.

Blocks are numbered by input partition and place in it: the input must give the same rows in the same partitions when
a task is run again, as a table scan does (write or checkpoint anything else first). A block whose replies don't fit its
words stops the job with an error.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .blocks import Packer, counts, expand, pieces

BLOCK_BYTES = 8 << 20
# a single space between two other characters always starts a pre-token, whatever stands before it
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (one base64 token and its id per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _encode_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    get, never = ranks.get, 1 << 31
    pair = [get(word[i:i + 2], never) for i in range(len(word) - 1)]
    while pair:
        best = min(pair)
        if best == never:
            break
        i = pair.index(best)
        joined = parts[i] + parts.pop(i + 1)
        parts[i] = joined
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + joined, never)
        if i < len(pair):
            pair[i] = get(joined + parts[i + 1], never)
    return [ranks[x] for x in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1)) + [n]      # part i is word[i:end[i]]
    before = list(range(-1, n))
    alive = [True] * n + [False]
    heap = []

    def offer(i):
        j = end[i]
        if i >= 0 and j < n:
            r = ranks.get(word[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and alive[j] and end[j] == stop):
            continue  # one of the two has been merged since
        end[i], alive[j] = stop, False
        before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class _Uneven(Exception):
    """A piece between two spaces that is empty or starts or ends with white space."""


class _Words(dict):
    """Pre-token -> number in order of appearance, and piece of text -> numbers of its pre-tokens."""

    def __init__(self, pattern):
        super().__init__()
        self.number, self.find = {}, pattern.findall

    def first(self, piece: str) -> tuple[int, ...]:
        number = self.number
        return tuple([number.setdefault(t, len(number)) for t in self.find(piece)])

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        found = self[piece] = self.first(" " + piece)
        return found

    def text(self, text: str) -> list[int]:
        pieces = text.split(" ")
        try:
            if pieces[0] and not pieces[0][-1].isspace():
                return [*self.first(pieces[0]), *chain.from_iterable(map(self.__getitem__, pieces[1:]))]
        except _Uneven:
            pass
        pieces = _CUT.split(text)
        return [*self.first(pieces[0]), *chain.from_iterable(self.first(" " + p) for p in pieces[1:])]


def _blocks(batches, size: int):
    """(block number, its rows, texts): consecutive rows of up to about ``size`` bytes."""
    part = TaskContext.get().partitionId()
    for nth, rows in enumerate(pieces(batches, 1, size)):
        yield (part << 24) + nth, rows, rows.column(1).to_pylist()


def _numbered(texts, pattern, n_buckets: int):
    """Words of a block in bucket order, their buckets, and for each text its sequence of places among them."""
    words = _Words(pattern)
    found = [np.array(words.text(t) if t else (), np.uint32) for t in texts]
    raw = [w.encode("utf-8", "surrogatepass") for w in words.number]
    bucket = np.array([zlib.crc32(w) for w in raw], np.int64) % n_buckets
    # by bucket, then by bytes: neighbours share their beginnings, which compresses
    order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return [raw[i] for i in order], bucket[order], place, found


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 as their lowest bytes, then the next ones and so on: like bytes together compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def whole(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").ravel()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = (), n_buckets: int | None = None, block_bytes: int = BLOCK_BYTES,
               with_bytes: bool = False) -> DataFrame:
    """One row per input row: (doc_id, n_tokens, ids array<int>) and the columns in ``keep``, without special tokens.

    Defined cases: null and empty texts have no ids; null and repeated document ids are passed through; an empty table
    gives an empty result; further columns are not read. ``ranks_path`` is read by the driver; the rank table, bounded by
    the vocabulary, is the only thing broadcast. A block of ``block_bytes`` of text needs some twenty times its size in
    memory; larger blocks shuffle fewer words. ``with_bytes`` adds ``decoded`` as :func:`bpe_decode` would, in the tasks
    that assemble the ids.
    """
    spark = docs.sparkSession
    n_buckets = n_buckets or counts(docs, 2)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    table = spark.sparkContext.broadcast({v: k for k, v in ranks.value.items()}) if with_bytes else None
    extra = [f"_keep{i}" for i in range(len(keep))]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         *[F.col(c).alias(e) for e, c in zip(extra, keep)])
    kept = source.select(*extra).schema.fields
    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()),
                         StructField("ids", ArrayType(IntegerType())), *kept,
                         *([StructField("decoded", BinaryType())] if with_bytes else [])])

    def words_and_positions(batches):
        split = regex.compile(pattern)
        for block, own, texts in _blocks(batches, block_bytes):
            words, bucket, place, found = _numbered(texts, split, n_buckets)
            del texts
            buckets, first = np.unique(bucket, return_index=True)
            cuts = [*first.tolist(), len(words)]
            data = [Packer().put(np.array([len(w) for w in words[a:b]], np.uint32))
                    .put(np.frombuffer(b"".join(words[a:b]), np.uint8)).squeezed() for a, b in zip(cuts, cuts[1:])]
            n = np.array([len(x) for x in found], np.int64)
            seq = np.concatenate(found)
            del found
            # the rows without their texts travel with the positions
            rest = pa.Table.from_batches([own]).drop_columns("text")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_table(rest)
            p = Packer().put(np.frombuffer(sink.getvalue(), np.uint8))
            p.put(n).put(np.array([len(words)])).put(planes(place[seq]))
            data.append(p.squeezed())
            yield pa.RecordBatch.from_arrays([pa.array([*buckets.tolist(), -1 - block], pa.int64()),
                                              pa.array([block] * len(data), pa.int64()), pa.array(data, pa.binary())],
                                             ["key", "block", "data"])

    def encode(table: pa.Table) -> pa.Table:
        bucket = table["key"][0].as_py()
        if bucket < 0:  # positions
            return pa.table({"key": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()),
                             "data": pa.array([], pa.binary())})
        known, rank, out = {}, ranks.value, []
        for data in table["data"].to_pylist():
            p = Packer.of_squeezed(data)
            ends = np.cumsum(p.get(np.uint32)).tolist()
            raw = p.get(np.uint8).tobytes()
            ids = []
            for a, b in zip([0, *ends], ends):
                w = raw[a:b]
                found = known.get(w)
                if found is None:
                    found = known[w] = encode_word(w, rank)
                ids.append(found)
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            size = np.array([len(x) for x in ids], np.uint32)
            out.append(Packer().put(planes(size)).put(planes(flat)).squeezed())
        return pa.table({"key": pc.subtract(-1, table["block"]), "bucket": pa.array([bucket] * len(out), pa.int64()),
                         "data": pa.array(out, pa.binary())})

    def assemble(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if blocks.num_rows and blocks["key"][0].as_py() >= 0:  # words
            return none
        order = np.argsort(replies["bucket"].to_numpy())
        data = replies["data"].to_pylist()
        sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in order:
            p = Packer.of_squeezed(data[i])
            sizes.append(whole(p.get(np.uint8))), ids.append(whole(p.get(np.uint8)))
        size, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        begin = np.cumsum(size) - size
        if blocks.num_rows != 1:
            raise RuntimeError("a block's words came back without its documents: the input's partitions have changed")
        p = Packer.of_squeezed(blocks["data"][0].as_py())
        own, n = pa.ipc.open_stream(pa.py_buffer(p.get(np.uint8))).read_all(), p.get(np.int64)
        if int(p.get(np.int64)[0]) != len(size):
            raise RuntimeError("a block's words don't fit its documents: the input's partitions have changed")
        seq = whole(p.get(np.uint8))
        per_word = size[seq]
        cut = np.r_[0, np.cumsum(n)]
        at = np.r_[0, np.cumsum(per_word)][cut]
        out = ids[expand(begin[seq], per_word)]
        return pa.table([own["doc_id"], pa.array(np.diff(at), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32())),
                         *[own[e] for e in extra],
                         *([pa.array([_bytes_of(out[a:b], table.value) for a, b in zip(at, at[1:])], pa.binary())] if with_bytes else [])],
                        names=["doc_id", "n_tokens", "ids", *extra, *(["decoded"] if with_bytes else [])])

    # words by bucket and positions by block are dealt in one exchange, which both rounds read
    none = to_arrow_schema(schema).empty_table()
    dealt = source.mapInArrow(words_and_positions, "key long, block long, data binary")
    words = dealt.groupBy("key").applyInArrow(encode, "key long, bucket long, data binary")
    found = dealt.groupBy("key").cogroup(words.groupBy("key")).applyInArrow(assemble, schema)
    return found.select("doc_id", "n_tokens", "ids", *[F.col(e).alias(c) for e, c in zip(extra, keep)],
                        *(["decoded"] if with_bytes else []))


def _bytes_of(ids: np.ndarray, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with one more column, ``decoded`` binary: the bytes of its ids, joined with the token-byte table.

    Null ids give null, no ids empty bytes; an id that isn't in the table stops the job. All columns are kept; one
    that is named ``decoded`` already is replaced.
    """
    spark: SparkSession = encoded.sparkSession
    ranks = read_ranks(ranks_path)
    table = spark.sparkContext.broadcast({v: k for k, v in ranks.items()})
    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def decode(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            out = [None if gone else _bytes_of(ids[i].values.to_numpy(), table.value)
                   for i, gone in enumerate(ids.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, schema)
