"""Token ids as binary files: concatenated ids with Elias-Fano encoded document boundaries.

Texts are dealt to ranges of document ids and encoded there. Each range is cut into segments of bounded size, and each
segment is one file, written by Spark's own file writer so that a lost task
leaves nothing behind and any store that Spark writes to will do. A segment holds, all little-endian:

====================  ==================================================================================================
magic                 8 bytes, ``SKTOKEN1``
header                8 unsigned 32-bit numbers: range, place in the range, documents, documents without an id, bytes per
                      id (2 or 4), then three zeros; then 2 unsigned 64-bit numbers: ids, bytes of the ids' section
document ids          Elias-Fano, of the differences to the first one, which stands before it as a signed 64-bit number
boundaries            Elias-Fano, of the end of each document, counted in ids
ids                   all ids, one document after the other
line feed             one byte, from the writer
====================  ==================================================================================================

Elias-Fano keeps the low bits of each number packed and the rest in unary, about two bits a number; every 256th set bit's
place is kept as a 32-bit number, so that ``select`` looks at a few bytes to give any document's offset. There is no table
of 64-bit offsets.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from ..util import bounded_broadcast
from .blocks import expand, pieces

MAGIC = b"SKTOKEN1"
SAMPLE = 256
SEGMENT_BYTES = 4 << 20
BATCH_BYTES = 1 << 20   # of text that is encoded at once; a longer text is encoded alone


@dataclass
class EliasFano:
    """Non-decreasing numbers below 2**63 in near-minimal space, with random access."""
    n: int
    low_bits: int
    low: np.ndarray      # packed bits
    high: np.ndarray     # packed bits: for each number a set bit, before it one clear bit for each step of the high part
    samples: np.ndarray  # places of the set bits 0, 256, 512 ...

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, *(np.zeros(0, np.uint8),) * 2, np.zeros(0, np.uint32))
        low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        bits = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> bits) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(place[-1]) + 1, np.uint8)
        flags[place] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), place[::SAMPLE].astype(np.uint32))

    def select(self, which) -> np.ndarray:
        """The numbers at the places ``which``."""
        which = np.asarray(which, np.int64)
        at = np.empty(len(which), np.int64)
        group = which // SAMPLE
        order = np.argsort(group, kind="stable")
        groups, first = np.unique(group[order], return_index=True)
        for g, mine in zip(groups.tolist(), np.split(order, first[1:])):
            a = int(self.samples[g]) // 8
            b = int(self.samples[g + 1]) // 8 + 1 if g + 1 < len(self.samples) else len(self.high)
            found = a * 8 + np.flatnonzero(np.unpackbits(self.high[a:b], bitorder="little"))
            found = found[found >= int(self.samples[g])]
            at[mine] = found[which[mine] - g * SAMPLE]
        out = (at - which).astype(np.uint64) << np.uint64(self.low_bits)
        for bit in range(self.low_bits):
            p = which * self.low_bits + bit
            out |= ((self.low[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(bit)
        return out

    def bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """(numbers, place after them)."""
        n, low_bits, low, high, samples = np.frombuffer(data, "<u4", 5, at).tolist()
        at += 20
        parts = [np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                 np.frombuffer(data, "<u4", samples, at + low + high)]
        return cls(n, low_bits, *parts), at + low + high + 4 * samples


@dataclass
class Segment:
    part: int
    place: int
    n_null: int          # the first documents have no id
    doc_ids: EliasFano
    base: int            # the first document id
    ends: EliasFano
    ids: np.ndarray

    def bytes(self) -> bytes:
        head = np.array([self.part, self.place, self.ends.n, self.n_null, self.ids.itemsize, 0, 0, 0], "<u4").tobytes()
        size = np.array([len(self.ids), self.ids.nbytes], "<u8").tobytes()
        return b"".join([MAGIC, head, size, np.array([self.base], "<i8").tobytes(), self.doc_ids.bytes(),
                         self.ends.bytes(), self.ids.tobytes()])

    @classmethod
    def read(cls, data: bytes) -> Segment:
        if data[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        part, place, _, n_null, width, *_ = np.frombuffer(data, "<u4", 8, 8).tolist()
        n, _ = np.frombuffer(data, "<u8", 2, 40).tolist()
        base = int(np.frombuffer(data, "<i8", 1, 56)[0])
        doc_ids, at = EliasFano.read(data, 64)
        ends, at = EliasFano.read(data, at)
        return cls(part, place, n_null, doc_ids, base, ends, np.frombuffer(data, f"<u{width}", n, at))

    def documents(self) -> list[int | None]:
        known = self.doc_ids.select(np.arange(self.doc_ids.n)) + np.int64(self.base).astype(np.uint64)
        return [None] * self.n_null + known.astype(np.int64).tolist()

    def offsets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, end) of the documents at the places ``which``."""
        which = np.asarray(which, np.int64)
        start = np.zeros(len(which), np.int64)
        start[which > 0] = self.ends.select(which[which > 0] - 1)
        return start, self.ends.select(which).astype(np.int64)


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece between two single spaces once.

    A byte-level tokenizer begins a new token at a single space between two other characters, whatever stands around; so
    texts are cut there (and nowhere else), the distinct pieces are encoded, and their ids put together by position. What
    is known of earlier pieces is kept up to ``KNOWN`` pieces or ``CHARS`` characters, by the next tasks of the worker too,
    then forgotten. ASCII punctuation at the end of a piece, after a letter, is encoded apart: there a token begins as well.
    New words go to the library in runs of ``RUN``, each run one text; the tokens that begin with a space tell them apart.
    """
    KNOWN = 1 << 19
    CHARS = 1 << 23
    RUN = 64
    TAIL = r"^(?P<core>.*\pL)(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
    MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))  # the bytes of a tail
    last: tuple = ()

    @classmethod
    def of(cls, tokenizer_json: str, special_as_text: bool) -> Encoder:
        """The encoder of this worker, made anew for another tokenizer."""
        key = (hash(tokenizer_json), len(tokenizer_json), special_as_text)
        if not cls.last or cls.last[0] != key:
            cls.last = (key, cls(tokenizer_json, special_as_text))
        return cls.last[1]

    def __init__(self, tokenizer_json: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.chars = 0
        self.end, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # of each known piece; room for more behind

    def units(self, texts: pa.Array) -> tuple[list[str], int, np.ndarray, np.ndarray]:
        """(distinct units, how many of them, the first ones, are a space and a word without white space around, which of
        them stand in all texts one after the other, first of each text and the end)."""
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words, code = coded.dictionary, coded.indices.to_numpy()
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        opens = np.zeros(len(code), bool)
        opens[first] = True
        # no cut beside other white space: such pieces go together with their neighbours
        initial, final = self._ends(words)
        left = self._spaces(words, initial, 0, 1)
        right = self._spaces(words, final, -1)
        ends = right[code]
        joins = ~opens & (left[code] | np.r_[False, ends[:-1]])
        start = np.flatnonzero(~joins)
        size = np.diff(np.r_[start, len(code)])
        # the first piece of a text has no space before it
        own = opens[start] | (size > 1) | ends[start]
        which = code[start].astype(np.int64)
        used = np.zeros(len(words), bool)
        used[which[~own]] = True
        place_of = np.cumsum(used) - 1
        which = place_of[which]
        used = np.flatnonzero(used)
        words_of = words.take(pa.array(used))
        # pieces as one unit or two
        ending = np.flatnonzero(self.MARK[final[used]])
        parted = pc.extract_regex(words_of.take(pa.array(ending)), self.TAIL)
        two = parted.is_valid().to_numpy(zero_copy_only=False)
        ending, parted = ending[two], parted.filter(pa.array(two))
        mask = np.zeros(len(used), bool)
        mask[ending] = True
        cores = pc.replace_with_mask(words_of, pa.array(mask), pc.struct_field(parted, "core")).dictionary_encode()
        tails = pc.struct_field(parted, "tail").dictionary_encode()
        units = pc.binary_join_element_wise("", cores.dictionary, " ").to_numpy(zero_copy_only=False).tolist()
        n_words = len(units)
        core, tail = cores.indices.to_numpy().astype(np.int64), np.full(len(used), -1)
        tail[ending] = tails.indices.to_numpy().astype(np.int64) + n_words
        units += tails.dictionary.to_pylist()
        place = {}
        for i, a, k in zip(np.flatnonzero(own).tolist(), start[own].tolist(), size[own].tolist()):
            unit = ("" if opens[a] else " ") + " ".join(words.take(pa.array(code[a:a + k])).to_pylist())
            at = place.get(unit)
            if at is None:
                at = place[unit] = len(used) + len(place)
            which[i] = at
        core = np.r_[core, len(units) + np.arange(len(place))]
        tail = np.r_[tail, np.full(len(place), -1)]
        units += place
        second = tail[which]
        at = np.r_[0, np.cumsum(1 + (second >= 0))]
        seq = np.empty(at[-1], np.int64)
        seq[at[:-1]] = core[which]
        two = second >= 0
        seq[at[:-1][two] + 1] = second[two]
        return units, n_words, seq, at[np.searchsorted(start, np.r_[first, len(code)])]

    @staticmethod
    def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last byte of each word, 32 for an empty one."""
        if not len(words):
            return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        empty = at[1:] == at[:-1]
        return (np.where(empty, 32, data[np.minimum(at[:-1], len(data) - 1)]),
                np.where(empty, 32, data[np.maximum(at[1:] - 1, 0)]))

    def _spaces(self, words: pa.Array, byte: np.ndarray, *cut: int) -> np.ndarray:
        """Which words have, at the end where ``byte`` stands and ``cut`` takes the character, white space or nothing."""
        out = (byte <= 32) | (byte == 127)
        wide = np.flatnonzero(byte > 127)
        out[wide] = self._space(pc.utf8_slice_codeunits(words.take(pa.array(wide)), *cut)).to_numpy(zero_copy_only=False)
        return out

    @staticmethod
    def _space(chars: pa.Array) -> pa.Array:
        """Which characters may be white space to the tokenizer: more of them than it knows do no harm."""
        return pc.or_(pc.utf8_is_space(chars), pc.match_substring_regex(chars, r"[\x00-\x20\x7F-\xA0\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]"))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), by the library."""
        sizes, pools = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(texts), 1 << 8):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a:a + (1 << 8)], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            pools.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(pools)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are a space and a word each."""
        firsts = np.arange(0, len(words), self.RUN)
        sizes, ids = self._library(["".join(words[a:a + self.RUN]) for a in firsts.tolist()])
        begins = np.flatnonzero(self.spaced[ids])
        per_run = np.diff(np.searchsorted(begins, np.r_[0, np.cumsum(sizes)]))
        if not np.array_equal(per_run, np.diff(np.r_[firsts, len(words)])) or (len(ids) and not self.spaced[ids[0]]):
            return self._library(words)  # the vocabulary has no space, or a special token takes it
        return np.diff(np.r_[begins, len(ids)]), ids

    def _learn(self, words: list[str], rest: list[str]) -> None:
        """Encode new pieces, ``words`` being a space and a word each."""
        n = len(self.known)
        self.chars += sum(map(len, words)) + sum(map(len, rest))
        self.known.update(zip(chain(words, rest), range(n, n + len(words) + len(rest))))
        for sizes, ids in (self._words(words), self._library(rest)):
            used, n_after = int(self.end[n]), n + len(sizes)
            if n_after >= len(self.end):
                self.end = np.r_[self.end[:n + 1], np.empty(max(n, len(sizes)), np.int64)]
            if used + len(ids) > len(self.pool):
                self.pool = np.r_[self.pool[:used], np.empty(max(used, len(ids)), np.uint32)]
            self.end[n + 1:n_after + 1] = used + np.cumsum(sizes)
            self.pool[used:used + len(ids)] = ids
            n = n_after

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text and the end)."""
        units, n_words, which, first = self.units(pc.fill_null(texts, ""))
        if len(self.known) > self.KNOWN or self.chars > self.CHARS:
            self.forget()
        n = len(self.known)
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0)
        at[new] = n + np.arange(len(new))
        k = int(np.searchsorted(new, n_words))
        self._learn([units[i] for i in new[:k].tolist()], [units[i] for i in new[k:].tolist()])
        seq = at[which]
        begin = self.end[seq]
        per = self.end[seq + 1] - begin
        return self.pool[expand(begin, per)], np.r_[0, np.cumsum(per)][first]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 0, id_col: str = "doc_id",
                      text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, special_as_text: bool = True) -> None:
    """Deal the texts of ``docs`` (a table or checkpointed) to ranges of their ids, encode them there and write segments in
    ascending order of the ids under ``path``.

    Null ids come first; rows that share an id stand in the order of the table. ``end_id`` closes each document. Ids have
    two bytes where the vocabulary allows, else four. A segment ends with the document that fills ``segment_bytes``. The
    tokenizer's file is read by the driver and broadcast; its kind must be byte-level BPE without a space put before texts.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    kind = json.loads(text).get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space"):
        raise ValueError("not a byte-level tokenizer without a space put before texts")
    own = docs.sparkSession.sparkContext.broadcast(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("_row"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("_row").asc()]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def segments(batches):
        part, place = TaskContext.get().partitionId(), 0
        encode = Encoder.of(own.value, special_as_text)
        width = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        close = np.array([] if end_id is None else [end_id], width)
        doc_ids, sizes, data, filled = [], [], [], 0

        def segment():
            known = np.array([d for d in doc_ids if d is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            steps = known.astype(np.uint64) - np.int64(base).astype(np.uint64)
            return Segment(part, place, len(doc_ids) - len(known), EliasFano.of(steps), base,
                           EliasFano.of(np.cumsum(np.array(sizes, np.int64))), np.concatenate(data)).bytes()

        for batch in pieces(batches, 1, BATCH_BYTES):
            ids, at = encode(batch.column(1))
            ids, at = ids.astype(width), at.tolist()
            for d, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                doc_ids.append(d), sizes.append(b - a + len(close)), data.extend((ids[a:b], close))
                filled += sizes[-1] * ids.itemsize + 8
                if filled >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([segment()], pa.binary())], ["value"])
                    place, filled = place + 1, 0
                    doc_ids, sizes, data = [], [], []
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([segment()], pa.binary())], ["value"])

    (ranged.mapInArrow(segments, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files under ``path``: (doc_id, start, n_tokens, ids_crc32) and, if asked, ids array<int>.

    ``start`` counts the ids of all documents before it, over all files; ``ids_crc32`` is the CRC-32 of the ids as unsigned
    32-bit numbers. Offsets come from the select structures of each segment; across segments, from sums by range.
    """
    ensure_checkpoint_dir(spark)
    schema = "part long, place long, local long, doc_id long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                data = data.as_buffer()
                if not data.size:
                    continue
                seg = Segment.read(memoryview(data).tobytes())
                doc_ids = seg.documents()
                for a in range(0, seg.ends.n, 4096):
                    which = np.arange(a, min(seg.ends.n, a + 4096))
                    start, end = seg.offsets(which)
                    ids = [seg.ids[x:y].astype("<u4") for x, y in zip(start.tolist(), end.tolist())]
                    columns = [np.full(len(which), seg.part), np.full(len(which), seg.place), start,
                               pa.array(doc_ids[a:a + 4096], pa.int64()), end - start,
                               np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64)]
                    names = ["part", "place", "local", "doc_id", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                                                     names)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(read, schema + (", ids array<int>" if with_ids else "")).checkpoint()
    sizes = found.groupBy("part", "place").agg(F.sum("n_tokens").alias("n"))
    ranges = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range
    base = ranges.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(F.broadcast(base), "part").select(
        "part", "place", (F.col("base") + F.col("inside")).alias("base")).checkpoint()
    starts, _ = bounded_broadcast(starts, 1_000_000)
    return found.join(starts, ["part", "place"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int | None = 0,
                id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> str:
    """Encode ``docs``, write them as token files under ``path`` (default: a fresh folder in the shared scratch folder) and
    return it.

    Defined cases: null and empty texts have the end id alone; null ids come before all others; repeated ids and rows are
    documents of their own; an empty table gives files without documents; further columns are not read.
    """
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path, end_id, id_col, text_col, segment_bytes)
    return path
