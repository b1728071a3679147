"""Substring dedup by words: a compressed FM-index per shard, backward search over wavelet trees.

A shard is a hash bucket of anchors (see ``repeats``): it holds the text segments in which a window of ``window`` words
could repeat, from all documents. Its FM-index is built over the distinct segments: word hashes become ranks, suffixes
are ordered by prefix doubling to ``2 * window`` words or more, the Burrows-Wheeler text is kept as a wavelet matrix of
packed bits. The segments are then streamed through it from right to left; each backward step extends the match by one
word, and a bit vector of the places where neighbouring suffixes share fewer than ``window`` words cuts it back to
``window``. The matching statistics thus give for each window the interval of all its occurrences in the shard, of
which the one with the smallest document and start stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .blocks import Packer, counts, deal, expand, in_order, rounds, rows
from .textnum import Running, U, WHITE, mix, span_hashes, utf8, word_spans


ORDER = (np.int64, np.uint32, np.uint32)  # id, document and start of a segment's first place in a block
PART_WORDS = 1 << 19  # of a shard that are indexed at once


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        mask = (U(1) << (i & 63).astype(np.uint64)) - U(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """Rank of any symbol over a sequence of small integers, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        x = symbols
        for d in reversed(range(self.depth)):
            bit = ((x >> d) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, bits, zeros in zip(reversed(range(self.depth)), self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((c >> d) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position i."""
        return self._walk(c, i) - self.first[c]


class FMIndex:
    """Index of texts (words as ranks from 1 on, each text closed by 0) for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        self.depth = depth
        n = len(text)
        rank, same, h = text.astype(np.int64), None, 1
        while h <= depth:  # after each round, order and equality hold for 2h symbols
            if h * 2 > depth and same is None:
                same = self._same(rank, h, depth - h)
            follow = np.zeros(n, np.int64)
            follow[:n - h] = rank[h:] + 1
            key = rank * (n + n_symbols + 2) + follow
            _, rank = np.unique(key, return_inverse=True)
            h *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.begin = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.bwt = WaveletMatrix(bwt, n_symbols)
        # rows whose first `depth` symbols differ from those of the row before open a new class
        a, b = order[1:], order[:-1]
        new = np.r_[True, (same[0][a] != same[0][b]) | (same[1][a] != same[1][b])]
        self.class_of = np.cumsum(new) - 1
        self.class_start = np.r_[np.flatnonzero(new), n]

    @staticmethod
    def _same(rank: np.ndarray, h: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Two ranks of h symbols each that together tell apart h + shift symbols."""
        second = np.zeros_like(rank)
        second[:len(rank) - shift] = rank[shift:] + 1
        return rank, second

    def stream(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Class of the ``depth`` symbols from each position of the patterns on, -1 where fewer follow.

        Matching statistics of indexed texts: every symbol of a pattern occurs in the index.
        """
        out = np.full(len(patterns), -1, np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        lo = np.zeros(len(starts), np.int64)
        hi = np.full(len(starts), len(self.class_of), np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            m = int(np.searchsorted(-lengths, -step, "left"))  # texts longer than step
            at = starts[:m] + lengths[:m] - 1 - step
            c = patterns[at]
            lo[:m] = self.begin[c] + self.bwt.rank(c, lo[:m])
            hi[:m] = self.begin[c] + self.bwt.rank(c, hi[:m])
            if step + 1 >= self.depth:  # cut the match back to `depth` symbols
                k = self.class_of[lo[:m]]
                lo[:m], hi[:m] = self.class_start[k], self.class_start[k + 1]
                out[at] = k
        return out


def _words(table: pa.Table):
    table, ids = in_order(table)
    buf, offs = utf8(table["text"])
    starts, ends, first = word_spans(buf, offs)
    return table, ids, buf, offs, starts, ends, first


def substring_dedup(docs: DataFrame, window: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    n_blocks: int | None = None, n_shards: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Each word covered by a window of ``window`` words is removed if the
    window's word sequence also starts earlier (smaller id, or same document, earlier start); ``kept`` joins the other
    words by one space. Defined cases: null and empty texts have no words; a null id orders before all others; rows that
    share an id are separate documents in the order of their texts (so of repeated rows the first keeps its words);
    an empty table gives an empty result; further columns are not read. ``window`` is at least ``k``, a power of two.
    """
    n_blocks, n_shards = n_blocks or counts(docs), n_shards or counts(docs)

    def anchors(buf, starts, ends, first):
        h = span_hashes(buf, starts, ends)
        return h, repeats.anchors(lambda a, b: h[a:b], first, len(h), window, k, n_shards, 4 * (window - k + 1))

    def find(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, _, buf, _, starts, ends, first = _words(table)
        return repeats.ask(block, anchors(buf, starts, ends, first)[1], n_shards)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(0, 0, [])
        block = table["block"][0].as_py()
        _, ids, buf, _, starts, ends, first = _words(table)
        h, found = anchors(buf, starts, ends, first)
        running = Running(lambda a, b: h[a:b], len(h))

        def content(at, windows):
            return mix(running.parts(at, windows + window - 1) + windows.astype(np.uint64))

        def write(p, at, windows):
            distinct, codes = np.unique(h[expand(at, windows + window - 1)], return_inverse=True)
            p.put(distinct).put(codes.astype(np.uint32))

        def order_of(at):
            doc = np.searchsorted(first, at, "right") - 1
            return ids[doc], doc.astype(np.uint32), (at - first[doc]).astype(np.uint32)  # as ORDER

        keep = repeats.repeated_segments(found, replies)
        return repeats.send(block, found, keep, content, write, order_of)

    def decide(table: pa.Table) -> pa.Table:
        return shard_decisions(table, window, part_words)

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        table, ids, buf, offs, starts, ends, first = _words(table)
        gone = repeats.covered(replies, len(starts), window)
        stay = ~gone
        # a kept word takes the white-space byte after it along, if its document has one
        doc_end = offs[1:][np.repeat(np.arange(len(ids)), np.diff(first))]
        step = np.zeros(len(buf) + 1, np.int8)
        step[starts[stay]] += 1
        upto = np.minimum(ends[stay] + 1, doc_end[stay])
        np.add.at(step, upto, -1)
        mask = np.cumsum(step[:-1], dtype=np.int8) > 0
        clean = np.where(WHITE[buf], np.uint8(0x20), buf)
        out = clean[mask].tobytes()
        at = np.r_[0, np.cumsum(mask)][offs].tolist()
        kept = [out[a:b - 1] if b > a and out[b - 1] == 0x20 else out[a:b] for a, b in zip(at, at[1:])]
        removed = np.r_[0, np.cumsum(gone)]
        return pa.table({
            "doc_id": table["doc_id"].combine_chunks(),
            "n_words": pa.array(np.diff(first).astype(np.int64)),
            "n_removed": pa.array((removed[first[1:]] - removed[first[:-1]]).astype(np.int64)),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return rounds(deal(docs, n_blocks, id_col, text_col), find, repeats.resolve, cut, decide, apply,
                  "doc_id long, n_words long, n_removed long, kept string")


def shard_decisions(table: pa.Table, window: int, part_words: int) -> pa.Table:
    """Index a shard's distinct segments, stream them, and tell each block which of its windows start earlier elsewhere."""
    def read(p: Packer) -> np.ndarray:
        distinct = p.get(np.uint64)
        return distinct[p.get(np.uint32)]

    entries = repeats.received(table, window, ORDER, read)
    return entries.report([_late(entries, chosen) for chosen in entries.parts(part_words)])


def _late(entries: repeats.Entries, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, number) of the windows, at all places of the entries ``mine``, that start earlier."""
    window, win, n_places = entries.window, entries.windows[mine], entries.n_places[mine]
    _, chosen, content = np.unique(entries.content[mine], return_index=True, return_inverse=True)
    # the distinct segments, each closed by symbol 0
    length = win[chosen] + window - 1
    symbols, coded = np.unique(entries.symbols[expand(entries.at[mine][chosen], length)], return_inverse=True)
    at = np.cumsum(length + 1) - (length + 1)
    joined = np.zeros(int((length + 1).sum()), np.int64)
    joined[expand(at, length)] = coded + 1
    class_at = FMIndex(joined, len(symbols) + 1, window).stream(joined, at, length)
    # one row per window of each entry: its class and the order of the entry's first place
    offset = expand(np.zeros(len(win), np.int64), win)
    entry = np.repeat(np.arange(len(win)), win)
    cls = class_at[at[content][entry] + offset]
    doc_id, nth, start = (x[mine][entry] for x in entries.order)
    block = entries.table["block"].to_numpy()[entries.block[mine]][entry]
    sort = np.lexsort((start + offset, nth, block, doc_id, cls))
    late = np.ones(len(cls), bool)
    late[sort[np.r_[True, cls[sort][1:] != cls[sort][:-1]]]] = False
    # at an entry's first place all but the earliest window of a class, at its other places all
    first = entries.place[entries.first[mine]]
    more = expand(entries.first[mine] + 1, n_places - 1)
    owner = np.repeat(np.arange(len(win)), n_places - 1)
    return (np.r_[entries.block[mine][entry][late], entries.block[mine][owner]],
            np.r_[(first[entry] + offset)[late], entries.place[more]],
            np.r_[np.ones(int(late.sum()), np.int64), win[owner]])


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), w AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20
), k AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d
), kept AS (
  SELECT word.doc_id, count(gone.j) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY word.j) FILTER (WHERE gone.j IS NULL), '') AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
