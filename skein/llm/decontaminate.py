"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

The benchmark is the stated query set: it is read in slices of bounded size, and each slice meets all documents where
they are read, without a shuffle. For every item length the windows of that many words are fingerprinted; a multi-index
over ``radius + 1`` blocks of the 64 bits finds every item fingerprint within ``radius`` (of so many blocks at least one
has no differing bit); each candidate is verified by the exact weighted Jaccard similarity of its five-word shingles,
weights being their numbers of occurrences. Windows that hold too few shingles of any one item to reach the threshold,
a bound from counts, are not fingerprinted. A document with fewer words than the item is one window, all of it, with its
own number of shingles; being one each, these windows are verified for every item that passes the bound from counts,
without fingerprints.

``radius`` 24 covers the threshold 0.8: two texts of weighted similarity 0.8 differ in 9.7 of 64 bits on average with a
standard deviation of 2.9, so a pair beyond 24 is a five-sigma case; equal texts never differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import expand, pieces
from .textnum import LOWER, U, shingle_hashes, span_hashes, utf8, word_spans

SHINGLE = 5
SLICE_BYTES = 8 << 20  # of item texts that are broadcast at once


def _words(column):
    buf, offs = utf8(column)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    return span_hashes(buf, starts, ends), first


def fingerprints(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of the ``n`` shingles from each start on."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        one = ((grams >> U(bit)) & U(1)).astype(np.int32)
        total = np.r_[0, np.cumsum(one)]
        out |= (2 * (total[starts + n] - total[starts]) > n).astype(np.uint64) << U(bit)
    return out


def hamming_candidates(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i of a, j of b) within ``radius``: equal in one of ``radius + 1`` blocks, then counted."""
    edge = np.linspace(0, 64, radius + 2).astype(int)
    pairs = []
    for lo, hi in zip(edge, edge[1:]):
        mask = U((1 << int(hi - lo)) - 1)
        x, y = (a >> U(lo)) & mask, (b >> U(lo)) & mask
        order = np.argsort(y, kind="stable")
        left, right = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        i = np.repeat(np.arange(len(a)), right - left)
        j = order[expand(left, right - left)]
        near = np.bitwise_count(a[i] ^ b[j]) <= radius
        pairs.append(i[near] * len(b) + j[near])
    found = np.unique(np.concatenate(pairs))
    return found // max(1, len(b)), found % max(1, len(b))


class Items:
    """Index of a slice of items: shingle -> items, and per number of words the items with their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], percent: int):
        self.ids = np.array(ids, np.int64)
        words, first = _words(pa.array(texts, pa.string()))
        self.percent, self.lengths = percent, {}
        n_words = np.diff(first)
        for length in np.unique(n_words[n_words > 0]).tolist():
            k = min(SHINGLE, length)
            n = length - k + 1
            at = np.flatnonzero(n_words == length)
            grams = np.stack([shingle_hashes(words[first[i]:first[i + 1]], k) for i in at])
            prints = np.array([fingerprints(g, np.zeros(1, np.int64), n)[0] for g in grams], np.uint64)
            gram = np.unique(grams)
            item = np.repeat(np.arange(len(at)), n)
            flat = np.unique(np.stack([np.searchsorted(gram, grams.ravel()), item], 1), axis=0)
            self.lengths[length] = (k, n, at, np.sort(grams, axis=1), prints, gram, flat)
        self.every = {k: np.unique(np.concatenate([v[5] for v in self.lengths.values() if v[0] == k]))
                      for k in {v[0] for v in self.lengths.values()}}

    def search(self, texts, radius: int) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, words, shared shingles, shingles of window and item together) of the best window of
        each document and item it matches."""
        words, first = _words(texts)
        doc_words = np.diff(first)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best: dict[tuple[int, int], tuple] = {}
        grams = {}
        for k, every in self.every.items():
            g = shingle_hashes(words, k)
            ok = doc[:len(g)] == doc[k - 1:k - 1 + len(g)]
            known = every[np.minimum(np.searchsorted(every, g), len(every) - 1)] == g
            grams[k] = g, np.flatnonzero(known & ok)
        for length, (k, n, at, sorted_grams, prints, gram, flat) in self.lengths.items():
            g, hits = grams[k]
            for d, t in self._short(hits, g, n, k, gram, flat, doc, doc_words, length):
                m = int(doc_words[d]) - k + 1
                shared = _common(np.sort(g[first[d]:first[d] + m]), sorted_grams[t])
                if 100 * shared >= self.percent * (m + n - shared):
                    best[d, int(at[t])] = (-shared, int(first[d])), int(doc_words[d]), m + n
            starts = self._windows(g, hits, n, gram, flat, doc, length)
            if not len(starts):
                continue
            region = np.unique(expand(starts, np.full(len(starts), n)))  # fingerprints from these shingles alone
            window = np.searchsorted(region, starts)
            i, j = hamming_candidates(fingerprints(g[region], window, n), prints, radius)
            for s, t in zip(starts[i].tolist(), j.tolist()):
                shared = _common(np.sort(g[s:s + n]), sorted_grams[t])
                if 100 * shared >= self.percent * (2 * n - shared):
                    key = (int(doc[s]), int(at[t]))
                    now = (-shared, s)
                    if key not in best or now < best[key][0]:
                        best[key] = now, length, 2 * n
        return [(d, int(self.ids[t]), s - int(first[d]), length, -shared, both)
                for (d, t), ((shared, s), length, both) in sorted(best.items())]

    def _short(self, hits, g, n, k, gram, flat, doc, doc_words, length) -> list[tuple[int, int]]:
        """(document, item) where the document has fewer words than the items and could share enough with the item."""
        own = doc_words[doc[hits]]
        hits = hits[(own < length) & (100 * (own - k + 1) >= self.percent * n)]
        if not len(hits):
            return []
        at = np.minimum(np.searchsorted(gram, g[hits]), len(gram) - 1)
        mine = gram[at] == g[hits]
        hits, at = hits[mine], at[mine]
        begin, end = np.searchsorted(flat[:, 0], at, "left"), np.searchsorted(flat[:, 0], at, "right")
        pairs = np.stack([np.repeat(doc[hits], end - begin), flat[expand(begin, end - begin), 1]], 1)
        pairs, held = np.unique(pairs, axis=0, return_counts=True)
        both = doc_words[pairs[:, 0]] - k + 1 + n
        return [tuple(x) for x in pairs[(100 + self.percent) * held >= self.percent * both].tolist()]

    def _windows(self, g, hits, n, gram, flat, doc, length) -> np.ndarray:
        """Starts of windows of ``n`` shingles, inside one document, that could share enough with one item."""
        need = -(-2 * self.percent * n // (100 + self.percent))  # shared >= p (2n - shared)
        if not len(hits):
            return hits
        at = np.searchsorted(gram, g[hits])
        mine = gram[np.minimum(at, len(gram) - 1)] == g[hits]
        hits, at = hits[mine], at[mine]
        begin, end = np.searchsorted(flat[:, 0], at, "left"), np.searchsorted(flat[:, 0], at, "right")
        item, place = flat[expand(begin, end - begin), 1], np.repeat(hits, end - begin)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        if len(place) < need:
            return place[:0]
        a, b = place[:len(place) - need + 1], place[need - 1:]
        close = (item[:len(a)] == item[need - 1:]) & (b - a < n)
        lo, hi = np.maximum(b[close] - n + 1, 0), a[close]
        starts = np.unique(expand(lo, hi - lo + 1))
        starts = starts[starts + length <= len(doc)]
        return starts[doc[starts] == doc[starts + length - 1]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.where(y[at] == x, np.minimum(n, m[at]), 0).sum())


def slices(items: DataFrame, id_col: str, text_col: str, percent: int):
    """Indexes of the benchmark, each over at most about SLICE_BYTES of text."""
    spark = items.sparkSession
    own = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for i in range(n):
        part = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast(Items([-1 if r[0] is None else r[0] for r in part], [r[1] for r in part],
                                                 percent))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, radius: int = 24, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, shared, similarity): the best window for each document row and item that
    it matches, of equal ones the first. Documents without a match have no row. Windows have as many words as the item;
    a document that has fewer is one window, with ``n_words`` its own.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an item with fewer than five words is one shingle. Defined
    cases: null and empty texts of documents match nothing, items without words are skipped; null document ids are
    passed through, a null item id is -1; repeated rows repeat their results; empty tables give an empty result;
    further columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, shared long, similarity double"
    result = None
    for index in slices(items, item_id_col, item_text_col, percent):
        def search(batches, index=index):
            for batch in pieces(batches, 1):
                found = index.value.search(batch.column(1), radius)
                doc, item, start, words, shared, both = np.array(found, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), *map(pa.array, (item, start, words, shared)),
                     pa.array(shared / np.maximum(1, both - shared))],
                    ["doc_id", "item_id", "start_word", "n_words", "shared", "similarity"])

        part = own.mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, radius: int = 24,
                         text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that match no item; cases as in :func:`contaminated`."""
    for index in slices(items, item_id_col, item_text_col, percent):
        def clean(batches, index=index, at=docs.columns.index(text_col)):
            for batch in pieces(batches, at):
                stay = np.ones(batch.num_rows, bool)
                found = index.value.search(batch.column(at).fill_null(""), radius)
                stay[[f[0] for f in found]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
