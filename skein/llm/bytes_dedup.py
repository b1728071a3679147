"""Substring dedup by bytes: suffix order by prefix-free parsing.

Bytes that could belong to a repeated window meet, as distinct segments, in the bucket of their anchor (see
``repeats``). There the segments are parsed: a rolling hash of ``TRIGGER`` bytes marks triggers, and the phrases run
from one trigger to the next, both included, so that no phrase suffix that ends in a trigger is a prefix of another.
The dictionary of distinct phrases gets a suffix array by prefix doubling, the parse (the sequence of phrase ranks) a
second one; the place of any window in corpus order is the pair (rank of its phrase suffix, rank of the parse after
it). Highly repetitive text has a short dictionary and a short parse, however often it occurs. Equal windows are
neighbours in that order; fingerprints of all their bytes tell where one class ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .blocks import counts, deal, expand, in_order, rounds, rows
from .textnum import BYTE, PIECE, Running, U, kgram_hashes, mix, utf8

TRIGGER = 8       # bytes of a trigger
PHRASE = 16       # one in so many trigger hashes ends a phrase


PART_BYTES = 2 << 20    # of a shard that are ordered at once
PACKED = 6              # symbols of up to 10 bits that the first sort looks at


def suffix_ranks(symbols: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Rank of each suffix ``symbols[i:end[i]]`` by its first ``reach`` symbols (or more); equal ones share a rank.

    Prefix doubling; from the second round on only suffixes that are not yet alone with their rank are sorted.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    key, h = symbols.astype(np.int64) + 1, 1
    if key.max() < 1024:
        for j in range(1, PACKED):
            follow = np.zeros(n, np.int64)
            follow[:max(0, n - j)] = symbols[j:] + 1
            key = key * 1024 + np.where(at + j < end, follow, 0)
        h = PACKED
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))  # number of smaller suffixes
    alone = new & np.r_[new[1:], True]
    todo = order[~alone]
    while h < reach and len(todo):
        follow = np.zeros(len(todo), np.int64)
        inside = todo + h < end[todo]
        follow[inside] = rank[todo[inside] + h] + 1
        old = rank[todo]
        key = old * (n + 1) + follow
        order = np.argsort(key)
        key, old, todo = key[order], old[order], todo[order]
        place = np.arange(len(todo))
        group = np.r_[True, old[1:] != old[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        if new.sum() == group.sum():  # no longer prefix tells more apart
            break
        rank[todo] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(
            np.where(group, place, 0))
        todo = todo[~(new & np.r_[new[1:], True])]
        h *= 2
    return rank


def corpus_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, reach: int,
                 running: Running) -> np.ndarray:
    """A number that orders the suffixes from the positions ``at`` of the texts ``starts..ends``: rank of the phrase
    suffix in the dictionary, then rank of the parse after it."""
    n, w = len(text), TRIGGER
    own = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    hit = np.concatenate([a + np.flatnonzero(kgram_hashes(BYTE[text[a:a + PIECE + w - 1]], w) % U(PHRASE) == 0)
                          for a in range(0, n, PIECE)])
    hit = hit[own[hit] == own[np.minimum(hit + w - 1, n - 1)]]  # starts of triggers inside one text
    # phrases: from a text's start or a trigger to the end of the next trigger or of the text
    first = np.sort(np.concatenate([starts, hit]))  # a trigger at a text's start closes a phrase of its own
    nxt = np.r_[first[1:], n]
    text_of = own[first]
    last = np.r_[text_of[1:] != text_of[:-1], True]
    stop = np.where(last, ends[text_of], nxt + w)
    length = stop - first
    phrase = mix(running.parts(first, length) + length.astype(np.uint64) * U(2) + last.astype(np.uint64))
    _, chosen, which = np.unique(phrase, return_index=True, return_inverse=True)
    # dictionary: the distinct phrases; one that ends its text is closed by a symbol below all bytes
    size = length[chosen] + last[chosen]
    d_at = np.cumsum(size) - size
    d = np.zeros(int(size.sum()), np.int64)
    d[expand(d_at, length[chosen])] = text[expand(first[chosen], length[chosen])].astype(np.int64) + 1
    rank_d = suffix_ranks(d, np.repeat(d_at + size, size), reach + w)
    # parse: phrases in text order, each by the rank of its whole
    parse = rank_d[d_at[which]]
    parse_end = np.searchsorted(text_of, text_of, "right")
    rank_p = suffix_ranks(parse, parse_end, reach)
    # each position belongs to the first phrase whose closing trigger starts at it or later
    j = np.searchsorted(np.where(last, stop - 1, stop - w), at, "left")
    suffix = rank_d[d_at[which[j]] + at - first[j]]
    after = np.where(last[j], 0, rank_p[np.minimum(j + 1, len(first) - 1)] + 1)
    return suffix * (int(rank_p.max(initial=0)) + 2) + after


def _bytes(table: pa.Table):
    table, ids = in_order(table)
    buf, offs = utf8(table["text"])
    return table, ids, buf, offs


def bytes_dedup(docs: DataFrame, window: int = 200, k: int = 32, id_col: str = "doc_id", text_col: str = "text",
                n_blocks: int | None = None, n_shards: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept binary).

    Every UTF-8 byte covered by a ``window``-byte string that also starts anywhere else, in the same document or
    another, is removed; overlaps count, matches never cross documents. ``n_spans`` counts maximal removed runs. Defined
    cases: null and empty texts have no bytes; rows that share an id, with or without equal texts, are separate
    documents, so repeated rows remove each other; null ids are allowed; an empty table gives an empty result; further
    columns are not read. ``window`` is at least ``k``, a power of two. ``kept`` is binary: a cut may split a character.
    """
    n_blocks, n_shards = n_blocks or counts(docs), n_shards or counts(docs)

    def anchors(buf, offs):
        return repeats.anchors(lambda a, b: BYTE[buf[a:b]], offs, len(buf), window, k, n_shards,
                               2 * (window - k + 1))

    def find(table: pa.Table) -> pa.Table:
        _, _, buf, offs = _bytes(table)
        return repeats.ask(table["block"][0].as_py(), anchors(buf, offs), n_shards)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(0, 0, [])
        _, _, buf, offs = _bytes(table)
        found = anchors(buf, offs)
        running = Running(lambda a, b: BYTE[buf[a:b]], len(buf))

        def content(at, windows):
            return mix(running.parts(at, windows + window - 1) + windows.astype(np.uint64))

        def write(p, at, windows):
            p.put(buf[expand(at, windows + window - 1)])

        keep = repeats.repeated_segments(found, replies)
        return repeats.send(table["block"][0].as_py(), found, keep, content, write, lambda at: ())

    def decide(table: pa.Table) -> pa.Table:
        return shard_decisions(table, window, part_bytes)

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()),
                             "kept": pa.array([], pa.binary())})
        table, _, buf, offs = _bytes(table)
        gone = repeats.covered(replies, len(buf), window)
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        opens = gone & (np.r_[True, ~gone[:-1]] | edge[:-1]) if len(buf) else gone
        removed, opened = np.r_[0, np.cumsum(gone)][offs], np.r_[0, np.cumsum(opens)][offs]
        out = buf[~gone].tobytes()
        at = (offs - removed).tolist()
        return pa.table({
            "doc_id": table["doc_id"].combine_chunks(),
            "n_bytes": pa.array(np.diff(offs)),
            "n_removed": pa.array(np.diff(removed)),
            "n_spans": pa.array(np.diff(opened)),
            "kept": pa.array([out[a:b] for a, b in zip(at, at[1:])], pa.binary()),
        })

    return rounds(deal(docs, n_blocks, id_col, text_col), find, repeats.resolve, cut, decide, apply,
                  "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def shard_decisions(table: pa.Table, window: int, part_bytes: int) -> pa.Table:
    """Order a shard's distinct segments, and tell each block which of its windows occur more than once."""
    entries = repeats.received(table, window, (), lambda p: p.get(np.uint8))
    found = [_repeated(entries, chosen) for chosen in entries.parts(part_bytes)]
    return entries.report(found)


def _repeated(entries: repeats.Entries, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, number) of the runs of repeated windows at all places of the entries ``mine``."""
    window = entries.window
    _, chosen, content = np.unique(entries.content[mine], return_index=True, return_inverse=True)
    n_places = entries.n_places[mine]
    times = np.bincount(content, weights=n_places).astype(np.int64)
    win = entries.windows[mine][chosen]
    length = win + window - 1
    joined = entries.symbols[expand(entries.at[mine][chosen], length)]
    ends = np.cumsum(length)
    begin = ends - length
    at = expand(begin, win)  # the positions where windows start
    owner = np.repeat(np.arange(len(chosen)), win)
    running = Running(lambda a, b: BYTE[joined[a:b]], len(joined))
    order = np.argsort(corpus_order(joined, begin, ends, at, window, running))
    fingerprint = running.parts(at[order], window)
    first = np.flatnonzero(np.r_[True, fingerprint[1:] != fingerprint[:-1]])
    class_times = np.add.reduceat(times[owner[order]], first)
    repeated = np.empty(len(at), bool)
    repeated[order] = np.repeat(class_times > 1, np.diff(np.r_[first, len(order)]))
    # runs of repeated windows of each distinct segment
    new = np.r_[True, owner[1:] != owner[:-1], True]
    run_a = np.flatnonzero(repeated & (np.r_[True, ~repeated[:-1]] | new[:-1]))
    run_b = np.flatnonzero(repeated & (np.r_[~repeated[1:], True] | new[1:])) + 1
    run_owner = owner[run_a]
    run_cut = np.searchsorted(run_owner, np.arange(len(chosen) + 1))
    offset = run_a - (np.cumsum(win) - win)[run_owner]
    # every place of every entry repeats the runs of its content
    place_content = np.repeat(content, n_places)
    n_runs = np.diff(run_cut)[place_content]
    run = expand(run_cut[place_content], n_runs)
    place = entries.place[expand(entries.first[mine], n_places)]
    return (np.repeat(np.repeat(entries.block[mine], n_places), n_runs), np.repeat(place, n_runs) + offset[run],
            (run_b - run_a)[run])
