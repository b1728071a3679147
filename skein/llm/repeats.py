"""Where windows of T symbols (words or bytes) may repeat: rounds shared by the two substring operators.

Every window is sent to the bucket of its *anchor*, the smallest hash among its k-grams; equal windows have equal
anchors, so all occurrences of a window meet. A window whose anchor stands at one place only cannot repeat: the first
two rounds count the places of each anchor over all documents, and only the segments around repeated ones are cut out
and sent on. Nothing is decided here: an anchor counted twice by chance costs work, never a wrong result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .blocks import Packer, expand, rows
from .textnum import PIECE, U, kgram_hashes, slide

LONGEST = 64  # segments are cut so that they hold at most LONGEST times the windows of one anchor


@dataclass
class Anchors:
    values: np.ndarray   # distinct anchors of the block, by bucket
    multi: np.ndarray    # the anchor stands at several places of the block
    bucket: np.ndarray
    starts: np.ndarray   # segments: first window, number of windows, anchor (place in values)
    windows: np.ndarray
    which: np.ndarray


def anchors(symbols, doc_of_first: np.ndarray, total: int, window: int, k: int, n_buckets: int,
            longest: int) -> Anchors:
    """``symbols(a, b)`` gives symbol hashes of positions a..b; ``doc_of_first``: offset of each document and the end."""
    w = window - k + 1
    n = total - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(np.zeros(0, np.uint64), np.zeros(0, bool), empty, empty, empty, empty)
    least, places = np.empty(n, np.uint64), []
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        # with the windows around the piece, so that every place knows all windows that hold it
        lo, hi = max(0, a - w + 1), min(n, b + w - 1)
        g = kgram_hashes(symbols(lo, hi + window - 1), k)
        m = slide(g, w, np.minimum)
        least[a:b] = m[a - lo:b - lo]
        # a k-gram is an anchor if it is the smallest of some window that holds it
        top = slide(np.r_[np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)], w, np.maximum)
        here = np.arange(len(g)) + lo
        mine = (top == g) & (here >= a) & (here < (b if b < n else n + w))
        places.append(g[mine])
    ok = np.zeros(n, bool)
    for a, b in zip(doc_of_first[:-1], doc_of_first[1:]):
        if b - a >= window:
            ok[a:b - window + 1] = True
    change = np.r_[True, (least[1:] != least[:-1]) | ~ok[:-1]] & ok
    starts = np.flatnonzero(change)
    if not len(starts):
        return Anchors(np.zeros(0, np.uint64), np.zeros(0, bool), empty, empty, empty, empty)
    ends_at = np.flatnonzero(ok & np.r_[(least[1:] != least[:-1]) | ~ok[1:], True]) + 1
    lengths = ends_at - starts
    if lengths.max() > longest:
        parts = -(-lengths // longest)
        nth = expand(np.zeros(len(parts), np.int64), parts)
        starts, lengths = np.repeat(starts, parts) + nth * longest, np.repeat(lengths, parts) - nth * longest
        lengths = np.minimum(lengths, longest)
    found, n_places = np.unique(np.concatenate(places), return_counts=True)
    values = np.unique(least[starts])
    at = np.searchsorted(found, values)
    multi = n_places[at] > 1
    bucket = (values % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    which = back[np.searchsorted(values, least[starts])]
    return Anchors(values[order], multi[order], bucket[order], starts, lengths, which)


def ask(block: int, found: Anchors, n_buckets: int) -> pa.Table:
    """One row for each bucket: 39 bits of each anchor and whether it stands at several places already."""
    tags = (((found.values // U(n_buckets)) & U((1 << 39) - 1)) << U(1)) | found.multi.astype(np.uint64)
    raw = tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    buckets, first = np.unique(found.bucket, return_index=True)
    cuts = [*first.tolist(), len(raw)]
    return rows(block, buckets, [raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])


def resolve(table: pa.Table) -> pa.Table:
    """For each row of the bucket: the bits that say which of its anchors stand at two places or more."""
    table = table.combine_chunks()
    data = table["data"].to_pylist()
    sizes = np.array([len(x) // 5 for x in data])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 5)
    tags = wide.view("<u8").ravel()
    key = tags >> U(1)
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    repeated = (n[inverse] > 1) | ((tags & U(1)) == 1)
    cuts = np.r_[0, np.cumsum(sizes)].tolist()
    bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return rows(table["block"].to_numpy(), table["bucket"].to_numpy(), bits)


def repeated_segments(found: Anchors, replies: pa.Table) -> np.ndarray:
    """Which segments of the block have an anchor that the buckets found repeated."""
    flag = np.zeros(len(found.values), bool)
    if len(flag):
        buckets, first, n = np.unique(found.bucket, return_index=True, return_counts=True)
        at = {int(b): (int(f), int(c)) for b, f, c in zip(buckets, first, n)}
        for b, bits in zip(replies["bucket"].to_pylist(), replies["data"].to_pylist()):
            f, c = at[b]
            flag[f:f + c] = np.unpackbits(np.frombuffer(bits, np.uint8), count=c).astype(bool)
    return flag[found.which] if len(found.which) else np.zeros(0, bool)


def send(block: int, found: Anchors, keep: np.ndarray, content_hash, write, order_of) -> pa.Table:
    """Rows for buckets: each distinct segment of the block once, with all its places.

    ``content_hash(starts, windows)`` identifies segments, ``write(packer, starts, windows)`` packs their symbols and
    ``order_of(starts)`` gives arrays that order first places over all blocks.
    """
    seg = np.flatnonzero(keep)
    if not len(seg):
        return rows(block, 0, [])
    starts, windows, which = found.starts[seg], found.windows[seg], found.which[seg]
    h = content_hash(starts, windows)
    order = np.lexsort((starts, h, which))
    starts, windows, which, h = starts[order], windows[order], which[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (which[1:] != which[:-1])]
    first = np.flatnonzero(new)
    n_places = np.diff(np.r_[first, len(starts)])
    bucket = found.bucket[which[first]]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    data = []
    for a, b in zip(cuts, cuts[1:]):
        f = first[a:b]
        p = Packer().put(h[f]).put(found.values[which[f]]).put(windows[f].astype(np.uint32))
        p.put(n_places[a:b].astype(np.uint32))
        p.put(starts[first[a]:(first[b] if b < len(first) else len(starts))].astype(np.uint32))
        for x in order_of(starts[f]):
            p.put(x)
        write(p, starts[f], windows[f])
        data.append(p.squeezed())
    return rows(block, bucket[cuts[:-1]], data)


@dataclass
class Entries:
    """What a bucket has got: one entry for each distinct segment of each block."""
    table: pa.Table
    block: np.ndarray     # row of the table
    content: np.ndarray   # hash of the segment
    anchor: np.ndarray
    windows: np.ndarray
    n_places: np.ndarray
    first: np.ndarray     # of the entry's places
    place: np.ndarray     # all places, in windows of the block
    order: list           # what orders first places
    symbols: np.ndarray   # all segments
    at: np.ndarray        # the entry's in them
    window: int

    def parts(self, size: int):
        """Entries by anchor, in parts of about ``size`` symbols: no window is in two parts."""
        n = max(1, -(-len(self.symbols) // size))
        part = (self.anchor >> U(32)) % U(n)
        for i in range(n):
            chosen = np.flatnonzero(part == i)
            if len(chosen):
                yield chosen

    def report(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        """Rows for blocks from (row of the table, first window, number of windows) of what is to be reported."""
        block, start, length = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(block, kind="stable")
        block, start, length = block[order], start[order], length[order]
        told, first = np.unique(block, return_index=True)
        cuts = [*first.tolist(), len(block)]
        return rows(self.table["block"].to_numpy()[told], self.table["bucket"][0].as_py(),
                    [spans_of(start[a:b], length[a:b]) for a, b in zip(cuts, cuts[1:])])


def received(table: pa.Table, window: int, order_types, read) -> Entries:
    """Unpack a bucket's rows; ``read(packer)`` gives the symbols that ``write`` of :func:`send` has put."""
    n, content, anchor, windows, n_places, place, order, symbols = [], [], [], [], [], [], [], []
    for data in table["data"].to_pylist():
        p = Packer.of_squeezed(data)
        content.append(p.get(np.uint64)), anchor.append(p.get(np.uint64))
        windows.append(p.get(np.uint32)), n_places.append(p.get(np.uint32)), place.append(p.get(np.uint32))
        order.append([p.get(t) for t in order_types])
        symbols.append(read(p))
        n.append(len(content[-1]))
    windows = np.concatenate(windows).astype(np.int64)
    n_places = np.concatenate(n_places).astype(np.int64)
    size = windows + window - 1
    return Entries(table, np.repeat(np.arange(len(n)), n), np.concatenate(content), np.concatenate(anchor), windows,
                   n_places, np.cumsum(n_places) - n_places, np.concatenate(place).astype(np.int64),
                   [np.concatenate(x) for x in zip(*order)], np.concatenate(symbols), np.cumsum(size) - size, window)


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Ranges of windows, merged where they touch."""
    if not len(starts):
        return b""
    order = np.argsort(starts, kind="stable")
    a, b = np.asarray(starts, np.int64)[order], (np.asarray(starts, np.int64) + lengths)[order]
    reach = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([a[first], reach[np.r_[first[1:] - 1, len(a) - 1]]]).astype(np.uint32).tobytes()


def covered(replies: pa.Table, n: int, window: int) -> np.ndarray:
    """The symbols of the block that the reported windows cover."""
    step = np.zeros(n + 1, np.int32)
    for data in replies["data"].to_pylist():
        a, b = np.frombuffer(data, np.uint32).reshape(2, -1).astype(np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, b - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0
