"""Words, hashes and sliding minima of text held in Arrow buffers, as NumPy passes without a Python object per word.

Spans (words, lines, windows) are hashed by two polynomials over the field of the prime ``PRIME`` with independent values
for each symbol: 62 bits, without the regular collisions that polynomials modulo a power of two have for some texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15  # multiplier of the polynomial hashes; odd, so it has an inverse modulo 2**64
_INV = pow(_ODD, -1, 2**64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
PIECE = 1 << 18  # bytes or symbols handled at once, so that the passes stay in the cache


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_ODD))  # one random-looking value for each byte


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ODD**i, ODD**-i) for i < n."""
    both = []
    for base in (_ODD, _INV):
        x = np.full(n, U(base))
        if n:
            x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return both[0], both[1]


PRIME = (1 << 31) - 1
_P, _31 = U(PRIME), U(31)
BASES = (0x3C6EF372 % PRIME, 0x1B873593 % PRIME)


def fold(x: np.ndarray) -> np.ndarray:
    """Numbers modulo PRIME, made smaller: below 2**32 from numbers below 2**62; twice, any are at most PRIME + 5."""
    high = x >> _31
    high += x & _P
    return high


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME, below PRIME."""
    x = fold(fold(x))
    x -= (x >= _P) * _P
    return x


def field_powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = reduced(out[:more] * U(pow(base, done, PRIME)))
        done += more
    return out[:n]


_FIELD = [(field_powers(b, PIECE * 2), field_powers(pow(b, -1, PRIME), PIECE * 2)) for b in BASES]
_BYTE_HALVES = np.stack([reduced(BYTE >> U(33)), reduced(BYTE & _P)])


def halves(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values below 2**31 of each 64-bit symbol hash."""
    return symbols >> U(33), symbols & _P


class Running:
    """Prefix sums of a stream of symbol hashes, for the hash of any part of it.

    ``symbols(a, b)`` gives the hashes of positions a..b; powers are kept for one piece and one row of pieces only.
    """

    def __init__(self, symbols, n: int):
        self.total = np.zeros((2, n + 1), np.uint32)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            for total, x, base, (pw, _) in zip(self.total, halves(symbols(a, b)), BASES, _FIELD):
                part = fold(np.cumsum(fold(x * pw[:b - a]), dtype=np.uint64))
                part *= U(pow(base, a, PRIME))
                part += U(total[a])
                total[a + 1:b + 1] = reduced(part)
        self.inverse = [np.array([pow(base, -a, PRIME) for a in range(0, n + 1, PIECE)], np.uint64) for base in BASES]

    def parts(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Hashes of ``lengths`` symbols from ``starts`` on, equal for equal parts (not spread, see :func:`mix`)."""
        out = np.zeros(len(starts), np.uint64)
        stops, piece, rest = starts + lengths, starts // PIECE, starts % PIECE
        for total, inverse, (_, ipw), shift in zip(self.total, self.inverse, _FIELD, (U(31), U(0))):
            x = fold((total[stops].astype(np.uint64) + _P - total[starts]) * inverse[piece])
            out |= reduced(fold(x) * ipw[rest]) << shift
        return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    offs = offs.astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, between=WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the words, by default ``[^\\x20\\x09-\\x0D]+``."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    white = between[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    solid = ~white
    starts = np.flatnonzero(solid & (np.r_[True, white[:-1]] | edge[:-1]))
    ends = np.flatnonzero(solid & (np.r_[white[1:], True] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        s, e = starts[i:j] - a, ends[i:j] - a
        if b - a < 2 * PIECE:
            part = np.zeros(j - i, np.uint64)
            for of_byte, (pw, ipw), shift in zip(_BYTE_HALVES, _FIELD, (U(31), U(0))):
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum(fold(of_byte[buf[a:b]] * pw[:b - a]), out=total[1:])
                part |= reduced(fold(fold(total[e] - total[s])) * ipw[s]) << shift
        else:  # one long span
            part = Running(lambda x, y: BYTE[buf[a + x:a + y]], b - a).parts(s, e - s)
        out[i:j] = mix(part) + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def kgram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive symbol hashes from each position on; ``k`` is a power of two."""
    g, n = symbols, 1
    while n < k:
        g = g[:max(0, len(g) - n)] + g[n:] * U(pow(_ODD, n, 2**64))
        n *= 2
    return mix(g)


def slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each ``w`` consecutive values."""
    n = 1
    while n * 2 <= w:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[:len(x) - (w - n)], x[w - n:]) if w > n else x


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (any ``k``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g += words[j:j + n] * U(pow(_ODD, j, 2**64))
    return mix(g)
