"""Different long words and lines that polynomials modulo a power of two can't tell apart; piece borders of the hashes."""

import numpy as np
import pytest

from skein.llm import repeats, textnum
from skein.llm.bytes_dedup import bytes_dedup
from skein.llm.decontaminate import contaminated
from skein.llm.jaccard_join import jaccard_components
from skein.llm.line_dedup import line_dedup
from skein.llm.substring_dedup import substring_dedup

DOCS = "doc_id long, text string"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def other(word):
    return word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_hashes(n):
    word = thue_morse(n)
    buf = np.frombuffer(f"{word} {other(word)} {word}".encode(), np.uint8)
    starts, ends, _ = textnum.word_spans(buf, np.array([0, len(buf)]))
    a, b, c = textnum.span_hashes(buf, starts, ends)
    assert a == c != b
    running = textnum.Running(lambda x, y: textnum.BYTE[buf[x:y]], len(buf))
    a, b, c = running.parts(starts, n)
    assert a == c != b


def test_hashes_over_pieces():
    """A part hashes alike wherever it stands, and as integers say."""
    r = np.random.default_rng(5)
    size = textnum.PIECE
    buf = r.integers(97, 100, 3 * size).astype(np.uint8)
    places = np.array([0, size - 350, 2 * size - 1, 3 * size - 700])
    for p in places:
        buf[p:p + 700] = buf[:700]
    running = textnum.Running(lambda x, y: textnum.BYTE[buf[x:y]], len(buf))
    got = running.parts(np.r_[places, 1], 700)
    assert len(set(got[:-1].tolist())) == 1 and got[-1] != got[0]
    base, total = textnum.BASES[1], 0
    for i, x in enumerate(textnum.halves(textnum.BYTE[buf[:size + 9]])[1].tolist()):
        total = (total + x * pow(base, i, textnum.PRIME)) % textnum.PRIME
    assert total == running.total[1][size + 9]
    long = np.full(5 * size, 120, np.uint8)  # two spans longer than the tables of powers
    long[2 * size + 200] = 32
    starts, ends = np.array([0, 2 * size + 201]), np.array([2 * size + 200, len(long)])
    ends[1] = starts[1] + ends[0]
    a, b = textnum.span_hashes(long, starts, ends)
    assert a == b


@pytest.mark.parametrize("n", [1024, 4096])
def test_different_words_stay_apart(spark, n):
    word = thue_morse(n)
    around = [f"w{i}" for i in range(24)]
    first = " ".join(around[:12] + [word] + around[12:])
    second = " ".join(around[:12] + [other(word)] + around[12:])
    docs = spark.createDataFrame([(1, first), (2, second)], DOCS)
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 2}
    lines = spark.createDataFrame([(1, f"a b c d {word}\nown first line of this"),
                                   (2, f"a b c d {other(word)}\nown second line of that")], DOCS)
    assert {r.doc_id: r.n_removed for r in line_dedup(lines).collect()} == {1: 0, 2: 0}
    items = spark.createDataFrame([(7, first)], "item_id long, text string")
    assert [r.doc_id for r in contaminated(docs, items).collect()] == [1]
    raw = spark.createDataFrame([(1, word[:300] + "x"), (2, other(word)[:300] + "y")], DOCS)
    text = {1: word[:300] + "x", 2: other(word)[:300] + "y"}
    every = [t[i:i + 200] for t in text.values() for i in range(len(t) - 199)]
    want = {}
    for d, t in text.items():
        gone = set()
        for i in range(len(t) - 199):
            if every.count(t[i:i + 200]) > 1:
                gone.update(range(i, i + 200))
        want[d] = len(gone)
    assert {r.doc_id: r.n_removed for r in bytes_dedup(raw).collect()} == want


def test_anchor_pieces(monkeypatch):
    """The anchors of windows don't depend on the pieces they are found in."""
    r = np.random.default_rng(3)
    symbols = textnum.mix(r.integers(0, 40, 3000).astype(np.uint64))
    offs = np.array([0, 700, 701, 1900, 3000])
    whole = repeats.anchors(lambda a, b: symbols[a:b], offs, 3000, 20, 8, 4, 60)
    monkeypatch.setattr(repeats, "PIECE", 64)
    parts = repeats.anchors(lambda a, b: symbols[a:b], offs, 3000, 20, 8, 4, 60)
    for x, y in zip(vars(whole).values(), vars(parts).values()):
        assert np.array_equal(x, y)
