"""Importance resampling against plain Python, and its defined cases."""

import hashlib
import math
import random
import re
import zlib

import pytest

from skein.llm import resample as module
from skein.llm.resample import resample

DOCS = "doc_id long, text string, rank string, score string, bucket string"
ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, n):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i:i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


def brute(docs, items, n=2, size=10_000, percent=25, least=20):
    def total(texts):
        out = [0] * size
        for t in texts:
            for f in features(t, n)[1]:
                out[zlib.crc32(f.encode()) % size] += 1
        return out
    source, target = total(t for _, t in docs), total(items)
    s_all, t_all = sum(source), sum(target)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size))))
            for s, t in zip(source, target)]
    rows = []
    for d, t in docs:
        words, found = features(t, n)
        weight = sum(gain[zlib.crc32(f.encode()) % size] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32))), None, len(words)])
    chosen = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(chosen[:percent * len(chosen) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def run(spark, docs, items, **kw):
    df = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in docs], DOCS).repartition(4)
    return [tuple(r) for r in resample(df, spark.createDataFrame(list(enumerate(items)), ITEMS), **kw).collect()]


@pytest.mark.parametrize("n,size", [(1, 10_000), (2, 10_000), (3, 64)])
def test_resample(spark, monkeypatch, n, size):
    r = random.Random(n)
    vocabulary = ["the", "The", "straße", "日本", "x1", "7", "Ünder", "a-b", "it's", "q", "ÅB", " ", "long" * 30]
    docs = [(i, r.choice(["", "..", " "]) + r.choice([" ", ", ", "\n", "_"]).join(r.choices(vocabulary, k=r.randrange(60))))
            for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (None, docs[3][1]), (203, "word " * 30_000), (204, "w" * 100_000)]
    items = ["the x1 7 straße, the x1", None, "", docs[5][1]]
    got = run(spark, docs, items, n=n, n_buckets=size)
    assert ordered(got) == ordered(brute(docs, items, n, size))


def test_pieces_change_nothing(spark):
    """Pieces of few bytes give the same counts and sums as one piece."""
    import numpy as np
    import pyarrow as pa
    texts = pa.array(["a b a b", None, "", "B, c  a", "a b"] * 3)
    whole = module.Grams(texts, 2, 50)
    parts = [module.Grams(texts.slice(i, 1), 2, 50) for i in range(len(texts))]
    assert np.array_equal(whole.counts(50), sum(p.counts(50) for p in parts))
    gains = np.arange(50) - 20
    assert np.array_equal(whole.sums(gains), np.concatenate([p.sums(gains) for p in parts], axis=1))


def test_repeated_rows_and_ties(spark):
    text = "one two three " * 10
    docs = [(1, text)] * 8 + [(2, "four " * 25), (2, "four " * 25)]
    got = run(spark, docs, ["one two"])
    assert len(got) == 10 and sorted(r[4] for r in got if r[4]) == [1, 2]
    best = max(r[3] for r in got)
    assert all(r[3] == best for r in got if r[4] == 1)


def test_empty(spark):
    assert run(spark, [], ["x"]) == []
    assert [r[2] is not None for r in run(spark, [(1, "a b")], [])] == [True]
