"""Decontamination against brute force over all windows, slices, defined cases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skein.llm import decontaminate
from skein.llm.decontaminate import contaminated, hamming_candidates, without_contaminated

DOCS = "doc_id long, text string, item_id string, n string"
ITEMS = "item_id long, text string, doc_id string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(words):
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = []
    for d, text in docs:
        words = words_of(text)
        for t, item in items:
            own = words_of(item)
            if not own:
                continue
            a, best = grams(own), None
            for s in range(len(words) - len(own) + 1):
                b = grams(words[s:s + len(own)])
                shared, either = sum((a & b).values()), sum((a | b).values())
                if 100 * shared >= 80 * either and (best is None or shared > best[0]):
                    best = (shared, s, shared / either)
            if best:
                out.append((d, -1 if t is None else t, best[1], len(own), best[0], round(best[2], 9)))
    return out


def data():
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "and", "a"] * 3 + [f"w{i}" for i in range(60)])
    items = [(i, " ".join(word() for _ in range(r.choice([2, 4, 5, 15, 30, 57])))) for i in range(25)]
    items += [(None, "an item without any id at all"), (90, None), (91, ""), (92, "x y x y x y x y x y x y")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(r.randrange(5, 150))]
        if r.random() < .6:
            own = words_of(r.choice(items)[1])
            for _ in range(r.randrange(3)):
                if own:
                    own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = [w.upper() for w in own]
        docs.append((i, r.choice([" ", "\n", " \t"]).join(words)))
    docs += [(None, items[5][1]), (3, items[6][1]), (3, items[6][1]), (200, None), (201, ""), (202, "x y x y x y x y x y x y x y")]
    return docs, items


def test_windows(spark, monkeypatch):
    docs, items = data()
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], DOCS)
    t = spark.createDataFrame([(a, b, "z") for a, b in items], ITEMS)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(brute(docs, items), key=key)
    assert len(want) > 20
    for size in (8 << 20, 300):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        got = [(r[0], *map(int, r[1:5]), round(r[5], 9)) for r in contaminated(d, t).collect()]
        assert sorted(got, key=key) == want
    stay = without_contaminated(d, t)
    assert stay.columns == d.columns
    bad = {(a, b) for a, b in docs if brute([(a, b)], items)}
    assert sorted(map(repr, [tuple(r)[:2] for r in stay.collect()])) == sorted(map(repr, [x for x in docs if x not in bad]))


def brute_short(docs, items):
    """Whole documents that have fewer words than the item, by definition of the weighted similarity."""
    out = []
    for d, text in docs:
        for t, item in items:
            words, own = words_of(text), words_of(item)
            k = min(5, len(own))
            if not k or not k <= len(words) < len(own):
                continue
            a, b = (Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1)) for x in (own, words))
            shared, either = sum((a & b).values()), sum((a | b).values())
            if 100 * shared >= 80 * either:
                out.append((d, t, 0, len(words), shared, round(shared / either, 9)))
    return out


def test_documents_shorter_than_the_item(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(["the", "of"] + [f"w{j}" for j in range(60)]) for _ in range(n)))
             for i, n in enumerate([2, 4, 6, 9, 10, 14, 20, 30, 40, 40, 41, 80])]
    items += [(50, items[8][1]), (51, "x y " * 10)]
    docs = [(1, " ".join(items[8][1].split()[:38])), (2, " ".join(items[8][1].upper().split()[3:])), (3, ""), (4, None),
            (5, "x y " * 9), (6, items[0][1].split()[0]), (7, " ".join(items[3][1].split()[:8]))]
    for i in range(300):
        own = r.choice(items)[1].split()
        a = r.randrange(min(3, len(own)))
        own = own[a:max(a + 1, len(own) - r.randrange(8))]
        if r.random() < .3:
            own[r.randrange(len(own))] = "changed"
        docs.append((100 + i, " ".join(own)))
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], DOCS)
    t = spark.createDataFrame([(a, b, "z") for a, b in items], ITEMS)
    want = brute_short(docs, items)
    assert (1, 8, 0, 38, 34, round(34 / 36, 9)) in want and len(want) > 50
    got = [(r[0], *map(int, r[1:5]), round(r[5], 9)) for r in contaminated(d, t).collect()]
    assert sorted(got) == sorted(want + brute(docs, items))
    bad = {x[0] for x in got}
    assert {r[0] for r in without_contaminated(d, t).collect()} == {x for x, _ in docs} - bad


def test_radius():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(0b1011), r.integers(0, 2**63, 100).astype(np.uint64)])
    i, j = hamming_candidates(a, b, 24)
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 24
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(near)]))


def test_empty(spark):
    d = spark.createDataFrame([(0, "some words", "x", "y")], DOCS)
    t = spark.createDataFrame([(0, "some words", "z")], ITEMS)
    assert contaminated(d.where(F.lit(False)), t).count() == 0
    assert contaminated(d, t.where(F.lit(False))).count() == 0
    assert without_contaminated(d, t.where(F.lit(False))).count() == 1
    assert contaminated(d, t).count() == 1
