"""Jaccard join against brute force, small tiles, defined cases; components of long chains and stars."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, block string, digest string, n string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def near_copies(seed, families=12, size=8):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 20, 60, 150]))]
        if r.random() < .6:
            base[2:2] = passage
        for _ in range(r.randrange(1, size)):
            now = list(base)
            for _ in range(r.randrange(4)):
                now[r.randrange(len(now))] = f"x{r.randrange(1000)}"
            if r.random() < .3:
                now = now[:-r.randrange(1, 4)] or now
            texts.append((" " if r.random() < .5 else "\n\t").join(now))
            base = now if r.random() < .5 else base
    docs = list(enumerate(texts))
    docs += [(None, texts[1]), (None, None), (None, "quite alone"), (2, texts[5]), (2, texts[2]), (900, ""), (901, None),
             (902, "A b"), (903, "a B"), (904, "b a"), (905, "A b c d e"), (906, " \n ")]
    r.shuffle(docs)
    return docs


def rows(found):
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))


@pytest.mark.parametrize("seed,tile_rows", [(1, 4096), (2, 2), (3, 3)])
def test_links(spark, seed, tile_rows):
    docs = near_copies(seed)
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA)
    got = jaccard_components(df, tile_rows=tile_rows, n_blocks=4, n_buckets=3)
    assert rows(map(tuple, got.collect())) == rows(brute(docs))


def test_empty(spark):
    none = spark.createDataFrame([(0, "x", "", "", "")], SCHEMA).where(F.lit(False))
    assert jaccard_components(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000}
    assert len(got) == 501
