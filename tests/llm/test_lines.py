"""Line dedup against brute force, patience diff, defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm.line_dedup import aligned, line_dedup, patience

SCHEMA = "doc_id long, text string, block string, n_lines string"
WHITE = " \t\n\x0b\x0c\r"


def brute(docs, min_words=5):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, (docs[i][1] or "").encode()))
    seqs = [[x.strip(WHITE) for x in (docs[i][1] or "").split("\n")] if docs[i][1] else [] for i in order]
    big = [[len(x.split()) >= min_words for x in s] for s in seqs]
    holder = {}
    for p, s in enumerate(seqs):
        for x, b in zip(s, big[p]):
            if b:
                holder.setdefault(x, p)
    out = []
    for p, s in enumerate(seqs):
        gone = set()
        for q in sorted({holder[x] for x, b in zip(s, big[p]) if b} - {p}):
            gone |= set(aligned(seqs[q], s, big[p]))
        lines = (docs[order[p]][1] or "").split("\n") if s else []
        out.append((docs[order[p]][0], len(s), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def corpus(seed):
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 3, 5, 8]))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = [r.choice(["", "  "]) + r.choice(pool) + r.choice(["", "\t"]) if r.random() < .6
                 else f"own line {i} with {r.random()} words" if r.random() < .8 else "" for _ in range(r.randrange(12))]
        if i % 3 == 0:
            lines[1:1] = ["This licence line is in very many documents", "and a second line of the same licence text"]
        docs.append((i, "\n".join(lines)))
    docs += [(None, docs[5][1]), (None, None), (7, docs[7][1]), (7, docs[8][1]), (99, ""), (100, None), (101, "\n\n"),
             (102, docs[3][1]), (103, docs[3][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    got = line_dedup(df, n_blocks=5, n_buckets=3, keep=("n_lines", "block")).toDF("a", "b", "c", "d", "e", "f")
    assert {(r.e, r.f) for r in got.select("e", "f").collect()} == {("y", "x")}
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    found = [tuple(r)[:4] for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute(docs), key=key)


def test_patience():
    assert patience(list("abcxyz"), list("qabcyzz")) == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 6)]
    assert patience([], [1]) == [] and patience([1, 1], [1]) == [(0, 0)]
    assert aligned([1, 2, 3], [9, 1, 2, 8], [False, False, True, False]) == [1, 2]
    assert aligned([1, 2, 3], [9, 1, 2, 8], [False] * 4) == []


def common_runs(a, b, anchor):
    """By definition: places of b in a run of lines with an anchor that stands in a, over all runs."""
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return sorted({y for i in range(len(b)) for j in range(i + 1, len(b) + 1)
                   if tuple(b[i:j]) in runs and any(anchor[i:j]) for y in range(i, j)})


def test_repeated_and_crossed():
    r = random.Random(9)
    for _ in range(3000):
        a, b = ([r.choice("PQRstu-") for _ in range(r.randrange(14))] for _ in range(2))
        b = [x if r.random() < .7 else f"own {i}" for i, x in enumerate(b)]
        anchor = [x in "PQR" for x in b]
        assert aligned(a, b, anchor) == common_runs(a, b, anchor)
    for n in (1, 2, 3):
        assert aligned(list("ab") * 400, list("ab") * n * 100, [True, False] * n * 100) == list(range(n * 200))


def test_passages_that_stand_twice(spark):
    p, q = "a shared passage of many words\nand its short end", "another passage of many words too"
    docs = [(1, f"a\n{p}\nb"), (2, f"c\n{p}\nd\n{p}\ne"),
            (3, f"f\n{q}\ng\n{q}\nh"), (4, f"i\n{q}\nj"), (5, f"k\n{q}\nl\n{p}\nm"), (6, f"n\n{p}\no\n{q}\np")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup(df, n_blocks=3, n_buckets=2).collect()}
    assert got == {1: docs[0][1], 2: "c\nd\ne", 3: docs[2][1], 4: "i\nj", 5: "k\nl\nm", 6: "n\no\np"}
    crossed = [(1, f"a\n{p}\nb\n{q}\nc"), (2, f"d\n{q}\ne\n{p}\nf")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in crossed], SCHEMA)
    assert {r.doc_id: r.text for r in line_dedup(df).collect()} == {1: crossed[0][1], 2: "d\ne\nf"}


def brute_runs(docs, least=5):
    """By definition: each document against the first holder of every run of lines with five words, over all runs."""
    count = lambda x: len(x.split()) + sum("\u3041" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in x) // 2
    seqs = [[x.strip(WHITE) for x in t.split("\n")] if t else [] for t in docs]
    spans = [{tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)} for s in seqs]
    out = []
    for p, s in enumerate(seqs):
        words, partners, gone = [count(x) for x in s], set(), set()
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s) + 1) if sum(words[i:j]) >= least), None)
            if words[i] and j:
                partners.add(next(q for q in range(len(seqs)) if tuple(s[i:j]) in spans[q]))
        for q in partners - {p}:
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    if sum(words[i:j]) >= least and tuple(s[i:j]) in spans[q]:
                        gone |= set(range(i, j))
        out.append((p, len(s), len(gone), "\n".join(x for i, x in enumerate(docs[p].split("\n")) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_short_lines(spark, seed):
    r = random.Random(seed)
    pool = ["one", "two", "a b", "c d", "", "e f g", "five words in this line", "\u6f22\u5b57\u306e\u884c\u306b", "\u4e00\u884c"]
    verse = "so much\ndepends upon\n\na red\nwheel barrow"
    docs = []
    for i in range(50):
        lines = [r.choice(["", " "]) + r.choice(pool) if r.random() < .7 else f"own{i}x{r.random()}" for _ in range(r.randrange(11))]
        if i % 4 == 0:
            lines.insert(r.randrange(len(lines) + 1), verse)
        docs.append("\n".join(lines))
    docs += [verse, verse, "\u6f22" * 7, "\u6f22" * 7, "x\n" + "\u6f22" * 10, "y\n" + "\u6f22" * 10 + "\nz", "k\nl m\nn", "k\nl m\nn"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], SCHEMA)
    got = sorted(tuple(x) for x in line_dedup(df, n_blocks=5, n_buckets=3).collect())
    assert got == brute_runs(docs)
    assert got[51][3] == "" and got[53][3] == docs[53] and got[55][3] == "y\nz" and got[57][3] == docs[57]


def test_empty(spark):
    none = spark.createDataFrame([(0, "x", "", "")], SCHEMA).where(F.lit(False))
    assert line_dedup(none).count() == 0
