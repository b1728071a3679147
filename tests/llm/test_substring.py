"""Substring operators against brute force, and their defined cases."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm.bytes_dedup import bytes_dedup
from skein.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, block string, data string"


def brute_words(docs, window):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] or ""))
    seen, out = set(), []
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[i][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out.append((docs[i][0], len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def brute_bytes(docs, window):
    times = defaultdict(int)
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for s in range(len(b) - window + 1):
            times[b[s:s + window]] += 1
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if times[b[s:s + window]] > 1:
                gone[s:s + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(seed, n, alphabet, length):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < .15 and texts:
            texts.append(r.choice(texts))
        elif kind < .4 and texts:
            a, b = r.choice(texts), r.choice(texts)
            texts.append(a[:r.randrange(len(a) + 1)] + " " + b[r.randrange(len(b) + 1):])
        else:
            texts.append("".join(r.choice(alphabet) + r.choice(["", " ", "\n", "  \t"])
                                 for _ in range(r.randrange(length))))
    docs = list(enumerate(texts))
    docs += [(None, None), (None, texts[0]), (3, texts[3]), (3, texts[4]), (n, ""), (n + 1, " \n "),
             (n + 2, "ab " * 300), (n + 3, "a" * 700), (n + 4, "é" * 150)]
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)


@pytest.mark.parametrize("seed,window,k", [(1, 6, 4), (2, 20, 8), (3, 8, 8)])
def test_words(spark, seed, window, k):
    docs = corpus(seed, 60, ["a", "b", "c", "dd", "ee", "é"] if window < 20 else list("abcdefghijkl"), 150)
    got = substring_dedup(frame(spark, docs), window, k, n_blocks=5, n_shards=3, part_words=[300, 1 << 19][seed % 2])
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_words(docs, window), key=key)


@pytest.mark.parametrize("seed,window,k", [(1, 12, 4), (2, 40, 16), (3, 200, 32)])
def test_bytes(spark, seed, window, k):
    docs = corpus(seed, 50, ["a", "b", "cd", "é"] if window < 40 else [f"{i:x}{i * 7 % 13}" for i in range(40)],
                  120 if window < 200 else 400)
    got = bytes_dedup(frame(spark, docs), window, k, n_blocks=5, n_shards=3, part_bytes=[900, 2 << 20][seed % 2])
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    rows = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(brute_bytes(docs, window), key=key)


def test_empty(spark):
    none = frame(spark, [(0, "x")]).where(F.lit(False))
    assert substring_dedup(none).count() == 0
    assert bytes_dedup(none).count() == 0


def test_text_exchange_is_planned_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark, corpus(5, 40, list("abcdefgh"), 60)).write.parquet(path)
    df = substring_dedup(spark.read.parquet(path), n_blocks=8, n_shards=4)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1 or plan.count("FileScan") == 1
