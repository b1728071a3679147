"""Toxicity: messages against sums over all paths, held-out accuracy, spans, defined cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import crf
from skein.llm.toxicity import held_out, score_toxicity, train, without_toxic

SF = "/root/testdata/sf0.1"


def test_messages_and_viterbi():
    r = np.random.default_rng(1)
    move = r.normal(size=(2, 2))
    lengths = [1, 7, 0, 5, 9, 2]
    logits = r.normal(size=sum(lengths)) * 2
    first = np.r_[0, np.cumsum(lengths)]
    got = crf.marginals(logits, move, first)
    for a, b in zip(first, first[1:]):
        weight, total, best = np.zeros(b - a), 0.0, (-np.inf, ())
        for path in itertools.product((0, 1), repeat=int(b - a)):
            s = sum(x for x, y in zip(logits[a:b], path) if y) + sum(move[p, q] for p, q in zip(path, path[1:]))
            best = max(best, (s, path))
            weight += np.exp(s) * np.array(path)
            total += np.exp(s)
        assert np.allclose(got[a:b], weight / total)
        assert tuple(crf.viterbi(logits[a:b].tolist(), move.tolist())) == best[1]


def test_recursion_in_columns():
    r = np.random.default_rng(2)
    a, b, c, d = r.random((4, 3000)) + .01
    a[::700] = c[::700] = 0
    x, want = 0.0, []
    for t in range(3000):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        want.append(x)
    assert np.allclose(crf.recursion(a, b, c, d), want)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return train(*tables, per_class=1500)


def test_held_out(tables, model):
    docs, labels = tables
    found = (score_toxicity(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
             .groupBy("toxic", (F.col("score") >= .5).alias("bad")).count().collect())
    n = {(r.toxic, r.bad): r["count"] for r in found}
    assert n.get((1, True), 0) >= 0.85 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]


def test_spans(spark, model):
    text = "É the idiot of thing, and a\nmoron IDIOT here"
    row = score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    words = {text[s.start:s.end] for s in row.spans}
    assert row.score > .5 and any("idiot" in w for w in words) and any("moron" in w for w in words)
    assert not any("thing" in w for w in words)


def test_cases(spark, tables, model):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "idiot moron scum clown " * 30, "y")],
                               "doc_id long, text string, score string")
    got = score_toxicity(df, model).collect()
    assert len(got) == 4 and sum(r.score >= .5 for r in got) == 1 and all(0 <= r.score <= 1 for r in got)
    stay = without_toxic(df, model)
    assert stay.columns == df.columns and stay.count() == 3
    assert score_toxicity(df.where(F.lit(False)), model).count() == 0
    none = train(tables[0], tables[1].where(F.lit(False)))
    assert [r.score for r in score_toxicity(df, none).collect()] == [0.0] * 4


def test_no_feature(spark):
    ids = [i for i, held in spark.range(40).select("id", held_out(F.col("id"))).collect() if not held][:20]
    docs = spark.createDataFrame([(i, "awful words" if n < 4 else "fine words") for n, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n < 4)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    got = score_toxicity(docs, train(docs, labels)).collect()
    assert len(got) == 20 and {(r.score, len(r.spans)) for r in got} == {(0.2, 0)}
