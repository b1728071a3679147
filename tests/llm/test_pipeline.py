"""The pipeline stage by stage against brute force, and its handling of nulls, repeats and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.toxicity import score_toxicity, train

from .test_decontaminate import grams, words_of
from .test_jaccard import brute as brute_groups
from .test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(
        docs.limit(1).withColumn("text", F.lit(None).cast("string"))).withColumn("lang", F.lit(None).cast("string"))
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_toxicity(spark, stages):
    model = train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {(r.doc_id, r.score >= .5) for r in score_toxicity(stages[0], model).collect()}
    bad = {d for d, toxic in bad if toxic}
    same(rows(stages[1]), [r for r in rows(stages[0]) if r[0] not in bad or r[0] is None and r in rows(stages[1])])
    assert stages[1].columns == COLUMNS


def test_lines(stages):
    same(rows(stages[2]), [(d, t) for d, _, gone, t in brute_lines(rows(stages[1])) if not gone or t.strip(" \t\n\v\f\r")])
    wordless = lambda df: df.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count()
    assert [wordless(s) for s in stages[2:5]] == [wordless(stages[1])] * 3
    assert stages[2].columns == COLUMNS
    assert stages[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates(stages):
    docs = rows(stages[2])
    groups = {}
    for (d, n, c), (_, t) in zip(brute_groups(docs), docs):
        if n and c is not None:
            groups.setdefault(c, []).append((d is None, d or 0, t))
    got = rows(stages[3])
    kept = [(d, t) for d, t in got if words_of(t)]
    assert len([d for d, t in kept if d is not None]) == len(groups)
    assert {d for d, t in kept if d is not None} == set(groups)
    same([r for r in got if not words_of(r[1])], [r for r in docs if not words_of(r[1])])


def test_decontamination(spark, stages):
    items = [(r.item_id, grams(words_of(r.text)), len(words_of(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def dirty(text):
        words = words_of(text)
        every = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        for _, own, n in items:
            if len(every & set(own)) < .8 * len(own):
                continue
            for s in range(len(words) - n + 1):
                b = grams(words[s:s + n])
                if 100 * sum((own & b).values()) >= 80 * sum((own | b).values()):
                    return True
        return False

    same(rows(stages[4]), [r for r in rows(stages[3]) if not dirty(r[1])])


def test_tokens(stages):
    got = {(r.doc_id, r.text_sha256) for r in stages[5].collect()}
    want = {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows(stages[4])}
    assert got == want and stages[5].count() == stages[4].count()
    assert stages[5].where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, none, SF)
        assert got.count() == 0 and got.columns == COLUMNS
