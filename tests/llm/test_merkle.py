"""Merkle manifest against a plain tree, over small blocks so that there are several tiers, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import ranks
from skein.llm.merkle import folded, merkle_manifest, proof_digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank string, hash string, item string"
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc):
    out = ""
    for key in ("doc_id", "source", "lang", "n_chars", "text"):
        v = doc[key]
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def tree(nodes):
    """(root, siblings [(left, right)] per level of each node)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            run, own = nodes[at[i] // 8 * 8:at[i] // 8 * 8 + 8], at[i] % 8
            way.append(("".join(run[:own]), "".join(run[own + 1:])))
            at[i] //= 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def manifest(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append(d)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, ways = [], []
    for name in names:
        groups[name].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        root, way = tree([leaf(d) for d in groups[name]])
        subroots.append(root), ways.append(way)
    root, tops = tree(subroots)
    out = []
    for name, subroot, way, top in zip(names, subroots, ways, tops):
        for d, w in zip(groups[name], way):
            steps = w + top
            touched = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            at = leaf(d | {"text": d["text"].translate(ASCII_LOWER)} if touched and d["text"] is not None else d)
            for left, right in steps:
                at = sha(left + at + right)
            out.append((d["doc_id"], leaf(d), subroot, root, sha("".join(a + b for a, b in steps)), at))
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "x", "x", "x", "x")
                                for d in docs], DOCS).repartition(3)
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle_manifest(df, tampered=(touched, {"text": lowered}), **kw)
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), folded(
        F.coalesce("tampered_leaf", "leaf"), F.col("path"))).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_tree(spark, levels):
    r = random.Random(levels)
    docs = [{"doc_id": i, "text": r.choice(["Ab", "é X", "", None, f"Own {i}", "x" * 70_000]), "source": r.choice(["s", None]),
             "lang": r.choice(["de", "de", "de", "de", "en", None, "", "é", "z"] + [f"l{i % 11}"]), "n_chars": r.choice([1, None])}
            for i in range(300)]
    docs += [docs[5], docs[5], {"doc_id": None, "text": "Null id", "source": "s", "lang": "de", "n_chars": 1},
             {"doc_id": 7, "text": "same id", "source": "s", "lang": docs[7]["lang"], "n_chars": 1}]
    assert ordered(run(spark, docs, levels=levels)) == ordered(manifest(docs))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    docs = [{"doc_id": -i, "text": f"T{i}", "source": "s", "lang": "en", "n_chars": i} for i in range(n)]
    got = run(spark, docs, levels=1)
    assert ordered(got) == ordered(manifest(docs))
    same = {r[0] for r in got if r[5] == r[3]}
    assert same == {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3}


def test_empty(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_places_in_groups(spark):
    """A group over many ranges, and ranges that hold the ends of groups."""
    rows = [("big", i) for i in range(500)] + [(None, i) for i in range(40)] + [(f"g{i % 7}", i) for i in range(60)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, v int").repartition(4).checkpoint()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.grp, r.v): r["rank"] for r in ranks.in_groups(df, "grp", [F.col("v").desc()]).collect()}
        whole = {(r.grp, r.v): r["rank"] for r in ranks.in_order(df, [F.col("v").asc(), F.col("grp").asc()]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert got == {(g, v): i for g, vs in groups.items() for i, v in enumerate(sorted(vs, reverse=True))}
    assert whole == {x: i for i, x in enumerate(sorted(rows, key=lambda x: (x[1], x[0] is not None, x[0] or "")))}
