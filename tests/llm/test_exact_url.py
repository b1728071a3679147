"""Exact dedup and URL filter against brute force, with their defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm.exact_dedup import exact_dedup
from skein.llm.url_filter import RULES, filter_urls

DOCS = "doc_id long, text string, digest string, run string"
PAGES = "page_id long, url string, html string, host string"


def brute_groups(docs):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    out = []
    for t, rows in groups.items():
        first = min(rows)
        for row in rows:
            out.append((None if row[0] else row[1], None if first[0] else first[1], len(rows), row == first,
                        hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("runs,fan_in", [(8, 2), (1, 8), (27, 3), (5, 8)])
def test_exact(spark, runs, fan_in):
    r = random.Random(runs)
    docs = [(i, r.choice(["a b", "a\t b", "a  b ", "é", "", None, " ", f"own {i}", "A b", "a\x0bb", "a b"]))
            for i in range(200)]
    docs += [(None, "a b"), (None, None), (None, "only without id"), (None, "only without id"), (7, docs[7][1]), (7, "else")]
    r.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS).repartition(5)
    key = lambda x: tuple((v is not None, v or 0) for v in x[:4]) + x[4:]
    got = [tuple(x) for x in exact_dedup(df, runs=runs, fan_in=fan_in).collect()]
    assert sorted(got, key=key) == sorted(brute_groups(docs), key=key)


def test_exact_empty(spark):
    assert exact_dedup(spark.createDataFrame([(0, "", "", "")], DOCS).where(F.lit(False))).count() == 0


def brute_urls(pages, damping=.85, threshold=.5):
    parsed = []
    for p, url, html in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(x), v, h + x) for v, h, x in RULES if (host == h or host.endswith("." + h)) and path.startswith(x)]
        parsed.append((p, host, path, max(fits) if fits else None, html))
    count, allow, block, links = (defaultdict(float) for _ in range(4))
    for _, host, _, rule, html in parsed:
        if host:
            count[host] += 1
            if rule:
                (allow if rule[1] == "allow" else block)[host] += 1
            for to in re.findall(r'(?i)(?:href|src)\s*=\s*["\']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"\'\s<>]+)', html or ""):
                if to.lower() != host:
                    links[host, to.lower()] += 1
    hosts = set(count) | {b for _, b in links}

    def rank(seed, edges):
        out = defaultdict(float)
        for (a, _), n in edges.items():
            out[a] += n
        score = dict(seed)
        for _ in range(200):
            now = defaultdict(float, seed)
            for (a, b), n in edges.items():
                now[b] += damping * n / out[a] * score.get(a, 0)
            score = now
        return score

    trust = rank({h: allow[h] / count[h] for h in hosts if count[h]}, links)
    doubt = rank({h: block[h] / count[h] for h in hosts if count[h]}, {(b, a): n for (a, b), n in links.items()})
    return [(p, h, x, r and r[2], r[1] if r else "block" if doubt.get(h, 0) >= threshold and doubt.get(h, 0) > trust.get(h, 0)
             else "allow") for p, h, x, r, _ in parsed]


def test_urls(spark):
    r = random.Random(3)
    hosts = ["a.example.net", "Example.NET", "b.net", "x.example.com", "example.com", "z.org", "org", "good.com", "spam.com",
             "lonely.com", "notnet", "farm.com", "near.com"]
    pages = []
    for i in range(150):
        h = r.choice(hosts)
        url = f"{r.choice(['http', 'https'])}://{h}{r.choice(['', '/', '/en/1', '/de/2', '/fr/', '/fr', '/en', '/de/?q=/fr/', '?x=1', '#/de/'])}"
        to = {"spam.com": "b.net", "good.com": "z.org", "farm.com": "spam.com", "near.com": r.choice(["b.net", "good.com"])}.get(h)
        html = f'<a href="https://{to}/x">t</a><a href="/local">l</a><img src=//{h}/i.png>' if to else r.choice([None, "", "<a href='/x'>"])
        if h == "z.org":
            html = '<a HREF = "http://Good.com:80/">g</a>'
        pages.append((i, url, html))
    pages += [(None, None, None), (1, "no scheme", None), (1, "http://", ""), (1, "://b.net/x", None), (2, "a://b://net/", "x")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], PAGES)
    key = lambda x: tuple((v is not None, v or "") if not isinstance(v, int) else (True, str(v)) for v in x)
    want = brute_urls(pages, threshold=.3)
    got = [tuple(x) for x in filter_urls(df, tolerance=1e-9, threshold=.3).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    verdict = {h: v for _, h, _, rule, v in want if rule is None}
    assert verdict["spam.com"] == "block" and verdict["lonely.com"] == "allow" and verdict["good.com"] == "allow"


def test_urls_hub(spark):
    """A blocked host that 10,000 hosts link to, and one host that alone links to all of these."""
    n = 10_000
    link = lambda h: f'<a href="https://{h}/">x</a>'
    pages = [(0, "https://bad.net/", "", "")] + [(1, "https://farm.com/", "".join(link(f"h{i}.com") for i in range(n)), "")]
    pages += [(2 + i, f"https://h{i}.com/", link("bad.net"), "") for i in range(n)]
    got = {r.host: r.verdict for r in filter_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert got.pop("bad.net") == "block" and got.pop("farm.com") == "block" and set(got.values()) == {"allow"}


def test_urls_port(spark):
    pages = [(1, "https://bad.net/", "", ""), (2, "https://farm.com:8080/x", '<a href="//bad.net/">b</a>', ""),
             (3, "https://far.com:81/", '<a href="//farm.com:8080/">f</a>', ""), (4, "https://farm.com/y", "", "")]
    got = {r.host: r.verdict for r in filter_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {"bad.net": "block", "farm.com:8080": "block", "farm.com": "block", "far.com:81": "block"}


def test_urls_empty(spark):
    assert filter_urls(spark.createDataFrame([(0, "", "", "")], PAGES).where(F.lit(False))).count() == 0
