"""URL filter: explicit rules first, then link-graph propagation (DataFrame operations only).

Hosts are the nodes, links between pages of different hosts the edges. Trust starts at hosts whose pages an allow rule
accepts and flows along links (personalised PageRank); distrust starts at hosts whose pages a block rule rejects and
flows against them, from a blocked host to the hosts that link to it. A page that no rule fits takes its host's
verdict: ``block`` when the host's distrust reaches ``threshold`` and exceeds its trust, else ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The rules of the contract (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An href or src value that names a host, with or without a scheme.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def node(host: Column) -> Column:
    """The node of a host in the graph: without its port."""
    return F.regexp_replace(host, r":\d+$", "")


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. ``rules`` is a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # a longer one overrides
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Fixed point of ``score = seed + damping * sum(share * score of the sources)``: (host, score).

    ``edges`` (src, dst, share) with shares of a source summing to 1, ``seeds`` (host, seed) in 0..1. Every round adds
    what moved in the last one, damped, so what is left shrinks at least by ``damping``; no addition is dropped, and the
    loop ends when the additions of all hosts together are at most ``tolerance``: a hub's many small ones may meet
    again. Each round is cut by a checkpoint in the shared folder.
    """
    moved = seeds.select("host", F.col("seed").alias("add"))
    score = seeds.select("host", F.col("seed").alias("score"))
    while True:
        moved = (edges.join(moved.withColumnRenamed("host", "src"), "src")
                 .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("add") * damping).alias("add"))
                 .checkpoint())
        total = moved.agg(F.sum("add")).first()[0] or 0.0
        if not total:
            return score
        score = (score.unionByName(moved.withColumnRenamed("add", "score"))
                 .groupBy("host").agg(F.sum("score").alias("score")).checkpoint())
        if total <= tolerance:
            return score


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted; ``pages`` has host and html."""
    found = pages.select(F.col("host").alias("src"),
                         F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("to"))
    return (found.select("src", node(F.translate("to", UPPER, LOWER)).alias("dst"))
            .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    out = edges.groupBy(src).agg(F.sum("n").alias("_all"))
    return edges.join(out, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"),
                                       (F.col("n") / F.col("_all")).alias("share"))


def filter_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4,
                threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    Seeds of a host are shares of its pages: trust = share accepted by an allow rule, distrust = share rejected by a
    block rule. Defined cases: a null url or one without ``://`` has empty host and path, no rule, verdict ``allow``
    (an empty host is no node of the graph); hosts that differ in the port alone are one node; null html has no links; repeated rows give repeated results and count in
    the shares; an empty table gives an empty result; further columns are not read.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                          F.col(html_col).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "ruled": verdict, "node": node(F.col("host"))})
    seeds = (judged.where(F.col("node") != "").groupBy(F.col("node").alias("host"))
             .agg((F.count(F.when(F.col("ruled") == "allow", 1)) / F.count(F.lit(1))).alias("trust"),
                  (F.count(F.when(F.col("ruled") == "block", 1)) / F.count(F.lit(1))).alias("distrust"))).checkpoint()
    edges = host_edges(parsed.withColumn("host", node(F.col("host")))).checkpoint()
    trust, distrust = seeds.select("host", F.col("trust").alias("seed")), seeds.select("host", F.col("distrust").alias("seed"))
    if not edges.isEmpty():
        trust = propagate(_shares(edges, "src", "dst"), trust.where("seed > 0"), damping, tolerance) \
            .withColumnRenamed("score", "seed")
        distrust = propagate(_shares(edges, "dst", "src"), distrust.where("seed > 0"), damping, tolerance) \
            .withColumnRenamed("score", "seed")
    hosts = (trust.select("host", F.col("seed").alias("t"), F.lit(0.0).alias("d"))
             .unionByName(distrust.select("host", F.lit(0.0).alias("t"), F.col("seed").alias("d")))
             .groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
             .select("host", ((F.col("d") >= threshold) & (F.col("d") > F.col("t"))).alias("bad")))
    hosts = hosts.withColumnRenamed("host", "node")
    return (judged.drop("html").join(hosts, "node", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict")))
