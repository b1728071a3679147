"""Merkle dataset manifest by a rollup of nested structs.

Rows are ranked within their group; the digits of a rank in base ``fan`` are the way from the top of the tree to the row.
Within a *block* of ``fan ** levels`` consecutive rows the digit columns are grouped away one after the other, each time
nesting the child structs under the node that they hash to. A block is dealt once and then holds its whole subtree, of
bounded size. The blocks' own hashes are the rows of the next tier, and so on until each group has one node; the groups'
nodes in order of their names make one more tree. Downwards each block gets the siblings above it as one more row of its
group, and a transform and an explode of its nested struct emit the proofs of all its rows: no joins, and no table of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ranks

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 8, 3
PATH = "array<struct<left:string,right:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: UTF-8 byte count, colon, value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(row: dict[str, Column]) -> Column:
    return sha(*[field(c) for c in row.values()])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its way give."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hashes(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["hash"]), "")


def _alone(index: Column, children: Column) -> Column:
    """Whether a node's one child was the last node of its group, so that there is nothing to hash."""
    return (index == 0) & (F.size(children) == 1)


def _over(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def _rolled(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, block, hash, tree) from ``nodes`` (grp, rank, hash, item): one row for each block."""
    size = fan ** levels
    digits = [f"_d{i}" for i in range(levels)]
    rows = nodes.select("grp", _over(F.col("rank"), size).alias("block"),
                        *[F.pmod(_over(F.col("rank"), fan ** i), F.lit(fan)).cast("int").alias(d)
                          for i, d in enumerate(digits)], "hash", F.col("item").alias("kids"))
    rows = rows.repartition("grp", "block")
    for i, d in enumerate(digits):
        above = digits[i + 1:]
        rows = rows.groupBy("grp", "block", *above).agg(
            F.array_sort(F.collect_list(F.struct(d, "hash", "kids"))).alias("kids"))
        # number of the node in its level
        index = F.col("block") * fan ** (levels - 1 - i)
        for j, a in enumerate(above):
            index = index + F.col(a) * fan ** j
        rows = rows.withColumn("hash", F.when(_alone(index, F.col("kids")), F.col("kids")[0]["hash"])
                               .otherwise(sha(_hashes(F.col("kids")))))
    return rows.withColumnRenamed("kids", "tree")


def _step(alone: Column, kids: Column, at: Column) -> Column:
    """What child ``at`` of a node adds to the paths of its rows."""
    left, right = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.size(kids))
    return F.when(alone, F.array().cast(PATH)).otherwise(
        F.array(F.struct(_hashes(left).alias("left"), _hashes(right).alias("right"))))


def _proofs(blocks: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, hash, item, path, subroot, root) of the rows of ``blocks``, given ``above`` (grp, block, path, subroot, root).

    The way to a block comes as one more row of the block.
    """
    none = lambda schema: F.lit(None).cast(schema)
    tree = blocks.schema["tree"].dataType
    both = (blocks.select("grp", "block", "tree", none(PATH).alias("path"), none("string").alias("subroot"),
                          none("string").alias("root"))
            .unionByName(above.select("grp", "block", none(tree).alias("tree"), "path", "subroot", "root")))
    met = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c)
                                             for c in ("tree", "path", "subroot", "root")])

    def below(kids: Column, level: int, index: Column, way: Column) -> Column:
        """Rows under the nodes ``kids`` of the level, with the steps of their ways from the row upwards."""
        def child(x, at):
            steps = F.concat(_step(_alone(index, kids), kids, at), way)
            if level == 0:
                return F.struct(x["hash"].alias("hash"), x["kids"].alias("item"), steps.alias("path"))
            return below(x["kids"], level - 1, index * fan + x[f"_d{level}"], steps)
        found = F.transform(kids, child)
        return found if level == 0 else F.flatten(found)

    rows = below(F.col("tree"), levels - 1, F.col("block"), F.array().cast(PATH))
    return (met.select("grp", "subroot", "root", F.col("path").alias("_above"), F.explode(rows).alias("_row"))
            .select("grp", "subroot", "root", "_row.hash", "_row.item",
                    F.concat("_row.path", "_above").alias("path")))


def _climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The tiers of blocks over ``nodes``, up to the one where each group has a single block."""
    tiers = [_rolled(nodes, fan, levels).checkpoint()]
    while not tiers[-1].where(F.col("block") > 0).isEmpty():
        up = tiers[-1].select("grp", F.col("block").alias("rank"), "hash", F.struct("block").alias("item"))
        tiers.append(_rolled(up, fan, levels).checkpoint())
    return tiers


def merkle_proofs(leaves: DataFrame, order: list[Column], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(grp, leaf, item, path, subroot, root) of ``leaves`` (grp string, leaf, item struct), a checkpointed table.

    Leaves stand in ``order`` within their group (repeated rows as the table has them), groups by name, null first, by
    their UTF-8 bytes. While there are several nodes, each ``fan`` consecutive ones become the hash of their hashes. ``path``
    has for each such level the joined hashes left and right of the way, from the leaf to the root of all groups. Blocks hold
    ``fan ** levels`` leaves; a group of any size is spread over as many blocks. An empty table gives no rows.
    """
    ensure_checkpoint_dir(leaves.sparkSession)
    ranked = ranks.in_groups(leaves, "grp", order)
    tiers = _climb(ranked.select("grp", "rank", F.col("leaf").alias("hash"), "item"), fan, levels)
    groups = ranks.in_order(tiers[-1].select(F.col("grp").alias("name"), F.col("hash").alias("subroot")).checkpoint(),
                            [F.col("name").asc_nulls_first()])
    top = _climb(groups.select(F.lit("").alias("grp"), "rank", F.col("subroot").alias("hash"),
                               F.struct("name").alias("item")), fan, levels)
    way = top[-1].select("grp", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"),
                         F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for tier in reversed(top):
        way = _proofs(tier, way, fan, levels)
        way = (way.select("grp", F.col("item.block").alias("block"), "path", "subroot", "root") if tier is not top[0] else
               way.select(F.col("item.name").alias("grp"), F.lit(0).cast("long").alias("block"), "path",
                          F.col("hash").alias("subroot"), "root"))
    for tier in reversed(tiers):
        way = _proofs(tier, way, fan, levels)
        if tier is not tiers[0]:
            way = way.select("grp", F.col("item.block").alias("block"), "path", "subroot", "root")
    return way.select("grp", F.col("hash").alias("leaf"), "item", "path", "subroot", "root")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
                    tampered: tuple[Column, dict[str, Column]] | None = None, fan: int = FAN,
                    levels: int = LEVELS) -> DataFrame:
    """One row per input row: (doc_id, leaf, tampered_leaf, path, subroot, root).

    A leaf hashes ``fields`` in order; each group (``group_col``) is a tree over its leaves in ascending order of the id, and
    the groups' roots make one more. ``tampered``, a condition and replaced fields, gives ``tampered_leaf`` for the rows
    that meet it (null for others), for a test of the proofs. Defined cases: null fields go in as a dash; null ids come
    first; rows that share an id are ordered by their leaves; a null group is a group of its own; repeated rows are rows;
    an empty table has no rows and no root; further columns are not read.
    """
    row = {f: F.col(f) for f in fields}
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered[0], leaf_of(row | tampered[1]))
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), leaf_of(row).alias("leaf"),
                         F.struct(F.col(id_col).alias("doc_id"), changed.alias("tampered_leaf")).alias("item"))
    found = merkle_proofs(leaves.checkpoint(), [F.col("item.doc_id").asc_nulls_first(), F.col("leaf").asc()], fan, levels)
    return found.select("item.doc_id", "leaf", "item.tampered_leaf", "path", "subroot", "root")


# CRC-32 of a decimal id bit by bit; levels of nodes and the folding of each leaf by recursion.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS uid,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 3 = 0 AS touched
  FROM documents
), e AS (
  SELECT uid, doc_id, lang, touched,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')
           AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS low
  FROM d
), leaf AS (
  SELECT uid, doc_id, lang, sha256(head || body) AS leaf,
         CASE WHEN touched THEN sha256(head || low) ELSE sha256(head || body) END AS shown
  FROM e
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
), nodes(lang, lvl, idx, n, h) AS (
  SELECT lang, 0, rk, n, leaf FROM ranked
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, lvl, n, idx // 8
), sub AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rk, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops(lvl, idx, n, h) AS (
  SELECT 0, rk, n, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1
  GROUP BY lvl, n, idx // 8
), all_nodes AS (  -- levels of a group's tree, then those of the groups' tree
  SELECT 0 AS tree, coalesce(lang, '-null-') AS grp, lvl, idx, n, h FROM nodes
  UNION ALL SELECT 1, '', lvl, idx, n, h FROM tops
), sides AS (
  SELECT tree, grp, lvl, idx,
         coalesce(string_agg(h, '' ORDER BY idx) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '' ORDER BY idx) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM all_nodes WHERE n > 1 WINDOW r AS (PARTITION BY tree, grp, lvl, idx // 8 ORDER BY idx)
), fold(uid, tree, grp, lvl, idx, cur, proof, up) AS (
  SELECT uid, 0, coalesce(k.lang, '-null-'), 0, k.rk, shown, '', sub.rk
  FROM ranked k JOIN sub ON k.lang IS NOT DISTINCT FROM sub.lang
  UNION ALL
  SELECT f.uid, coalesce(s.tree, 1), coalesce(s.grp, ''), CASE WHEN s.l IS NULL THEN 0 ELSE f.lvl + 1 END,
         CASE WHEN s.l IS NULL THEN f.up ELSE f.idx // 8 END,
         CASE WHEN s.l IS NULL THEN f.cur ELSE sha256(s.l || f.cur || s.r) END,
         CASE WHEN s.l IS NULL THEN f.proof ELSE f.proof || s.l || s.r END, f.up
  FROM fold f LEFT JOIN sides s ON s.tree = f.tree AND s.grp = f.grp AND s.lvl = f.lvl AND s.idx = f.idx
  WHERE f.tree = 0 OR s.l IS NOT NULL
), done AS (
  SELECT uid, last(cur ORDER BY tree, lvl) AS folded_root, sha256(last(proof ORDER BY tree, lvl)) AS proof_sha256
  FROM fold WHERE tree = 1 GROUP BY uid
)
SELECT k.doc_id, k.leaf, sub.subroot, t.h AS root, done.proof_sha256, done.folded_root, done.folded_root = t.h AS verified
FROM ranked k JOIN sub ON k.lang IS NOT DISTINCT FROM sub.lang JOIN done USING (uid)
CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
