"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

1. Every document becomes the sorted array of its distinct shingle hashes; equal sets are one node, represented by one
   document.
2. Two sets that reach the threshold share a shingle among the first ``n - ceil(t * n) + 1`` of each in any common
   order. Those prefixes are sent to hash buckets; a shingle that several sets sent opens a group, which is cut into
   bands of sizes where a link is possible. Shingles found very frequent come last in the order, so that a passage
   which a third of the documents share is in no prefix unless nearly all of a document is such passages.
3. Groups with the same first member form a tile; its members send it their bitmap signatures, two bits or more per
   shingle. A tile with more than ``tile_rows`` members is dealt to sub-tiles by hash, each pair of parts to one of them.
   Sets are taken by size; the counts of bits that one set has and the other lacks bound the overlap from above.
4. Members that bounds leave connected send their arrays, and those are intersected exactly. In both steps pairs already
   connected are skipped, so a group of near copies costs as many links as it has members, not pairs.
5. Links between nodes are joined to components with DataFrame operations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir
from .blocks import Packer, counts, deal, expand, in_order, pieces, rows
from .components import components
from .textnum import LOWER, U, mix, shingle_hashes, span_hashes, utf8, word_spans

SHINGLE = 5
HEAVY_SHARE = 0.005  # of the documents of a batch: shingles above it are candidates for the end of the order
HEAVY_MAX = 4096     # how many shingles at most are put at the end; the choice changes the cost, never the result


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are lower-cased, short texts are one shingle."""
    buf, offs = utf8(texts)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends)
    grams = shingle_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            h = np.sort(grams[a:b - SHINGLE + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:  # the whole sequence, told apart from longer ones by its length
            out.append(mix(shingle_hashes(words[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _describe(batches):
    """Of each document (block, doc_id, n, digest); of each batch also its most frequent shingles (digest null)."""
    for batch in pieces(batches, 2, 8 << 20):
        found = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([
            batch.column("block"), batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
            pa.array([digest_of(x) for x in found], pa.binary()), pa.nulls(len(found), pa.int64())],
            ["block", "doc_id", "n", "digest", "heavy"])
        distinct, n = np.unique(np.concatenate(found), return_counts=True)
        often = np.flatnonzero(n >= max(8, HEAVY_SHARE * len(found)))
        often = often[np.argsort(-n[often], kind="stable")][:HEAVY_MAX]
        if len(often):
            k = len(often)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(n[often].astype(np.int64)),
                pa.nulls(k, pa.binary()), pa.array(distinct[often].view(np.int64))],
                ["block", "doc_id", "n", "digest", "heavy"])


def prefix_of(found: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The first ``n - ceil(percent * n / 100) + 1`` hashes: those not in ``heavy`` by value, then the others."""
    n = len(found)
    p = n - -(-percent * n // 100) + 1
    if len(heavy):
        late = heavy[np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)] == found
        if late.any():
            found = np.concatenate([found[~late], found[late]])
    return found[:p]


def _chosen(table: pa.Table, wanted: pa.Table):
    """(place in block order, digest, set) of the documents that represent the wanted sets in this block."""
    table, _ = in_order(table)
    need = {x for x in wanted["digest"].to_pylist()}
    for i, s in enumerate(shingle_sets(table["text"])):
        d = digest_of(s)
        if d in need:
            need.remove(d)
            yield i, d, s


def groups_of(keys: np.ndarray, node: np.ndarray, size: np.ndarray, percent: int, tile_rows: int):
    """(node, tile, parts, part) of the members of each band of each group of equal keys with two nodes or more."""
    order = np.lexsort((node, size, keys))
    keys, node, size = keys[order], node[order], size[order]
    cut = np.r_[True, (keys[1:] != keys[:-1]) | (100 * size[:-1] < percent * size[1:])]
    first = np.flatnonzero(cut)
    n = np.diff(np.r_[first, len(keys)])
    tile = np.minimum.reduceat(node, first)
    parts = np.ones(len(n), np.int64)
    big = n > tile_rows
    parts[big] = 1 << np.ceil(np.log2(n[big] / tile_rows)).astype(np.int64)
    several = np.repeat(n > 1, n)
    parts = np.repeat(parts, n)[several]
    tile, node = np.repeat(tile, n)[several], node[several]
    part = (mix(node.astype(np.uint64)) & (parts - 1).astype(np.uint64)).astype(np.int64)
    return np.unique(np.stack([node, tile, parts, part], axis=1), axis=0)


def width_of(n: int) -> int:
    """Bits of the signature of a set of n shingles, by size band: the power of two from 2n on, 256 at least."""
    return 1 << max(8, int(2 * n - 1).bit_length())


def signature_of(found: np.ndarray) -> np.ndarray:
    """One bit per shingle, by its hash; folding the halves together gives the signature of half the width."""
    width = width_of(len(found))
    out = np.zeros(width // 64, np.uint64)
    bit = found & U(width - 1)
    np.bitwise_or.at(out, (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out


def possible(size_a, a, size_b, b, percent: int) -> np.ndarray:
    """Whether a set could reach the threshold with each row of ``b``: an element of one whose bit the other lacks is
    not shared."""
    most = np.minimum(size_a - np.bitwise_count(a & ~b).sum(1, dtype=np.int64),
                      size_b - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return 100 * most >= percent * (size_a + size_b - most)


def connect(size: np.ndarray, signature: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray,
            exact=None) -> list[tuple[int, int]]:
    """Connect the members of one tile; with two sides only pairs across them are compared.

    ``label`` holds the components known so far and is updated; a pair already connected is skipped. Pairs are linked
    if their signatures leave it possible and, where given, ``exact(i, j)`` confirms it. Returns the links made.
    """
    order = np.argsort(size, kind="stable")
    size, side, label_ = size[order], side[order], label[order]
    two, out = side.min() != side.max(), []
    words = np.array([len(signature[k]) for k in order])
    edge = np.r_[0, np.flatnonzero(words[1:] != words[:-1]) + 1, len(order)]
    level = [np.stack([signature[k] for k in order[x:y]]) for x, y in zip(edge, edge[1:])]  # sets of one width
    half = [x.reshape(len(x), 2, -1) for x in level]
    half = [x[:, 0] | x[:, 1] for x in half]
    for at, (x, y) in enumerate(zip(edge, edge[1:])):
        for i in range(x, y):
            stop = int(np.searchsorted(size * percent, 100 * size[i], "right"))
            for to, bits in ((at, level), (at + 1, half)):
                if to + 1 >= len(edge):
                    continue
                lo = max(i + 1, edge[to])
                j = np.arange(lo, min(stop, edge[to + 1]))
                j = j[label_[j] != label_[i]]
                if two:
                    j = j[side[j] != side[i]]
                if not len(j) or bits[to].shape[1] != level[at].shape[1]:
                    continue  # a set of four times the width is too large for a link
                j = j[possible(size[i], level[at][i - x], size[j], bits[to][j - edge[to]], percent)]
                for k in j.tolist():
                    if label_[k] != label_[i] and (exact is None or exact(int(order[i]), int(order[k]))):
                        label_[label_ == label_[k]] = label_[i]
                        out.append((int(order[i]), int(order[k])))
    label[order] = label_
    return out


def ship(block: int, member: np.ndarray, n_buckets: int, payload) -> pa.Table:
    """Rows for buckets: ``member`` has place, side and the columns of the tile's key; ``payload(packer, places)`` packs
    what each of the places sends, once per bucket."""
    home = np.zeros(len(member), np.uint64)
    for column in member[:, 2:].T:
        home = mix(home + column.astype(np.uint64))
    bucket = (home % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    member, bucket = member[order], bucket[order]
    buckets, first = np.unique(bucket, return_index=True)
    cuts, data = [*first.tolist(), len(bucket)], []
    for x, y in zip(cuts, cuts[1:]):
        here, nth = np.unique(member[x:y, 0], return_inverse=True)
        p = Packer().put(member[x:y]).put(nth)
        payload(p, here.tolist())
        data.append(p.squeezed())
    return rows(block, buckets, data)


def tiles(table: pa.Table, columns: int, read):
    """(key, members as [place, side, row of the table, number]) of each tile of a bucket; ``read(packer)`` takes in
    what a block's places have sent and returns how many there are."""
    member, total = [], 0
    for i, data in enumerate(table["data"].to_pylist()):
        p = Packer.of_squeezed(data)
        m, nth = p.get(np.int64).reshape(-1, columns), p.get(np.int64)
        member.append(np.c_[m, np.full(len(m), i), nth + total])
        total += read(p)
    member = np.concatenate(member)
    member = member[np.lexsort((member[:, -1], *member[:, 2:columns].T[::-1]))]
    key = member[:, 2:columns]
    cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]).tolist()
    for x, y in zip(cuts, cuts[1:]):
        yield key[x], member[x:y][:, [0, 1, columns, columns + 1]]


def _find_components(docs: DataFrame, percent: int, tile_rows: int, id_col: str, text_col: str, n_blocks: int,
                     n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(sets, nodes): a row (doc_id, n, digest) per document, and a row (digest, least, at, root) per distinct set with
    its smallest id, the place of its first document and the root of its component."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    dealt = deal(docs, n_blocks, id_col, text_col)
    described = dealt.mapInArrow(_describe, "block int, doc_id long, n long, digest binary, heavy long").checkpoint()
    sets = described.where("heavy is null")
    heavy = np.sort(np.array([r[0] for r in described.where("heavy is not null").groupBy("heavy")
                             .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "heavy").limit(HEAVY_MAX)
                             .collect()], np.int64).view(np.uint64))
    nodes = (sets.where("digest is not null").groupBy("digest")
             .agg(F.min("doc_id").alias("least"),
                  F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "block")).alias("at"))
             .select("digest", "least", "at"))
    wanted = nodes.select("at.block", "digest")

    def find(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows or not wanted.num_rows:
            return rows(0, 0, [])
        block = table["block"][0].as_py()
        place, size, n, hashes = [], [], [], []
        for i, _, s in _chosen(table, wanted):
            p = prefix_of(s, heavy, percent)
            place.append(i), size.append(len(s)), n.append(len(p)), hashes.append(p)
        h = np.concatenate(hashes)
        bucket = (h % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        who = np.repeat(np.arange(len(n)), n)[order]
        place, size = np.array(place, np.uint32)[who], np.array(size, np.uint32)[who]
        tag = ((h // U(n_buckets)) & U((1 << 40) - 1))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        buckets, first = np.unique(bucket[order], return_index=True)
        cuts = [*first.tolist(), len(h)]
        return rows(block, buckets, [Packer().put(tag[a:b]).put(place[a:b]).put(size[a:b]).squeezed()
                                     for a, b in zip(cuts, cuts[1:])])

    def resolve(table: pa.Table) -> pa.Table:
        keys, node, size = [], [], []
        for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist()):
            p = Packer.of_squeezed(data)
            raw = p.get(np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            keys.append(wide.view("<u8").ravel())
            node.append((block << 32) + p.get(np.uint32).astype(np.int64))
            size.append(p.get(np.uint32).astype(np.int64))
        found = groups_of(np.concatenate(keys), np.concatenate(node), np.concatenate(size), percent, tile_rows)
        block = found[:, 0] >> 32
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else block
        cuts = [*first.tolist(), len(block)]
        return rows(block[first], table["bucket"][0].as_py(),
                    [Packer().put(found[a:b]).squeezed() for a, b in zip(cuts, cuts[1:])])

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(0, 0, [])
        told = np.unique(np.concatenate([Packer.of_squeezed(x).get(np.int64).reshape(-1, 4)
                                         for x in replies["data"].to_pylist()]), axis=0)
        node, tile, parts, part = told.T
        every = np.repeat(np.arange(len(told)), parts)  # a member goes to the sub-tiles of its part with each other
        other = expand(np.zeros(len(told), np.int64), parts)
        member = np.stack([node[every] & 0xFFFFFFFF, part[every], tile[every], parts[every],
                           np.minimum(part[every], other), np.maximum(part[every], other)], axis=1)
        found = sets_of(table, member[:, 0])

        def signatures(p, places):
            own = [found[i] for i in places]
            p.put(np.array([len(s) for s in own], np.int64)).put(np.concatenate([signature_of(s) for s in own]))

        return ship(table["block"][0].as_py(), member, n_buckets, signatures)

    def sets_of(table: pa.Table, places: np.ndarray) -> dict[int, np.ndarray]:
        ordered, _ = in_order(table)
        use = np.unique(places)
        return dict(zip(use.tolist(), shingle_sets(ordered["text"].combine_chunks().take(pa.array(use)))))

    def screen(table: pa.Table) -> pa.Table:
        """To each block: the members of tiles that bounds leave connected, with their component."""
        size, signature = [], []

        def read(p):
            n = p.get(np.int64)
            bits = p.get(np.uint64)
            ends = np.cumsum([width_of(x) // 64 for x in n.tolist()])
            signature.extend(np.split(bits, ends[:-1]))
            size.extend(n.tolist())
            return len(n)

        found = [np.zeros((0, 8), np.int64)]
        for key, m in tiles(table, 6, read):
            own = m[:, 3]
            label = np.arange(len(m))
            connect(np.array([size[i] for i in own]), [signature[i] for i in own], m[:, 1], percent, label)
            several = np.bincount(label, minlength=len(m))[label] > 1
            found.append(np.c_[m[:, 2], m[:, :2], np.tile(key, (len(m), 1)), label][several])
        found = np.concatenate(found)
        found = found[np.argsort(found[:, 0], kind="stable")]
        told, first = np.unique(found[:, 0], return_index=True)
        cuts = [*first.tolist(), len(found)]
        return rows(table["block"].to_numpy()[told], table["bucket"][0].as_py(),
                    [Packer().put(found[a:b, 1:]).squeezed() for a, b in zip(cuts, cuts[1:])])

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(0, 0, [])
        member = np.concatenate([Packer.of_squeezed(x).get(np.int64).reshape(-1, 7) for x in replies["data"].to_pylist()])
        found = sets_of(table, member[:, 0])

        def arrays(p, places):
            own = [found[i] for i in places]
            p.put(np.array([len(s) for s in own], np.int64)).put(np.concatenate(own))
            p.put(np.frombuffer(b"".join(map(digest_of, own)), np.uint8))

        return ship(table["block"][0].as_py(), member, n_buckets, arrays)

    def link(table: pa.Table) -> pa.Table:
        every, digests, found = [], [], []

        def read(p):
            n = p.get(np.int64)
            every.extend(np.split(p.get(np.uint64), np.cumsum(n)[:-1]))
            raw = p.get(np.uint8).tobytes()
            digests.extend(raw[i:i + 16] for i in range(0, len(raw), 16))
            return len(n)

        for _, m in tiles(table, 7, read):
            own = m[:, 3].tolist()

            def exact(i, j):
                a, b = every[own[i]], every[own[j]]
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                return 100 * common >= percent * (len(a) + len(b) - common)

            size = np.array([len(every[i]) for i in own])
            for i, j in connect(size, [signature_of(every[i]) for i in own], m[:, 1], percent, np.arange(len(m)), exact):
                found.append((digests[own[i]], digests[own[j]]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()),
                         "b": pa.array([x for _, x in found], pa.binary())})

    row = "block int, bucket int, data binary"
    sent = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(find, row)
    told = sent.groupBy("bucket").applyInArrow(resolve, row)
    signatures = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut, row)
    screened = signatures.groupBy("bucket").applyInArrow(screen, row)
    arrays = dealt.groupBy("block").cogroup(screened.groupBy("block")).applyInArrow(send, row)
    links = arrays.groupBy("bucket").applyInArrow(link, "a binary, b binary")
    roots = components(links)
    return sets, nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "least", "at", F.coalesce("root", "digest").alias("root"))


def jaccard_components(docs: DataFrame, percent: int = 80, tile_rows: int = 4096, id_col: str = "doc_id",
                       text_col: str = "text", n_blocks: int | None = None,
                       n_buckets: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles 5 words. Documents link when the Jaccard
    similarity of their shingle sets is at least ``percent`` hundredths. Defined cases: a text with fewer words is one
    shingle, a null text or one without words has none and links with nothing (its component is its own id); null ids
    take part and are the component id only where a component has no other; rows that repeat an id are documents of
    their own; an empty table gives an empty result; further columns are not read.
    """
    sets, nodes = _find_components(docs, percent, tile_rows, id_col, text_col, n_blocks or counts(docs),
                                   n_buckets or counts(docs))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_digest = nodes.join(least, "root").select("digest", "component_id")
    with_set = (sets.where("digest is not null").join(of_digest, "digest")
                .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    without = sets.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"),
                                                  F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without)


def one_of_each(docs: DataFrame, percent: int = 80, tile_rows: int = 4096, id_col: str = "doc_id",
                text_col: str = "text", n_blocks: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the one with the smallest id, of rows
    that share it the first by text. Documents without shingles all stay; cases as in :func:`jaccard_components`."""
    n_blocks = n_blocks or counts(docs)
    _, nodes = _find_components(docs, percent, tile_rows, id_col, text_col, n_blocks, n_buckets or counts(docs))
    stay = (nodes.groupBy("root").agg(F.min(F.struct("at.no", "at.doc_id", "at.block", "digest")).alias("first"))
            .select("first.block", "first.digest"))
    keep = {f"_keep{i}": F.col(c) for i, c in enumerate(docs.columns)}
    dealt, names = deal(docs, n_blocks, id_col, text_col, keep), list(keep)
    schema = StructType([StructField(name, f.dataType) for name, f in zip(keep, docs.schema.fields)])

    def choose(table: pa.Table, stay: pa.Table) -> pa.Table:
        table, _ = in_order(table, names)
        need, rows_ = set(stay["digest"].to_pylist()), []
        for i, s in enumerate(shingle_sets(table["text"])):
            d = digest_of(s)
            if d is None or d in need:
                need.discard(d)
                rows_.append(i)
        return table.select(names).take(pa.array(rows_, pa.int64()))

    chosen = dealt.groupBy("block").cogroup(stay.groupBy("block")).applyInArrow(choose, schema)
    return chosen.select(*[F.col(k).alias(c) for k, c in zip(keep, docs.columns)])
