"""Importance resampling towards a target distribution, with hashed n-gram features.

Texts become features in Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` give one dictionary of words and their indices; shifted indices form n-grams, of which each distinct
one is hashed once, from the hash of the n-gram before it. The first pass counts the buckets of all features over the
corpus and over the target; both are as long as there are buckets, whatever the data. The second pass takes each distinct
n-gram's gain and reduces them by document. Gumbel noise from a hash of the id makes the highest scores a draw without
replacement; their ranks come from ranges of the scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ranks
from .blocks import pieces

#: Words are what stands between runs of these: digits, ASCII letters (lower-cased) and all other characters make words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 20  # bytes of text whose words are in memory at once; a longer text is a piece of its own


class Grams:
    """The n-grams of some texts: their bucket, one for each distinct one, and which one stands at each place."""

    def __init__(self, texts: pa.Array, n: int, n_buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        doc = pc.list_parent_indices(lists).to_numpy()
        code = coded.indices.to_numpy().astype(np.int64)
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        filled = np.array([len(w) > 0 for w in words], bool)[code] if len(words) else np.zeros(0, bool)
        code, doc = code[filled], doc[filled]  # the ends of a text that begins or ends between words are no words
        self.n_words = np.bincount(doc, minlength=len(texts))
        self.doc, self.crc, self.which = [], [], []
        gram, crc = code, np.array([zlib.crc32(w) for w in words], np.uint32)
        for m in range(1, n + 1):
            if m > 1:  # each distinct (shorter n-gram, next word) once
                size = len(code) - m + 1
                inside = doc[:max(0, size)] == doc[m - 1:]
                pair = gram[:max(0, size)] * len(words) + code[m - 1:]
                pair[~inside] = -1
                distinct, gram = np.unique(pair, return_inverse=True)
                if len(distinct) and distinct[0] == -1:
                    crc_of = [0]
                    distinct = distinct[1:]
                else:
                    crc_of = []
                before, last = np.divmod(distinct, max(1, len(words)))
                crc = np.array(crc_of + [zlib.crc32(b" " + words[w], int(crc[b])) for b, w in
                                         zip(before.tolist(), last.tolist())], np.uint32)
                self.doc.append(doc[:max(0, size)][inside]), self.which.append(gram[inside])
            else:
                self.doc.append(doc), self.which.append(gram)
            self.crc.append(crc)
        self.buckets = [(c % np.uint32(n_buckets)).astype(np.int64) for c in self.crc]
        self.n_docs = len(texts)

    def counts(self, n_buckets: int) -> np.ndarray:
        total = np.zeros(n_buckets, np.int64)
        for bucket, which in zip(self.buckets, self.which):
            total += np.bincount(bucket, weights=np.bincount(which, minlength=len(bucket)),
                                 minlength=n_buckets).astype(np.int64)
        return total

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, sum of their gains) of each text."""
        n, total = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64)
        for doc, bucket, which in zip(self.doc, self.buckets, self.which):
            if len(doc):
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                n[doc[first]] += np.diff(np.r_[first, len(doc)])
                total[doc[first]] += np.add.reduceat(gains[bucket][which], first)
        return n, total


def bucket_counts(texts: DataFrame, text_col: str, n: int, n_buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in pieces(batches, 0, PIECE):
            total += Grams(batch.column(0), n, n_buckets).counts(n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = (texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n"))).toArrow()  # n_buckets rows at most
    out = np.zeros(n_buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of a bucket's share in the target over that in the source, smoothed by one, rounded down."""
    n = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """1000 times Gumbel noise from the first 32 bits of a digest of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_weights(docs: DataFrame, target: DataFrame, n: int = 2, n_buckets: int = 10_000, id_col: str = "doc_id",
                       text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a text's features, 0 without any.

    Features are all runs of 1 to ``n`` words, with repeats. Null and empty texts have none.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, n, n_buckets),
                                              bucket_counts(target, target_col, n, n_buckets)))

    def weigh(batches):
        for batch in pieces(batches, 1, PIECE):
            grams = Grams(batch.column(1), n, n_buckets)
            count, total = grams.sums(gain.value)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams.n_words), pa.array(count), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, n: int = 2,
             n_buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_features, weight, score, rank), all long.

    Of the N texts with at least ``min_words`` words the floor(``percent`` * N / 100) of highest score are drawn and have
    ranks from 1 on in descending order of the score, ties to the smaller id; all others have a null rank. Defined cases:
    null and empty texts have no features and weight 0; null ids hash as an empty id and come before others in ties; of rows
    that share id and score, which one has the earlier rank is left open; an empty table gives an empty result, an empty
    target has no counts; further columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    scored = (importance_weights(docs, target, n, n_buckets, id_col, text_col, target_col)
              .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))).checkpoint()
    enough = F.col("n_words") >= min_words
    placed = ranks.in_order(scored.where(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "place")
    drawn = scored.where(enough).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*columns).unionByName(rest.select(*columns))


# CRC-32 by its table of 256 numbers, over the hexadecimal digits of each distinct feature.
OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) AS t
  FROM range(256) r(i)
), own AS (
  SELECT row_number() OVER () AS uid, doc_id, 0 AS side, text FROM documents
), texts AS (
  SELECT uid, side, text FROM own
  UNION ALL SELECT row_number() OVER (), 1, text FROM benchmark
), words AS (
  SELECT uid, side, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM texts
), grams AS (
  SELECT uid, side, unnest(w) AS g FROM words
  UNION ALL
  SELECT uid, side, p[1] || ' ' || p[2] FROM (SELECT uid, side, unnest(list_zip(w, w[2:])) AS p FROM words) WHERE p[2] IS NOT NULL
), known AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams)
), hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i:
             ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket
  FROM known, crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM grams JOIN hashed USING (g) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counted
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g_of
  FROM counted, totals
), summed AS (
  SELECT uid, count(*) AS n, sum(g_of) AS total
  FROM grams JOIN hashed USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY uid
), scored AS (
  SELECT uid, doc_id, coalesce(n, 0)::BIGINT AS n_features, len(w) AS n_words,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM own LEFT JOIN summed USING (uid) JOIN words USING (uid) WHERE words.side = 0
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rk, count(*) OVER () AS eligible
  FROM noisy WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rk <= 25 * eligible // 100 THEN rk END AS rank
FROM noisy LEFT JOIN ranked USING (uid)
"""
