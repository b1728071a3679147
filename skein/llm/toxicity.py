"""Toxicity by a linear-chain conditional random field over tokens.

*Labelled tokens.* The labels are on documents; tokens get theirs from them: in a toxic training document the tokens
whose word or word beginning is far more frequent in toxic than in clean documents are toxic, all others, and all of
clean documents, are not. The statistics come from a bounded, label-balanced sample of the training fold (``per_class``
documents of each label, those with the smallest hashes of their ids).

*Model.* Two states, transitions between neighbours, emissions from the log odds of the token's word and of its first
4, 5 and 6 bytes, so that unseen forms of a known stem count. The weights maximise the conditional likelihood of the
labelled tokens (forward-backward gradients).

*Scores.* Forward-backward gives every token of a whole text the marginal probability of being toxic; runs at 0.5 or
more are the offending spans. Sum, maximum and density of the marginals are turned into a probability by a logistic
regression on the same sample, corrected to the label shares of the whole training fold.

A very long text costs no more per token than a short one (see ``crf``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import crf
from .blocks import pieces
from .textnum import BYTE, LOWER, PIECE, U, mix, powers, utf8, word_spans

BETWEEN = np.ones(256, bool)  # tokens are runs of ASCII letters, digits and non-ASCII bytes
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PREFIXES = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def token_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, token starts, ends, first token of each document); one row of features per kind, 0 where it has none."""
    buf, offs = utf8(texts)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs, BETWEEN)
    out = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        pw, inv = powers(b - a + 1) if b - a > PIECE else _powers()
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE[buf[a:b]] * pw[:b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        for kind, n in enumerate((None, *PREFIXES)):
            stop = e if n is None else np.minimum(s + n, e)
            h = mix((total[stop] - total[s]) * inv[s] + U(kind + 1)) | U(1)
            out[kind, i:j] = h if n is None else np.where(e - s >= n, h, U(0))
        i = j
    return out, starts, ends, first


_cache: list = []


def _powers():
    if not _cache:
        _cache.append(powers(PIECE + 2))
    return _cache[0]


@dataclass
class Model:
    feature: np.ndarray     # sorted hashes
    odds: np.ndarray        # their log odds
    emission: np.ndarray    # weight of each kind's log odds and of the largest, then the bias
    move: np.ndarray        # 2 x 2 log weights of transitions, state 1 is toxic
    document: np.ndarray    # logistic regression: weights and intercept
    rest: float = 0.0       # score where nothing could be learned

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        """(kinds + 1) x tokens: log odds of each feature, 0 for unknown ones, and the largest."""
        if not len(self.feature):
            return np.zeros((features.shape[0] + 1, features.shape[1]))
        at = np.minimum(np.searchsorted(self.feature, features), len(self.feature) - 1)
        x = np.where(self.feature[at] == features, self.odds[at], 0.0)
        return np.concatenate([x, x.max(0, keepdims=True)])

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return crf.marginals(self.emission[:-1] @ self.log_odds(features) + self.emission[-1], self.move, first)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: log of the sum, the maximum and the density of the marginals, log of the length."""
    n = np.diff(first)
    total = np.r_[0, np.cumsum(p)]
    total = np.maximum(0, total[first[1:]] - total[first[:-1]])
    most = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        most[some] = np.maximum.reduceat(p, first[some])
    return np.stack([np.log1p(total), most, 10 * total / np.maximum(n, 1), np.log1p(n) / 5], axis=1)


def fit_crf(model: Model, texts: list[str], toxic: np.ndarray, label_odds: float) -> None:
    """Fit emission and transition weights to tokens labelled from their documents."""
    features, _, _, first = token_features(pa.array(texts, pa.string()))
    x = model.log_odds(features)
    if not x.shape[1]:
        return
    label = (np.repeat(toxic, np.diff(first)) == 1) & (x[-1] >= label_odds)
    model.emission, model.move = crf.fit(model.emission, model.move, lambda w: w[:-1] @ x + w[-1],
                                         lambda gap: np.r_[x @ gap, gap.sum()], label, first)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and intercept of a logistic regression, lightly regularised (Newton's method)."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, 1e-2), 1e-4]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = 8000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", crf_docs: int = 400, crf_bytes: int = 20_000, min_toxic: int = 5,
          label_odds: float = 3.0) -> Model:
    """Learn from the rows of ``labels`` that are not held out, at most ``per_class`` documents of each label.

    The chain's weights are fitted on the first ``crf_docs`` of these of each label that have at most ``crf_bytes`` bytes;
    features and the regression come from all of them. A feature counts from ``min_toxic`` toxic documents of the sample on;
    a token of a toxic document teaches the chain as toxic from log odds of ``label_odds`` on. Documents whose label is null, or that the table labels both
    ways, teach nothing; without both labels, or where no feature is in ``min_toxic`` toxic documents and more frequent in
    them than in clean ones, the model gives every text the share of toxic labels.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    fold = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
            .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most"))
    share = {r["toxic"]: r["n"] for r in fold.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(np.zeros(0, np.uint64), np.zeros(0), np.r_[np.zeros(len(PREFIXES) + 1), 1.0, -3.0],
                  np.array([[2.0, -1.0], [0.0, 0.0]]), np.zeros(5))
    if len(share) < 2:
        model.rest = float(next(iter(share), 0))
        return model
    chosen = None
    for toxic in (0, 1):
        part = fold.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
              .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").checkpoint())  # 2 * per_class rows

    def present(batches, only=None, toxic=1):
        """(feature, documents of that label that hold it), for one piece of the sample."""
        for batch in pieces(batches, 0):
            batch = batch.filter(pa.array(batch.column(1).to_numpy() == toxic))
            features, _, _, first = token_features(batch.column(0))
            found = []
            for a, b in zip(first, first[1:]):
                f = np.unique(features[:, a:b])
                if only is not None and len(f):
                    f = f[only[np.minimum(np.searchsorted(only, f), len(only) - 1)] == f]
                found.append(f[f != 0])
            f, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], ["f", "n"])

    def table(frame):
        got = frame.toPandas()
        return got["f"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)

    column = sample.select("text", "toxic")
    feature, n_toxic = table(column.mapInArrow(present, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
                             .where(F.col("n") >= min_toxic))
    order = np.argsort(feature)
    feature, n_toxic = feature[order], n_toxic[order]
    n_clean = np.zeros(len(feature))
    if len(feature):
        f, n = table(column.mapInArrow(lambda b: present(b, feature, 0), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")))
        n_clean[np.searchsorted(feature, f)] = n
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        model.rest = share[1] / (share[0] + share[1])
        return model
    odds = np.log((n_toxic + .5) / (size[1] + 1)) - np.log((n_clean + .5) / (size[0] + 1))
    model.feature, model.odds = feature[odds >= 1], np.minimum(odds[odds >= 1], 6.0)
    if not len(model.feature):
        model.rest = share[1] / (share[0] + share[1])
        return model
    text = (sample.where(F.octet_length("text") <= crf_bytes)
            .select("text", "toxic", F.xxhash64("doc_id").alias("h"), "doc_id"))
    few = []
    for toxic in (0, 1):
        few += text.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(crf_docs).collect()
    fit_crf(model, [r["text"] for r in few], np.array([r["toxic"] for r in few]), label_odds)
    shared = spark.sparkContext.broadcast(model)

    def describe(batches):
        for batch in pieces(batches, 0):
            features, _, _, first = token_features(batch.column(0))
            x = document_features(shared.value.marginals(features, first), first)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], ["a", "b", "c", "d", "toxic"])

    x = column.mapInArrow(describe, "a double, b double, c double, d double, toxic int").toPandas()
    y = x.pop("toxic").to_numpy(np.float64)
    order = np.lexsort((y, *x.to_numpy().T))  # the same sums whatever order the rows came in
    w = fit_logistic(x.to_numpy()[order], y[order])
    w[-1] += np.log(share[1] / share[0]) - np.log(size[1] / size[0])
    model.document = w
    return model


def score_pieces(batches, column: int, model: Model, spans: bool):
    """(piece of a batch, scores of its rows, offending spans as (document, first and last character))."""
    for batch in pieces(batches, column):
        texts = batch.column(column).fill_null("")
        features, starts, ends, first = token_features(texts)
        p = model.marginals(features, first)
        if len(model.feature):
            x = document_features(p, first)
            score = 1 / (1 + np.exp(-np.clip(x @ model.document[:-1] + model.document[-1], -30, 30)))
        else:
            score = np.full(batch.num_rows, model.rest)
        runs = None
        if spans:
            buf, offs = utf8(texts)
            bad = p >= 0.5
            opens = np.zeros(len(p) + 1, bool)
            opens[first] = True
            run = np.flatnonzero(bad & (np.r_[True, ~bad[:-1]] | opens[:-1])) if len(p) else np.zeros(0, int)
            stop = np.flatnonzero(bad & np.r_[~bad[1:] | opens[1:-1], True]) if len(p) else run
            chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]  # characters before each byte
            doc = np.searchsorted(first, run, "right") - 1
            runs = doc, chars[starts[run]] - chars[offs[doc]], chars[ends[stop]] - chars[offs[doc]]
        yield batch, score, runs


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, score, spans array<struct<start,end>>), spans as character offsets.

    Only the text is read for a score. Defined cases: null and empty texts are scored as texts without tokens; null and
    repeated ids are passed through; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, value, (doc, a, b) in score_pieces(batches, 1, shared.value, True):
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            span = pa.StructArray.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), span)],
                ["doc_id", "score", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(score, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; cases as in :func:`score_toxicity`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch, score, _ in score_pieces(batches, at, shared.value, False):
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(clean, docs.schema)
