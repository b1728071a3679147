"""Token files against the tokenizer library, Elias-Fano against plain arrays, and the defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from skein.llm import tokenfile
from skein.llm.tokenfile import EliasFano, Segment, read_token_files, token_files

DOCS = "doc_id long, text string, n string, ids string, part string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.integers(0, 3))
def test_elias_fano(steps, shrink):
    values = np.cumsum(np.array([s >> (13 * shrink) for s in steps], np.uint64), dtype=np.uint64)
    kept, at = EliasFano.read(b"xyz" + EliasFano.of(values).bytes() + b"rest", 3)
    which = np.random.default_rng(1).permutation(len(values))
    assert np.array_equal(kept.select(which), values[which])
    assert at == 3 + len(EliasFano.of(values).bytes())


def test_space():
    """About two bits a number beside the low bits, and a sample for every 256."""
    n, gap = 100_000, 700
    values = np.cumsum(np.random.default_rng(0).integers(1, 2 * gap, n))
    assert len(EliasFano.of(values).bytes()) * 8 / n < 2 + np.log2(gap) + 0.2


def brute(docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, docs, parts=3, **kw):
    df = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in docs], DOCS)
    if parts > 1:
        df = df.repartition(parts)
    path = token_files(df, PATH, **kw)
    return [tuple(r) for r in read_token_files(spark, path).collect()], path


@pytest.mark.parametrize("segment_bytes", [1, 500, 8 << 20])
def test_files(spark, segment_bytes):
    r = random.Random(4)
    words = ["hello", "World", "日本語", "don't", "\n\n", "  ", "été", "123", "<|endoftext|>", " ", "\x00"]
    docs = [(i * r.choice([1, 10**12]) - 50, " ".join(r.choices(words, k=r.randrange(40)))) for i in range(200)]
    docs = list({d: t for d, t in docs}.items()) + [(-10**15, None), (2**62, ""), (-(2**62), "far"), (None, "no id")]
    got, path = run(spark, docs, segment_bytes=segment_bytes)
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(got, key=key) == brute(docs)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    assert files.count() >= (len(docs) if segment_bytes == 1 else 1)
    for f in files.limit(3).collect():
        seg = Segment.read(bytes(f["content"]))
        assert seg.ids.dtype == np.uint16 and f["content"][-1] == 10


def test_cuts(monkeypatch):
    """Texts are cut where the tokenizer cuts, and forgotten pieces are encoded again."""
    r = random.Random(9)
    monkeypatch.setattr(tokenfile.Encoder, "KNOWN", 30)
    with open(PATH, encoding="utf-8") as f:
        encode = tokenfile.Encoder(f.read())
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    bits = ["word", " ", " ", "  ", "\n", " x", "12", "é", "'s ", "\u00a0", "\t ", "\u2028", "\x1c", "\u180e", "日本 ", "<|endoftext|>"]
    for _ in range(40):
        texts = ["".join(r.choices(bits, k=r.randrange(50))) for _ in range(20)] + ["", " ", "  ", "a", " a", "a "]
        ids, at = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_new_words_in_runs():
    """Words go to the library in runs, with the ids that each text has alone."""
    r = random.Random(2)
    with open(PATH, encoding="utf-8") as f:
        encode = tokenfile.Encoder(f.read())
    tokenizer, encode.tokenizer = encode.tokenizer, Counting(encode.tokenizer)
    odd = ["'s", "x'", "'ll!", "<|endoftext|>", "a\nb", "a\n", "\ta", "Ġ", "ĠaĠ", "é.", "日本,", "٣4", "_", "--", "a\u00a0b", "\u00a0"]
    words = ["".join(r.choices("abcdeéô日", k=r.randrange(3, 9))) + r.choice(["", "", "'", ".", "),", "1"]) for _ in range(9000)]
    texts = ["x " + " ".join(words[a:a + 900] + r.sample(odd, 9)) for a in range(0, 9000, 900)] + ["ends so\n", "a \n", "\n a", ""]
    ids, at = encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode.tokenizer.texts < 600
    assert [len(x) for x in encode(pa.array([], pa.string()))] == [0, 1]


def test_vocabulary_without_space():
    """No token tells where a word begins, so that words are encoded one by one."""
    tiny = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")]))
    tiny.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    encode = tokenfile.Encoder(tiny.to_str())
    texts = ["ab a b abab", "b c ab", "c", "ab ab"]
    ids, at = encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tiny.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_are_forgotten(monkeypatch):
    """What is known of earlier pieces is bounded in characters, not only in number."""
    monkeypatch.setattr(tokenfile.Encoder, "CHARS", 5000)
    with open(PATH, encoding="utf-8") as f:
        encode = tokenfile.Encoder(f.read())
    for i in range(30):
        text = f"{i}-" + "ab" * 1000
        ids, _ = encode(pa.array([text]))
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, encode.known)) <= 5000 + len(text)


def test_long_text(spark):
    docs = [(1, "word " * 600_000), (2, "a" * 5000), (3, "tail"), (4, " " * 3000 + "x  " * 2000)]
    assert sorted(run(spark, docs)[0]) == brute(docs)


def test_repeated_and_empty(spark):
    docs = [(1, "a"), (1, "b c"), (1, "a"), (None, "x y z"), (None, None), (0, "q")]
    got, _ = run(spark, docs)
    assert sorted(x[2] for x in got) == sorted(x[2] for x in brute(docs))
    starts = sorted((x[1], x[2]) for x in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [x[0] for x in sorted(got, key=lambda x: x[1])] == [None, None, 0, 1, 1, 1]
    assert run(spark, [], parts=1)[0] == []


def test_ids_come_back(spark):
    docs = [(i, f"text number {i} " * i) for i in range(30)]
    df = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in docs], DOCS)
    path = token_files(df, PATH, segment_bytes=300)
    tokenizer = Tokenizer.from_file(PATH)
    back = {r.doc_id: r.ids for r in read_token_files(spark, path, with_ids=True).collect()}
    assert {d: tokenizer.decode(ids[:-1]) for d, ids in back.items()} == dict(docs)
