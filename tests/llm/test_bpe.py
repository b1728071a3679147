"""Byte-level BPE against the reference tokenizer library, and its round trip."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from skein.llm.bpe import bpe_decode, bpe_encode, encode_word, read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, block string, decoded string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(3)
    parts = ["the", "The", " of", "  ", " ", "\n", "\t", "\r\n", "'s", "'ll", "don't", "é", "ß", "日本語", "٣٤", "12 345", "½",
             "_x_", "😀", "👩‍👩‍👧", " ", " ", "​", "\u0085", "\x1c", "<|endoftext|>", "...", "a" * 90, "ab" * 200, " x"]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(300)]
    return [*out, "", " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "x" * 5000, "é" * 3000, "\n" * 100 + "a"]


def test_round_trip(spark, library):
    docs = list(enumerate(texts())) + [(None, "no id"), (None, None), (5, "again"), (5, "again"), (7, None)]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA).repartition(3).checkpoint()
    found = bpe_decode(bpe_encode(df, PATH, P.PATTERN, n_buckets=5), PATH).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids, bytes(r.decoded)) for r in found)
    want = []
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((d is not None, d or 0, len(ids), ids, (t or "").encode()))
    assert got == sorted(want)


def test_words(library):
    ranks, r = read_ranks(PATH), random.Random(1)
    for n in [1, 2, 5, 20, 63, 64, 65, 66, 200, 1000]:
        for _ in range(20):
            word = "".join(r.choice("aeetthrns") for _ in range(n))
            assert encode_word(word.encode(), ranks) == library.encode_ordinary(word)


def test_empty(spark):
    none = spark.createDataFrame([(0, "x", "", "", "")], SCHEMA).where(F.lit(False))
    assert bpe_decode(bpe_encode(none, PATH, P.PATTERN), PATH).count() == 0
