"""H1: the splitter's contract and the reference's chunker cases."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions.chunking import fixed_windows, split_offsets, split_text


def test_short_text_is_one_chunk():
    assert split_text("Short text.", 100, 20) == ["Short text."]


def test_250_chars_at_100_20():
    chunks = split_text("a" * 250, 100, 20)
    assert len(chunks) >= 3
    assert all(len(c) <= 100 for c in chunks)


def test_sentences_overlap():
    text = " ".join(f"This is sentence number {i} of the test." for i in range(7))
    off = split_offsets(text, 100, 20)
    assert all(b - a <= 100 for a, b in off)
    assert off[0][0] == 0 and off[-1][1] == len(text)
    for (a1, b1), (a2, b2) in zip(off, off[1:]):
        assert a2 <= b1  # neighbours touch or overlap: nothing is lost


def test_empty_and_none():
    assert split_text("", 100, 20) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n")), min_size=1, max_size=600),
       st.integers(20, 120), st.integers(0, 15))
def test_cover_and_bound(text, size, overlap):
    off = split_offsets(text, size, overlap)
    assert off[0][0] == 0 and off[-1][1] == len(text)
    for a, b in off:
        assert 0 <= a < b <= len(text) and b - a <= size
    for (a1, b1), (a2, b2) in zip(off, off[1:]):
        assert a2 <= b1 and a2 > a1


def test_fixed_windows_sql(spark):
    df = spark.createDataFrame([("a" * 250,), ("",), (None,)], "t string")
    rows = df.select(fixed_windows(F.col("t"), 100, 20).alias("w")).collect()
    assert [len(x) for x in rows[0]["w"]] == [100, 100, 90]
    assert rows[1]["w"] == [] and rows[2]["w"] == []


def test_small_batches(spark):
    """Texts reach Python in batches of bounded rows and bytes, however many a partition has."""
    from skein.operators.chunks import chunk_files
    from skein.options import DEFAULTS
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    files = spark.range(6000).select(F.lit("f").alias("file_path"), F.lit("some words").alias("text"))
    chunk_files(files, DEFAULTS)
    sizes = spark.range(6000).coalesce(1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["id"]) for b in bs), "id long")
    assert max(r.id for r in sizes.collect()) <= 1000
    spark.conf.set(key, "100")
    chunk_files(files, DEFAULTS)
    assert spark.conf.get(key) == "100"  # a smaller setting stays
    spark.conf.unset(key)


@pytest.mark.parametrize("separators", [("",), (". ", " ", "")])
def test_texts_are_cut_and_embedded_once(spark, separators):
    """No filter runs the splitter or the embedder a second time."""
    from skein.operators.chunks import build_chunk_table
    from skein.options import DEFAULTS
    files = spark.createDataFrame([("/a", "some words. " * 200), ("/b", "... "), ("/c", None)], "file_path string, text string")
    table = build_chunk_table(files, DEFAULTS.with_(separators=separators))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert {r["file_path"] for r in table.select("file_path", "embedding").collect()} == {"/a"}


def test_hashed_vectors(spark):
    """Words by their md5, whatever batch they stand in; none for texts without a word or whose words cancel out."""
    import hashlib
    import numpy as np
    from pyspark.sql import functions as F
    from skein.functions.embedding import HashingEmbedder
    texts = ["Word two, two \u00c9t\u00e9 \u65e5\u672c", "!!", "", None, " x "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(HashingEmbedder(16).embed(F.col("t"))).collect()]
    for text, vec in ((["word", "two", "two", "\u00e9t\u00e9", "\u65e5\u672c"], got[0]), (["x"], got[4])):
        want = np.zeros(16)
        for w in text:
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 16] += 1 - 2 * (int(h[8], 16) & 1)
        assert np.allclose(vec, want / np.linalg.norm(want))
    assert got[1] is None and got[2] is None and got[3] is None
