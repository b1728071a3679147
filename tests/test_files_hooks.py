"""S1-S5 file sources, answer/summary hooks (M6, M9), the embedding hook (M1) and the index job."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from skein.functions.embedding import PandasEmbedder
from skein.functions.text import NO_DOCUMENTS_ANSWER
from skein.operators.chunks import build_chunk_table
from skein.operators.context import summary_context
from skein.options import DEFAULTS
from skein.plans.jobs import index_files
from skein.plans.query import answer_questions
from skein.session import scratch_path
from skein.sources.files import collect_files, extract_text, is_text
from skein.sources.store import ChunkStore


def make_dir():
    d = tempfile.mkdtemp(prefix="skein-files-")
    os.makedirs(os.path.join(d, "sub"))
    files = {"ruby.txt": "Ruby is a dynamic programming language created by Yukihiro Matsumoto.",
             "sub/python.md": "Python is a programming language created by Guido van Rossum.",
             "page.html": "<html><script>x=1</script><body><p>JavaScript &amp; the web</p></body></html>",
             "empty.txt": "   ",
             "image.bin": "\x00\x01\x02"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    return d


def test_collect_and_extract(spark):
    d = make_dir()
    files = collect_files(spark, d)
    names = sorted(os.path.basename(r.path) for r in files.select("path").collect())
    assert names == ["empty.txt", "page.html", "python.md", "ruby.txt"]
    ex = {os.path.basename(r.file_path): r for r in extract_text(files).collect()}
    assert ex["page.html"].text == "JavaScript & the web"
    assert ex["ruby.txt"].file_type == "txt" and ex["python.md"].file_type == "md"
    allf = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d)
    flags = {os.path.basename(r.path): r.t for r in allf.select("path", is_text("content", "path").alias("t")).collect()}
    assert flags["ruby.txt"] and not flags["image.bin"]


def test_bad_bytes_and_references(spark):
    d = tempfile.mkdtemp(prefix="skein-files-")
    for name, data in (("good.txt", "é".encode()), ("latin.txt", "é".encode("latin-1")),
                       ("page.html", b"<p>&copy; a&nbsp;&middot; &#233;&#x2014;&eacute;</p>")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    got = {r.file_name: r for r in extract_text(collect_files(spark, d)).collect()}
    assert got["good.txt"].text == "é" and got["good.txt"].error is None
    assert got["latin.txt"].text is None and got["latin.txt"].error == "not UTF-8 text"
    assert got["page.html"].text == "© a · é—é"
    store = ChunkStore(spark, scratch_path(spark, "bad"))
    c = index_files(extract_text(collect_files(spark, d)), store, DEFAULTS)
    assert (c["files_processed"], c["errors"]) == (2, 1)


def test_index_job_and_answers(spark):
    d = make_dir()
    files = extract_text(collect_files(spark, d))
    store = ChunkStore(spark, scratch_path(spark, "idx"))
    c = index_files(files, store, DEFAULTS)
    assert c["files_processed"] == 4 and c["chunks_created"] == 3
    again = index_files(files, store, DEFAULTS)
    assert again["chunks_created"] == 0 and store.read().count() == 3  # J6: nothing twice
    qs = spark.createDataFrame([(1, "Who created Ruby?"), (2, "   ")], "query_id long, query_text string")

    class Gen:
        def generate(self, prompt):
            return F.when(F.instr(prompt, "Matsumoto") > 0,
                          F.lit("<think>look</think> Yukihiro Matsumoto created Ruby."))

    out = {r.query_id: r for r in answer_questions(store.read(), qs, DEFAULTS, generator=Gen()).collect()}
    assert out[1].answer == "Yukihiro Matsumoto created Ruby."
    assert "ruby.txt" in out[1].sources and out[1].n_sources >= 1 and 0 < out[1].confidence <= 100
    assert out[2].answer == NO_DOCUMENTS_ANSWER and out[2].sources == "" and out[2].confidence == 0.0


def test_summary_context(spark):
    df = spark.createDataFrame([("ctx", "sum"), ("ctx", None)], "c string, s string")
    r = df.select(summary_context(F.col("c"), F.col("s")).alias("r")).collect()
    assert r[0].r == "Summary: sum\n\nDetailed Information:\nctx\n" and r[1].r == "ctx"


def test_pandas_embedder_hook(spark):
    def load():
        return lambda texts: np.ones((len(texts), 4), dtype=np.float32)
    emb = PandasEmbedder(load, 4)
    files = spark.createDataFrame([("/a.txt", "some text here"), ("/b.txt", "  ")], "file_path string, text string")
    rows = build_chunk_table(files, DEFAULTS, emb).collect()
    assert len(rows) == 1 and list(rows[0].embedding) == [1.0, 1.0, 1.0, 1.0]


def test_mixed_chunking_and_json(spark):
    from skein.operators.chunks import chunk_mixed
    from skein.plans.query import answers_json
    d = make_dir()
    paths = spark.createDataFrame([(os.path.join(d, "ruby.txt"),)], "p string")
    texts = spark.createDataFrame([("raw text here",)], "t string")
    docs = spark.createDataFrame([("doc text", '{"file_path": "/x/y.md"}')], "text string, metadata string")
    rows = chunk_mixed(spark, paths, texts, docs).collect()
    assert sorted(r.file_path.split("/")[-1] for r in rows) == ["inline_text", "ruby.txt", "y.md"]
    js = answers_json(spark.createDataFrame([(1, "a")], "query_id long, answer string")).first().json
    assert js == '{"query_id":1,"answer":"a"}'


def test_topic_hooks_and_export(spark):
    from skein.operators import topics as tp
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    df = e.select(F.col("vec_id").cast("string").alias("id"), "embedding",
                  F.concat(F.lit("word"), F.col("label").cast("string"), F.lit(" shared text")).alias("chunk_text"))
    assigned = tp.cluster(df, "embedding", DEFAULTS, k=10)

    class Summ:
        def summarize(self, prompt):
            return F.concat(F.lit("Summary: about "), F.substring(prompt, 1, 5))

    class Lab:
        def label(self, terms, docs):
            return F.lit(None).cast("string")
    t = tp.topic_table(assigned, DEFAULTS, labeler=Lab(), summarizer=Summ()).collect()
    assert all(r.summary.startswith("about ") for r in t)
    assert all(r.label == ", ".join(r.terms[:3]) for r in t)
    out = scratch_path(spark, "topics-json")
    tp.export_json(tp.topic_table(assigned, DEFAULTS), out)
    j = spark.read.json(out).first()
    assert j.summary.total_topics == len(t) and j.generated_at


def test_apply_reducer_job(spark):
    from skein.plans.jobs import apply_reducer, train_reducer
    store = ChunkStore(spark, scratch_path(spark, "red"))
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    store.add(build_chunk_table(files, DEFAULTS))
    r = train_reducer(store.read(), scratch_path(spark, "model"), DEFAULTS, n_components=16)
    c = apply_reducer(store, r).first()
    n = store.read().count()
    assert c.processed == n and c.skipped == 0
    assert store.read().where(F.size("reduced_embedding") == 16).count() == n


def test_stored_fts_index_gives_same_answers(spark):
    from skein.plans import catalog, tables
    from skein.plans.jobs import build_fts_index, load_fts_index
    sf = "/root/testdata/sf0.001"
    opts = catalog.SQL_CHUNKING
    chunks = catalog.chunk_table(spark, sf, opts)
    path = scratch_path(spark, "fts")
    build_fts_index(chunks, path)
    idx = load_fts_index(spark, path)
    qs = tables.benchmark_questions(spark, sf)
    a = sorted(tuple(r) for r in answer_questions(chunks, qs, opts).collect())
    b = sorted(tuple(r) for r in answer_questions(chunks, qs, opts, fts_index=idx).collect())
    assert a == b


def test_summary_hook_in_answers(spark):
    from skein.plans import catalog, tables
    sf = "/root/testdata/sf0.001"
    chunks = catalog.chunk_table(spark, sf, catalog.SQL_CHUNKING)
    qs = tables.benchmark_questions(spark, sf)

    class Summ:
        def summarize(self, prompt):
            return F.when(F.instr(prompt, "Query: ") > 0, F.lit("short summary"))
    rows = answer_questions(chunks, qs, catalog.SQL_CHUNKING, summarizer=Summ()).collect()
    found = [r for r in rows if r.n_candidates > 0]
    assert found and all(r.answer.startswith("Based on the retrieved information:\n\nSummary: short summary")
                         for r in found)


def test_prompts_reach_the_hooks_and_rewriting_runs_once(spark):
    from skein.functions import text as tx
    from skein.functions.text import metadata_fields, text_of
    counter = spark.sparkContext.accumulator(0)

    @F.udf("struct<clarified_intent:string,query_type:string,sub_queries:array<string>,key_terms:array<string>,context_needed:string>")
    def rewrite(prompt):
        counter.add(1)
        return ("intent of " + prompt.split("User Query: ")[1].split("\n")[0], "x", ["red boat", "blue sea"], [], "minimal")

    class Rewriter:
        def rewrite_prompt(self, prompt):
            return rewrite(prompt)

    class Gen:
        def generate(self, prompt):
            return F.when(prompt.startswith(tx.ANSWER_INSTRUCTIONS), F.concat(F.lit("got "), F.element_at(F.split(prompt, "Question: "), -1)))

    files = spark.createDataFrame([("/a.txt", "a red boat on a blue sea")], "file_path string, text string")
    chunks = build_chunk_table(files, DEFAULTS).checkpoint()
    qs = spark.createDataFrame([(i, f"question {i}") for i in range(10)], "query_id long, query_text string").checkpoint()
    out = answer_questions(chunks, qs, DEFAULTS, rewriter=Rewriter(), generator=Gen()).collect()
    assert counter.value == 10
    assert {r.answer for r in out} == {f"got intent of question {i}" for i in range(10)} and {r.n_sub_queries for r in out} == {3}
    df = spark.createDataFrame([('{"chunk_text": "a", "text": "b"}',), ('{"text": "b"}',), ('{"x": 1}',), ("plain",), (None,)], "r string")
    assert [r[0] for r in df.select(text_of("r")).collect()] == ["a", "b", "", "plain", ""]
    m = spark.createDataFrame([('{"a": 1}',), (None,), ("{broken",)], "m string").select(metadata_fields("m").alias("m")).collect()
    assert [r.m for r in m] == [{"a": "1"}, {}, {}]
