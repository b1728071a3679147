"""Files that are new, unchanged, changed, blank or removed; pruned look-ups; replays and failed ingests."""

import pytest
from pyspark.sql import functions as F

from skein.operators.chunks import build_chunk_table
from skein.options import DEFAULTS
from skein.sources.file_index import FileIndex
from skein.streaming.ingest import run_ingest

OPTS = DEFAULTS.with_(embedding_dim=8, chunk_size=40, chunk_overlap=5)


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, text string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def same_as_whole(spark, index, rows):
    assert ids(index.live()) == ids(build_chunk_table(files(spark, rows), OPTS))


def test_states(spark, tmp_path):
    index = FileIndex(spark, str(tmp_path / "i"), n_buckets=16)
    assert index.live().count() == 0 and index.generations() == []
    state = {f"/a/{i}.txt": f"text number {i} with several words. " * (i % 4 + 1) for i in range(40)}
    first = index.ingest(files(spark, list(state.items()) + [(None, "no path")]), OPTS)
    assert first == {"new": 40, "changed": 0, "unchanged": 0, "buckets_read": 0}
    same_as_whole(spark, index, list(state.items()))
    # a replay changes nothing
    assert index.ingest(files(spark, list(state.items())), OPTS)["unchanged"] == 40 and index.generations() == [1]
    # one changed, one now blank, one new; the others of the batch are known
    state |= {"/a/3.txt": "quite another text", "/a/4.txt": "", "/b/new.txt": "a new file"}
    batch = {k: state[k] for k in ("/a/3.txt", "/a/4.txt", "/b/new.txt", "/a/5.txt")}
    second = index.ingest(files(spark, list(batch.items())), OPTS)
    assert (second["new"], second["changed"], second["unchanged"]) == (1, 2, 1) and 1 <= second["buckets_read"] <= 4
    same_as_whole(spark, index, list(state.items()))
    assert {r.gen for r in index.live().where("file_path = '/a/3.txt'").collect()} == {2}
    # back to the first state
    assert index.ingest(files(spark, [("/a/3.txt", "text number 3 with several words. " * 4)]), OPTS)["changed"] == 1
    state["/a/3.txt"] = "text number 3 with several words. " * 4
    same_as_whole(spark, index, list(state.items()))
    assert index.remove(files(spark, [("/a/7.txt", ""), ("/none", "")])) == 1
    same_as_whole(spark, index, [x for x in state.items() if x[0] != "/a/7.txt"])
    assert index.ingest(files(spark, [("/a/7.txt", state["/a/7.txt"])]), OPTS)["changed"] == 1
    same_as_whole(spark, index, list(state.items()))


def test_new_paths_read_no_ledger(spark, tmp_path):
    """Nearly all buckets are left unread when a batch's paths are new to them."""
    index = FileIndex(spark, str(tmp_path / "i"), n_buckets=32)
    index.ingest(files(spark, [(f"/a/{i}", f"text {i}") for i in range(600)]), OPTS)
    got = index.ingest(files(spark, [(f"/b/{i}", f"text {i}") for i in range(30)]), OPTS)
    assert got["new"] == 30 and got["buckets_read"] <= 6
    plan = index.ledger([3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


def test_failed_ingest(spark, tmp_path, monkeypatch):
    index = FileIndex(spark, str(tmp_path / "i"), n_buckets=4)
    index.ingest(files(spark, [("/a", "one two"), ("/b", "three")]), OPTS)
    monkeypatch.setattr(FileIndex, "_blooms", lambda self, rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.ingest(files(spark, [("/a", "changed"), ("/c", "new")]), OPTS)
    same_as_whole(spark, index, [("/a", "one two"), ("/b", "three")])
    monkeypatch.undo()
    assert index.ingest(files(spark, [("/a", "changed again")]), OPTS)["changed"] == 1
    same_as_whole(spark, index, [("/a", "changed again"), ("/b", "three")])


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} says something", "s") for i in range(6)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in" / "one"))
    index, state = FileIndex(spark, str(tmp_path / "i"), n_buckets=4), str(tmp_path / "state")
    run_ingest(spark, str(tmp_path / "in" / "*"), docs.schema, index, OPTS, checkpoint=state)
    docs.where("doc_id < 3").withColumn("text", F.lit("changed")).write.parquet(str(tmp_path / "in" / "two"))
    run_ingest(spark, str(tmp_path / "in" / "*"), docs.schema, index, OPTS, checkpoint=state)
    got = {r.file_path: (r.chunk_text, r.gen) for r in index.live().collect()}
    assert got == {f"/s/doc_{i}.txt": ("changed", 2) if i < 3 else (f"document {i} says something", 1) for i in range(6)}
