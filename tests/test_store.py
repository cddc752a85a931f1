"""The store: parts that can hold a leaf, merging, two writers, begun parts and their repair, listings by time."""

import hashlib
import threading
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamina.plans import catalogue
from lamina.plans import store as S
from lamina.plans.library import Library
from lamina.plans.store import Part, Store

LEAVES = "content_hash string, source_path string, format string, title string, collection string, segment_count int, status string, error string, created_at timestamp, updated_at timestamp"
CHUNKS = "id string, segment_id string, leaf_id string, segment_index int, chunk_index int, chunk_label string, content_text string, embedding array<float>, embed_provider string, embed_model string, embed_dimension int"
START = datetime(2025, 1, 1)


def name(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def library(spark, ids, minute=0, status="ready", children=True):
    at = START + timedelta(minutes=minute)
    leaves = spark.createDataFrame([(name(i), f"p/{i}", "plain_text", None, "c", 1, status, None, at, at + timedelta(seconds=k)) for k, i in enumerate(ids)], LEAVES).coalesce(1)
    own = ids if children else []
    segments = spark.createDataFrame([(f"s{i}", name(i), 0, "section", f"text {i}") for i in own], "id string, leaf_id string, segment_index int, segment_label string, content_text string").coalesce(1)
    chunks = spark.createDataFrame([(f"c{i}", f"s{i}", name(i), 0, 0, "section", f"text {i}", None, "none", "none", 0) for i in own], CHUNKS).coalesce(1)
    return Library(leaves, segments, chunks, spark.createDataFrame([(name(i), "t") for i in own], "leaf_id string, tag string").coalesce(1))


def test_appends_are_merged_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGED_PARTS", 3)
    store = Store(spark, str(tmp_path))
    for k in range(11):
        store.append(library(spark, [10 * k, 10 * k + 1], k))
    assert [p.level for p in store.snapshot()] == [2, 0, 0] and [p.leaves for p in store.snapshot()] == [18, 2, 2]
    every = store.load()
    assert every.leaves.count() == 22 == every.chunks.count() == every.segments.count() == every.leaf_tags.count()
    assert store.read(name(31), 0).first().content == "text 31" and store.leaf(name(101)).first().chunk_count == 1
    one = store.load([name(101)])
    assert {f.split("part-")[1][:32] for f in one.leaves.inputFiles()} == {store.snapshot()[-1].name[5:]}
    assert sum(p.may_hold(name(i)) for p in store.snapshot()[1:] for i in range(1000, 1200)) < 40
    assert all(p.may_hold(name(i)) for p, own in zip(store.snapshot(), (range(0, 90, 10), [90, 91], [100, 101])) for i in own)
    # the last row of a leaf counts, through merges too
    store.append(library(spark, [0], 50, "error", False))
    store.append(library(spark, [0], 60, "ready", False))
    row = store.load().leaves.where(F.col("content_hash") == name(0)).collect()
    assert len(row) == 1 and row[0].status == "ready" and store.leaf(name(0)).first().chunk_count == 1


def test_recent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(5):
        store.append(library(spark, [10 * k + j for j in range(3)], k), compact=False)
    store.append(library(spark, [1], 30, children=False), compact=False)  # changed last; its chunk is in the first part
    opened = []
    whole = store._library
    store._library = lambda parts: opened.append(len(parts)) or whole(parts)
    got = store.recent(4).collect()
    exp = whole(store.snapshot()).list_leaves(limit=4).collect()
    assert got == exp and got[0].content_hash == name(1) and got[0].chunk_count == 1 and got[0].tags == ["t"]
    assert opened[-1] == 3  # the newest part, the next one, and the one with the chunks
    assert [r.content_hash for r in store.recent(9, tags=["t"], status="ready").collect()] == [r.content_hash for r in whole(store.snapshot()).list_leaves(limit=9, tags=["t"], status="ready").collect()]
    assert store.recent(200).count() == 15


def test_two_writers(spark, tmp_path):
    """Of two commits for one number one appears; appends at the same time are both there."""
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.commit(library(spark, [1]))
    a._point([Part("part-a")], 2)
    with pytest.raises(OSError):
        b._point([Part("part-b")], 2)
    assert b.parts() == ["part-a"] and not [x for x in tmp_path.iterdir() if x.name.startswith(".pointer")]
    other = Store(spark, str(tmp_path / "both"))
    other.append(library(spark, [0]))
    threads = [threading.Thread(target=Store(spark, str(tmp_path / "both")).append, args=(library(spark, [i]),)) for i in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.source_path for r in other.load().leaves.collect()} == {"p/0", "p/1", "p/2", "p/3"}


def test_begun_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.begin(library(spark, [1, 2]).leaves, "run-a")
    assert store.load().leaves.where("status = 'processing'").count() == 2 and store.load().chunks.count() == 0
    begun = store.begin(library(spark, [1, 2]).leaves, "run-a")  # the run starts again
    assert len(store.parts()) == 1
    store.append(library(spark, [3]))
    store.finish(begun, library(spark, [1, 2], 1))
    assert store.load().leaves.where("status = 'ready'").count() == 3 == store.load().chunks.count()
    # a run that dies: its leaves stay processing until the lease ends, then they are gone, and its folders are removed
    dead = store.begin(library(spark, [4]).leaves, "run-b", lease=60)
    left = store._write(library(spark, [4])).name
    assert store.repair(grace=3600) == [] and store.load().leaves.count() == 4
    gone = store.repair(now=time.time() + 120, grace=0)
    assert dead in gone and left in gone and store.load().leaves.count() == 3
    assert not (tmp_path / left).exists() and store.read(name(1), 0).first().content == "text 1"


@pytest.mark.parametrize("query", ["store_appends", "leaves_recent"])
def test_texts_are_shuffled_once(spark, tmp_path, query):
    """Nine appends and a merge shuffle each text once; leaves of null and negative ids are appended too."""
    text = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {k}")), 512) for k in range(120)))  # not compressible below half
    ids = F.when(F.col("id") == 7, None).when(F.col("id") == 9, -9).otherwise(F.col("id"))
    spark.range(200).select(ids.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    time.sleep(1)
    before = written()
    rows = catalogue.Q[query](spark, str(tmp_path)).collect()
    time.sleep(1)
    if query == "store_appends":
        assert len(rows) == 200 and {(r.chunks, r.parts) for r in rows} == {(1, 2)} and sum(r.status == "error" for r in rows) >= 39
    else:
        assert len(rows) == 50 and {(r.chunk_count, r.status) for r in rows[:39]} == {(1, "error")}
    assert 200 * 120 * 64 < written() - before < 3 * 200 * 120 * 128


def test_bytes_of_appended_texts(spark, tmp_path):
    """Rows and an append write each text three times, in less than 2.6 times the bytes of the table; read again they are the same."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", k), F.lit(3000)).cast("string")))
    spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    size = lambda root: sum(p.stat().st_size for p in root.rglob("*.parquet") if p.is_file())
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = size(shared)
    rows, store = catalogue._stored_rows(spark, str(tmp_path)), Store(spark, str(shared / "one-append"))
    store.append(catalogue._store_library(rows, catalogue.table(spark, str(tmp_path), "labels")))
    assert size(shared) - before < 2.6 * size(tmp_path)
    lib = store.load()
    assert lib.leaves.count() == lib.chunks.count() == 4000
    texts = spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.sha2(F.col("text").cast("binary"), 256).alias("leaf_id"), F.col("text").alias("content_text"))
    for t in (lib.segments, lib.chunks):
        assert texts.exceptAll(t.select("leaf_id", "content_text")).isEmpty()
