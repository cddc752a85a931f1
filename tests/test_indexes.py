"""Stored indexes of vectors and of terms against exact search."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.plans import hybrid
from lamina.plans.library import Library
from lamina.plans.text_index import TextIndex
from lamina.plans.vector_index import NO_CELL, VectorIndex

KINDS = "id string, leaf_id string, segment_index int, chunk_index int, chunk_label string, content_text string, embedding array<double>"


def library(spark, vectors):
    rows = [(f"c{i}", f"L{i % 7}", 0, i, "v", f"text {i}", v) for i, v in enumerate(vectors)]
    leaves = [(f"L{k}", f"p/L{k}", f"c{k}", "processing" if k == 6 else "ready") for k in range(7)]
    tags = [(f"L{k}", "rare" if k == 3 else "common") for k in range(7)]
    chunks = spark.createDataFrame(rows, KINDS)
    return Library(spark.createDataFrame(leaves, "content_hash string, source_path string, collection string, status string"), chunks, chunks, spark.createDataFrame(tags, "leaf_id string, tag string"))


def exact(lib, q, **options):
    return [(r.chunk_id, round(r.score, 6) if r.score is not None else None) for r in lib.search(F.array(*map(F.lit, q)), **options).collect()]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 32))
    vectors = (centres[rng.integers(0, 24, 3000)] + 0.35 * rng.normal(size=(3000, 32))).tolist()
    vectors[5] = vectors[6] = vectors[7]  # ties
    vectors[40], vectors[41], vectors[42], vectors[43] = None, [0.0] * 32, [1.0, 2.0], [float("inf")] * 32
    lib = library(spark, vectors)
    root = str(tmp_path_factory.mktemp("index"))
    return lib, vectors, VectorIndex.build(lib.chunks, root, cells=24), root


def found(index, lib, q, **options):
    return [(r.chunk_id, round(r.score, 6) if r.score is not None else None) for r in index.search(lib, q, **options).collect()]


def test_all_cells_are_exact(clustered):
    lib, vectors, index, _ = clustered
    for i in (0, 5, 900):
        assert found(index, lib, vectors[i], limit=20, probes=None, pool=4000) == exact(lib, vectors[i], limit=20)
    assert found(index, lib, vectors[3], tags=["rare"], probes=None, pool=4000) == exact(lib, vectors[3], tags=["rare"])
    assert found(index, lib, vectors[3], tags=[]) == [] == found(index, lib, vectors[3], collections=["none"])


def test_recall_with_few_probes(clustered, spark):
    lib, vectors, index, root = clustered
    again = VectorIndex(spark, root)
    hit = total = 0
    for i in range(100, 112):
        want = {c for c, _ in exact(lib, vectors[i], limit=10)}
        hit += len(want & {c for c, _ in found(again, lib, vectors[i], limit=10, probes=3, pool=100)})
        total += len(want)
    assert hit >= 0.9 * total


def test_only_probed_cells_are_read(clustered):
    _, vectors, index, _ = clustered
    rows = index.candidates(vectors[0], index.order(vectors[0])[:2], 10)
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "vector" not in plan.split("ReadSchema")[-1].split("\n")[0]
    assert len(rows.select(F.input_file_name()).distinct().collect()) < len(index.lists.inputFiles())
    assert index.lists.count() == sum(v is not None for v in vectors)
    assert {r.id for r in index.lists.where(F.col("cell") == NO_CELL).collect()} == {"c41", "c42", "c43"}


def test_more_cells_until_filters_are_met(clustered):
    lib, vectors, index, _ = clustered
    assert len(found(index, lib, vectors[0], tags=["rare"], limit=20, probes=1)) == 20


def test_empty_index(spark, tmp_path):
    lib = library(spark, [None, [0.0, 0.0]])
    index = VectorIndex.build(lib.chunks, str(tmp_path / "a"))
    assert found(index, lib, [1.0, 0.0]) == [("c1", None)]
    empty = VectorIndex.build(lib.chunks.where("false"), str(tmp_path / "b"))
    assert found(empty, lib, [1.0]) == []


WORDS = ["the", "and", "cat", "dog", "bird", "fish", "Zürich", "42"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(9)
    share = np.array([0.4, 0.3, 0.1, 0.08, 0.05, 0.04, 0.02, 0.01])
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 60), p=share))) for i in range(2500)] + [(9000, None), (9001, ""), (9002, "cat " * 4000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def terms_index(spark, texts, tmp_path_factory):
    index = TextIndex(spark, str(tmp_path_factory.mktemp("terms")), "doc_id", "bigint")
    return index.append(texts.where("doc_id < 1000"), "text").append(texts.where("doc_id >= 1000"), "text")


def rounded(rows):
    return {r.doc_id: round(r.score, 9) for r in rows.collect()}


@pytest.mark.parametrize("asked", [["the"], ["cat", "zürich", "42"], ["the", "and", "fish", "none"], ["none"], []])
def test_scores_and_best(texts, terms_index, asked):
    exp = rounded(hybrid.bm25(texts, "doc_id", "text", asked))
    assert rounded(terms_index.scores(asked)) == exp
    for limit in (10, 3000):
        got = [(r.doc_id, round(r.score, 9)) for r in terms_index.search(asked, limit).collect()]
        assert got == sorted(exp.items(), key=lambda x: (-x[1], x[0]))[:limit]


def test_blocks_are_skipped_and_folders_pruned(spark, tmp_path):
    rows = [(i, "cat dog cat cat" if 5000 <= i < 5030 else "cat " + "the " * (40 + i % 9) + ("dog" if i % 50 == 0 else "")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path), "doc_id", "bigint").append(docs, "text")
    asked = ["cat", "dog"]
    kept, _ = index.surviving(asked, 5)
    every = index.postings(asked)
    assert kept.count() <= 4 < 40 < every.count() and every.agg(F.max(F.size("keys"))).first()[0] <= 128
    exp = sorted(rounded(hybrid.bm25(docs, "doc_id", "text", asked)).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.doc_id, round(r.score, 9)) for r in index.search(asked, 5).collect()] == exp
    assert "PartitionFilters" in every._jdf.queryExecution().toString()
    opened = {r[0].split("folder=")[1].split("/")[0] for r in every.select(F.input_file_name()).distinct().collect()}
    assert len(opened) <= 2


def test_a_part_that_dies_is_not_seen(spark, texts, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path), "doc_id", "bigint").append(texts.where("doc_id < 100"), "text")
    before = rounded(index.scores(["cat"]))
    monkeypatch.setattr("lamina.plans.text_index.hybrid.words", lambda c: F.raise_error(F.lit("dies")).cast("array<string>"))
    with pytest.raises(Exception, match="dies"):
        index.append(texts.where("doc_id >= 100"), "text")
    assert rounded(index.scores(["cat"])) == before


def test_postings_are_shuffled_once(spark, tmp_path):
    """Texts are dealt by key and postings once; terms of many documents and rows of equal key keep their counts."""
    rng = np.random.default_rng(3)
    rows = [(int(k) if k else None, " ".join(f"w{i}" for i in rng.integers(0, 20_000, 250))) for k in rng.integers(0, 1 << 40, 2400)] + [(5, "w1 w2"), (5, "w1 w3"), (None, "w1"), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    time.sleep(1)
    before = written()
    index = TextIndex(spark, str(tmp_path / "index"), "doc_id", "bigint").append(spark.read.parquet(str(tmp_path / "docs")), "text")
    time.sleep(1)
    assert 0 < written() - before < 40 * 2400 * 248
    exp = rounded(hybrid.bm25(docs, "doc_id", "text", ["w1", "w2", "w77"]))
    assert rounded(index.scores(["w1", "w2", "w77"])) == exp and {5, None} <= set(exp)


def test_document_frequencies_are_those_of_blocks(spark, texts, terms_index):
    """Postings are not read and shuffled again for frequencies by term; blocks have them, and weights sum them over parts."""
    assert {x.name for x in Path(terms_index.root).iterdir()} == {"postings", "sizes"}
    assert terms_index.postings(["the", "cat"]).where("docs <> size(keys) or docs > 128").count() == 0
    words = texts.where("text is not null").select("doc_id", F.explode(hybrid.words(F.col("text"))).alias("w"))
    df = {r.w: r.n for r in words.where("w in ('the', 'cat')").groupBy("w").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert {r.term: r.n for r in terms_index.postings(["the", "cat"]).groupBy("term").agg(F.sum("docs").alias("n")).collect()} == df
    idf, _ = terms_index.weights(["the", "cat", "none"])
    docs = texts.count()
    assert {t: round(x, 9) for t, x in idf.items()} == {t: round(float(np.log(1 + (docs - n + 0.5) / (n + 0.5))), 9) for t, n in df.items()}
