"""A persisted inverted index for BM25: postings by term in folders, statistics that add up over parts, block bounds.

A part is written once for a set of documents. It has `postings` (blocks of BLOCK documents of a term, with the block's
number of documents, greatest frequency, least length and least length by frequency) and `sizes` (documents and words).
Terms are dealt to folders by a hash, so that a search opens those of its terms. Parts are appended; the documents of a
term's blocks and sizes are summed when a search asks for them, so weights are those of all documents together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hybrid

#: Folders of terms, documents of a block, blocks of each term that give a search its first threshold.
FOLDERS, BLOCK, FIRST = 64, 128, 16
_POSTINGS = "term string, block long, docs int, most int, least int, ratio double, keys array<{}>, tfs array<int>, sizes array<int>, folder int"


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK rows of a term from rows (folder, term, key, tf, n) in that order; an Arrow batch ends a block."""
    task, done = TaskContext.get().partitionId() << 33, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        term, tf, n = rows.column("term"), rows.column("tf").to_numpy(), rows.column("n").to_numpy()
        place, new = np.arange(len(tf)), np.ones(len(tf), bool)
        new[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        first = np.maximum.accumulate(np.where(new, place, 0))
        at = np.flatnonzero((place - first) % BLOCK == 0)
        ends = pa.array(np.append(at, len(tf)), pa.int32())
        arrays = {name: pa.ListArray.from_arrays(ends, rows.column(own)) for name, own in (("keys", "key"), ("tfs", "tf"), ("sizes", "n"))}
        most, least, ratio = np.maximum.reduceat(tf, at), np.minimum.reduceat(n, at), np.minimum.reduceat(n / tf, at)
        words = np.add.reduceat(tf.astype(np.int64), at)
        block = pa.array(task + done + np.arange(len(at)), pa.int64())
        done += len(at)
        yield pa.RecordBatch.from_pydict({"term": term.take(pa.array(at)), "block": block, "docs": np.diff(np.append(at, len(tf))).astype(np.int32), "most": most, "least": least, "ratio": ratio, **arrays, "folder": rows.column("folder").take(pa.array(at)), "words": words})


class TextIndex:
    """The index below root; key is the name of the documents' key in results, kind its type."""

    def __init__(self, spark: SparkSession, root: str, key: str, kind: str):
        self.spark, self.root, self.key, self.kind = spark, root.rstrip("/"), key, kind

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of all parts; a part counts once its sizes are there, which are written last."""
        read = lambda t, kinds: self.spark.read.schema(kinds).parquet(f"{self.root}/{t}")
        sizes = read("sizes", "docs long, words long, texts long, part string")
        if name == "sizes":
            return sizes
        parts = [r[0] for r in sizes.select("part").distinct().collect()]  # one row for each part
        return read(name, f"{schema}, part string").where(F.col("part").isin(parts))

    def append(self, docs: DataFrame, text: str) -> "TextIndex":
        """Indexes docs (key, text), whose keys the index does not have yet. A part appears whole: its sizes, which name
        it, are written last and renamed. Null texts count as documents, but not
        towards the mean length; rows of equal key count as rows of their own
        in `sizes`, and their words are added up."""
        # texts are dealt by key, so that the words of a document are counted where they are found
        docs = docs.select(F.col(self.key).cast(self.kind).alias("key"), F.col(text).alias("text"))
        words = docs.where("text is not null").repartition("key").select("key", hybrid.words(F.col("text")).alias("w"))
        rows = words.select("key", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("key", "n", "term").agg(F.count("*").cast("int").alias("tf"))
        # the one shuffle of postings: a folder of many of them spreads over several tasks and files, each with blocks of its own
        placed = rows.select(folder(F.col("term")).alias("folder"), "term", "key", "tf", "n").hint("rebalance", F.col("folder")).sortWithinPartitions("folder", "term", "key")
        part = uuid.uuid4().hex
        blocks = placed.mapInArrow(cut, f"{_POSTINGS.format(self.kind)}, words long").sortWithinPartitions("folder", "block")  # numbers ascend by term
        blocks.write.partitionBy("folder").parquet(f"{self.root}/postings/part={part}")
        stored = self.spark.read.schema(f"{_POSTINGS.format(self.kind)}, words long").parquet(f"{self.root}/postings/part={part}")
        sizes = docs.agg(F.count("*").alias("docs"), F.count("text").alias("texts")).crossJoin(stored.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words")))  # one row each
        sizes.select("docs", "words", "texts").coalesce(1).write.parquet(f"{self.root}/_sizes-{part}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(path(f"{self.root}/sizes"))
        if not system.rename(path(f"{self.root}/_sizes-{part}"), path(f"{self.root}/sizes/part={part}")):
            raise OSError("the part could not be named")
        return self

    def postings(self, terms: list[str]) -> DataFrame:
        """Blocks of the terms; only their folders are read."""
        return self._of(self._read("postings", _POSTINGS.format(self.kind)), terms)

    def _of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        folders = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(folder(F.col("term"))).distinct().collect()] if terms else []
        return rows.where(F.col("folder").isin(folders) & F.col("term").isin(terms))

    def weights(self, terms: list[str]) -> tuple[dict[str, float], float]:
        """The inverse document frequency of each term that occurs, and the mean length, over all parts."""
        docs, words, texts = self._read("sizes", "").agg(F.sum("docs"), F.sum("words"), F.sum("texts")).first()
        df = self.postings(terms).groupBy("term").agg(F.sum("docs").alias("df"))  # of the blocks, only term and docs are read
        rows = df.select("term", F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))).collect()  # one row for each term
        return dict(map(tuple, rows)), float(words or 0) / (texts or 1) or 1.0

    def _weight(self, tf: Column, n: Column, mean: float) -> Column:
        return tf * (hybrid.K1 + 1) / (tf + hybrid.K1 * (1 - hybrid.B + hybrid.B * n / F.lit(mean)))

    def _scores(self, blocks: DataFrame, mean: float) -> DataFrame:
        """key, score of the documents in blocks (with idf)."""
        rows = blocks.select("idf", F.explode(F.arrays_zip("keys", "tfs", "sizes")).alias("p"))
        own = F.col("idf") * self._weight(F.col("p.tfs"), F.col("p.sizes"), mean)
        return rows.select(F.col("p.keys").alias(self.key), own.alias("score")).groupBy(self.key).agg(F.sum("score").alias("score"))

    def _bounded(self, terms: list[str]) -> tuple[DataFrame, float]:
        """Blocks with the idf of their term and bound, the most that a document of the block can score by it."""
        idf, mean = self.weights(terms)
        value = F.element_at(F.create_map(*(F.lit(x) for t, w in sorted(idf.items()) for x in (t, w))), F.col("term")) if idf else F.lit(None).cast("double")
        blocks = self.postings(sorted(idf)).withColumn("idf", value)
        # a weight rises with the frequency and falls with the length, and with length by frequency at that frequency
        bound = F.least(self._weight(F.col("most"), F.col("least"), mean), self._weight(F.col("most"), F.col("most") * F.col("ratio"), mean))
        return blocks.withColumn("bound", F.col("idf") * bound), mean

    def scores(self, terms: list[str]) -> DataFrame:
        """key, score of every document with at least one of the terms, as hybrid.bm25()."""
        blocks, mean = self._bounded(sorted(set(terms)))
        return self._scores(blocks, mean)

    def surviving(self, terms: list[str], limit: int) -> tuple[DataFrame, float]:
        """The blocks that can hold one of the best `limit` documents, and the mean length.

        A first threshold is the limit-th score in each term's FIRST best blocks, where documents score no more than they
        do in all. A block goes if its bound and the greatest bounds of all other terms stay below it: then no document
        of it reaches the threshold. All blocks of a document that reaches it stay, so its score is whole."""
        terms = sorted(set(terms))
        blocks, mean = self._bounded(terms)
        best = {r["term"]: r["b"] for r in blocks.groupBy("term").agg(F.max("bound").alias("b")).collect()}  # one row for each term
        first = None
        for t in best:
            own = blocks.where(F.col("term") == t).orderBy(F.desc("bound"), "block").limit(FIRST)
            first = own if first is None else first.unionByName(own)
        if first is None:
            return blocks, mean
        top = self._scores(first, mean).orderBy(F.desc("score")).limit(limit).collect()  # at most limit rows
        if len(top) < limit:
            return blocks, mean
        others = F.element_at(F.create_map(*(F.lit(x) for t in best for x in (t, sum(b for u, b in best.items() if u != t)))), F.col("term"))
        return blocks.where(F.col("bound") + others >= top[-1]["score"] * (1 - 1e-9)), mean

    def search(self, terms: list[str], limit: int = 20) -> DataFrame:
        """The best limit rows of scores(), ties (to 12 places) by key; blocks that cannot reach them are not opened."""
        return self._scores(*self.surviving(terms, limit)).orderBy(F.desc(F.round("score", 12)), self.key).limit(limit)
