"""A stored vector index for search: inverted lists by cell, product-quantised codes, exact rerank.

Vectors are unit vectors in half precision. A coarse quantiser (spherical k-means) gives each its cell, and a product
quantiser codes what the cell's centre leaves. Both are fitted to a bounded sample; all vectors are indexed. Lists are
folders by cell, so that a search opens the cells it probes and no others. It reads codes first, keeps the best of
them, and reads the vectors of those alone for exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector as V
from .library import READY, SEARCH_LIMITS, Library, clamp

#: Vectors that the quantisers are fitted to, about; at most twice as many reach the driver.
SAMPLE = 20_000
#: Cells at most, subspaces of a code, values of a subspace.
MAX_CELLS, SUBSPACES, VALUES = 4096, 16, 256
#: Cells that a search probes first, and candidates that it compares exactly.
PROBES, POOL = 8, 1000
#: The cell of vectors without a direction, or of another length than the index has.
NO_CELL = -1
KEYS = ["leaf_id", "segment_index", "chunk_index", "id"]
_LISTS = "leaf_id string, segment_index int, chunk_index int, id string, vector array<float>, code binary, cell int"


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds; of unit length if unit. Empty ones start again at a row of x."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = sums / np.maximum(n, 1)[:, None]
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a bounded block of rows at a time."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantisers:
    """Centres of cells, and for each subspace the values of codes."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.bounds = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, subspaces: int, seed: int = 7) -> "Quantisers":
        """Fitted to unit rows; fewer rows than cells or values give fewer of these."""
        rng = np.random.default_rng(seed)
        centres = _means(x, max(1, min(cells, len(x))), rng, True) if len(x) else np.zeros((1, x.shape[1]), np.float32)
        rest = x - centres[_nearest(x, centres)]
        parts = np.array_split(np.arange(x.shape[1]), min(subspaces, max(1, x.shape[1])))
        books = [_means(rest[:, p], min(VALUES, len(x)), rng, False) if len(x) else np.zeros((1, len(p)), np.float32) for p in parts]
        return cls(centres, books)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (a byte for each subspace) of unit rows."""
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], axis=1).astype(np.uint8)

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Inner products of a unit query with the centres and with the values of each subspace."""
        return self.centres @ query, [book @ query[a:b] for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]


def _unit_rows(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, which rows have a direction, the given length and finite components)."""
    rows = [np.asarray(v, np.float64) if v is not None and len(v) == length and None not in v else np.zeros(length) for v in lists.to_pylist()]
    x = np.array(rows, np.float64).reshape(-1, length)
    norm = np.linalg.norm(x, axis=1)
    good = (norm > 0) & np.isfinite(norm)
    return (np.where(good[:, None], x, 0) / np.where(good, norm, 1)[:, None]).astype(np.float32), good


class VectorIndex:
    """The index below root: `centres`, `books` (small tables) and `lists`, partitioned by cell."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        centres = spark.read.parquet(f"{self.root}/centres").orderBy("cell").collect()  # at most MAX_CELLS
        books = spark.read.parquet(f"{self.root}/books").orderBy("subspace", "value").collect()
        by = {}
        for r in books:
            by.setdefault(r["subspace"], []).append(r["vector"])
        self.quantisers = Quantisers(np.array([r["vector"] for r in centres], np.float32), [np.array(by[s], np.float32) for s in sorted(by)])
        self.lists = spark.read.schema(_LISTS).parquet(f"{self.root}/lists")

    @classmethod
    def build(cls, chunks: DataFrame, root: str, cells: int | None = None, subspaces: int = SUBSPACES, sample: int = SAMPLE) -> "VectorIndex":
        """Indexes all chunks (id, leaf_id, segment_index, chunk_index, embedding) with a vector.

        cells: about the square root of the number of vectors by default. Vectors of another length than the commonest,
        without a direction or with null or non-finite components go to NO_CELL, which is probed last."""
        spark = chunks.sparkSession
        rows = chunks.where(F.col("embedding").isNotNull()).select("leaf_id", F.col("segment_index").cast("int"), F.col("chunk_index").cast("int"), "id", V.f16_vector(F.col("embedding")).cast("array<float>").alias("vector"))
        sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        length, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
        share = min(1.0, sample / max(total, 1))
        some = rows.where((F.size("vector") == length) & (F.shiftrightunsigned(F.xxhash64("id"), 32) < int(share * (1 << 32)))).select("vector").limit(2 * sample).toArrow()
        x, good = _unit_rows(some.column("vector").combine_chunks(), length)
        wanted = cells or int(round(total**0.5))
        quantisers = Quantisers.fit(x[good], max(1, min(wanted, MAX_CELLS, max(1, len(x) // 8))), subspaces)
        shared = spark.sparkContext.broadcast(quantisers)  # at most MAX_CELLS vectors, and VALUES for the codes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                unit, good = _unit_rows(b.column("vector"), length)
                cell, code = shared.value.code(unit)
                own = [pa.array(np.where(good, cell, NO_CELL), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "cell", "code"])

        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        coded = rows.mapInArrow(run, f"{kinds}, cell int, code binary")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["cell", *KEYS]  # a cell with many vectors spreads over several tasks and files
        coded.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("cell").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{root}/lists")
        as_rows = lambda m: [(i, [float(v) for v in r]) for i, r in enumerate(m)]
        spark.createDataFrame(as_rows(quantisers.centres), "cell int, vector array<float>").coalesce(1).write.parquet(f"{root}/centres")
        books = [(s, i, v) for s, book in enumerate(quantisers.books) for i, v in as_rows(book)]
        spark.createDataFrame(books, "subspace int, value int, vector array<float>").coalesce(1).write.parquet(f"{root}/books")
        return cls(spark, root)

    def order(self, query: list[float]) -> list[int]:
        """All cells, nearest first."""
        unit, good = _unit_rows(pa.array([query]), self.quantisers.centres.shape[1])
        score = self.quantisers.centres @ unit[0]
        return [*np.argsort(-score, kind="stable").tolist(), NO_CELL]

    def candidates(self, query: list[float], cells: list[int], pool: int) -> DataFrame:
        """cell, the keys and the estimated score of the best pool rows of these cells; codes are read, not vectors."""
        unit, _ = _unit_rows(pa.array([query]), self.quantisers.centres.shape[1])
        centres, tables = self.quantisers.tables(unit[0])

        @F.pandas_udf("double")
        def estimate(cell: pd.Series, code: pd.Series) -> pd.Series:
            codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
            score = centres[np.maximum(cell.to_numpy(), 0)].astype(np.float64)
            for j, table in enumerate(tables):
                score += table[codes[:, j]]
            return pd.Series(np.where(cell.to_numpy() < 0, -np.inf, score), index=cell.index)

        rows = self.lists.where(F.col("cell").isin(cells)).select("cell", *KEYS, "code")
        return rows.withColumn("estimate", estimate("cell", "code")).drop("code")

    def search(self, library: Library, query: list[float], collections: list[str] | None = None, tags: list[str] | None = None, limit: int | None = None, probes: int | None = PROBES, pool: int = POOL) -> DataFrame:
        """As Library.search(), of the chunks in the probed cells (None: all) whose estimates are among the best pool.

        Filters apply before the pool is cut. While fewer rows than limit pass them, twice as many cells are probed,
        up to all. With all cells and a pool of all rows the result is exact."""
        limit = clamp(limit, SEARCH_LIMITS)
        leaves = library.filtered(library.leaves.where(F.col("status") == READY), collections, tags).select(F.col("content_hash").alias("leaf_id"), "source_path")
        cells, found = self.order(query), []
        probes = len(cells) if probes is None else probes
        while True:
            kept = self.candidates(query, cells[:probes], pool).join(leaves, "leaf_id")
            found = kept.orderBy(F.desc("estimate"), *KEYS[:3]).limit(max(pool, limit)).collect()  # at most pool rows
            if len(found) >= limit or probes >= len(cells):
                break
            probes *= 2
        q = V.f16_vector(F.array(*map(F.lit, map(float, query))))
        ids = [r["id"] for r in found]
        near = self.lists.where(F.col("cell").isin(sorted({r["cell"] for r in found})) & F.col("id").isin(ids)).select(*KEYS, "vector")
        top = V.nearest(near.join(leaves, "leaf_id"), "vector", q, limit, KEYS[:3]).drop("vector")
        return library.cited(top)
