"""Reads over a library of leaves, segments, chunks and leaf_tags: search, read, outline, listings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..errors import Ambiguous, NotFound
from ..operators import vector as V

SEARCH_LIMITS, LIST_LIMITS = (5, 1, 20), (50, 1, 200)
READY = "ready"


def clamp(limit: int | None, bounds: tuple[int, int, int]) -> int:
    default, low, high = bounds
    return max(low, min(high, default if limit is None else limit))


@dataclass
class Library:
    """The four tables; embeddings are read by search alone."""

    leaves: DataFrame
    segments: DataFrame
    chunks: DataFrame
    leaf_tags: DataFrame

    def filtered(self, leaves: DataFrame, collections: list[str] | None, tags: list[str] | None) -> DataFrame:
        """None: no filter; an empty list matches nothing; any listed tag matches."""
        if collections is not None:
            leaves = leaves.where(F.col("collection").isin(collections) if collections else F.lit(False))
        if tags is not None:
            wanted = self.leaf_tags.where(F.col("tag").isin(tags) if tags else F.lit(False)).select(F.col("leaf_id").alias("content_hash"))
            leaves = leaves.join(wanted, "content_hash", "left_semi")
        return leaves

    def search(self, query: Column, collections: list[str] | None = None, tags: list[str] | None = None, limit: int | None = None, half: bool = True) -> DataFrame:
        """Chunks of ready leaves nearest to the query vector, with citations. half: rounds both vectors to half precision."""
        leaves = self.filtered(self.leaves.where(F.col("status") == READY), collections, tags).select(F.col("content_hash").alias("leaf_id"), "source_path")
        q, e = (V.f16_vector(query), V.f16_vector(F.col("embedding"))) if half else (query, F.col("embedding"))
        rows = self.chunks.where(F.col("embedding").isNotNull()).select("id", "leaf_id", "segment_index", "chunk_index", V.cosine_distance(e, q).alias("_d"))
        top = rows.join(leaves, "leaf_id").orderBy(F.col("_d").asc_nulls_last(), "leaf_id", "segment_index", "chunk_index").limit(clamp(limit, SEARCH_LIMITS))
        return self.cited(top.withColumn("score", 1 - F.col("_d")))

    def cited(self, top: DataFrame) -> DataFrame:
        """chunk_id, score, content, citation of a search's rows (the keys of chunks, source_path, score), best first.

        Neither vectors nor texts pass through the search itself: texts are joined to its rows, at most as many as a
        search may return."""
        texts = self.chunks.select(F.col("id").alias("_id"), F.col("leaf_id").alias("_leaf"), "chunk_label", "content_text")
        found = texts.join(F.broadcast(top), (F.col("_id") == F.col("id")) & (F.col("_leaf") == F.col("leaf_id")))
        citation = F.struct("leaf_id", "source_path", "segment_index", "chunk_index", "chunk_label")
        order = [F.col("score").desc_nulls_last(), "citation.leaf_id", "citation.segment_index", "citation.chunk_index"]
        return found.select(F.col("id").alias("chunk_id"), "score", F.col("content_text").alias("content"), citation.alias("citation")).orderBy(*order)

    def read(self, leaf_id: str, segment_index: int, chunk_index: int | None = None, to_chunk_index: int | None = None) -> DataFrame:
        """mode, content and chunks of a segment, a chunk or a range of chunks; no row if there is nothing.

        Without chunk_index the whole segment is read and to_chunk_index is ignored. read_or_raise() raises instead."""
        rows = self.chunks.where((F.col("leaf_id") == leaf_id) & (F.col("segment_index") == segment_index))
        mode = "segment" if chunk_index is None else "chunk" if to_chunk_index is None else "range"
        if mode != "segment":
            rows = rows.where(F.col("chunk_index").between(chunk_index, chunk_index if mode == "chunk" else to_chunk_index))
        one = F.struct("chunk_index", F.col("id").alias("chunk_id"), "chunk_label", F.col("content_text").alias("content"))
        found = rows.agg(F.sort_array(F.collect_list(one)).alias("chunks")).where(F.size("chunks") > 0)
        return found.select(F.lit(mode).alias("mode"), F.array_join(F.col("chunks.content"), "\n\n").alias("content"), "chunks")

    def read_or_raise(self, leaf_id: str, segment_index: int, chunk_index: int | None = None, to_chunk_index: int | None = None) -> DataFrame:
        """read(), or NotFound if it has no row."""
        return self.require("read", self.read(leaf_id, segment_index, chunk_index, to_chunk_index), f"segment {segment_index} of {leaf_id}, or its chunks,")

    def outline(self, leaf_id: str) -> DataFrame:
        """Segments of a leaf in order; NotFound if there is no such leaf."""
        self.require("outline", self.leaves.where(F.col("content_hash") == leaf_id), f"the leaf {leaf_id}")
        return self.segments.where(F.col("leaf_id") == leaf_id).select("segment_index", "segment_label").orderBy("segment_index")

    def _summaries(self, leaves: DataFrame, chunks: DataFrame) -> DataFrame:
        """leaves (at most as many as a listing has) with chunk_count and tags; only their chunks and tags are grouped."""
        listed = F.broadcast(leaves.select(F.col("content_hash").alias("leaf_id")))
        chunks, marks = chunks.join(listed, "leaf_id", "left_semi"), self.leaf_tags.join(listed, "leaf_id", "left_semi")
        counts = chunks.groupBy("leaf_id").agg(F.count("*").alias("chunk_count")).withColumnRenamed("leaf_id", "content_hash")
        tags = marks.groupBy(F.col("leaf_id").alias("content_hash")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
        out = leaves.join(counts, "content_hash", "left").join(tags, "content_hash", "left")
        empty = F.array().cast("array<string>")
        return out.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "tags": F.coalesce("tags", empty)})

    def leaf(self, leaf_id: str) -> DataFrame:
        """Metadata, tags and number of chunks of one leaf; the key is pushed below the aggregates."""
        own = Library(self.leaves, self.segments, self.chunks, self.leaf_tags.where(F.col("leaf_id") == leaf_id))
        return own._summaries(self.leaves.where(F.col("content_hash") == leaf_id), self.chunks.where(F.col("leaf_id") == leaf_id))

    def leaf_or_raise(self, leaf_id: str) -> DataFrame:
        """leaf(), or NotFound if there is no such leaf."""
        return self.require("leaf", self.leaf(leaf_id), f"the leaf {leaf_id}")

    def list_leaves(self, format: str | None = None, status: str | None = None, collections: list[str] | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Leaves by the last update first; the limit is taken before counts and tags are joined."""
        leaves = self.leaves
        for name, value in (("format", format), ("status", status)):
            if value is not None:
                leaves = leaves.where(F.col(name) == value)
        order = [F.col("updated_at").desc(), "content_hash"]
        top = self.filtered(leaves, collections, tags).orderBy(*order).limit(clamp(limit, LIST_LIMITS))
        return self._summaries(top, self.chunks).orderBy(*order)

    def collections(self) -> DataFrame:
        return self.leaves.where(F.col("status") == READY).select("collection").distinct().orderBy("collection")

    def by_prefix(self, prefix: str) -> DataFrame:
        """Up to two hashes with a literal prefix."""
        return self.leaves.where(F.col("content_hash").startswith(prefix)).select("content_hash").orderBy("content_hash").limit(2)

    def resolve_prefix(self, prefix: str) -> str | None:
        found = [r[0] for r in self.by_prefix(prefix).collect()]
        if len(found) > 1:
            raise Ambiguous("list", f"several leaves start with {prefix!r}", "give more characters")
        return found[0] if found else None

    def require(self, tool: str, rows: DataFrame, what: str) -> DataFrame:
        """rows, or NotFound if there are none."""
        if rows.isEmpty():
            raise NotFound(tool, f"{what} does not exist", "list what there is")
        return rows

    def health(self) -> dict[str, str]:
        """ok and connected, or degraded if the leaves cannot be read, with the version; never an error."""
        try:
            self.leaves.limit(1).collect()
            return {"status": "ok", "version": __version__, "store": "connected"}
        except Exception as e:  # noqa: BLE001
            return {"status": "degraded", "version": __version__, "store": "unreachable", "error": str(e)[:200]}


def results_json(rows: DataFrame, name: str = "results", **fields) -> str:
    """The rows of a tool's result as JSON: {name: [row, ...], the given fields, count}. Null values stay as nulls.

    Tools return at most as many rows as their limits allow; only such results are meant for it."""
    found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]
    return json.dumps({name: found, **fields, "count": len(found)}, ensure_ascii=False)
