"""Intake: leaves by content hash, segments, chunks and vectors as one lazy plan for each table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators.chunking import ChunkConfig, chunk_segments
from ..operators.embed import Provider, embed_chunks
from ..sources.decomposers import custom_segments, registered
from ..sources.epub import epub_segments
from ..sources.pdf import Backend, pdf_segments
from . import store
from .library import READY, Library
from .storage import stored

TEXT_FORMATS = ("plain_text", "markdown", "html")


def first_of_each(files: DataFrame, order: str) -> DataFrame:
    """One row for each content_hash: the first by order."""
    n = F.row_number().over(W.partitionBy("content_hash").orderBy(order))
    return files.withColumn("_n", n).where("_n = 1").drop("_n")


def ingest(files: DataFrame, as_of: datetime, collection: str = "default", tags: list[str] | None = None, known: DataFrame | None = None, cfg: ChunkConfig = ChunkConfig(), provider: Provider | None = None, pdf: Backend | None = None, skip_segments: bool = False) -> Library:
    """A library of files (source_path, content, content_hash, format); leaves of known that are ready, or that
    another run is at, are skipped.

    Files that are not valid UTF-8 where they should be, broken EPUB files, PDF files without a backend and
    files with a chunk on which the provider fails become leaves with status error and no segments. Images and
    rendered pages are embedded if the provider has embed_image_bytes, else they have no vectors. Files are decomposed
    once, into a table in shared storage, and so are vectors. With skip_segments a segment on which the provider or the
    PDF backend fails is left out and counted in the leaf's skipped_segments; the leaf is an error only if nothing else
    is left of it."""
    rows = first_of_each(files, "source_path").withColumn("leaf_id", F.col("content_hash"))
    if known is not None:
        rows = rows.join(known.where(F.col("status").isin(READY, "processing")).select("content_hash"), "content_hash", "left_anti")
    textual = F.col("format").isin(*TEXT_FORMATS)
    bad = textual & ~F.is_valid_utf8(F.col("content").cast("string"))
    text = rows.where(textual & ~bad).select("leaf_id", "format", "source_path", F.decode("content", "UTF-8").alias("text"))
    images = rows.where(F.col("format") == "image").select("leaf_id", "format", "source_path", F.lit(None).cast("string").alias("text"))
    pictures = rows.where(F.col("format") == "image").select("leaf_id", F.lit(0).alias("segment_index"), F.col("content").alias("image"))
    books = epub_segments(rows.where(F.col("format") == "epub"))
    papers = rows.where(F.col("format") == "pdf")
    scans = pdf_segments(papers, pdf) if pdf else None
    pages = scans.drop("image") if pdf else papers.select("leaf_id", F.lit(None).cast("int").alias("segment_index"), F.lit(None).cast("string").alias("segment_label"), F.lit(None).cast("string").alias("content_text"), F.lit("no PDF backend").alias("error"))
    other = books.unionByName(pages)
    if registered():
        other = other.unionByName(custom_segments(rows.where(F.col("format").isin(*registered()))))
    found = D.segments_of(text.unionByName(images)).withColumn("error", F.lit(None).cast("string")).unionByName(other)
    found = stored(found.unionByName(rows.where(bad).select("leaf_id", F.lit("not valid UTF-8").alias("error")), True), "segments")
    segments = found.where("error is null").drop("error")
    segments = segments.select(store.chunk_id("leaf_id", "segment_index").alias("id"), "*")
    broken = found.where("error is not null").select("leaf_id", "segment_index", F.col("error").alias("_error"))
    chunked = chunk_segments(segments, cfg).unionByName(segments.where("content_text is null").select("leaf_id", "segment_index", F.lit(0).alias("chunk_index"), F.col("segment_label").alias("chunk_label"), "content_text"))
    chunked = chunked.select(store.chunk_id("leaf_id", "segment_index", "chunk_index").alias("id"), store.chunk_id("leaf_id", "segment_index").alias("segment_id"), "*")
    if provider is not None:
        if pdf:
            pictures = pictures.unionByName(scans.where("image is not null").select("leaf_id", "segment_index", "image"))
        if hasattr(provider, "embed_image_bytes"):
            shown = chunked.where("content_text is null").join(pictures, ["leaf_id", "segment_index"], "left")
            chunked = chunked.where("content_text is not null").unionByName(shown, True)
        chunked = stored(embed_chunks(chunked, provider, isolate=["leaf_id", "segment_index"] if skip_segments else ["leaf_id"]), "vectors")
        failed = chunked.where("embed_error is not null").groupBy("leaf_id", "segment_index").agg(F.min("embed_error").alias("_error"))
        broken = broken.unionByName(failed)
        gone = failed.select("leaf_id", "segment_index") if skip_segments else failed.select("leaf_id").distinct()
        segments, chunked = (x.join(gone, gone.columns, "left_anti").select(x.columns) for x in (segments, chunked.drop("embed_error")))
    else:
        chunked = embed_chunks(chunked, None)
    counts = segments.groupBy("leaf_id").agg(F.count("*").cast("int").alias("segment_count"))
    now = F.lit(as_of).cast("timestamp")
    errors = broken.groupBy("leaf_id").agg(F.min("_error").alias("_error"), F.count_if(F.col("segment_index").isNotNull()).cast("int").alias("_skipped"), F.count_if(F.col("segment_index").isNull()).alias("_whole"))
    leaves = rows.select("leaf_id", "content_hash", "source_path", "format").join(counts, "leaf_id", "left").join(errors, "leaf_id", "left")
    if skip_segments:
        lost = (F.col("_whole") > 0) | F.col("segment_count").isNull()
        leaves = leaves.withColumns({"_error": F.when(lost, F.col("_error")), "_skipped": F.when(F.col("_whole") == 0, F.col("_skipped"))})
    else:
        leaves = leaves.withColumn("_skipped", F.lit(0))
    leaves = leaves.select(
        "content_hash", "source_path", "format", F.lit(None).cast("string").alias("title"), F.lit(collection).alias("collection"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("_skipped", F.lit(0)).alias("skipped_segments"),
        F.when(F.col("_error").isNull(), READY).otherwise("error").alias("status"), F.col("_error").alias("error"), now.alias("created_at"), now.alias("updated_at"),
    )
    marks = leaves.select(F.col("content_hash").alias("leaf_id"), F.explode(F.array_distinct(F.array(*map(F.lit, tags)))).alias("tag")) if tags else leaves.select(F.col("content_hash").alias("leaf_id"), F.lit("").alias("tag")).where(F.lit(False))
    return Library(leaves, segments, chunked, marks)


def processing(files: DataFrame, as_of: datetime, collection: str = "default") -> DataFrame:
    """Leaves of files that are about to be taken in, with the columns of ingest(); one for each content."""
    first = files.groupBy("content_hash").agg(F.min(F.struct("source_path", "format")).alias("f"))
    now = F.lit(as_of).cast("timestamp")
    none = F.lit(None).cast("string")
    return first.select("content_hash", "f.source_path", "f.format", none.alias("title"), F.lit(collection).alias("collection"), F.lit(0).alias("segment_count"), F.lit(0).alias("skipped_segments"), F.lit("processing").alias("status"), none.alias("error"), now.alias("created_at"), now.alias("updated_at"))


def report(files: DataFrame, library: Library) -> DataFrame:
    """total, ingested, skipped, errors, segments, skipped_segments and chunks of an intake."""
    done = library.leaves.agg(F.count_if(F.col("status") == READY).alias("ingested"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("segment_count").alias("segments"), F.sum("skipped_segments").alias("skipped_segments"))
    parts = done.unionByName(library.chunks.agg(F.count("*").alias("chunks")), True).unionByName(files.agg(F.count("*").alias("total")), True)
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "ingested", "errors", "segments", "skipped_segments", "chunks")))
    return sums.withColumn("skipped", F.col("total") - F.col("ingested") - F.col("errors"))
