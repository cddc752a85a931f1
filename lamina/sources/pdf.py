"""PDF pages through a backend: extract(bytes) -> iterator of (page index, text or None, png or None).

No PDF library is part of the engine; a backend wraps one that is installed. Pages with text become text
segments, others image segments; a page without either is left out, so indices can have gaps. A backend that also has
pages(bytes) -> number and pages_of(bytes, first, last) -> the same rows for a range of pages is asked for ranges, which
are tasks of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[bytes], Iterator[tuple[int, str | None, bytes | None]]]
#: Pages of a range.
RANGE = 16
_COLUMNS = ["leaf_id", "segment_index", "segment_label", "content_text", "image", "error"]
_KINDS = "leaf_id string, segment_index int, segment_label string, content_text string, image binary, error string"


def _rows(leaf: str, pages: Iterator[tuple[int, str | None, bytes | None]], at: int | None) -> Iterator[tuple]:
    """Rows of pages one by one; an error ends them with a row of its own, at the given index. Pages before it count."""
    try:
        for page, text, png in pages:
            text = (text or "").strip() or None
            if text or png:
                yield leaf, page, f"p. {page + 1}", text, None if text else png, None
    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
        yield leaf, at, None, None, None, f"{type(e).__name__}: {e}"


def _frames(rows: Iterator[tuple], most: int = 64) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded number, so that a file's pages do not pile up."""
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == most:
            yield pd.DataFrame(part, columns=_COLUMNS).astype({"segment_index": "Int32"})
            part = []
    yield pd.DataFrame(part, columns=_COLUMNS).astype({"segment_index": "Int32"})


def page_ranges(files: DataFrame, backend: Backend, most: int = RANGE) -> DataFrame:
    """leaf_id, content, first, last of every range of pages of files, dealt to tasks; files whose pages cannot be counted
    have one row with error. A file's bytes travel with each of its ranges, as a range is read from the whole file."""

    @F.pandas_udf("pages int, error string")
    def counted(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                out.append((backend.pages(bytes(content)), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["pages", "error"]).astype({"pages": "Int32"})

    rows = files.select("leaf_id", "content", counted("content").alias("n"))
    first = F.when(F.col("n.error").isNull(), F.sequence(F.lit(0), F.greatest(F.col("n.pages"), F.lit(1)) - 1, F.lit(most))).otherwise(F.array(F.lit(0)))
    rows = rows.select("leaf_id", "content", F.col("n.error").alias("error"), F.col("n.pages").alias("pages"), F.explode(first).alias("first"))
    rows = rows.withColumn("last", F.least(F.col("first") + most, "pages"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "leaf_id", "first")


def pdf_segments(files: DataFrame, backend: Backend) -> DataFrame:
    """leaf_id, segment_index, segment_label (`p. N`), content_text, image, error from files (leaf_id, content).

    An error's row has no index if it spoils the file; in a range of pages, the first one of these."""
    if hasattr(backend, "pages_of"):
        ranges = page_ranges(files, backend)

        def run_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    if r.error is not None and r.error == r.error:
                        yield from _frames(iter([(r.leaf_id, None, None, None, None, r.error)]))
                    else:
                        yield from _frames(_rows(r.leaf_id, backend.pages_of(bytes(r.content), int(r.first), int(r.last)), int(r.first)))

        return ranges.select("leaf_id", "content", "error", "first", F.coalesce("last", F.lit(0)).alias("last")).mapInPandas(run_ranges, _KINDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for leaf, content in zip(pdf["leaf_id"], pdf["content"]):
                rows = list(_rows(leaf, backend(content), None))  # an error spoils the file, so its pages wait for the end
                yield from _frames(iter([r for r in rows if r[-1] is not None] or rows))

    return files.select("leaf_id", "content").mapInPandas(run, _KINDS)
