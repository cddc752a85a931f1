"""File events (event_id, event_type, content_hash, path): moved and copied files, deleted ones, and what is to be taken in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import allowed
from .library import READY

GONE = "gone"


def since(events: DataFrame, cursor: int, roots: list[str] | None = None) -> DataFrame:
    """Events after the cursor whose path lies below one of the roots. Files that were created or updated need a supported
    extension; a file of the library that moves to a path without one is still followed there. A root is a folder, matched by whole names. The new cursor is the greatest event_id that was read."""
    fresh = F.col("event_type").isin("created", "updated")
    rows = events.where(F.col("event_id") > cursor).where(allowed(F.col("path")) | ~fresh)
    if roots is None:
        return rows
    below = F.lit(False)
    for r in roots:
        below = below | F.col("path").startswith(r.rstrip("/") + "/")
    return rows.where(below)


def apply_events(leaves: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """leaves after the events, in order of event_id; nothing is taken in again, segments stay.

    A leaf's path is that of the last event of its hash that is not a deletion, if there is one. A leaf is `gone` once its
    path is deleted after that event, and `ready` again if a gone leaf's file appears anew. Deletions of other paths of a
    hash, events of unknown hashes and events without hash or path change nothing; events of equal id count in order of
    their path. updated_at changes where something else does."""
    rows = events.where(F.col("content_hash").isNotNull() & F.col("path").isNotNull()).select("content_hash", "path", "event_id", F.col("event_type") == "deleted")
    rows = rows.toDF("content_hash", "path", "event_id", "_deleted")
    last = rows.where(~F.col("_deleted")).groupBy("content_hash").agg(F.max(F.struct("event_id", "path")).alias("_last"))
    out = leaves.join(last, "content_hash", "left").withColumn("_path", F.coalesce("_last.path", "source_path"))
    lost = rows.where("_deleted").groupBy("content_hash", F.col("path").alias("_path")).agg(F.max("event_id").alias("_lost"))
    out = out.join(lost, ["content_hash", "_path"], "left")
    gone = F.col("_lost").isNotNull() & (F.col("_last").isNull() | (F.col("_lost") > F.col("_last.event_id")))
    back = (F.col("status") == GONE) & F.col("_last").isNotNull()
    status = F.when(gone, GONE).when(back, READY).otherwise(F.col("status"))
    changed = ~(F.col("_path").eqNullSafe(F.col("source_path")) & status.eqNullSafe(F.col("status")))
    now = F.when(changed, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    return out.withColumns({"status": status, "source_path": F.col("_path"), "updated_at": now}).select(*leaves.columns)


def wanted(events: DataFrame, leaves: DataFrame) -> DataFrame:
    """path, content_hash to take in: each path whose last event created or updated it, unless its leaf is ready or gone."""
    last = W.partitionBy("path").orderBy(F.desc("event_id"), F.desc("content_hash"))
    rows = events.withColumn("_n", F.row_number().over(last)).where("_n = 1 and event_type in ('created', 'updated')")
    known = leaves.where(F.col("status").isin(READY, GONE)).select("content_hash")
    return rows.join(known, "content_hash", "left_anti").select("path", "content_hash")
