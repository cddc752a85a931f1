"""Incremental intake: a checkpointed file stream whose batches are merged into a store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import ChunkConfig
from ..operators.embed import Provider
from ..plans.events import since
from ..plans.ingest import ingest, processing
from ..plans.library import READY, Library
from ..plans.store import Store
from ..sources import files as S
from .event_state import PROVIDER, VERDICT, apply_verdicts, verdicts


def files_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.where(S.allowed(path)).select(path.alias("source_path"), "content", F.sha2("content", 256).alias("content_hash"), S.format_of(path).alias("format"))


def take_in(rows: DataFrame, store: Store, owner: str, cfg: ChunkConfig = ChunkConfig(), provider: Provider | None = None, **options) -> None:
    """Files into a store, in two commits: first their leaves with the status processing and a lease, then all they have.

    A run of the same owner that died is taken over; leaves that others are at are left to them until their lease ends.
    Leaves that are ready are not touched; those with the status error are tried again and keep their created_at."""
    old, now = store.load(), datetime.now(timezone.utc)
    leaves = processing(rows.select("content_hash", "source_path", "format"), now)
    known = None
    if old:
        own = [p.name for p in store.snapshot() if p.owner == owner]
        mine = store.spark.read.parquet(*(f"{store.root}/{n}/leaves" for n in own)).select("content_hash") if own else old.leaves.where(F.lit(False)).select("content_hash")
        known = old.leaves.join(mine, "content_hash", "left_anti")
        leaves = leaves.join(known.where(F.col("status").isin(READY, "processing")), "content_hash", "left_anti")
    before = old.leaves.select("content_hash", F.col("created_at").alias("_created")) if old else None
    begun = store.begin(leaves, owner)
    new = ingest(rows, now, cfg=cfg, provider=provider, known=known, **options)
    if before is not None:
        new.leaves = new.leaves.join(before, "content_hash", "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    store.finish(begun, new)


def run_available(spark: SparkSession, folder: str, store: Store, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), provider: Provider | None = None) -> None:
    """Takes in all new files, then stops; a batch that is run again finds its leaves ready and changes nothing.

    A batch is a part of its own, begun before its files are decomposed."""

    def batch(rows: DataFrame, number: int) -> None:
        take_in(rows, store, f"{checkpoint}#{number}", cfg, provider)

    query = files_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_folder(spark: SparkSession, folder: str, store: Store, cfg: ChunkConfig = ChunkConfig(), provider: Provider | None = None, most: int = 10_000, **options) -> int:
    """Takes in the files below a folder whose path, length or time the store does not know; how many it read.

    The listing alone decides what is read. Contents are read by path, most files at a time, each a commit of its own."""
    seen = S.listing(spark, folder)
    fresh = seen.join(store.files(), ["source_path", "modified", "length"], "left_anti")
    paths = sorted(r["source_path"] for r in fresh.select("source_path").collect())  # Spark's own listing holds all paths, too
    for first in range(0, len(paths), most):
        part = paths[first : first + most]
        rows = S.read_files(spark, part)
        take_in(rows, store, f"{folder}#{first}", cfg, provider, **options)
        hashes = rows.select("source_path", "content_hash")
        store.note_files(seen.join(hashes, "source_path"))
    return len(paths)


def run_events(spark: SparkSession, folder: str, store: Store, checkpoint: str, roots: list[str] | None = None, most: int | None = None, grace: float = 0, as_of: datetime | None = None) -> None:
    """Applies all new file events (JSON lines below folder, at most `most` files a batch) to the store's leaves, then stops.

    The checkpoint is the cursor and has the state of each content hash, so events may come in any order and in any split.
    A file whose path is deleted is gone at once, or after grace seconds without a new path; that is seen by a batch that
    runs later, and all new files are then one batch. Leaves that change are appended; a batch that is run again changes nothing. Files that were created or
    updated come in by run_available(); events of a hash before its leaf is there show with its next event."""
    schema = "event_id long, event_type string, content_hash string, path string"
    own = spark.newSession()  # its state store is the stream's own setting
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))

    def batch(found: DataFrame, number: int) -> None:
        old = store.load()
        if old is None:
            return
        now = as_of or datetime.now(timezone.utc)
        at = f"{checkpoint.rstrip('/')}-verdicts/{number}"
        found.write.mode("overwrite").parquet(at)
        told = spark.read.schema(VERDICT).parquet(at)
        at = f"{checkpoint.rstrip('/')}-changed/{number}"
        apply_verdicts(old.leaves, told, now, changed_only=True).write.mode("overwrite").parquet(at)
        leaves = spark.read.schema(old.leaves.schema).parquet(at)
        if not leaves.isEmpty():
            store.append(Library(leaves, *(getattr(old, t).where(F.lit(False)) for t in ("segments", "chunks", "leaf_tags"))))

    rows = own.readStream.schema(schema)
    rows = (rows.option("maxFilesPerTrigger", most) if most else rows).json(folder)
    out = verdicts(since(rows, -1, roots), grace).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (out.trigger(once=True) if grace else out.trigger(availableNow=True)).start()  # with timers, availableNow does not end
    query.awaitTermination()
