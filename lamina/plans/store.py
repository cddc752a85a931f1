"""Mutations as plans, and a store of snapshots: parts are written whole, then a pointer file that names them appears."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotFound
from .library import LIST_LIMITS, READY, Library, clamp

TABLES = ("leaves", "segments", "chunks", "leaf_tags")
#: Tables of a store that has begun parts alone.
EMPTY = {
    "segments": "id string, leaf_id string, segment_index int, segment_label string, content_text string",
    "chunks": "id string, segment_id string, leaf_id string, segment_index int, chunk_index int, chunk_label string, content_text string, embedding array<float>, embed_provider string, embed_model string, embed_dimension int",
    "leaf_tags": "leaf_id string, tag string",
}


def chunk_id(*parts: str):
    """Deterministic id of a row by its key columns."""
    return F.md5(F.concat_ws("|", *parts))


def upsert_leaves(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """On an equal hash: path, collection and count of the new row, status processing, no error; format, title and created_at stay."""
    keep = old.join(new, "content_hash", "left_anti")
    kept = old.select("content_hash", F.col("format").alias("_format"), F.col("title").alias("_title"), F.col("created_at").alias("_created"), F.lit(True).alias("_old"))
    now, known = F.lit(as_of).cast("timestamp"), F.coalesce("_old", F.lit(False))
    merged = new.join(kept, "content_hash", "left").withColumns({
        "format": F.when(known, F.col("_format")).otherwise(F.col("format")), "title": F.when(known, F.col("_title")).otherwise(F.col("title")),
        "status": F.lit("processing"), "error": F.lit(None).cast("string"), "created_at": F.coalesce("_created", now), "updated_at": now,
    })
    return keep.unionByName(merged.select(*old.columns))


def mark(leaves: DataFrame, status: str, ids: DataFrame, as_of: datetime, error: str | None = None) -> DataFrame:
    """Sets the status of leaves in ids (leaf_id); error is set only with status `error`."""
    hit = ids.select(F.col("leaf_id").alias("content_hash"), F.lit(True).alias("_hit")).distinct()
    out = leaves.join(hit, "content_hash", "left")
    on = F.coalesce("_hit", F.lit(False))
    out = out.withColumns({"status": F.when(on, status).otherwise(F.col("status")), "updated_at": F.when(on, F.lit(as_of)).otherwise(F.col("updated_at")), "error": F.when(on & F.lit(status == "error"), F.lit(error)).otherwise(F.col("error"))})
    return out.select(*leaves.columns)


def purge(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """segments or chunks without those of the leaves in ids (leaf_id)."""
    return rows.join(ids.select("leaf_id").distinct(), "leaf_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old does not have are appended."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (leaf_id, tags array): all tags of these leaves are replaced; repeats count once; null or no tags keep the old ones."""
    some = new.where(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)
    return old.join(some.select("leaf_id"), "leaf_id", "left_anti").unionByName(some.select("leaf_id", F.explode(F.array_distinct("tags")).alias("tag")))


def move_collection(leaves: DataFrame, ids: DataFrame, collection: str, as_of: datetime) -> DataFrame:
    """Leaves in ids (leaf_id) belong to collection; vectors and chunks stay. Leaves that are there already keep updated_at."""
    hit = ids.select(F.col("leaf_id").alias("content_hash"), F.lit(True).alias("_hit")).distinct()
    on = F.coalesce("_hit", F.lit(False)) & ~F.col("collection").eqNullSafe(collection)
    out = leaves.join(hit, "content_hash", "left")
    return out.withColumns({"collection": F.when(on, collection).otherwise(F.col("collection")), "updated_at": F.when(on, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))}).select(*leaves.columns)


def merge(a: Library, b: Library) -> Library:
    """The union of two libraries by content hash; a's leaves win with all they have."""
    known = a.leaves.select(F.col("content_hash").alias("leaf_id"))
    fresh = b.leaves.join(a.leaves.select("content_hash"), "content_hash", "left_anti")
    add = lambda x, y: x.unionByName(y.join(known, "leaf_id", "left_anti"))
    return Library(a.leaves.unionByName(fresh), add(a.segments, b.segments), add(a.chunks, b.chunks), add(a.leaf_tags, b.leaf_tags))


@dataclass(frozen=True)
class Part:
    """A part as its pointer names it. A part of state `processing` has leaves alone, until its lease ends.

    bloom: a Bloom filter of the leaves' hashes, None if there are more than MAX_BLOOM_LEAVES or it is not known."""

    name: str
    level: int = 0
    leaves: int | None = None
    oldest: str | None = None
    newest: str | None = None
    bloom: str | None = None
    state: str = READY
    owner: str | None = None
    lease: float | None = None

    def may_hold(self, content_hash: str) -> bool:
        if self.leaves == 0:
            return False
        if self.bloom is None:
            return True
        bits = base64.b64decode(self.bloom)
        return all(bits[i >> 3] >> (i & 7) & 1 for i in _places(content_hash, 8 * len(bits)))


#: Bits of a Bloom filter for each leaf, and hash functions; leaves of a part up to which it has one.
BLOOM_BITS, BLOOM_HASHES, MAX_BLOOM_LEAVES = 10, 4, 500_000
#: Parts of one level that are merged into one of the next.
MERGED_PARTS = 8
#: Codec of parts: texts are written by an append and by each merge, and take two thirds of the bytes that snappy takes.
CODEC = "zstd"
#: Seconds that a begun part is another run's to finish.
LEASE = 3600.0


def _places(content_hash: str, bits: int) -> list[int]:
    digest = hashlib.md5(content_hash.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) % bits for i in range(BLOOM_HASHES)]


def bloom_of(leaves: DataFrame, n: int) -> str | None:
    """The Bloom filter of the hashes of n leaves: set bits are brought together byte by byte on the executors."""
    if n > MAX_BLOOM_LEAVES:
        return None
    bits = 1 << max(10, (BLOOM_BITS * n - 1).bit_length())  # at most a MB
    digest = F.md5(F.col("content_hash"))
    places = F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % bits for i in range(BLOOM_HASHES)))
    place = leaves.select(F.explode(places).alias("p"))
    own = place.groupBy(F.shiftright("p", 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("value")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[own.column("byte").to_numpy()] = own.column("value").to_numpy()
    return base64.b64encode(out.tobytes()).decode()


class Store:
    """Snapshots of a library below root. A snapshot is a list of parts, named by the pointer file of the highest number.

    A pointer appears under a number that does not exist yet, whole or not at all, and for one of several commits only:
    a commit that dies leaves the snapshot before it, and one that comes second reads the new snapshot and tries again.
    A pointer says of each part how many leaves it has, of which time, and a Bloom filter of their hashes, so that a leaf
    is read from the parts that can hold it. Parts of one level are merged when there are MERGED_PARTS of them, so
    a store of n appends has about log n parts, and a leaf is written again as often. Parts that no pointer names are
    ignored; repair() removes them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return max((int(n[8:]) for n in names if n.startswith("CURRENT-")), default=0)

    def snapshot(self, number: int | None = None) -> list[Part]:
        """The parts of the present snapshot (or of a number), oldest first."""
        n = self._last() if number is None else number
        lines = [r[0] for r in self.spark.read.text(f"{self.root}/CURRENT-{n:012d}").collect()] if n else []
        return [Part(**json.loads(x)) if x.startswith("{") else Part(x) for x in lines]

    def parts(self) -> list[str]:
        return [p.name for p in self.snapshot()]

    def load(self, holding: list[str] | None = None) -> Library | None:
        """The present snapshot; of a leaf that several parts have, the last one's row. holding: only parts that can hold
        one of these hashes are opened."""
        parts = self.snapshot()
        if not parts:
            return None
        if holding is not None:
            parts = [p for p in parts if any(map(p.may_hold, holding))] or parts[-1:]
        return self._library(parts)

    def _library(self, parts: list[Part]) -> Library:
        read = lambda t: self.spark.read.parquet(*(f"{self.root}/{p.name}/{t}" for p in parts if t == "leaves" or p.state == READY))
        leaves = read("leaves")
        if len(parts) > 1:
            place = F.create_map(*(x for i, p in enumerate(parts) for x in (F.lit(p.name), F.lit(i))))
            part = F.regexp_extract(F.col("_metadata.file_path"), "(part-[0-9a-f]+)/leaves/", 1)
            last = W.partitionBy("content_hash").orderBy(F.desc("_place"))
            leaves = leaves.withColumn("_place", place[part]).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_place")
        if all(p.state != READY for p in parts):
            none = {t: self.spark.createDataFrame([], EMPTY[t]) for t in TABLES[1:]}
            return Library(leaves, *none.values())
        return Library(leaves, *(read(t) for t in TABLES[1:]))

    def leaf(self, content_hash: str) -> DataFrame:
        """Library.leaf() from the parts that can hold it."""
        return self._holding(content_hash).leaf(content_hash)

    def read(self, leaf_id: str, segment_index: int, chunk_index: int | None = None, to_chunk_index: int | None = None) -> DataFrame:
        """Library.read() from the parts that can hold the leaf."""
        return self._holding(leaf_id).read(leaf_id, segment_index, chunk_index, to_chunk_index)

    def _holding(self, content_hash: str) -> Library:
        found = self.load([content_hash])
        if found is None:
            raise NotFound("store", "the store is empty", "commit a library")
        return found

    def recent(self, limit: int | None = None, **filters) -> DataFrame:
        """Library.list_leaves(), of the parts that it takes: the newest ones, until the limit-th leaf is newer than all
        that are left, and all parts that can hold one of the leaves listed, so that their last rows, chunks and tags count."""
        n, parts = clamp(limit, LIST_LIMITS), self.snapshot()
        if not parts:
            raise NotFound("store", "the store is empty", "commit a library")
        newest = {i: p.newest or "9" for i, p in enumerate(parts) if p.leaves != 0}  # a part of unknown time is the newest
        order = sorted(newest, key=lambda i: (newest[i], i), reverse=True) or [0]
        opened = set(order[:1]) if filters.get("tags") is None else set(order)  # tags may lie in any part
        while True:
            found = self._library([parts[i] for i in sorted(opened)]).list_leaves(limit=n, **filters)
            top = found.select("content_hash", F.col("updated_at").cast("string").alias("t")).collect()  # at most limit rows
            left = [i for i in order if i not in opened]
            held = {i for i in left if any(parts[i].may_hold(r["content_hash"]) for r in top)}
            late = [i for i in left if len(top) < n or newest[i] >= top[-1]["t"]]
            if not held and not late:
                return found
            opened |= held | set(late[:1])

    def _write(self, library: Library, level: int = 0, **kind) -> Part:
        """A part with all tables, segments and chunks ordered for citation reads within each file.

        Texts stay in the tasks that have them: a filter on leaf_id goes by the pages' bounds in every file, so a shuffle by
        leaf_id would not spare a file."""
        name = f"part-{uuid.uuid4().hex}"
        for t in TABLES if kind.get("state", READY) == READY else TABLES[:1]:
            rows = getattr(library, t)
            if t in ("segments", "chunks"):
                rows = rows.sortWithinPartitions(*[c for c in ("leaf_id", "segment_index", "chunk_index") if c in rows.columns])
            rows.write.option("compression", CODEC).parquet(f"{self.root}/{name}/{t}")
        leaves = self.spark.read.schema(library.leaves.schema).parquet(f"{self.root}/{name}/leaves")
        stamp = F.col("updated_at").cast("string") if "updated_at" in leaves.columns else F.lit(None).cast("string")
        n, oldest, newest = leaves.agg(F.count("*"), F.min(stamp), F.max(stamp)).first()
        return Part(name, level, n, oldest, newest, bloom_of(leaves, n), **kind)

    def _point(self, parts: list[Part], number: int) -> None:
        """Makes the pointer of this number appear, whole; OSError if it exists."""
        new, at = f"{self.root}/.pointer-{uuid.uuid4().hex}", f"{self.root}/CURRENT-{number:012d}"
        stream = self._fs.create(self._path(new), True)
        stream.write("\n".join(json.dumps(vars(p)) for p in parts).encode())
        stream.close()
        if self._fs.getScheme() == "file":  # a local rename overwrites; a second name for the file does not
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(new), local(at))
            except FileExistsError as e:
                raise OSError("another commit came first") from e
            finally:
                self._fs.delete(self._path(new), False)
            return
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(new).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(new), self._path(at), none)  # fails if the name is taken
        except Py4JJavaError as e:
            self._fs.delete(self._path(new), False)
            raise OSError("another commit came first") from e

    def _change(self, change: Callable[[list[Part]], list[Part]], tries: int = 20) -> None:
        """A snapshot with changed parts; where another commit came first, the change is made to that one's."""
        for left in reversed(range(tries)):
            number = self._last()
            try:
                return self._point(change(self.snapshot(number)), number + 1)
            except OSError:
                if not left:
                    raise

    def commit(self, library: Library) -> str:
        """A snapshot of this library alone."""
        number = self._last() + 1
        part = self._write(library)
        self._point([part], number)
        return part.name

    def append(self, library: Library, compact: bool = True) -> str:
        """The present snapshot with this library's rows; its leaves replace leaves of equal hash, which may have no
        segments, chunks or tags yet. Then parts of a level are merged if there are enough."""
        part = self._write(library)
        self._change(lambda parts: [*parts, part])
        if compact:
            self.compact()
        return part.name

    def compact(self) -> int:
        """Merges MERGED_PARTS or more parts of one level into one of the next, level by level; how often it did.

        Parts of one level follow each other, older levels first, so the last row of a leaf stays the last. Another
        commit's parts stay where they are."""
        done = 0
        while True:
            ready = [p for p in self.snapshot() if p.state == READY]
            full = [own for level in sorted({p.level for p in ready}) if len(own := [p for p in ready if p.level == level]) >= MERGED_PARTS]
            if not full:
                return done
            old = full[0]
            new = self._write(self._library(old), old[0].level + 1)

            def swap(parts: list[Part]) -> list[Part]:
                names = {p.name for p in old}
                if not names <= {p.name for p in parts}:
                    return parts  # another compaction came first
                at = next(i for i, p in enumerate(parts) if p.name in names)
                return [*parts[:at], new, *(p for p in parts[at:] if p.name not in names)]

            self._change(swap)
            done += 1

    def begin(self, leaves: DataFrame, owner: str, now: float | None = None, lease: float = LEASE) -> str:
        """Adds leaves with the status processing; what the owner began before is replaced. finish() takes their place."""
        now = time.time() if now is None else now
        rows = leaves.withColumn("status", F.lit("processing"))
        part = self._write(Library(rows, rows, rows, rows), state="processing", owner=owner, lease=now + lease)
        self._change(lambda parts: [*(p for p in parts if p.owner != owner), part])
        return part.name

    def finish(self, begun: str, library: Library, compact: bool = True) -> str:
        """Replaces a begun part by its library, all at once."""
        part = self._write(library)
        self._change(lambda parts: [*(p for p in parts if p.name != begun), part])
        if compact:
            self.compact()
        return part.name

    def files(self) -> DataFrame:
        """source_path, modified, length of the files that were taken in, as note_files() was told."""
        kind, at = "source_path string, modified timestamp, length long, content_hash string", f"{self.root}/files"
        return self.spark.read.schema(kind).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], kind)

    def note_files(self, rows: DataFrame) -> None:
        """Remembers files (source_path, modified, length, content_hash) after their leaves were committed. A run that dies
        before it does so reads them again, and finds their leaves."""
        rows.select("source_path", "modified", "length", "content_hash").write.mode("append").parquet(f"{self.root}/files")

    def repair(self, now: float | None = None, grace: float = LEASE) -> list[str]:
        """Drops parts whose lease has ended, so that their leaves are taken in again, and removes the folders of parts that
        are in no snapshot from the last one on and were written more than grace seconds ago; their names."""
        now = time.time() if now is None else now
        if any(p.lease is not None and p.lease < now for p in self.snapshot()):
            self._change(lambda parts: [p for p in parts if p.lease is None or p.lease >= now])
        named, gone = set(self.parts()), []
        for x in self._fs.listStatus(self._path(self.root)) if self._last() else []:
            name = x.getPath().getName()
            if name.startswith("part-") and name not in named and x.getModificationTime() / 1000 < now - grace:
                self._fs.delete(x.getPath(), True)
                gone.append(name)
        return gone
