"""Shared helpers: text batches, shared storage, hashing of words and shingles."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words in every operator that counts words: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def prepare(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where no such folder is set (tests), one below the warehouse is used and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lamina-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to shared storage and reads it: cuts lineage and survives lost executors.

    discard() removes the table; others stay until the folder is cleaned after the application."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of stored() that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lamina_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_order(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows, stored in the order of keys over range partitions, with `at`: a number that is unique and ascends in that
    order. Equal keys may stand in any order, but stay in it once stored. An aggregate of the table gives no task more
    than its share, however often a key occurs, if the keys tell rows apart."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ordered")


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """rows of in_order(), whose first key is group (not null), with `rank`: the place among the rows of its group, from 0.

    Counts of a group in each range partition are summed over the partitions; no task gets a whole group."""
    part = F.shiftright("at", 33)
    parts = rows.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_part")) - F.col("_n")  # a row for each partition the group is in
    parts = parts.select("_group", "_part", (before - F.col("_first")).alias("_shift"))
    return rows.join(parts, (F.col(group) == F.col("_group")) & (part == F.col("_part"))).withColumn("rank", F.col("at") + F.col("_shift")).drop("_group", "_part", "_shift")


def carried(docs: DataFrame, function: Callable, added: str) -> DataFrame:
    """docs with the columns of `added` (DDL) that function(texts) gives for each text as a list of lists.

    All columns of docs travel along, so no join by a key has to bring them back."""
    prepare(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    kinds = to_arrow_schema(T._parse_datatype_string(added))
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            first = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 1 << 20 or i == len(texts) - 1:
                    columns = function([t or "" for t in texts[first : i + 1]])
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, f.type) for c, f in zip(columns, kinds))], names=[*part.schema.names, *kinds.names])
                    first, size = i + 1, 0

    return docs.mapInArrow(run, schema)


def remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; null ids give null."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % modulus


def held_out(col: str, modulus: int, value: int) -> Column:
    """Null ids are never held out."""
    return F.coalesce(remainder(col, modulus) == value, F.lit(False))


def text_slices(batches: Iterator, limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about limit characters from Arrow batches (doc_id, text); null texts are empty."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if t is None:
                texts[i] = t = ""
            size += len(t)
            if size >= limit:
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], texts[start:]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix on an array of uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _lanes(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of b on as an integer; zeros follow the end."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray(len(b) + 1, np.dtype("<u8"), padded, strides=(1,))


#: Masks of the first n bytes of a lane.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes from which a span is hashed by itself.
_LONG = 256


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: lanes of eight bytes enter a keyed mix one after another; long spans by BLAKE2."""
    lanes, n = _lanes(b), end - start
    h = mix(n.astype(np.uint64), 17)
    some = np.arange(len(n))
    for j in range(0, _LONG, 8):
        some = some[n[some] > j] if j else some
        if not len(some):
            break
        x = lanes[start[some] + j] & _FIRST[np.minimum(n[some] - j, 8)]
        h[some] = mix(h[some] ^ mix(x, 19), 23 + j)
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def distinct_spans(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans of data, and for each span its number among them.

    Spans meet by hash, then each is compared with the first of its hash byte by byte, so that the result is exact."""
    b = np.frombuffer(data, np.uint8)
    _, at, inverse = np.unique(span_hashes(b, start, end), return_index=True, return_inverse=True)
    n, first = end - start, start[at][inverse]
    same = n == (end - start)[at][inverse]
    lanes, some = _lanes(b), np.flatnonzero(same)
    for j in range(0, int(n.max(initial=0)), 8):
        some = some[n[some] > j] if j else some
        if j >= _LONG and len(some):  # few spans are that long
            same[some] &= [data[i : i + k] == data[f : f + k] for i, f, k in zip(start[some].tolist(), first[some].tolist(), n[some].tolist())]
            break
        same[some] &= (lanes[start[some] + j] ^ lanes[first[some] + j]) & _FIRST[np.minimum(n[some] - j, 8)] == 0
    if same.all():
        return [data[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())], inverse
    numbers: dict[bytes, int] = {}
    inverse = np.array([numbers.setdefault(data[i:j], len(numbers)) for i, j in zip(start.tolist(), end.tolist())], np.int64)
    return list(numbers), inverse


def word_hashes(texts: list[str], lower: str = "unicode") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the number of words in each text.

    lower: 'unicode' lower-cases all letters, 'ascii' A-Z only. Equal words, equal hashes.
    Texts of over a million characters together are hashed in parts, which bounds the arrays."""
    if len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
        half = len(texts) // 2
        (h, n), (g, m) = word_hashes(texts[:half], lower), word_hashes(texts[half:], lower)
        return np.concatenate([h, g]), np.concatenate([n, m])
    data = "\n".join([t.lower() for t in texts] if lower == "unicode" else texts).encode("utf-8", "surrogatepass")
    b = np.frombuffer(data.lower() if lower == "ascii" else data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    h = span_hashes(b, start, end)
    if lower == "unicode":
        sizes = np.array([len(t.lower().encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts], np.int64)
    else:
        sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    bounds = np.searchsorted(start, np.cumsum(sizes + 1))
    return h, np.diff(bounds, prepend=0)


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of width lower-cased words, and each text's number of them.

    A text of fewer words has one shingle, all its words; a text without words has none."""
    h, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[doc]
    stop = (first + counts)[doc]
    out = np.full(len(at), 0x51ED270B, np.uint64)
    for j in range(width):
        ok = at + j < stop
        out = np.where(ok, mix(out ^ h[np.minimum(at + j, max(len(h) - 1, 0))], j), out) if len(h) else out
    return out, sizes
