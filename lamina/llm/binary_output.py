"""Token-id files of patched frame-of-reference blocks (operator 9).

File format (little-endian), one image for each file:
  magic b"PFR2", u32 block size, u64 n ids, u32 n blocks, u32 length of the data, u32 n documents,
  the index: u32 offset of each block in the data,
  data: for each block u32 minimum, u8 width, u16 number of exceptions, the packed low bits of
  (id - minimum) at that width, then u16 places and u32 high bits of the exceptions,
  the documents in their order: u64 number of ids of each, i64 doc_id of each, u8 1 for each null doc_id.
A block's width is the least that holds a given share (a percentile) of its offsets. Documents are found by
the file alone. File images travel as rows of a Parquet table in shared storage, so that Spark's own committer
makes them whole or absent.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .vocabulary import read_content, vocabulary

BLOCK, PERCENTILE = 1024, 0.98
#: Ids in a file: whole slices of documents until this many are reached.
FILE_IDS = 1 << 19
_HEAD, _MAGIC = struct.Struct("<4sIQIII"), b"PFR2"
_ENCODERS: dict[int, "_Encoder"] = {}
#: Unknown pieces that one call of the library encodes; pieces and ids that are kept.
_AT_ONCE, _KEPT, _KEPT_IDS = 200, 1_000_000, 8_000_000


def _blocks(x: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of ids (blocks, size), all of one size; blocks of one width are packed together."""
    n, m = x.shape
    low = x.min(axis=1)
    d = x - low[:, None]
    k = max(0, int(np.ceil(percentile * m)) - 1)
    width = np.frexp(np.partition(d, k, axis=1)[:, k].astype(np.float64))[1].astype(np.int64)
    high = (d.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype("<u4")
    row, place = np.nonzero(high)
    bounds = np.searchsorted(row, np.arange(n + 1))
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(d[own].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (w + 7) // 8], axis=1, bitorder="little")[:, :w]
        for i, part in zip(own.tolist(), np.packbits(bits.reshape(len(own), m * w), axis=1, bitorder="little")):
            packed[i] = part.tobytes()
    out = []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        rest = place[a:b].astype("<u2").tobytes() + high[i, place[a:b]].tobytes() if b > a else b""
        out.append(struct.pack("<IBH", low[i], width[i], b - a) + packed[i] + rest)
    return out


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE, doc_ids: list[int | None] = (), lengths: list[int] = ()) -> bytes:
    """A file image of ids (unsigned 32-bit) and of the documents they belong to."""
    ids = np.ascontiguousarray(ids, np.uint32)
    whole, out = len(ids) // block * block, []
    for first in range(0, whole, block << 6):
        out += _blocks(ids[first : min(whole, first + (block << 6))].reshape(-1, block), percentile)
    if whole < len(ids):
        out += _blocks(ids[None, whole:], percentile)
    starts = np.cumsum([0, *map(len, out)])
    keys, nulls = np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8)
    head = _HEAD.pack(_MAGIC, block, len(ids), len(out), int(starts[-1]), len(keys))
    return head + starts[:-1].astype("<u4").tobytes() + b"".join(out) + np.array(lengths, "<u8").tobytes() + keys.tobytes() + nulls.tobytes()


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default), found by the index; blocks of one width are read together."""
    magic, block, n, blocks, _, _ = _HEAD.unpack_from(image)
    if magic != _MAGIC:
        raise ValueError("not a file of this format")
    last = blocks if last is None else min(last, blocks)
    data, starts = np.frombuffer(image, np.uint8), np.frombuffer(image, "<u4", blocks, _HEAD.size).astype(np.int64) + _HEAD.size + 4 * blocks
    heads = [struct.unpack_from("<IBH", image, at) for at in starts[first:last].tolist()]
    out = np.zeros((max(0, last - first), block), np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, width, _) in enumerate(heads):
        groups.setdefault((width, min(block, n - (first + i) * block)), []).append(i)
    for (width, m), every in groups.items():
        size = (m * width + 7) // 8
        for part in (np.array(every[i : i + 64]) for i in range(0, len(every), 64)):
            bits = np.unpackbits(data[(starts[first + part] + 7)[:, None] + np.arange(size)], axis=1, count=m * width, bitorder="little")
            wide = 16 if width <= 16 else 32
            d = np.zeros((len(part) * m, wide), np.uint8)
            d[:, :width] = bits.reshape(len(part) * m, width)
            out[part, :m] = np.packbits(d.reshape(-1), bitorder="little").view(f"<u{wide // 8}").reshape(len(part), m)
        for i in every:
            low, _, over = heads[i]
            if over:
                at = int(starts[first + i]) + 7 + size
                places, high = np.frombuffer(image, "<u2", over, at), np.frombuffer(image, "<u4", over, at + 2 * over)
                out[i, places] |= high << np.uint32(width)
            out[i] += np.uint32(low)
    return out.reshape(-1)[: max(0, min(n, last * block) - first * block)]


def documents(image: bytes) -> tuple[list[int | None], np.ndarray]:
    """The doc_ids and numbers of ids of a file's documents."""
    _, _, _, blocks, size, n = _HEAD.unpack_from(image)
    at = _HEAD.size + 4 * blocks + size
    lengths, keys = np.frombuffer(image, "<u8", n, at), np.frombuffer(image, "<i8", n, at + 8 * n)
    nulls = np.frombuffer(image, np.uint8, n, at + 16 * n)
    return [None if x else k for x, k in zip(nulls.tolist(), keys.tolist())], lengths.astype(np.int64)


def _classes(b: np.ndarray) -> np.ndarray:
    """A kind for each byte of UTF-8: 1 Latin letters, 2 ASCII digits, 3 ASCII signs, 4 the apostrophe, 5 other
    signs that are no white space by their first byte, 0 all else."""
    kind = _KINDS[b]
    lead = np.flatnonzero((b[:-1] >= 0xC3) & (b[:-1] <= 0xC5))  # U+00C0 to U+017F are letters, but for two
    two = lead[(b[lead] != 0xC3) | ((b[lead + 1] & 0xDF) != 0x97)]
    kind[two] = kind[two + 1] = 1
    return kind


_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = 3
for _first, _last, _kind in ((48, 58, 2), (65, 91, 1), (97, 123, 1), (39, 40, 4), (0xC6, 0xE1, 5), (0xE4, 0xF5, 5)):
    _KINDS[_first:_last] = _kind


class _Encoder:
    """Texts -> ids, by the tokenizers library; equal pieces of texts are encoded once.

    Where the file's own splitter is the byte-level one without a normaliser, texts are cut at places that this
    splitter never crosses: before a space that a non-space follows, around a single line feed between signs, and
    between letters, digits and other signs (but not after an apostrophe). Cuts and 64-bit hashes of pieces are found
    by numpy over a slice of texts; pieces of equal hash in one slice are compared by their bytes. Pieces not known yet are
    encoded many at a time, in a row or joined by line feeds, and told apart by their bytes. Files of another kind,
    and texts that hold one of the file's added tokens, are encoded as a whole."""

    def __init__(self, content: str):
        vocab, spec = vocabulary(content), json.loads(content)
        self.library = vocab.library
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        self.sizes = np.array([len(vocab.names.get(i, "")) for i in range(max(vocab.names, default=0) + 1)], np.int64)  # a letter of a name is a byte
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.spans = np.zeros((1 << 16, 2), np.int64)  # first id in the pool, and number of ids

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Adds pieces whose ids are ids[first : last]."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = len(self.places)
        while at + len(pieces) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.spans[at : at + len(pieces)] = np.stack([first + self.used, last - first], axis=1)
        self.places.update(zip(pieces, range(at, at + len(pieces))))
        self.used += len(ids)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes new distinct pieces: those with a space before a sign in a row, other ones joined by line feeds."""
        spaced, plain, other = [], [], []
        for p in pieces:
            text = p.decode("utf-8", "surrogatepass")
            rest = text[1:] if text[0] == " " else text
            (other if rest.split() != [rest] else plain if rest is text else spaced).append(p)
        if other:
            ids = [self._whole(p.decode("utf-8", "surrogatepass")) for p in other]
            last = np.cumsum([len(x) for x in ids])
            self._keep(other, np.concatenate(ids), np.append(0, last[:-1]), last)
        for own, between in ((spaced, b""), (plain, b"\n")):
            parts = [own[i : i + _AT_ONCE] for i in range(0, len(own), _AT_ONCE)]
            for part, found in zip(parts, self.library.encode_batch_fast([between.join(p).decode() for p in parts], add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                stop = np.cumsum(np.fromiter(map(len, part), np.int64) + len(between)) - len(between)
                last = np.searchsorted(np.cumsum(self.sizes[ids]), stop) + 1
                self._keep(part, ids, np.append(0, last[:-1] + len(between)), last)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pool places of all pieces of the texts in order, and each text's number of pieces."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"".join(coded)
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = _classes(b)
        sign = kind > 0
        cut = np.zeros(len(b) + 1, bool)
        x, y = kind[:-1], kind[1:]
        known = (x > 0) & (y > 0) & (x < 5) & (y < 5)
        cut[1:-1] = known & (x != y) & ~((x == 3) & (y == 4)) & (x != 4)
        cut[1:-1] |= (x == 4) & (y == 2)
        cut[:-2] |= (b[:-1] == 32) & sign[1:]
        feeds = np.flatnonzero((b[1:-1] == 10) & sign[:-2] & (kind[:-2] < 5) & sign[2:]) + 1
        cut[feeds] = cut[feeds + 1] = True
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64))))
        cut[starts] = True
        edges = np.flatnonzero(cut)
        first, last = edges[:-1], edges[1:]
        found, inverse = common.distinct_spans(data, first, last)
        self._learn([p for p in dict.fromkeys(found) if p not in self.places])
        place = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        return place[inverse], np.diff(np.searchsorted(first, starts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        whole = [not self.cuts or any(a in t for a in self.added) for t in texts]
        if self.used > _KEPT_IDS or len(self.places) > _KEPT:
            self._forget()
        places, n = self._pieces(["" if w else t for w, t in zip(whole, texts)])
        begin, size = self.spans[places].T
        total = np.cumsum(size)
        ids = self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)]
        ends = np.append(0, total)[np.cumsum(n)]
        if not any(whole):
            return ids, np.diff(ends, prepend=0)
        parts = [self._whole(t) if w else p for w, t, p in zip(whole, texts, np.split(ids, ends[:-1]))]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def encoder(content: str) -> _Encoder:
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(content)
    return _ENCODERS[key]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), appends end_id to each and stores file images in ascending doc_id order.

    Returns the stored table: part, seq (files in order), n_ids, image. Null texts have the end id only; null
    doc_ids come first; rows of equal id are ordered by their text's hash and stay rows of their own; an empty
    table gives no file; other columns of docs are ignored. Texts are range-sorted before encoding (they are
    smaller than their ids), so one shuffle moves each text once; the hash of the text is part of the range,
    so that rows of one id spread over tasks."""
    spark = docs.sparkSession
    common.prepare(spark)
    content = spark.sparkContext.broadcast(read_content(tokenizer_path))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(content.value).encode, TaskContext.get().partitionId(), 0
        keys, lengths, data, size = [], [], [], 0

        def image() -> pa.RecordBatch:
            values = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([size], pa.int64()), "image": pa.array([pack(np.concatenate(data), doc_ids=keys, lengths=lengths)], pa.binary())}
            return pa.record_batch(list(values.values()), list(values))

        for own, texts in common.text_slices(batches, 1 << 20):
            ids, n = encode(texts)
            data.append(np.insert(ids, np.cumsum(n), end_id))
            keys += own
            lengths += (n + 1).tolist()
            size += len(data[-1])
            if size >= FILE_IDS:
                yield image()
                keys, lengths, data, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield image()

    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return common.stored(ordered.mapInArrow(run, "part int, seq int, n_ids long, image binary"), "ids")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the stored files (part, seq, n_ids, image), from the images alone.

    start comes from two levels of prefix sums: over parts, then over a part's files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    offsets = files.select("part", "seq", "n_ids", within.alias("inside")).join(parts, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["image"]).astype("<u4").tobytes()
                keys, n = documents(row["image"])
                ends = np.cumsum(n)
                view = memoryview(data)
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                m = len(n)
                yield pa.record_batch([pa.array([row["part"]] * m, pa.int32()), pa.array([row["seq"]] * m, pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "image").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_id_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files of docs and reads them back: one row for each document; see write_ids, read_ids."""
    return read_ids(write_ids(docs, tokenizer_path))
