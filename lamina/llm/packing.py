"""Packing documents into sequences by shortest-pack-first over the histogram of lengths (operator 13).

Documents become ids once, in a stored table, and are cut into pieces of at most LONGEST ids: whole sequences, and a rest.
The driver sees the histogram of piece lengths alone, at most LONGEST rows. It places lengths longest first, each time into
the packs with the most room that are open, as a pattern with a count: packs of one pattern are a range of sequence
numbers, which is split where a length has too few pieces for all of them. Pieces are ranked within their length by a
distributed sort, and find their pack by length and rank.

Packs that would keep much room are poured: where the padding of all patterns exceeds MAX_PADDING of the ids, the packs with the
most padding are laid end to end and cut anew into full sequences, and the last of these into powers of two. Only pieces
that cross such a cut are cut, and only their ids are read again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .bpe_codec import codec
from .vocabulary import BYTE_LETTERS, read_content, vocabulary, white_runs

LONGEST = 2048
END_ID = 1
#: Share of all ids up to which padding is left as the patterns have it.
MAX_PADDING = 0.01
#: Rows of cut pieces up to which they are broadcast to the documents' ids: about 20 MB; beyond, both are shuffled.
FEW_CUTS = 200_000
#: Distinct pieces, and their ids, that an encoder keeps between slices of texts.
_KEPT, _KEPT_IDS = 1_000_000, 8_000_000
#: New pieces that one call of the library encodes.
_AT_ONCE = 2_000
_ENCODERS: dict[int, "Encoder"] = {}


#: What a kind of character each byte of lower-cased Latin UTF-8 belongs to: 0 white space, 1 letters, 2 numbers, 3 signs;
#: of two bytes led by 0xC2, the second one says it.
_KINDS, _AFTER_C2 = np.zeros(256, np.uint8), np.full(256, 3, np.uint8)
_KINDS[33:127], _KINDS[48:58], _KINDS[97:123], _KINDS[0xC3:0xC6] = 3, 2, 1, 1
_AFTER_C2[[0xAA, 0xB5, 0xBA]], _AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 1, 2
#: Texts of these characters alone are cut by numpy: ASCII, and Latin letters and signs whose classes never changed.
_SIMPLE = re.compile("[\t\n\r -~\u00a1-\u012f\u0132-\u017f]*")
#: The splitter that the cuts stand for (a fixed value of the tokenizer file).
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The letters of bytes, but for the space between pieces.
_PIECE_LETTERS = {b: x for b, x in BYTE_LETTERS.items() if b != 32}


def cuts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the pieces of lower-cased UTF-8 of _SIMPLE characters, as _SPLITTER cuts them."""
    kind = _KINDS[b]
    two = np.flatnonzero((b >= 0xC2) & (b <= 0xC5))
    own = np.where(b[two] == 0xC2, _AFTER_C2[b[np.minimum(two + 1, len(b) - 1)]], np.where((b[two] == 0xC3) & ((b[two + 1] & 0xDF) == 0x97), 3, 1)) if len(two) else two
    kind[two] = kind[two + 1] = own
    cut = np.ones(len(b) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut[two + 1] = False
    quote = np.flatnonzero((b[:-1] == 39) & (kind[1:] == 1))
    quote = quote[(quote == 0) | (kind[quote - 1] != 3)]
    x, y = b[quote + 1], b[np.minimum(quote + 2, len(b) - 1)]
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    pair = (np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == 101) | (x == 108) & (y == 108)) & (quote + 2 < len(b))
    for some, n in ((quote[one], 1), (quote[pair], 2)):
        cut[some + 1], cut[some + 1 + n] = False, True
    edges = np.flatnonzero(cut)
    first, last = edges[:-1], edges[1:]
    word = kind[first] > 0
    return first[word], last[word]


class Encoder:
    """Texts -> ids, as the tokenizers library gives them. Each distinct piece of a slice of texts is encoded once and has a
    number by which numpy gathers its ids.

    Where the file lower-cases and splits by _SPLITTER, texts of _SIMPLE characters are cut by numpy, and new pieces go to
    the library's model many at a time, in byte letters between spaces; each piece ends with a token that ends a word.
    Other texts are cut into runs between white space, which are encoded by the rank array."""

    def __init__(self, content: str):
        self.vocab, self.codec = vocabulary(content), codec(content)
        spec, names = json.loads(content), self.vocab.names
        self.cuts = self.vocab.plain is not None and bool(self.vocab.suffix) and self.vocab.plain.pattern == _SPLITTER
        self.model = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "truncation": None, "padding": None}))
        self.word_end = np.array([names.get(i, "").endswith(self.vocab.suffix or "\0") for i in range(max(names, default=0) + 1)], bool)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes | str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.spans = np.zeros((1 << 16, 2), np.int64)  # first id in the pool, number of ids

    def _keep(self, pieces: list[bytes] | list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Adds pieces whose ids lie one after another, up to ends."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = len(self.places)
        while at + len(pieces) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.spans[at : at + len(pieces), 0] = self.used + np.append(0, ends[:-1])
        self.spans[at : at + len(pieces), 1] = np.diff(ends, prepend=0)
        self.places.update(zip(pieces, range(at, at + len(pieces))))
        self.used += len(ids)

    def _learn(self, pieces: list[bytes]) -> None:
        parts = [pieces[i : i + _AT_ONCE] for i in range(0, len(pieces), _AT_ONCE)]
        texts = [b" ".join(p).decode("latin-1").translate(_PIECE_LETTERS) for p in parts]
        for part, found in zip(parts, self.model.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer's pieces do not end with a word's end")
            self._keep(part, ids, ends)

    def _learn_run(self, run: str) -> None:
        special = self.vocab.special.get(run)
        ids = np.array(self.codec.encode_run(run) if special is None else [special], np.uint32)
        self._keep([run], ids, np.array([len(ids)]))

    def _simple(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of texts cut by numpy, and each text's number of pieces."""
        coded = [t.lower().encode() for t in texts]
        data = b"\n".join(coded)
        if not data:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first, last = cuts(np.frombuffer(data, np.uint8))
        found, number = common.distinct_spans(data, first, last)
        self._learn([p for p in found if p not in self.places])
        place = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        return place[number], np.diff(np.searchsorted(first, np.cumsum(np.fromiter(map(len, coded), np.int64) + 1)), prepend=0)

    def _runs(self, text: str) -> np.ndarray:
        """Places of the runs of a text."""
        runs = [r for i, part in enumerate(self.vocab.parts(text)) for r in ([part] if i % 2 else white_runs(part))]
        for r in set(runs).difference(self.places):
            self._learn_run(r)
        return np.fromiter(map(self.places.__getitem__, runs), np.int64, len(runs))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        if len(self.places) > _KEPT or self.used > _KEPT_IDS:
            self._forget()
        simple = [self.cuts and _SIMPLE.fullmatch(t) is not None and not any(x in t for x in self.vocab.special) for t in texts]
        places, n = self._simple([t if s else "" for t, s in zip(texts, simple)])
        if not all(simple):
            parts = [p if s else self._runs(t) for t, s, p in zip(texts, simple, np.split(places, np.cumsum(n)[:-1]))]
            places, n = np.concatenate(parts), np.array([len(p) for p in parts])
        begin, size = self.spans[places].T
        total = np.cumsum(size)
        ids = self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)]
        return ids, np.diff(np.append(0, total)[np.cumsum(n)], prepend=0)


def encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, longest: int = LONGEST) -> DataFrame:
    """Stored (row, doc_id, n, crcs, ids) of every row of docs (doc_id, text): its ids and end_id as little-endian integers of
    2 bytes if all ids of the vocabulary fit, else of 4; crcs of its pieces of `longest` ids as 32-bit integers."""
    spark = docs.sparkSession
    common.prepare(spark)
    content = spark.sparkContext.broadcast(read_content(tokenizer_path))
    kind = id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value).encode
        for who, texts in common.text_slices(batches, 1 << 20):
            ids, n = encode(texts)
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            wide, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n).tolist()
            narrow, size = ids.astype(kind).tobytes(), kind.itemsize
            crcs = [[zlib.crc32(wide[4 * i : 4 * min(i + longest, e)]) for i in range(e - k, e, longest)] for e, k in zip(ends, n.tolist())]
            own = [narrow[size * (e - k) : size * e] for e, k in zip(ends, n.tolist())]
            yield pa.record_batch([pa.array(who, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(own, pa.binary())], ["doc_id", "n", "crcs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, crcs array<long>, ids binary")
    return common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "packed-ids")


def id_type(tokenizer_path: str) -> np.dtype:
    return np.dtype("<u2" if max(vocabulary(read_content(tokenizer_path)).names, default=0) < 1 << 16 else "<u4")


class Plan:
    """Where the pieces of each length and rank go: packs by shortest-pack-first, some of them poured."""

    def __init__(self, histogram: dict[int, int], longest: int = LONGEST, max_padding: float = MAX_PADDING):
        self.longest = longest
        slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in a sequence, offset
        heap: list[tuple[int, int, int]] = []  # used, first sequence, number of sequences of open packs
        packs: list[tuple[int, int, int]] = []  # (first sequence, number, used) of packs that take no more
        new = 0
        for length in sorted(histogram, reverse=True):
            rank, left = 0, histogram[length]
            while left and heap and heap[0][0] + length <= longest:
                used, first, count = heapq.heappop(heap)
                some = min(left, count)
                slots.append((length, rank, first, 1, used))
                heapq.heappush(heap, (used + length, first, some))
                if some < count:
                    heapq.heappush(heap, (used, first + some, count - some))
                rank, left = rank + some, left - some
            most = longest // length
            for each, count in ((most, left // most), (left % most, 1)):
                if each and count:
                    slots.append((length, rank, new, each, 0))
                    heapq.heappush(heap, (each * length, new, count))
                    rank, new = rank + each * count, new + count
        packs = sorted((first, count, used) for used, first, count in heap)
        slots.sort()
        self.key = np.array([(s[0] << 44) + s[1] for s in slots], np.int64)
        self.rank, self.sequence, self.each, self.offset = (np.array([s[k] for s in slots], np.int64) for k in (1, 2, 3, 4))
        self._pour(packs, sum(k * v for k, v in histogram.items()), max_padding)

    def padding(self, used: int) -> int:
        """Sequences are padded to `longest`, but not if they hold a power of two."""
        return 0 if used & (used - 1) == 0 else self.longest - used

    def _pour(self, packs: list[tuple[int, int, int]], total: int, max_padding: float) -> None:
        left, poured = sum(self.padding(u) * c for _, c, u in packs), set()
        for p in sorted(packs, key=lambda p: (-self.padding(p[2]), p)):
            if left > max_padding * total:
                poured.add(p)
                left -= self.padding(p[2]) * p[1]
        kept = base = 0
        rows = []
        for p in packs:
            first, count, used = p
            rows.append((first, used, base if p in poured else -1, kept))  # kept: new number of the first sequence
            base, kept = (base + count * used, kept) if p in poured else (base, kept + count)
        self.first, self.used, self.base, self.number = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        self.kept, self.full = kept, base // self.longest
        tail, at = [], self.full * self.longest
        for bit in reversed(range(self.longest.bit_length())):
            if (base % self.longest) >> bit & 1:
                tail.append(at)
                at += 1 << bit
        self.tail = np.array([*tail, base], np.int64)

    def _poured(self, g: np.ndarray) -> np.ndarray:
        """The poured sequence that holds place g."""
        return np.where(g < self.full * self.longest, g // self.longest, self.full + np.searchsorted(self.tail, g, side="right") - 1)

    def _start(self, s: np.ndarray) -> np.ndarray:
        return np.where(s <= self.full, s * self.longest, self.tail[np.clip(s - self.full, 0, len(self.tail) - 1)])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, first, size, sequence, offset) of the parts of each piece: which piece, the first of its ids, their number,
        and where they go."""
        if not len(length):
            return (np.zeros(0, np.int64),) * 5
        slot = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        turn = rank - self.rank[slot]
        sequence, offset = self.sequence[slot] + turn // self.each[slot], self.offset[slot] + turn % self.each[slot] * length
        pack = np.searchsorted(self.first, sequence, side="right") - 1
        copy = sequence - self.first[pack]
        g = self.base[pack] + copy * self.used[pack] + offset
        poured = self.base[pack] >= 0
        low = np.where(poured, self._poured(g), 0)
        parts = np.where(poured, self._poured(g + length - 1) - low + 1, 1)
        piece = np.repeat(np.arange(len(length)), parts)
        s = low[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = poured[piece]
        begin = np.where(own, np.maximum(g[piece], self._start(s)), g[piece])
        end = np.where(own, np.minimum((g + length)[piece], self._start(s + 1)), (g + length)[piece])
        sequence = np.where(own, self.kept + s, (self.number[pack] + copy)[piece])
        return piece, begin - g[piece], end - begin, sequence, np.where(own, begin - self._start(s), offset[piece])


def pack(ids: DataFrame, kind: np.dtype, longest: int = LONGEST, max_padding: float = MAX_PADDING) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ids (a table of encoded())."""
    spark = ids.sparkSession
    pieces = ids.select("row", "doc_id", "n", F.posexplode("crcs").alias("k", "crc")).withColumn("start", F.col("k") * F.lit(longest).cast("long"))
    pieces = pieces.select(F.least(F.lit(longest).cast("long"), F.col("n") - F.col("start")).alias("length"), "row", "start", "doc_id", "n", "crc")
    ranked = common.ranked(common.in_order(pieces, "length", "row", "start"), "length")
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # at most `longest` rows
    plan = spark.sparkContext.broadcast(Plan(histogram, longest, max_padding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank, start, crc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "start", "crc"))
            piece, first, size, sequence, offset = plan.value.place(length, rank)
            cut = size < length[piece]
            out = [b.column(c).take(pa.array(piece)) for c in ("row", "doc_id", "n")]
            yield pa.record_batch([*out, pa.array(start[piece] + first), pa.array(size), pa.array(crc[piece], pa.int64(), mask=cut), pa.array(sequence), pa.array(offset)], ["row", "doc_id", "n", "start", "length", "crc", "sequence_id", "offset"])

    kinds = "row long, doc_id long, n long, start long, length long, crc long, sequence_id long, offset long"
    placed = common.stored(ranked.select("length", "rank", "row", "start", "doc_id", "n", "crc").mapInArrow(run, kinds), "placed")
    cut = placed.where("crc is null")
    few = cut.count() <= FEW_CUTS
    joined = ids.select("row", "ids").join(F.broadcast(cut) if few else cut, "row")
    size, some = kind.itemsize, [c for c in placed.columns if c != "crc"]
    own = F.substring("ids", F.col("start").cast("int") * size + 1, F.col("length").cast("int") * size)

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in some), pa.array(found, pa.int64())], [*some, "crc"])

    again = joined.select(*some, own.alias("ids")).mapInArrow(crcs, ", ".join(f"{c} long" for c in [*some, "crc"]))
    every = placed.where("crc is not null").unionByName(again)
    return every.select("row", "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def sequences(ids: DataFrame, pieces: DataFrame, kind: np.dtype) -> DataFrame:
    """sequence_id, ids (binary, as in the table of encoded()) of every sequence, without padding."""
    size = kind.itemsize
    own = F.substring("ids", F.col("start").cast("int") * size + 1, F.col("length").cast("int") * size)
    rows = pieces.select("row", "start", "length", "sequence_id", "offset").join(ids.select("row", "ids"), "row").select("sequence_id", "offset", own.alias("own"))
    parts = F.sort_array(F.collect_list(F.struct("offset", "own")))  # a sequence has at most `longest` ids
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["own"]))
    return rows.groupBy("sequence_id").agg(whole.alias("ids"))


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row (doc_id, text).

    Null texts are empty: one piece, the end id alone. Rows of equal or null ids stay rows of their own; which of equal
    lengths go together follows the order of the table's rows. Texts of any length are cut; other columns of docs are
    ignored; an empty table gives an empty result."""
    return pack(encoded(docs, tokenizer_path), id_type(tokenizer_path)).drop("row")
