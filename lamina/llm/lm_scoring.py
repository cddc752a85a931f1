"""Language-model scores from a log-frequency Bloom filter (operator 6).

Texts are cut into stored slices of packed tokens. Each slice deals its distinct words and word pairs, with their
counts in training documents, by hash range to shards. A shard merges the counts. For words it answers each slice
with exact counts. For pairs it quantises the counts to q = 1 + floor(log2 c), fills its segment of the filter with
(pair, 1) ... (pair, q), and answers each slice with the levels read from it, by probing until one is missing. The
answers meet their slice again in a join, where texts are scored.

All pairs of training documents enter, and all words have their counts: a segment is as large as its keys need, and
the number of shards follows the input. Segments are blocked: a pair's probes lie in one block of 512 bits. They are
kept in the stored table of answers, in rows without a slice.

A level stands for the mean count of all training pairs of that level, so readings neither add nor lose counts over all
pairs; level 1 is exact. Score of word w after v, with c exact for words, ~c the reading, at most c(v) and c(w):
  log10 (~c(v, w) + MU * p(w)) / (c(v) + MU),  p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MU = 200.0
#: Bits for each key of the filter, and hash functions.
BITS_PER_KEY, PROBES = 10, 6
#: Bytes of a filter's segment, about; segments are as many as the input needs.
FILTER_BYTES = 2 << 20
#: Distinct words of a shard, about.
HOT_WORDS = 1 << 20
#: Characters of a slice, about.
SLICE = 4 << 20
#: The end token: a hash that no word has but by chance.
END = np.uint64(0xE4D0E4D0E4D0E4D0)
_LEVELS = 40
_WORDS, _PAIRS = 0, 1
#: Pairs that are probed at once.
_AT_ONCE = 1 << 18


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, one end token after each, and each text's number of tokens."""
    h, n = common.word_hashes(texts, "ascii")
    out = np.full(len(h) + len(texts), END, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    out[np.arange(len(h)) + doc] = h
    return out, n + 1


def pair_hashes(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of (token before, token) at each token; the first follows END."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[np.cumsum(n) - n] = END
    with np.errstate(over="ignore"):
        return common.mix(before * np.uint64(3) + common.mix(t, 5), 6)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _planes(x: np.ndarray) -> bytes:
    """Integers as bytes by place, so that the places that are nearly all 0 compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _whole(b: bytes, kind: type) -> np.ndarray:
    """The integers of _planes()."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as planes of their differences."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_whole(b, np.uint64), dtype=np.uint64)


def _positions(h: np.ndarray, level: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, PROBES bit places in it) of keys (hash, level)."""
    block = ((common.mix(h, 9) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    g = common.mix(h, 100 + level)
    return block, np.stack([(g >> np.uint64(9 * i)).astype(np.int64) & 511 for i in range(PROBES)])


def build_filter(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bytes of a segment that holds all levels of distinct pairs of counts c > 0."""
    q = np.frexp(c.astype(np.float64))[1]
    blocks = max(1, -(-int(q.sum()) * BITS_PER_KEY // 512))
    bits = np.zeros(blocks * 512, bool)
    for first in range(0, len(h), _AT_ONCE):
        part, most = h[first : first + _AT_ONCE], q[first : first + _AT_ONCE]
        for level in range(1, int(most.max()) + 1):
            block, places = _positions(part[most >= level], level, blocks)
            bits[(block * 512 + places).reshape(-1)] = True
    return np.packbits(bits, bitorder="little")


def read_levels(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Levels of pairs in a segment, 0 where level 1 is missing."""
    blocks, level_of = len(bits) // 64, np.zeros(len(h), np.uint8)
    for first in range(0, len(h), _AT_ONCE):
        left = np.arange(first, min(first + _AT_ONCE, len(h)))
        for level in range(1, _LEVELS):
            block, places = _positions(h[left], level, blocks)
            at = block * 512 + places
            left = left[((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)]
            if not len(left):
                break
            level_of[left] = level
    return level_of


def level_sums(c: np.ndarray) -> np.ndarray:
    """Number of pairs of each level, then their counts' sum at each level, from the pairs' counts."""
    q = np.frexp(c.astype(np.float64))[1]
    return np.concatenate([np.bincount(q, minlength=_LEVELS), np.bincount(q, c, _LEVELS)]).astype(np.int64)


def level_counts(sums: np.ndarray) -> np.ndarray:
    """The count that each level stands for: the mean of its pairs; where no pair has it, the middle of [2**(q-1), 2**q)."""
    n, total = sums[:_LEVELS], sums[_LEVELS:]
    means = np.where(n > 0, total / np.maximum(n, 1), 1.5 * 2.0 ** (np.arange(_LEVELS) - 1.0))
    means[:2] = 0.0, 1.0
    return means


def slices(base: DataFrame) -> DataFrame:
    """Stored (slice, ids, flags, n, words, code) of rows (doc_id, text): the ids, flags of 1 for null ids and 2 for
    training rows, and numbers of tokens of a slice's texts; its distinct token hashes and each token's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for who, texts in common.text_slices(batches, SLICE):
            t, n = tokens(texts)
            words, code = np.unique(t, return_inverse=True)
            ids = np.array([w["doc_id"] or 0 for w in who], np.int64)
            flags = np.array([(w["doc_id"] is None) + 2 * w["learn"] for w in who], np.uint8)
            row = [ids.tobytes(), flags.tobytes(), n.astype(np.int64).tobytes(), _pack(words), _planes(code.astype(np.uint32))]
            yield pa.record_batch([pa.array([x], pa.binary()) for x in row], ["ids", "flags", "n", "words", "code"])

    who = F.struct("doc_id", (~common.held_out("doc_id", 10, 0)).alias("learn")).alias("who")
    out = base.select(who, "text").mapInArrow(run, "ids binary, flags binary, n binary, words binary, code binary")
    return common.stored(out.withColumn("slice", F.monotonically_increasing_id()), "slices")


def answers(cut: DataFrame, word_shards: int, pair_shards: int) -> DataFrame:
    """Stored (kind, shard, slice, answer, total, known, sums): for each slice and shard, the training counts of the slice's
    distinct words (int64) or the filter's levels of its distinct pairs (uint8), in order of their hashes. The row of a
    shard without a slice has its numbers of training tokens and of distinct ones, and for pairs the filter's segment and level_sums()."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, code, words = np.frombuffer(r["n"], np.int64), _whole(r["code"], np.uint32), _unpack(r["words"])
                learn = np.repeat(np.frombuffer(r["flags"], np.uint8) >> 1, n)
                pairs, place = np.unique(pair_hashes(words[code], n), return_inverse=True)
                for kind, shards, h, at in ((_WORDS, word_shards, words, code), (_PAIRS, pair_shards, pairs, place)):
                    c = np.bincount(at, learn, len(h)).astype(np.uint32)
                    shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                    first = np.flatnonzero(np.diff(shard, prepend=-1))
                    spans = list(zip(first, np.append(first[1:], len(h))))
                    values = [
                        pa.array([kind] * len(spans), pa.int32()), pa.array(shard[first], pa.int64()), pa.array([r["slice"]] * len(spans), pa.int64()),
                        pa.array([_pack(h[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(c[a:b]) for a, b in spans], pa.binary()),
                    ]
                    yield pa.record_batch(values, ["kind", "shard", "slice", "h", "c"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        kind, shard = (k.as_py() for k in key)
        parts = [_unpack(x) for x in group["h"].to_pylist()]
        h, c = _counted([(x, _whole(y, np.uint32).astype(np.int64)) for x, y in zip(parts, group["c"].to_pylist())])
        h, c = h[c > 0], c[c > 0]
        if kind == _PAIRS:
            bits = build_filter(h, c)
            found = [read_levels(bits, x).tobytes() for x in parts]
        else:
            bits, found = np.zeros(0, np.uint8), []
            for x in parts:
                at = np.minimum(np.searchsorted(h, x), max(len(h) - 1, 0))
                found.append(_planes(np.where(h[at] == x, c[at], 0) if len(h) else np.zeros(len(x), np.int64)))
        k, sums = len(parts), level_sums(c).tolist() if kind == _PAIRS else None
        return pa.table({
            "kind": pa.array([kind] * (k + 1), pa.int32()), "shard": pa.array([shard] * (k + 1), pa.int64()), "slice": pa.array([*group["slice"].to_pylist(), None], pa.int64()),
            "answer": pa.array([*found, bits.tobytes()], pa.binary()), "total": pa.array([None] * k + [int(c.sum())], pa.int64()), "known": pa.array([None] * k + [len(h)], pa.int64()),
            "sums": pa.array([None] * k + [sums], pa.list_(pa.int64())),
        })

    dealt = cut.select("slice", "flags", "n", "words", "code").mapInArrow(deal, "kind int, shard long, slice long, h binary, c binary")
    merged = dealt.groupBy("kind", "shard").applyInArrow(merge, "kind int, shard long, slice long, answer binary, total long, known long, sums array<long>")
    return common.stored(merged, "answers")


def lm_scores(docs: DataFrame, mu: float = MU, filter_bytes: int = FILTER_BYTES, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (doc_id, text).

    Learns from rows whose crc32(doc_id) mod 10 is not 0. Null texts are empty: one end token. Rows of
    equal or null ids stay rows of their own. Without training rows the counts are 0 and scores are those
    of the smoothing alone. Words are identified by 64-bit hashes. filter_bytes and hot_words set how much
    a segment of the filter and a shard of words hold, about, and so their number; nothing is left out."""
    common.prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), "text")
    size = base.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    cut = slices(base)
    found = answers(cut, max(1, -(-size // (24 * hot_words))), max(1, -(-size // (4 * filter_bytes))))
    r = found.where(F.col("slice").isNull() & (F.col("kind") == _WORDS)).agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    n_train, v_train = r["n"] or 0, r["v"] or 0
    whole = n_train + 0.1 * (v_train + 1)
    sums = np.zeros(2 * _LEVELS, np.int64)
    for at, total in found.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect():
        sums[at] = total
    means = level_counts(sums)

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        n, code, words = np.frombuffer(r["n"], np.int64), _whole(r["code"], np.uint32), _unpack(r["words"])
        got = sorted(zip(found["kind"].to_pylist(), found["shard"].to_pylist(), found["answer"].to_pylist()))
        count = np.concatenate([_whole(x, np.int64) for kind, _, x in got if kind == _WORDS]).astype(np.float64)
        level = np.concatenate([np.frombuffer(x, np.uint8) for kind, _, x in got if kind == _PAIRS])
        t, c = words[code], count[code]
        start = np.cumsum(n) - n
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[start] = count[np.searchsorted(words, END)]
        seen = means[level[np.unique(pair_hashes(t, n), return_inverse=True)[1]]]
        seen = np.minimum(seen, np.minimum(c, before))  # a pair is no more frequent than its words
        p = (c + 0.1) / whole
        ids, flags = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["flags"], np.uint8)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=(flags & 1).astype(bool)), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), start), pa.int64()),
            "base_score": pa.array(np.add.reduceat(np.log10(p), start), pa.float64()), "score": pa.array(np.add.reduceat(np.log10(seen + mu * p) - np.log10(before + mu), start), pa.float64()),
        })

    told = found.where(F.col("slice").isNotNull()).select("slice", "kind", "shard", "answer")
    out = cut.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", common.held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
