"""BPE encoding and decoding with a contiguous rank array (operator 3)."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vocabulary import Memo, Vocabulary, read_content, vocabulary, white_runs

NONE = 1 << 60
#: From this many symbols on, the minimum is kept in a heap: scans would cost the square of the length.
SHORT = 200
#: Pieces up to this length are merged together, so many of them in one step.
TOGETHER, STEP = 64, 1 << 16
#: Runs that are looked up together; runs that are kept, and the longest of them.
BLOCK, KEPT, LONGEST = 1 << 17, 500_000, 256
_CODECS: dict[int, "Codec"] = {}


class Ranks:
    """The merges of a vocabulary as arrays: sorted pairs of ids, and the rank and the result of each."""

    def __init__(self, vocab: Vocabulary):
        self.size = max(vocab.ids.values()) + 1
        pairs = np.array([(vocab.ids[a], vocab.ids[b]) for a, b in vocab.ranks], np.int64).reshape(-1, 2)
        key, rank = pairs[:, 0] * self.size + pairs[:, 1], np.fromiter(vocab.ranks.values(), np.int32, len(pairs))
        self.none = np.int32(rank.max(initial=-1) + 1)
        self.result = np.zeros(self.none, np.int32)
        self.result[rank] = [vocab.ids[a + b] for a, b in vocab.ranks]
        order = np.argsort(key)
        self.key, self.rank = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order], self.none)
        letters = {ord(t): i for t, i in vocab.ids.items() if len(t) == 1}
        last = {ord(t[0]): i for t, i in vocab.ids.items() if t[1:] == vocab.suffix and t}
        self.first, self.last = (np.full(0x110000, -1, np.int32) for _ in range(2))
        for table, own in ((self.first, letters), (self.last, last)):
            table[list(own)] = list(own.values())

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, `none` if it is not merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first symbols of all pieces (none is empty), and where each piece begins, with the end."""
        at = np.cumsum([0, *map(len, pieces)])
        letters = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.first[letters]
        ids[at[1:] - 1] = self.last[letters[at[1:] - 1]]
        if len(ids) and ids.min() < 0:
            raise KeyError(chr(letters[int(ids.argmin())]))
        return ids, at

    def merge(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of pieces, a row of ids for each) for all pieces, by the number of ids.

        Each piece has a row of symbols and, beside it, a row of the ranks of its pairs. A step merges the first pair of
        least rank in every row, so rows become one symbol shorter and meet the pieces that began with that length."""
        ids, at = self.symbols(pieces)
        sizes = np.diff(at)
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        who, rows, ranks = np.zeros(0, np.int64), np.zeros((0, len(bounds)), np.int32), np.zeros((0, max(len(bounds) - 1, 0)), np.int32)
        for width in range(len(bounds) - 1, 0, -1):
            rows, ranks = rows[:, :width], ranks[:, : width - 1]
            own = order[bounds[width - 1] : bounds[width]]
            if len(own):
                new = ids[at[own][:, None] + np.arange(width)]
                who, rows, ranks = np.concatenate([who, own]), np.concatenate([rows, new]), np.concatenate([ranks, self.of(new[:, :-1], new[:, 1:])])
            if width == 1 or not len(who):
                if len(who):
                    yield who, rows
                continue
            place = ranks.argmin(1)
            least = ranks[np.arange(len(who)), place]
            ended = least == self.none
            if ended.any():
                yield who[ended], rows[ended]
                who, rows, ranks, place, least = (x[~ended] for x in (who, rows, ranks, place, least))
            n, column = np.arange(len(who)), np.arange(width - 1)
            rows = np.where(column <= place[:, None], rows[:, :-1], rows[:, 1:])
            rows[n, place] = self.result[least]
            ranks = np.where(column[:-1] < place[:, None], ranks[:, :-1], ranks[:, 1:])
            some = np.flatnonzero(place < width - 2)
            ranks[some, place[some]] = self.of(rows[some, place[some]], rows[some, place[some] + 1])
            some = np.flatnonzero(place > 0)
            ranks[some, place[some] - 1] = self.of(rows[some, place[some] - 1], rows[some, place[some]])


class Codec:
    """Encodes texts to ids and decodes ids, as the tokenizers library does with the same file."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pieces = Memo(lambda p: [vocab.ids[t] for t in self.merge(vocab.symbols(p))], 100_000)
        self.ranks: Ranks | None = None
        self.numbers: dict[str, str] = {}  # of runs: ids joined by spaces
        self.decoded: dict[str, str] = {}  # of runs: tokens joined by spaces
        self.empty: set[str] = set()  # runs without ids

    def merge(self, symbols: list[str]) -> list[str]:
        """Parts of a piece: boundaries and the rank of each adjacent pair lie in two lists side by side."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        rank = self.vocab.ranks.get
        parts = symbols
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same result for long pieces from a heap of (rank, place) over linked parts."""
        rank, n = self.vocab.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def encode_run(self, run: str) -> list[int]:
        return [i for p in self.vocab.pieces(run) for i in self.pieces[p]]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: what the library does for a file without a decoder; unknown ids vanish."""
        names = self.vocab.names
        return " ".join(names[i] for i in ids if i in names)

    def _joined(self, pieces: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids and tokens, each joined by spaces, of pieces."""
        if self.ranks is None:
            self.ranks = Ranks(self.vocab)
            self.words = [np.full(self.ranks.size, "", object) for _ in range(2)]  # by id
            for i in self.vocab.ids.values():
                self.words[0][i], self.words[1][i] = str(i), self.vocab.names[i]
        out: tuple[dict[str, str], dict[str, str]] = {}, {}
        long = [p for p in pieces if len(p) > TOGETHER]
        for p in long:
            ids = self.pieces[p]
            for found, words in zip(out, self.words):
                found[p] = " ".join(words[ids])
        short = list(pieces.difference(long)) if long else list(pieces)
        for first in range(0, len(short), STEP):
            for who, rows in self.ranks.merge(short[first : first + STEP]):
                own = [short[first + i] for i in who.tolist()]
                for found, words in zip(out, self.words):
                    found.update(zip(own, map(" ".join, words[rows].tolist()) if rows.shape[1] > 1 else words[rows[:, 0]].tolist()))
        return out

    def learn(self, runs: set[str]) -> list[str]:
        """Makes numbers and decoded hold all these runs; when they are full, they start anew. The runs that are new."""
        new = runs - self.numbers.keys()
        if len(self.numbers) + len(new) > KEPT:
            self.numbers, self.decoded, self.empty, new = {}, {}, set(), runs
        numbers, decoded = self.numbers, self.decoded
        for t in new & self.vocab.special.keys():
            numbers[t], decoded[t] = str(self.vocab.special[t]), t
        names = [r for r in new if r not in self.vocab.special]
        cut = self.vocab.pieces_of(names)
        ids, tokens = self._joined({p for pieces in cut for p in pieces})
        for run, pieces in zip(names, cut):
            if len(pieces) == 1:
                numbers[run], decoded[run] = ids[pieces[0]], tokens[pieces[0]]
            elif pieces:
                numbers[run], decoded[run] = " ".join([ids[p] for p in pieces]), " ".join([tokens[p] for p in pieces])
            else:
                numbers[run] = decoded[run] = ""
                self.empty.add(run)
        return names

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return list(map(int, self.both(text)[1].split()))

    def both(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text)."""
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """both() of every text: new runs of BLOCK or more are encoded together."""
        found: list[tuple[list[str], list[str]]] = [([], []) for _ in texts]
        group: list[tuple[int, list[str]]] = []
        size = 0

        def look_up() -> None:
            new = self.learn(set().union(*(runs for _, runs in group)))
            for i, runs in group:
                if self.empty:
                    runs = [r for r in runs if r not in self.empty]
                if runs:
                    found[i][0].append(" ".join(map(self.numbers.__getitem__, runs)))
                    found[i][1].append(" ".join(map(self.decoded.__getitem__, runs)))
            for r in new:
                if len(r) > LONGEST:
                    del self.numbers[r], self.decoded[r]
                    self.empty.discard(r)

        for i, text in enumerate(texts):
            runs = []
            for k, part in enumerate(self.vocab.parts(text)):
                runs += [part] if k % 2 else white_runs(part)
            for first in range(0, len(runs), BLOCK):
                group.append((i, runs[first : first + BLOCK]))
                size += len(group[-1][1])
                if size >= BLOCK:
                    look_up()
                    group, size = [], 0
        look_up()
        joined = [(" ".join(n), " ".join(d)) for n, d in found]
        return [(n.count(" ") + 1 if n else 0, n, d) for n, d in joined]


def codec(content: str) -> Codec:
    key = hash(content)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary(content))
    return _CODECS[key]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row; null texts are empty texts with no ids.

    Rows with equal or null ids stay rows of their own; other columns of docs are ignored; no shuffle."""
    spark = docs.sparkSession
    common.prepare(spark)
    content = spark.sparkContext.broadcast(read_content(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for ids, texts in common.text_slices(batches, 1 << 20):
            found = own.all(texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([list(map(int, x[1].split())) for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, by the same codec as encode().

    Null texts are empty texts; rows of equal or null ids stay rows of their own; an empty table gives an empty result. The
    ids' text and the decoded text never leave the worker."""
    spark = docs.sparkSession
    common.prepare(spark)
    content = spark.sparkContext.broadcast(read_content(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(content.value), lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for ids, texts in common.text_slices(batches, 1 << 20):
            rows = [(n, sha(i), sha(d)) for n, i, d in own.all(texts)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
