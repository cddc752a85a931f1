"""Token counts by a finite-state transducer (operator 1).

BPE of a piece is recognised by a deterministic transducer. Its state is the longest suffix read that
still begins some token, with the last token and the relative token count at each boundary inside that
suffix: all that later symbols can depend on, since a sequence of tokens is the BPE result exactly if
each adjacent pair is. Each transition carries the change in the number of emitted tokens, so the sum
along a piece is its token count. States and transitions are compiled when first reached and kept.

A text is cut into chunks, and each chunk becomes a map from states at its entry to (state at its exit, emitted
tokens). White space and the ends of pieces send every state to the start, so a chunk of whole runs maps the start
to itself with a count; the transitions of a whole run from the start are compiled into one and kept. A long run
is cut inside its pieces: there the entries are the states that the letters before the cut can lead to, from a few
places where a token may have begun; a state outside these is followed when it is met. Maps compose
associatively, and a prefix scan over a text's chunks (pairs, then pairs of pairs) gives the count up to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vocabulary import Memo, Vocabulary, read_content, vocabulary, white_runs

CHUNK = 1 << 14
#: The state before a piece: nothing read, no token yet.
START = ("", (None,), (0,))
#: States that a chunk inside a piece is followed from at first, about.
ENTRIES = 4
_COUNTERS: dict[int, "RunCounter"] = {}


class Transducer:
    """Deterministic transducer from symbols to token counts, compiled lazily."""

    def __init__(self, vocab: Vocabulary, most_states: int = 300_000):
        self.vocab, self.most = vocab, most_states
        #: One letter for each symbol, so that suffixes are substrings.
        self.letter: dict[str, str] = {}
        for t in (t for t in vocab.ids if len(t.removesuffix(vocab.suffix) if vocab.suffix else t) == 1):
            self.letter[t] = chr(0x4E00 + len(self.letter))
        plain = {t: self.spell(t) for t in vocab.ids}
        self.rank = {(plain[a], plain[b]): r for (a, b), r in vocab.ranks.items()}
        self.tokens = set(plain.values())
        self.prefixes = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.longest = max(map(len, self.tokens))
        self.pairs = Memo(lambda ab: self._merged(ab[0] + ab[1]) == list(ab), 500_000)
        self.whole = Memo(lambda t: self._merged(t) == [t], 500_000)
        self._reset()

    def spell(self, token: str) -> str:
        s = self.vocab.suffix
        out = list(token)
        if s and token.endswith(s):
            out = list(token[: -len(s)])
            out[-1] += s
        return "".join(self.letter[x] for x in out)

    def _reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self._state(START)

    def _state(self, key: tuple) -> int:
        if key not in self.names:
            self.names[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return self.names[key]

    def _merged(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        suffix, lasts, counts = self.keys[state]
        read = suffix + c
        for k in range(len(read), 0, -1):
            token = read[-k:]
            if token in self.tokens and self.whole[token]:
                before = lasts[len(lasts) - k]
                if before is None or self.pairs[(before, token)]:
                    break
        else:
            raise ValueError("symbol outside the vocabulary")
        delta = counts[len(counts) - k] + 1
        while read and read not in self.prefixes:
            read = read[1:]
        keep = len(read)
        lasts, counts = (*lasts, token)[-keep - 1 :], tuple(x - delta for x in (*counts, delta)[-keep - 1 :])
        return self._state((read, lasts, counts)), delta

    def run(self, entry: tuple, letters: str) -> tuple[tuple, int]:
        """(state after the letters, emitted tokens), from a state."""
        state, total = self._state(entry), 0
        for first in range(0, len(letters), 4096):
            if len(self.keys) > self.most:
                entry = self.keys[state]
                self._reset()
                state = self._state(entry)
            for c in letters[first : first + 4096]:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = self._compile(state, c)
                state, delta = step
                total += delta
        return self.keys[state], total


class ChunkMap:
    """A chunk's map from entry states to (exit state, emitted tokens); `follow` finds what is not known yet."""

    __slots__ = ("known", "follow")

    def __init__(self, known: dict[tuple, tuple[tuple, int]], follow: Callable[[tuple], tuple[tuple, int]]):
        self.known, self.follow = known, follow

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        if entry not in self.known:
            self.known[entry] = self.follow(entry)
        return self.known[entry]

    def then(self, other: "ChunkMap") -> "ChunkMap":
        """The map of this chunk and the one after it."""

        def follow(entry: tuple) -> tuple[tuple, int]:
            middle, n = self(entry)
            last, m = other(middle)
            return last, n + m

        return ChunkMap({entry: follow(entry) for entry in self.known}, follow)


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """The composition of the first 1, 2, 3 ... maps: pairs are joined, scanned, and the places between filled in."""
    if len(maps) < 2:
        return maps
    pairs = scan([a.then(b) for a, b in zip(maps[::2], maps[1::2])])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else pairs[i // 2 - 1].then(maps[i]))
    return out


class RunCounter:
    """Token counts of texts by chunk maps."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.machine = vocab, Transducer(vocab)
        self.pieces = Memo(lambda piece: self.machine.run(START, self._letters(piece))[1])
        self.runs = Memo(lambda run: sum(map(self.pieces.__getitem__, vocab.pieces(run))))

    def _letters(self, piece: str) -> str:
        return "".join(map(self.machine.letter.__getitem__, self.vocab.symbols(piece)))

    @staticmethod
    def _reset(count: int) -> ChunkMap:
        """A chunk from the start to the start."""
        return ChunkMap({START: (START, count)}, lambda entry: (START, count))

    def _inside(self, letters: str, first: int, last: int) -> ChunkMap:
        """The map of letters[first : last] of a piece; the piece's end sends all to the start."""
        machine, part, ends = self.machine, letters[first:last], last == len(letters)

        def follow(entry: tuple) -> tuple[tuple, int]:
            after, n = machine.run(entry, part)
            return (START if ends else after), n

        window = machine.longest
        entries = {START} if not first else {machine.run(START, letters[max(0, first - window - k) : first])[0] for k in range(0, window, max(1, window // ENTRIES))}
        return ChunkMap({entry: follow(entry) for entry in entries}, follow)

    def _long(self, run: str, chunk: int) -> list[ChunkMap]:
        """Maps of a run, which is cut inside its pieces."""
        maps, count = [], 0
        for piece in self.vocab.pieces(run):
            if len(piece) <= chunk:
                count += self.pieces[piece]
                continue
            letters = self._letters(piece)
            maps += [self._reset(count), *(self._inside(letters, i, min(i + chunk, len(letters))) for i in range(0, len(letters), chunk))]
            count = 0
        return [*maps, self._reset(count)]

    def maps(self, text: str, chunk: int = CHUNK) -> list[ChunkMap]:
        """The maps of a text's chunks of about `chunk` characters."""
        out = []
        for i, part in enumerate(self.vocab.parts(text)):
            if i % 2:  # a special token
                out.append(self._reset(1))
                continue
            runs = white_runs(part)
            if len(part) <= chunk:
                out.append(self._reset(sum(map(self.runs.__getitem__, runs))))
                continue
            count = size = 0
            for run in runs:
                if len(run) > chunk:
                    out += [self._reset(count), *self._long(run, chunk)]
                    count = size = 0
                    continue
                count += self.runs[run]
                size += len(run) + 1
                if size >= chunk:
                    out.append(self._reset(count))
                    count = size = 0
            out.append(self._reset(count))
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return scan(self.maps(text, chunk))[-1](START)[1]


def counter(content: str) -> RunCounter:
    key = hash(content)
    if key not in _COUNTERS:
        _COUNTERS[key] = RunCounter(vocabulary(content))
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text; other columns are ignored).

    Null texts count as empty (0 bytes, 0 tokens). Rows with equal or null ids stay rows of their own;
    an empty table gives an empty result. No shuffle: each row is counted where it is read."""
    spark = docs.sparkSession
    common.prepare(spark)
    content = spark.sparkContext.broadcast(read_content(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(content.value)
        for ids, texts in common.text_slices(batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(map(own.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
