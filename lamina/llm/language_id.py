"""Language identification by hyperdimensional profiles (operator 10).

Each letter has a random vector of +1 and -1, seeded by its code point. An n-gram's vector binds the
permuted (rolled) vectors of its letters by multiplication; a text's profile bundles (adds) those of its
n-grams, with a blank at each word's ends; a language's prototype bundles its documents' unit profiles.
A document goes to the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, GRAM = 1024, 3
#: Labelled documents that the prototypes are bundled from: an even part of about this many for each language, chosen
#: by a hash of id and text; a language of fewer documents gives them all.
MAX_TRAIN = 20_000
#: Languages are a dimension; prototypes of more than this many are refused.
MAX_LANGUAGES = 5_000
UNDETERMINED = "und"


class Space:
    """Letter and n-gram vectors, kept by code point and by n-gram."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, most: int = 40_000):
        self.dimensions, self.gram, self.most = dimensions, gram, most
        self.classes = np.zeros(0x110000, np.int8)  # 0 unknown, 1 letter, 2 other
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.int8)  # +1 and -1; workers keep it from stage to stage

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            words = common.mix(np.arange(-(-self.dimensions // 64), dtype=np.uint64), code)
            bits = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: self.dimensions]
            self.letters[code] = bits.astype(np.int8) * np.int8(2) - np.int8(1)
        return self.letters[code]

    def is_letter(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.classes[codes] == 0])
        for c in new.tolist():
            self.classes[c] = 1 if chr(c).isalpha() else 2
        return self.classes[codes] == 1

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Table rows of distinct n-grams (letters' code points, 21 bits each)."""
        if len(self.grams) + len(grams) > self.most:
            self.grams.clear()
        if len(self.grams) + len(grams) > len(self.table):
            more = max(len(self.grams) + len(grams), min(2 * len(self.table), self.most)) - len(self.table)
            self.table = np.concatenate([self.table, np.zeros((more, self.dimensions), np.int8)])
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.grams.get(g)
            if at is None:
                at = self.grams[g] = len(self.grams)
                v = np.ones(self.dimensions, np.int8)
                for k in range(self.gram):
                    v = v * np.roll(self.letter((g >> (21 * k)) & 0x1FFFFF), k)
                self.table[at] = v
            out[i] = at
        return out

    def profiles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit profile of each text (zero without letters), and its number of distinct n-grams (0 without letters)."""
        joined = "\n" + "".join(t.lower() + "\n" for t in texts)  # a blank before and after each text, wherever it stands
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        letter = self.is_letter(codes)
        doc = np.append(0, np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts]))
        kinds = np.zeros(len(texts), np.int64)
        code = np.where(letter, codes, 32).astype(np.int64)
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1]  # of each run of other signs the first stays, as a blank
        code, doc = code[keep], doc[keep]
        if len(code) < self.gram:
            return out, kinds
        n = len(code) - self.gram + 1
        gram = sum(code[k : k + n] << (21 * k) for k in range(self.gram))
        # only a blank may come from the text before, and from none after
        mid = (code[1 : 1 + n] != 32) & (doc[1 : 1 + n] == doc[self.gram - 1 :])
        distinct, inverse = np.unique(gram[mid], return_inverse=True)
        doc = doc[1 : 1 + n][mid]
        for at in range(0, len(distinct), self.most // 4):
            part = distinct[at : at + self.most // 4]
            rows = self.rows(part)
            for first in range(0, len(texts), 128):
                own = (inverse >= at) & (inverse < at + len(part)) & (doc >= first) & (doc < first + 128)
                m = min(128, len(texts) - first)
                counts = np.bincount((doc[own] - first) * len(part) + inverse[own] - at, minlength=m * len(part)).reshape(m, len(part)).astype(np.float32)
                kinds[first : first + m] += (counts > 0).sum(axis=1)
                used = np.flatnonzero(counts.any(axis=0))
                for some in np.array_split(used, len(used) // 4096 + 1):
                    out[first : first + m] += counts[:, some] @ self.table[rows[some]].astype(np.float32)
        norm = np.linalg.norm(out, axis=1)
        return out / np.maximum(norm, 1e-9)[:, None], kinds


_SPACES: dict[tuple[int, int], Space] = {}


def space(dimensions: int, gram: int) -> Space:
    if (dimensions, gram) not in _SPACES:
        _SPACES[(dimensions, gram)] = Space(dimensions, gram)
    return _SPACES[(dimensions, gram)]


def train(docs: DataFrame, max_train: int = MAX_TRAIN, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from docs (doc_id, text, lang), rows of null lang or text left out.

    About max_train / number of languages documents of each are bundled, so that every language is learned."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    quota = max_train / len(counts)
    shares = spark.createDataFrame([(r["lang"], int(min(1.0, quota / r["count"]) * (1 << 32))) for r in counts], "lang string, share long")
    # at most MAX_LANGUAGES rows are broadcast
    rows = rows.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 32) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        own = space(dimensions, gram)
        for langs, texts in common.text_slices(batches, 1 << 20):
            profiles, _ = own.profiles(texts)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + profiles[[x == lang for x in langs]].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted(((r["lang"], [y["x"] for y in r["v"]]) for r in summed.collect()))
    if not found:
        return [], np.zeros((0, dimensions), np.float32)
    m = np.array([v for _, v in found], np.float64)
    return [k for k, _ in found], (m / np.maximum(np.linalg.norm(m, axis=1), 1e-9)[:, None]).astype(np.float32)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray, gram: int = GRAM) -> DataFrame:
    """docs (text and any other columns) with lang_pred, score (cosine, 0 to 1) and grams (distinct n-grams) of every row.

    Null texts and texts without letters, and all texts where no language was learned, are `und` with
    score and grams 0. Equal cosines go to the first language by name. Only the text is read. Columns of docs
    may not have the names of the added ones."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, prototypes))  # at most MAX_LANGUAGES prototypes

    def score(texts: list[str]) -> tuple[list, list, list]:
        names, table = shared.value
        if not names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
        profiles, kinds = space(table.shape[1], gram).profiles(texts)
        cosines = profiles @ table.T
        best = cosines.argmax(axis=1)
        pred = [names[b] if h else UNDETERMINED for b, h in zip(best, kinds)]
        return pred, np.where(kinds > 0, np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1), 0.0), kinds

    return common.carried(docs, score, "lang_pred string, score double, grams long")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; prototypes come from rows whose crc32(doc_id) mod 4 is not 2."""
    langs, prototypes = train(docs.where(~common.held_out("doc_id", 4, 2)))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return identify(rows, langs, prototypes).select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
