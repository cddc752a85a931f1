"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences. Sentence scores are logistic in the sentence's words and word starts;
the document's score is their noisy-or, 1 - prod(1 - p). The weights are trained from document labels
alone, through the noisy-or, and the sentence scores then locate the offending sentences.

In a document of more than TYPICAL sentences the bias of each falls by FALL times the logarithm of their number over TYPICAL,
in training and in scoring: else many sentences that are each nearly sure to be clean would add up to a toxic document.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vocabulary import Memo

#: Labelled documents that are fitted: about this many, evenly by a hash of the id.
MAX_TRAIN = 6_000
#: Characters of these documents that the driver takes at most; of longer ones, fewer are fitted.
MAX_TRAIN_CHARS = 60_000_000
THRESHOLD = 0.3
#: Sentences from which on the bias falls, and the share of the logarithm by which it does: with all of it, one toxic
#: sentence among many thousands would be lost.
TYPICAL, FALL = 40, 0.75
#: Features seen in fewer training documents are left out; at most MAX_FEATURES are kept.
#: Of these, those stay whose share of toxic documents is SIGMA standard deviations or more from the mean share.
MIN_DOCS, MAX_FEATURES, SIGMA = 3, 60_000, 2.5
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word] if len(word) < 5 else [word, word[:4] + "*", word[:5] + "*"]


class Model:
    """Feature weights and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        if w not in self.words:
            if len(self.words) > 500_000:
                self.words.clear()
            self.words[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return self.words[w]

    def score(self, text: str) -> tuple[float, int, int, float]:
        """(document score, start and end of the most toxic sentence, its score)."""
        top, words, get, every = (-1e9, 0, 0), self.words, self.words.get, []
        for m in _SENTENCE.finditer(text):
            found = _WORD.findall(m[0].lower())
            if not found:
                continue
            z = self.bias
            for w in set(found):
                x = get(w)
                z += self.word(w) if x is None else x
            every.append(z)
            if z > top[0]:
                top = (z, *m.span())
        if not every:
            return 0.0, 0, 0, 0.0
        fall = FALL * math.log(max(1.0, len(every) / TYPICAL))
        stay = -np.logaddexp(0.0, np.array(every) - fall).sum()  # log of the product of 1 - sigmoid(z)
        return float(-np.expm1(stay)), top[1], top[2], float(1 / (1 + np.exp(-top[0])))


def fit(texts: list[str], labels: list[int], rounds: int = 300, decay: float = 2e-3, rate: float = 0.05) -> Model:
    """Trains by Adam on the cross-entropy of the noisy-or against document labels; no toxic label, no toxic text."""
    seen, toxic = Counter(), Counter()
    for text, label in zip(texts, labels):
        own = {f for w in set(_WORD.findall(text.lower())) for f in features(w)}
        seen.update(own)
        if label:
            toxic.update(own)
    share = sum(labels) / max(1, len(labels))
    telling = lambda f, n: abs(toxic[f] - n * share) >= SIGMA * (n * share * (1 - share)) ** 0.5
    names = [f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= MIN_DOCS and telling(f, n)][:MAX_FEATURES]
    at = {f: i for i, f in enumerate(names)}
    columns = Memo(lambda w: [at[f] for f in features(w) if f in at])
    cols, rows, doc = [], [], []
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            found = _WORD.findall(m[0].lower())
            if found:
                own = {c for w in found for c in columns[w]}
                cols += sorted(own)
                rows += [len(doc)] * len(own)
                doc.append(d)
    cols, rows, doc, y = np.array(cols, np.int64), np.array(rows, np.int64), np.array(doc, np.int64), np.array(labels, float)
    if not len(doc) or not y.any():
        return Model({}, -8.0)
    fall = FALL * np.log(np.maximum(1.0, np.bincount(doc, minlength=len(y)) / TYPICAL))[doc]
    w = np.zeros(len(names) + 1)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(doc)) + w[-1] - fall
        p = 1 / (1 + np.exp(-z))
        stay = np.exp(np.bincount(doc, -np.logaddexp(0.0, z), len(y)))  # prod(1 - p)
        # d loss / d z of a sentence: p if the label is 0, else -p * stay / (1 - stay)
        g = p * np.where(y == 1, -stay / np.maximum(1 - stay, 1e-6), 1.0)[doc] / len(y)
        grad = np.append(np.bincount(cols, g[rows], len(names)), g.sum())
        grad[:-1] += decay * w[:-1] / 100
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fits a model to about max_train labelled documents of at most max_chars characters together (chosen by a hash of
    doc_id); null texts, ids and labels are left out. A document with several labels takes the largest."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_train / max(1, known.count()))

    def some(rows: DataFrame) -> DataFrame:
        return rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int(share * (1 << 32)))

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    while (chars := some(texts).agg(F.sum(F.length("text"))).first()[0] or 0) > max_chars:
        share *= 0.9 * max_chars / chars
    rows = some(texts).join(some(known), "doc_id").select("text", "toxic").toPandas()
    order = sorted(range(len(rows)), key=lambda i: (rows["text"][i], rows["toxic"][i]))
    return fit([rows["text"][i] for i in order], [int(rows["toxic"][i] > 0) for i in order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text and any other columns) with score, predicted and the most toxic sentence (top_start,
    top_end in characters, top_score) of every row.

    Only the text is read. Null and empty texts have no sentence: score 0, not toxic. Columns of docs may
    not have the names of the added ones; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most MAX_FEATURES weights
    cache: dict[str, Model] = {}

    def run(texts: list[str]) -> list[list]:
        if "model" not in cache:
            cache["model"] = Model(*shared.value)
        found = list(map(cache["model"].score, texts))
        return [[x[0] for x in found], [int(x[0] >= threshold) for x in found], *([x[k] for x in found] for k in (1, 2, 3))]

    return common.carried(docs, run, "score double, predicted int, top_start long, top_end long, top_score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of all docs with held_out; learned from labels whose crc32(doc_id) mod 4 is not 2.

    Rows of equal or null ids stay rows of their own and are scored by their own text; a label counts for all texts of its
    id. An empty table of documents, or one without labels, gives scores of 0 for the rows there are."""
    model = train(docs, labels.where(~common.held_out("doc_id", 4, 2)))
    return score(docs.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "top_start", "top_end", "top_score")
