"""Extensions: BM25, reciprocal-rank fusion and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of documents with at least one of the terms. Only hits of the terms are exploded."""
    terms = sorted(set(terms))
    rows = docs.select(key, words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    docs_n, mean = rows.agg(F.count("*"), F.avg("n")).first()
    hits = rows.select(key, "n", F.explode(F.filter("w", lambda w: w.isin(terms))).alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term")  # df has a row for each term
    idf = F.log(1 + (docs_n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(float(mean or 1))))
    return joined.groupBy(key).agg(F.sum(idf * weight).alias("score"))


def fuse(key: str, *ranked: DataFrame, limit: int = 20, pool: int = 100) -> DataFrame:
    """Reciprocal-rank fusion of tables (key, score), each cut to its best pool rows first."""
    parts = None
    for i, r in enumerate(ranked):
        top = r.orderBy(F.desc("score"), key).limit(pool)
        rank = F.row_number().over(W.orderBy(F.desc("score"), key))  # at most pool rows
        own = top.select(key, (1 / (RRF_K + rank)).alias(f"_{i}"))
        parts = own if parts is None else parts.join(own, key, "full_outer")
    total = sum((F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(len(ranked))), F.lit(0.0))
    return parts.select(key, total.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """The share of the query's distinct words that a text has: a scorer that needs no model."""
    cut = lambda t: {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    asked = cut(query)
    return [len(asked & cut(t)) / max(len(asked), 1) for t in texts]


def rerank(found: DataFrame, key: str, text: str, query: str, scorer: Callable[[str, list[str]], list[float]] = word_overlap, limit: int = 20, pool: int = 100) -> DataFrame:
    """The best pool rows of found (key, text, score), scored anew by scorer(query, texts); the best limit of these by
    that score, then the first one, then the key. The first score is kept as first_score."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.tolist()), index=texts.index, dtype="float64")

    top = found.orderBy(F.desc("score"), key).limit(pool).withColumnRenamed("score", "first_score")
    return top.withColumn("score", scored(F.col(text))).orderBy(F.desc("score"), F.desc("first_score"), key).limit(limit)
