"""Embedding providers and the operator that applies one to a column of texts in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


class Provider(Protocol):
    """What a provider offers; query_prefix goes before queries only.

    A provider may have embed_image_bytes(images) as well; without it images get no vectors."""

    provider_name: str
    model_name: str
    dimension: int
    query_prefix: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def embed_query(provider: Provider, query: str) -> list[float]:
    return checked(provider, [provider.query_prefix + query])[0]


def checked(provider: Provider, texts: list[str]) -> list[list[float]]:
    """embed_batch(); too few or too many vectors, or a wrong length, is an error."""
    return _whole(provider, provider.embed_batch(texts), len(texts))


def _whole(provider: Provider, found: list[list[float]], n: int) -> list[list[float]]:
    if len(found) != n or any(len(v) != provider.dimension for v in found):
        raise EngineError("embed", f"{provider.provider_name} gave {len(found)} vectors for {n} inputs, or wrong lengths", "check the provider")
    return found


class HashingProvider:
    """Counts of lower-cased words in buckets by md5: needs no model and is the same in every engine."""

    provider_name, model_name, query_prefix = "hashing", "md5-words", ""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"[^\W_]+", text.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimension] += 1.0
            out.append(v)
        return out


class HttpProvider:
    """An OpenAI-style endpoint: POST {model, input}, answers ordered by their index."""

    provider_name = "http"

    def __init__(self, url: str, model: str, dimension: int, token: str | None = None, batch_size: int = 32, timeout: float = 120, query_prefix: str = ""):
        if not url or not model:
            raise EngineError("embed", "the http provider needs a URL and a model", "set both")
        self.url, self.model_name, self.dimension, self.token = url, model, dimension, token
        self.batch_size, self.timeout, self.query_prefix = batch_size, timeout, query_prefix

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch_size):
            part = texts[i : i + self.batch_size]
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
            request = urllib.request.Request(self.url, json.dumps({"model": self.model_name, "input": part}).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    body = json.load(answer)
            except urllib.error.HTTPError as e:
                raise EngineError("embed", f"HTTP {e.code}: {e.read()[:500]!r}", "check the endpoint") from e
            if "error" in body:
                raise EngineError("embed", str(body["error"].get("message", body["error"])), "check the request")
            found: list[list[float] | None] = [None] * len(part)
            for item in body["data"]:
                if 0 <= item["index"] < len(part):
                    found[item["index"]] = item["embedding"]
            if None in found:
                raise EngineError("embed", "the answer lacks some of the vectors", "try again")
            out += found
        return out


def provider_of(kind: str | None, **options) -> Provider | None:
    """`hashing`, `http` or None (ingest without vectors)."""
    if kind is None:
        return None
    kinds = {"hashing": HashingProvider, "http": HttpProvider}
    if kind not in kinds:
        raise EngineError("embed", f"unknown provider {kind!r}", f"use one of {sorted(kinds)}")
    return kinds[kind](**options)


def embed_images(provider: Provider, images: list[bytes]) -> list[list[float]]:
    """Vectors of encoded images, checked as those of texts; an error if the provider has none for images."""
    own = getattr(provider, "embed_image_bytes", None)
    if own is None:
        raise EngineError("embed", f"{provider.provider_name} does not support images", "use a provider with embed_image_bytes")
    return _whole(provider, own(images), len(images))


def _embed(embed: Callable[[list], list[list[float]]], values: list, leaves: list, at: list[int], vectors: list, errors: list | None) -> None:
    """Sets vectors of the values at these places. Where embed() raises and errors is a list, the leaves among them are
    tried one by one, so that a leaf's error is its own."""
    try:
        for i, v in zip(at, embed([values[i] for i in at])):
            vectors[i] = v
    except Exception as e:  # the provider's error is the leaf's, not the job's, if errors are kept
        own = sorted({leaves[i] or "" for i in at})
        if errors is None:
            raise
        for leaf in own if len(own) > 1 else ():
            _embed(embed, values, leaves, [i for i in at if (leaves[i] or "") == leaf], vectors, errors)
        for i in at if len(own) == 1 else ():
            errors[i] = f"{type(e).__name__}: {e}"[:500]


def embed_chunks(chunks: DataFrame, provider: Provider | None, batch: int = 256, isolate: list[str] | None = None) -> DataFrame:
    """chunks with embedding, embed_provider, embed_model, embed_dimension; null texts get null vectors.

    A column image (binary, null for texts) is embedded where the provider takes images, and dropped. With isolate,
    columns that tell apart what an error may spoil (a leaf, or a segment), an error of the provider gives null vectors
    and its text in the column embed_error (null elsewhere); otherwise it fails the job."""
    image = F.col("image") if "image" in chunks.columns else F.lit(None).cast("binary")
    error = F.lit(None).cast("string")
    if provider is None:
        out = chunks.withColumns({"embedding": F.lit(None).cast("array<float>"), "embed_provider": F.lit("none"), "embed_model": F.lit("none"), "embed_dimension": F.lit(0)})
        return (out.withColumn("embed_error", error) if isolate else out).drop("image")
    sees = hasattr(provider, "embed_image_bytes")

    @F.pandas_udf("embedding array<float>, embed_error string")
    def vectors(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, images, leaves in parts:
            found: list = [None] * len(texts)
            errors: list | None = [None] * len(texts) if isolate else None
            jobs = [(lambda x: checked(provider, x), texts)] + ([(lambda x: embed_images(provider, [bytes(b) for b in x]), images)] if sees else [])
            for embed, column in jobs:
                some, values = [i for i, x in enumerate(column.notna()) if x], column.tolist()
                for i in range(0, len(some), batch):
                    _embed(embed, values, leaves.tolist(), some[i : i + batch], found, errors)
            yield pd.DataFrame({"embedding": pd.Series(found, dtype=object), "embed_error": pd.Series(errors or [None] * len(found), dtype=object)})

    leaf = F.concat_ws("|", *isolate) if isolate else F.lit("")
    out = chunks.withColumn("_e", vectors(F.col("content_text"), image, leaf)).withColumn("embedding", F.col("_e.embedding"))
    out = out.withColumns({"embed_provider": F.lit(provider.provider_name), "embed_model": F.lit(provider.model_name), "embed_dimension": F.lit(provider.dimension)})
    return (out.withColumn("embed_error", F.col("_e.embed_error")) if isolate else out).drop("_e", "image")
