"""Formats beyond the built-in ones: decomposers that are registered by extension and run in batches on the executors.

A decomposer has format_name(), extensions, and decompose(content, path) -> (label, text) of each segment in order. Once
registered, its extensions are listed, read and dispatched like all others, and intake asks it for segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import EngineError

BUILT_IN = ("plain_text", "markdown", "html", "image", "epub", "pdf")


class Decomposer(Protocol):
    extensions: tuple[str, ...]

    def format_name(self) -> str: ...

    def decompose(self, content: bytes, path: str) -> Iterable[tuple[str, str]]: ...


_REGISTERED: dict[str, Decomposer] = {}


def register(decomposer: Decomposer) -> None:
    """Adds a format, or replaces one that was registered; formats and extensions that are built in cannot be taken."""
    from .files import EXTENSIONS

    name = decomposer.format_name()
    taken = {e for n, d in _REGISTERED.items() if n != name for e in d.extensions} | set(EXTENSIONS)
    if name in BUILT_IN or taken & set(decomposer.extensions):
        raise EngineError("ingest", f"the format {name!r} or one of its extensions is taken", "choose another")
    _REGISTERED[name] = decomposer


def unregister(name: str) -> None:
    _REGISTERED.pop(name, None)


def registered() -> dict[str, Decomposer]:
    return dict(_REGISTERED)


def extensions() -> dict[str, str]:
    """Extension -> format of all registered decomposers."""
    return {e: n for n, d in _REGISTERED.items() for e in d.extensions}


def custom_segments(files: DataFrame) -> DataFrame:
    """leaf_id, segment_index, segment_label, content_text, error from files (leaf_id, format, source_path, content) of
    registered formats. Empty texts give no segment; a decomposer's error is one row with the error alone."""
    known = registered()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, kind, path, content in zip(batch["leaf_id"], batch["format"], batch["source_path"], batch["content"]):
                try:
                    found = [(label, text) for label, text in known[kind].decompose(bytes(content), path) if text]
                    rows = [(leaf, i, label, text, None) for i, (label, text) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows = [(leaf, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["leaf_id", "segment_index", "segment_label", "content_text", "error"])
                yield out.astype({"segment_index": "Int32"})

    return files.select("leaf_id", "format", "source_path", "content").mapInPandas(run, "leaf_id string, segment_index int, segment_label string, content_text string, error string")
