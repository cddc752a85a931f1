"""EPUB files into segments, by the spine; runs in Arrow batches over binary content."""

from __future__ import annotations

import html as html_module
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import ENTITIES

_TAG = re.compile(r"<[^>]*>?")


def plain(xhtml: str) -> str:
    """Text without tags, entities decoded as for HTML segments."""
    x = _TAG.sub("", xhtml).replace(">", "")
    for name, value in ENTITIES:
        x = x.replace(name, value)
    return x.strip()


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""(?:^|[\s<]){re.escape(name)}\s*=\s*("([^"]*)"|'([^']*)')""", tag, re.I)
    return (m[2] if m[2] is not None else m[3]) if m else None


def _tags(xml: str, name: str) -> list[str]:
    return re.findall(rf"<(?:\w+:)?{name}\b[^>]*>", xml, re.I)


def _toc(book: zipfile.ZipFile, manifest: dict[str, tuple[str, str]], base: str) -> dict[str, str]:
    """href -> label; the first label of an href counts; NCX before the navigation document."""
    out: dict[str, str] = {}
    for href, _ in manifest.values():
        if href.endswith(".ncx") and (xml := _read(book, base + href)) is not None:
            for point in re.split(r"<navPoint\b", xml)[1:]:
                label, src = re.search(r"<text[^>]*>(.*?)</text>", point, re.S), re.search(r"<content\b[^>]*>", point)
                if label and src and (target := _attribute(src[0], "src")):
                    out.setdefault(target.split("#")[0], plain(label[1]))
            return out
    for href, properties in manifest.values():
        if "nav" in properties.split() and (xml := _read(book, base + href)) is not None:
            for tag, inner in re.findall(r"(<a\b[^>]*>)(.*?)</a>", xml, re.S | re.I):
                if target := _attribute(tag, "href"):
                    out.setdefault(target.split("#")[0], plain(inner))
            break
    return out


def _read(book: zipfile.ZipFile, name: str) -> str | None:
    try:
        return book.read(name).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def segments(content: bytes) -> list[tuple[int, str, str]]:
    """(index, label, text) of each spine item with text; ValueError if it is no EPUB file."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a zip file") from e
    container = _read(book, "META-INF/container.xml")
    roots = [_attribute(t, "full-path") for t in _tags(container or "", "rootfile")]
    if not roots or not roots[0] or (opf := _read(book, roots[0])) is None:
        raise ValueError("no package document")
    base = roots[0].rpartition("/")[0]
    base = f"{base}/" if base else ""
    manifest = {i: (html_module.unescape(h), _attribute(t, "properties") or "") for t in _tags(opf, "item") if (i := _attribute(t, "id")) and (h := _attribute(t, "href"))}
    toc, out = _toc(book, manifest, base), []
    for t in _tags(opf, "itemref"):
        href = manifest.get(_attribute(t, "idref") or "", (None,))[0]
        xhtml = _read(book, base + href) if href else None
        if xhtml is None or not (text := plain(xhtml)):
            continue
        label = toc.get(href) or toc.get(base + href) or f"chapter {len(out) + 1}"
        out.append((len(out), label, text))
    return out


def epub_segments(files: DataFrame) -> DataFrame:
    """leaf_id, segment_index, segment_label, content_text, error from files (leaf_id, content).

    A broken file gives one row with the error alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for leaf, content in zip(pdf["leaf_id"], pdf["content"]):
                try:
                    rows += [(leaf, i, label, text, None) for i, label, text in segments(content)]
                except Exception as e:  # noqa: BLE001  a broken, encrypted or unsupported member is a row, not a failed job
                    rows.append((leaf, None, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["leaf_id", "segment_index", "segment_label", "content_text", "error"])
            yield out.astype({"segment_index": "Int32"})

    return files.select("leaf_id", "content").mapInPandas(run, "leaf_id string, segment_index int, segment_label string, content_text string, error string")
