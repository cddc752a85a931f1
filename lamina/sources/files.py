"""Files: walking, allow-list, format dispatch, reading and hashing."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T
from . import decomposers

#: Extensions that a directory walk takes (fixed values, case-sensitive).
EXTENSIONS = ("pdf", "epub", "png", "jpg", "jpeg", "md", "markdown", "html", "htm", "txt")
FORMATS = {"pdf": "pdf", "epub": "epub", "png": "image", "jpg": "image", "jpeg": "image", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}


def _suffix(name: str) -> str:
    return name.rpartition(".")[2] if "." in name.lstrip(".") and name.rpartition(".")[0] else ""


def supported(path: str) -> bool:
    return _suffix(os.path.basename(path)) in known_extensions()


def known_extensions() -> tuple[str, ...]:
    """The built-in extensions and those of registered decomposers."""
    return (*EXTENSIONS, *decomposers.extensions())


def collect_files(folder: str) -> list[str]:
    """All supported files below folder, sorted; folders whose name starts with a dot are left out."""
    found, seen = [], {os.path.realpath(folder)}
    for at, folders, names in os.walk(folder, followlinks=True):
        real = {d: os.path.realpath(os.path.join(at, d)) for d in folders if not d.startswith(".")}
        folders[:] = [d for d in sorted(real) if real[d] not in seen]  # a folder that links lead to again is walked once
        seen.update(real[d] for d in folders)
        found += [os.path.join(at, n) for n in names if supported(n)]
    return sorted(found)


def expand(paths: list[str], recursive: bool) -> list[str]:
    """Files in the order of the arguments, each folder sorted; a folder needs recursive."""
    out = []
    for p in paths:
        if os.path.isdir(p):
            if not recursive:
                raise EngineError("ingest", f"{p} is a directory", "pass recursive")
            out += collect_files(p)
        else:
            out.append(p)
    return out


def format_of(path: Column) -> Column:
    """Format by exact extension; everything else, upper-case ones too, is plain_text."""
    e = T.extension(path)
    out = F.lit("plain_text")
    for name, kind in (FORMATS | decomposers.extensions()).items():
        out = F.when(e == name, kind).otherwise(out)
    return out


def allowed(path: Column) -> Column:
    return F.coalesce(T.extension(path).isin(*known_extensions()), F.lit(False))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_path, content, content_hash (sha-256), format of given files, in one distributed scan.

    Paths are literal: signs that a glob would read are escaped. Spark's reader leaves out names that start with a
    dot or an underscore."""
    return described(spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """read_files() of all supported files below a folder of any file system that Spark reads; names are chosen while
    files are listed, so no other file is opened. Names that start with a dot or an underscore are left out."""
    names = "*.{" + ",".join(known_extensions()) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    return described(rows).where(allowed(F.col("source_path")))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """source_path, modified, length of all supported files below a folder; no file is opened."""
    names = "*.{" + ",".join(known_extensions()) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(path.alias("source_path"), F.col("modificationTime").alias("modified"), "length").where(allowed(F.col("source_path")))


def described(rows: DataFrame) -> DataFrame:
    """source_path, content, content_hash, format of rows of a binary-file scan."""
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(path.alias("source_path"), "content", F.sha2("content", 256).alias("content_hash"), format_of(path).alias("format"))
