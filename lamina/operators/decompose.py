"""Texts and files into segments: column expressions array<struct<segment_index, segment_label, content_text>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Sizes in bytes: a segment's target, and a paragraph that sticks to its neighbours.
TARGET, STICKY = 1500, 80
PREAMBLE = "preamble"
HEADING_LINE = rf"^{T.SPACE}*#{{1,6}}(?: |\z)"
HEADING_TAG = r"(?is)<h([1-6])(?:>| [^>]*>)(.*?)</h\1>"


def _indexed(parts: Column) -> Column:
    return F.transform(parts, lambda x, i: F.struct(i.alias("segment_index"), x["label"].alias("segment_label"), x["text"].alias("content_text")))


def plain_label(part: Column) -> Column:
    """The first line without leading signs, lower-cased; `section` if it is empty or over 80 bytes."""
    line = T.trim(F.regexp_replace(F.get(F.split(part, "\n", 2), F.lit(0)), "^[- =#]+", ""))
    return T.let(line, lambda x: F.when((x == "") | (F.octet_length(x) > STICKY), F.lit("section")).otherwise(F.lower(x)))


def plain_text(text: Column) -> Column:
    """Paragraphs (split at blank lines) packed into segments of about 1500 bytes.

    Short paragraphs at the end of a full segment move on to the next one, and runs of short ones are not parted."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), T.trim), lambda x: x != "")

    def pack(ps: Column) -> Column:
        # the open segment is a range of paragraphs from `s` on: n of them, len bytes, of which tail bytes stand after the
        # k-th, its last long paragraph (or its first one, if all are short)
        zero = {x: F.lit(0) for x in ("i", "s", "n", "len", "k", "tail", "last")}

        def step(acc: Column, p: Column) -> dict[str, Column]:
            size = F.octet_length(p)
            short = size <= STICKY
            stays = (acc["n"] == 0) | (acc["len"] + size <= TARGET) | (short & (acc["last"] <= STICKY))
            s = F.when(stays, acc["s"]).otherwise(acc["s"] + acc["k"])
            n = F.when(stays, acc["n"]).otherwise(acc["n"] - acc["k"]) + 1
            after = acc["tail"] + size
            size_of_first = F.when(n == 1, size).otherwise(F.octet_length(F.get(ps, s)))
            new = {
                "i": acc["i"] + 1, "s": s, "n": n, "len": F.when(stays, acc["len"] + size).otherwise(after), "k": F.when(~short | (n == 1), n).when(stays, acc["k"]).otherwise(1),
                "tail": F.when(~short | (n == 1), 0).when(stays, after).otherwise(after - size_of_first), "last": size,
            }
            new = {x: v.cast("int") for x, v in new.items()}
            return new | {"found": F.when(stays, F.array().cast("array<int>")).otherwise(F.array(s.cast("int")))}

        def ranges(acc: Column, starts: Column) -> Column:
            at = F.when(acc["n"] > 0, F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
            return T.let(at, lambda a: F.transform(a, lambda x, i: F.slice(ps, x + 1, F.coalesce(F.get(a, i + 1), F.size(ps)) - x)))

        return T.fold(ps, zero, step, "array<int>", ranges)

    named = lambda g: F.struct(plain_label(F.get(g, F.lit(0))).alias("label"), F.array_join(g, "\n\n").alias("text"))
    return _indexed(F.transform(T.let(paragraphs, pack), named))


def markdown(text: Column) -> Column:
    """Sections by headings (#, 1 to 6, any indentation); the heading is the label; flat; empty sections go."""
    return T.let(F.split(text, "\r?\n", -1), _markdown)


def _markdown(lines: Column) -> Column:
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].rlike(HEADING_LINE))
    heads = F.transform(marks, lambda m: F.struct(m["i"].alias("i"), T.trim(F.regexp_replace(T.ltrim(m["x"]), "^#{1,6}", "")).alias("label")))
    all_heads = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(PREAMBLE).alias("label"))), heads)

    def sections(h: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(h, j + 1)["i"], F.size(lines))
            return F.struct(x["label"].alias("label"), T.trim(F.array_join(F.slice(lines, x["i"] + 2, stop - x["i"] - 1), "\n")).alias("text"))

        return F.filter(F.transform(h, one), lambda s: s["text"] != "")

    return _indexed(T.let(all_heads, sections))


def html(text: Column) -> Column:
    """Sections by h1 to h6; tags stripped, entities decoded; the heading's text is the label; empty sections go."""
    bodies = F.split(text, HEADING_TAG, -1)

    def named(titles: Column) -> Column:
        label = lambda i: F.when(i == 0, F.lit(PREAMBLE)).otherwise(T.trim(T.strip_tags(F.get(titles, i - 1))))
        return F.transform(bodies, lambda b, i: F.struct(label(i).alias("label"), T.trim(T.strip_tags(b)).alias("text")))

    parts = T.let(F.regexp_extract_all(text, F.lit(HEADING_TAG), F.lit(2)), named)
    return _indexed(F.filter(parts, lambda s: s["text"] != ""))


def image(path: Column) -> Column:
    """One segment without text, labelled by the file's name."""
    return F.array(F.struct(F.lit(0).alias("segment_index"), T.basename(path).alias("segment_label"), F.lit(None).cast("string").alias("content_text")))


SEGMENTS = "array<struct<segment_index:int,segment_label:string,content_text:string>>"


def segments_of(leaves: DataFrame) -> DataFrame:
    """Segments of text leaves (leaf_id, format, source_path, text); other formats come from sources."""
    f = F.col("format")
    found = F.when(f == "markdown", markdown(F.col("text"))).when(f == "html", html(F.col("text"))).when(f == "image", image(F.col("source_path"))).otherwise(plain_text(F.col("text")))
    return leaves.select("leaf_id", F.explode(found.cast(SEGMENTS)).alias("s")).select("leaf_id", "s.segment_index", "s.segment_label", "s.content_text")
