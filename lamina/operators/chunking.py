"""Structure-aware chunks of a text as one array fold; no Python and no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHARS_PER_TOKEN = 4
#: Scores of line kinds (fixed values): headings by level, fences, blank lines, sentence ends.
HEADING, FENCE, BLANK, SENTENCE = (100, 95, 90, 85, 85, 85), 80, 20, 10
NONE, BEFORE, FENCE_KIND, AFTER = 0, 1, 2, 3


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens. overlap repeats that many characters * 4 of the chunk before (0: none)."""

    target_tokens: int = 512
    tolerance_tokens: int = 256
    overlap_tokens: int = 0

    def __post_init__(self) -> None:
        if self.target_tokens <= 0 or self.tolerance_tokens >= self.target_tokens:
            raise ValueError("target must be positive and tolerance smaller than target")

    @property
    def target(self) -> int:
        return self.target_tokens * CHARS_PER_TOKEN

    @property
    def least(self) -> int:
        return (self.target_tokens - self.tolerance_tokens) * CHARS_PER_TOKEN

    @property
    def ceiling(self) -> int:
        return (self.target_tokens + self.tolerance_tokens) * CHARS_PER_TOKEN


def classify_line(line: Column) -> Column:
    """struct<score int, kind int>: kind says whether a break may go before or after the line, or a fence toggles."""
    t = T.trim(line)
    hashes = F.length(F.regexp_extract(t, r"^(#{1,6})(?: |\z)", 1))

    def kind(score: Column | int, k: int) -> Column:
        return F.struct((score if isinstance(score, Column) else F.lit(score)).cast("int").alias("score"), F.lit(k).alias("kind"))

    level = F.get(F.array(*map(F.lit, HEADING)), hashes - 1)
    return (
        F.when(hashes > 0, kind(level, BEFORE))
        .when(t.startswith("```") | t.startswith("~~~"), kind(FENCE, FENCE_KIND))
        .when(t == "", kind(BLANK, AFTER))
        .when(F.right(t, F.lit(1)).isin(".", "?", "!"), kind(SENTENCE, AFTER))
        .otherwise(kind(0, NONE))
    )


def fence_states(lines: Column) -> Column:
    """lines as structs (score, kind, open) with fences resolved: any fence marker closes any other, and
    lines inside a fence score 0. open tells whether the line stands inside a fence."""
    classes = F.transform(lines, classify_line)

    def resolved(c: Column) -> Column:
        # lines up to and with fence k lie inside if k is odd: a run of equal states for each fence, and one for the rest
        at = F.concat(F.filter(F.transform(c, lambda x, i: F.when(x["kind"] == FENCE_KIND, i)), lambda i: i.isNotNull()), F.array(F.size(c) - 1))
        runs = T.let(at, lambda p: F.flatten(F.transform(p, lambda e, k: F.array_repeat(k % 2 == 1, e - F.when(k == 0, -1).otherwise(F.get(p, k - 1))))))
        return F.zip_with(c, runs, state)

    def state(x: Column, inside: Column) -> Column:
        fence = x["kind"] == FENCE_KIND
        score = F.when(~fence & inside, 0).otherwise(x["score"]).cast("int")
        kind = F.when(fence, F.when(inside, AFTER).otherwise(BEFORE)).when(inside, NONE).otherwise(x["kind"]).cast("int")
        return F.struct(score.alias("score"), kind.alias("kind"), inside.alias("open"))

    return T.let(classes, resolved)


def decay(size: Column, target: int) -> Column:
    """1 at the target, falling to 0 at 0 and at twice the target."""
    if not target:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1 - F.abs(size - target) / F.lit(float(target)))


def _cuts(lines: Column, cfg: ChunkConfig) -> Column:
    """Line ranges array<struct<s,e>> (e excluded) before trimming."""
    items = F.transform(lines, lambda x, i: F.struct(i.alias("i"), (F.length(x) + 1).alias("n"), classify_line(x).alias("c")))
    start = {"st": F.lit(0), "sz": F.lit(0), "open": F.lit(False)}
    kind_of_cuts = "array<struct<s:int,e:int>>"

    def good(score: Column, size: Column) -> Column:
        return (score * decay(size, cfg.target) >= 10) | (size >= cfg.target)

    def step(acc: Column, x: Column) -> dict[str, Column]:
        fence = x["c"]["kind"] == FENCE_KIND
        score = F.when(~fence & acc["open"], 0).otherwise(x["c"]["score"])
        kind = F.when(fence, F.when(acc["open"], AFTER).otherwise(BEFORE)).when(acc["open"], NONE).otherwise(x["c"]["kind"])
        size = acc["sz"] + x["n"]
        before = (kind == BEFORE) & (x["i"] > acc["st"]) & (acc["sz"] >= cfg.least) & good(score, acc["sz"])
        st = F.when(before, x["i"]).otherwise(acc["st"])
        sz = F.when(before, x["n"]).otherwise(size)
        after = (size >= cfg.least) & (((kind == AFTER) & good(score, size)) | ((sz >= cfg.least) & (sz >= cfg.ceiling)))
        cut = lambda on, s, e: F.when(on, F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))).otherwise(F.array().cast(kind_of_cuts))
        return {
            "st": F.when(after, x["i"] + 1).otherwise(st).cast("int"), "sz": F.when(after, 0).otherwise(sz).cast("int"), "open": fence != acc["open"],
            "found": F.concat(cut(before, acc["st"], x["i"]), cut(after, st, x["i"] + 1)),
        }

    def finish(acc: Column, cuts: Column) -> Column:
        rest = F.array(F.struct(acc["st"].alias("s"), F.size(lines).alias("e")))
        return F.concat(cuts, F.when(acc["st"] < F.size(lines), rest).otherwise(F.array().cast(kind_of_cuts)))

    return T.let(items, lambda bound: T.fold(bound, start, step, kind_of_cuts, finish))


def chunks(content: Column, label: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<chunk_index, chunk_label, content_text>> of a text; null text has none."""
    whole = F.array(content)
    many = T.let(F.split(content, "\n", -1), lambda lines: F.transform(_cuts(lines, cfg), lambda c: T.rtrim(F.array_join(F.slice(lines, c["s"] + 1, c["e"] - c["s"]), "\n"))))
    parts = F.when(F.length(content) <= cfg.ceiling, whole).otherwise(F.filter(many, lambda x: x != ""))
    if cfg.overlap_tokens:
        n = cfg.overlap_tokens * CHARS_PER_TOKEN
        parts = T.let(parts, lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(p, i - 1), F.lit(n)), x))))

    def numbered(p: Column) -> Column:
        name = lambda i: F.when(F.size(p) > 1, F.concat(label, F.lit(" ["), (i + 1).cast("string"), F.lit("/"), F.size(p).cast("string"), F.lit("]"))).otherwise(label)
        return F.transform(p, lambda x, i: F.struct(i.alias("chunk_index"), name(i).alias("chunk_label"), x.alias("content_text")))

    return F.when(content.isNotNull(), T.let(parts, numbered))


def chunk_segments(segments: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row for each chunk of segments (leaf_id, segment_index, segment_label, content_text)."""
    rows = segments.select("leaf_id", "segment_index", F.explode(chunks(F.col("content_text"), F.col("segment_label"), cfg)).alias("c"))
    return rows.select("leaf_id", "segment_index", "c.chunk_index", "c.chunk_label", "c.content_text")
