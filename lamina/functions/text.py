"""Text functions as column expressions; lengths are in characters unless a name says bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, for Java and RE2 patterns alike (fixed values).
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Entities in the order in which they are decoded (fixed values); &amp; first, so &amp;lt; becomes <.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items that a fold takes before it puts what it found aside.
FOLD_BLOCK = 4096


def fold(items: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], found: str, finish: Callable[[Column, Column], Column]) -> Column:
    """finish(state, all that was found) of a fold over items; step gives the next state, and what it found as `found`,
    an array of type `found`.

    Arrays are copied when they grow, so what was found is gathered by blocks of items and joined once at the end: the
    work is linear in the items for texts of any size that a cell can hold. items has to be a bound value (let)."""
    state = lambda d: [v.alias(k) for k, v in d.items()]
    none = F.array().cast(found)

    def one(acc: Column, x: Column) -> Column:
        def joined(n: Column) -> Column:
            more = F.when(F.size(n["found"]) > 0, F.concat(acc["found"], n["found"])).otherwise(acc["found"])
            return F.struct(*(n[k].alias(k) for k in start), more.alias("found"))

        return let(F.struct(*state(step(acc, x))), joined)

    def block(acc: Column, b: Column) -> Column:
        own = F.slice(items, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))
        inner = F.aggregate(own, F.struct(*(acc[k].alias(k) for k in start), none.alias("found")), one)
        return let(inner, lambda r: F.struct(*(r[k].alias(k) for k in start), F.concat(acc["blocks"], F.array(r["found"])).alias("blocks")))

    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / FOLD_BLOCK).cast("int")
    zero = F.struct(*state(start), F.array().cast(f"array<{found}>").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), last), zero, block, lambda acc: finish(acc, F.flatten(acc["blocks"])))


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{SPACE}+", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"{SPACE}+\z", "")


def trim(x: Column) -> Column:
    """Trims all Unicode white space (the built-in trim only takes U+0020)."""
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def strip_tags(x: Column) -> Column:
    """Drops <...> (to the end if unclosed) and stray >; adds no white space; then decodes entities."""
    return decode_entities(F.regexp_replace(F.regexp_replace(x, "<[^>]*>?", ""), ">", ""))


def decode_entities(x: Column) -> Column:
    for name, value in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(value))
    return x


def basename(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def extension(path: Column) -> Column:
    """Extension without the dot; null for none and for names that only start with a dot."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]*)$", 1), F.lit(""))
