"""Repair of the structure of conversations by a retained-subsequence DP (operator 12).

A conversation's turns are kept, reroled or deleted, and empty turns inserted, so that the initials of its roles read
(s?(ua)+)?. The DP runs over retained turns. What stands between two retained turns is priced by prefix sums of
deletions, of which each state (nothing yet, s, u, a) keeps the running minimum of cost less prefix sum; the pair of
roles says how many turns are inserted. Equal costs go by the audit, the edits' initials.

A conversation may hold any share of the rows. Its turns are numbered by a distributed sort, and cut into blocks of
BLOCK. A block becomes a summary: for each state before and after it the cheapest cost, and the rank of its audit among
the block's audits. Audits of whole blocks are never a beginning of one another, so ranks of consecutive blocks
compare as the audits do, and FAN summaries compose to one of the same size, tier by tier. On the way back each block
gets its states, and runs its DP once more for its edits. Only the digest of a repaired text is taken in sequence: turns
stream through one task for each conversation in order, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Turns of a block, and blocks or summaries that are composed in one row.
BLOCK, FAN = 4096, 512
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States: the role retained last.
START, S, U, A = range(4)
ROLES = {"s": S, "u": U, "a": A}
NAMES = {"u": "user", "a": "assistant"}
#: Roles that are inserted between two retained ones, and after the last one.
BETWEEN = {(START, S): "", (START, U): "", (START, A): "u", (S, U): "", (S, A): "u", (U, U): "a", (U, A): "", (A, U): "", (A, A): "u"}
AFTER = ("", "ua", "a", "")
#: Codes of turns: the initial if it is one of ROLES, else x; upper case for truncated turns; d for those that must go.
_CHOICES = {c: [(r, 0, "K") for x, r in ROLES.items() if x == c] + [(r, REROLE, "R") for r in (U, A) if ROLES.get(c) != r] for c in "suax"}
CHOICES = _CHOICES | {c.upper(): [(r, x + TRUNCATED, e) for r, x, e in own] for c, own in _CHOICES.items()} | {"d": []}


@lru_cache(20_000)
def fold(codes: str, entry: int) -> tuple[tuple[int, str] | None, ...]:
    """For each state after a block of turns the cheapest (cost, audit) from the state before it; None if there is none.

    Inserted turns stand right before the retained turn that needs them, behind the deletions before it."""
    # least[q]: cost less the prefix sum of deletions up to the retained turn, its audit, the number of turns up to it
    least: list[tuple[int, str, int] | None] = [None] * 4
    least[entry] = (0, "", 0)
    for i, code in enumerate(codes):
        deleted = DELETE * i
        found: list[tuple[int, str] | None] = [None] * 4
        for role, cost, edit in CHOICES[code]:
            for q, old in enumerate(least):
                added = BETWEEN.get((q, role))
                if old is None or added is None:
                    continue
                price = old[0] + deleted + INSERT * len(added) + cost
                if found[role] is None or price <= found[role][0]:
                    new = (price, old[1] + "D" * (i - old[2]) + "I" * len(added) + edit)
                    found[role] = new if found[role] is None else min(found[role], new)
        for role, new in enumerate(found):
            if new is not None:
                old, price = least[role], new[0] - deleted - DELETE
                if old is None or (price, new[1]) < (old[0], old[1] + "D" * (i + 1 - old[2])):
                    least[role] = (price, new[1], i + 1)
    n = len(codes)
    return tuple(None if x is None else (x[0] + DELETE * n, x[1] + "D" * (n - x[2])) for x in least)


Summary = list  # for 4 * entry + exit: (cost, rank of the audit) or None


def _ranks(found: list[tuple[int, object] | None]) -> Summary:
    """Costs with the ranks of what they stand for."""
    order = {key: i for i, key in enumerate(sorted({x[1] for x in found if x is not None}))}
    return [None if x is None else (x[0], order[x[1]]) for x in found]


def summary(codes: str) -> Summary:
    return _ranks([x for entry in range(4) for x in fold(codes, entry)])


def compose(parts: list[Summary]) -> tuple[Summary, list[list[int | None]]]:
    """The summary of consecutive parts, and for each part and 4 * entry + exit the state before the part."""
    total: Summary = [(0, 0) if p == q else None for p in range(4) for q in range(4)]
    back = []
    for part in parts:
        found, before = [], []
        for entry in range(4):
            for state in range(4):
                ways = [(total[4 * entry + q][0] + part[4 * q + state][0], (total[4 * entry + q][1], part[4 * q + state][1]), q) for q in range(4) if total[4 * entry + q] and part[4 * q + state]]
                best = min(ways, default=None)
                found.append(best and best[:2])
                before.append(best and best[2])
        total = _ranks(found)
        back.append(before)
    return total, back


def best_end(whole: Summary) -> int:
    """The last state of the cheapest repair of a whole conversation, ties by audit."""
    return min((x[0] + INSERT * len(AFTER[q]), x[1], q) for q, x in enumerate(whole[:4]) if x is not None)[2]


def states_within(parts: list[Summary], entry: int, state: int) -> list[tuple[int, int]]:
    """The states before and after each part on the best way from entry to state."""
    out = []
    for before in reversed(compose(parts)[1]):
        q = before[4 * entry + state]
        out.append((q, state))
        state = q
    return out[::-1]


def edits_of(codes: str, entry: int, state: int) -> list[tuple[str, str, str]]:
    """(edit, roles inserted before the turn, new role of a reroled turn) of each turn of a block."""
    out, inserted, q, turn = [], 0, entry, iter(codes)
    for x in fold(codes, entry)[state][1]:
        if x == "I":
            inserted += 1
            continue
        code = next(turn).lower()
        if x == "D":
            out.append((x, "", ""))
            continue
        role = ROLES[code] if x == "K" else next(r for r in (U, A) if len(BETWEEN[q, r]) == inserted)
        out.append((x, BETWEEN[q, role], "" if x == "K" else "sua"[role - 1]))
        q, inserted = role, 0
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows, damaged by a hash of conversation and turn: dropped, emptied, cut, repeated, or
    given the role user. Nulls are one space, but for those of conv_id and turn, which stay null."""
    sign = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(sign("conv_id"), F.lit(":"), sign("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(sign("text"), "[.!?]", "")).otherwise(sign("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where(kind != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(sign("role")).alias("role"), text.alias("text"), F.explode(copies))
    return out.drop("col")


def _key(rows: DataFrame) -> Column:
    """A conversation as a string that is not null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Stored turns of rows (conv_id, turn, role, text) in order: c (the conversation's key), turn, role, digest, text, at."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    return common.in_order(rows.select(_key(rows).alias("c"), "turn", "role", digest.alias("digest"), "text"), "c", "turn", "role", "digest")


def faults(turns: DataFrame) -> DataFrame:
    """c, at, code, fault (blank, duplicate, truncated or null: the first that holds) of ordered turns, without texts.

    A turn is a duplicate if its conversation has its role and text earlier; that is found by the least `at` of each
    conversation, role and digest, and joined by `at`, which is unique."""
    seen = turns.groupBy("c", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    end = F.rtrim("text", F.lit(SPACE))
    rows = turns.select("c", "at", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    code = F.when(F.col("initial").isin(*ROLES), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return rows.join(seen, "at", "left").select("c", "at", "initial", fault.alias("fault")).select("c", "at", code.alias("code"), "fault")


_STATES = "c string, b long, entry int, state int"
_SUMMARY = "array<struct<cost:long,rank:int>>"


def _read(values: list) -> Summary:
    return [None if x is None else (x["cost"], x["rank"]) for x in values]


def _streamed(rows: DataFrame, function: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """function(rows of a partition as dicts) -> rows, in Arrow batches of a bounded number of rows."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = function(r for batch in batches for first in range(0, batch.num_rows, 256) for r in batch.slice(first, 256).to_pylist())
        while part := list(islice(own, 256)):
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x)) for x in part], kinds)

    return rows.mapInArrow(run, schema)


def _mapped(rows: DataFrame, function: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """function(row) -> rows, for every row."""
    return _streamed(rows, lambda own: (x for r in own for x in function(r)), schema)


def edits(marks: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """c, at, edit (K, R or D), before (initials of roles inserted before the turn), role (the new initial, if reroled),
    after (inserted behind the conversation's last turn) of every turn of faults()."""
    ranked = common.ranked(marks, "c")
    own = F.sort_array(F.collect_list(F.struct("rank", "at", "code")))  # at most `block` turns
    blocks = ranked.groupBy("c", F.floor(F.col("rank") / block).cast("long").alias("b")).agg(own.alias("m")).select("c", "b", F.array_join("m.code", "").alias("codes"), F.col("m.at").alias("ats"))
    blocks = common.stored(blocks, "blocks")
    pack = lambda s: [x and {"cost": x[0], "rank": x[1]} for x in s]
    tiers = [common.stored(_mapped(blocks.select("c", "b", "codes"), lambda r: [(r["c"], r["b"], pack(summary(r["codes"])))], f"c string, b long, s {_SUMMARY}"), "summaries")]
    while (tiers[-1].agg(F.max("b")).first()[0] or 0) > 0:
        group = tiers[-1].groupBy("c", F.floor(F.col("b") / fan).cast("long").alias("b")).agg(F.sort_array(F.collect_list(F.struct("b", "s"))).alias("m"))
        tiers.append(common.stored(_mapped(group.select("c", "b", F.col("m.s").alias("parts")), lambda r: [(r["c"], r["b"], pack(compose(list(map(_read, r["parts"])))[0]))], f"c string, b long, s {_SUMMARY}"), "summaries"))
    states = _mapped(tiers[-1], lambda r: [(r["c"], 0, START, best_end(_read(r["s"])))], _STATES)
    for below in reversed(tiers[:-1]):
        group = below.groupBy("c", F.floor(F.col("b") / fan).cast("long").alias("b")).agg(F.sort_array(F.collect_list(F.struct("b", "s"))).alias("m")).join(states, ["c", "b"])
        step = lambda r: [(r["c"], r["b"] * fan + i, *x) for i, x in enumerate(states_within(list(map(_read, r["parts"])), r["entry"], r["state"]))]
        states = _mapped(group.select("c", "b", "entry", "state", F.col("m.s").alias("parts")), step, _STATES)
    ends = ranked.groupBy("c").agg(F.max("rank").alias("last"))
    solved = blocks.join(states, ["c", "b"]).join(ends, "c")

    def expand(r: dict) -> list[tuple]:
        rows = [(r["c"], at, *x, "") for at, x in zip(r["ats"], edits_of(r["codes"], r["entry"], r["state"]))]
        if r["b"] == r["last"] // block:
            rows[-1] = (*rows[-1][:-1], AFTER[r["state"]])
        return rows

    return _mapped(solved.select("c", "b", "codes", "ats", "entry", "state", "last"), expand, "c string, at long, edit string, before string, role string, after string")


def turns_and_edits(turns: DataFrame, marks: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a conversation in order: each turn's edit (with its fault), then the turn itself."""
    marked = found.join(marks.select("at", "fault"), "at", "left")
    rows = turns.select("c", "at", F.lit(1).alias("kind"), "turn", F.col("role").alias("name"), "text").unionByName(marked.select("c", "at", F.lit(0).alias("kind"), "edit", "before", "role", "after", "fault"), True)
    return rows


def _kept(rows: Iterator[dict], stats: dict) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns of one conversation; counts its faults and edits in stats."""
    edit, last = None, None
    for r in rows:
        if r["kind"] < 0:  # says only that there is such a conversation
            continue
        if r["kind"] == 0:
            edit = r
            continue
        turn, initial = r["turn"], r["name"][:1]
        if last is not None:
            stats["illegal"] += last + initial not in ("su", "ua", "au")
        last = initial
        if turn is not None:
            stats["turns"] += turn != stats["high"]
            stats["low"], stats["high"] = turn if stats["low"] is None else stats["low"], turn
        if edit["fault"]:
            stats[edit["fault"]] += 1
        stats["audit"].append("I" * len(edit["before"]) + edit["edit"] + "I" * len(edit["after"]))
        stats["cost"] += INSERT * len(edit["before"] + edit["after"]) + {"K": 0, "R": REROLE, "D": DELETE}[edit["edit"]] + TRUNCATED * (edit["fault"] == "truncated" and edit["edit"] != "D")
        yield from ((NAMES[x], "") for x in edit["before"])
        if edit["edit"] != "D":
            yield NAMES[edit["role"]] if edit["edit"] == "R" else r["name"], r["text"]
        yield from ((NAMES[x], "") for x in edit["after"])


def _stats() -> dict:
    return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": []}


def _in_streams(rows: DataFrame) -> DataFrame:
    return rows.repartition("c").sortWithinPartitions("c", "at", "kind")


def repaired_turns(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id (text), place, role, text of the repaired conversations of rows (conv_id, turn, role, text)."""
    common.prepare(rows.sparkSession)
    turns = ordered(rows)
    marks = common.stored(faults(turns), "faults")

    def texts(stream: Iterator[dict]) -> Iterator[tuple]:
        for c, own in groupby(stream, key=itemgetter("c")):
            for place, (role, text) in enumerate(_kept(own, _stats())):
                yield c[1:] if c else None, place, role, text

    return _streamed(_in_streams(turns_and_edits(turns, marks, edits(marks, block, fan))), texts, "conv_id string, place long, role string, text string")


def repair_report(rows: DataFrame, every: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `every`
    (conv_id), repaired from rows (conv_id, turn, role, text).

    Turns of a conversation are ordered by turn, null first; of equal turns by role, then by a hash of the text, so that
    equal turns are adjacent. Null conversations are one conversation. Null roles and texts must not be in rows.
    Conversations without rows have zeros, an empty audit and the digest of nothing; without conversations the result is
    empty; other columns are ignored."""
    common.prepare(rows.sparkSession)
    turns = ordered(rows)
    marks = common.stored(faults(turns), "faults")
    named = every.select(_key(every).alias("c")).distinct().select("c", F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("kind"))
    stream = _in_streams(turns_and_edits(turns, marks, edits(marks, block, fan)).unionByName(named, True))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def digests(own: Iterator[dict]) -> Iterator[tuple]:
        for c, turns_of in groupby(own, key=itemgetter("c")):
            stats, sha, between = _stats(), hashlib.sha256(), ""
            for role, text in _kept(turns_of, stats):
                sha.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            stats["gaps"] = 0 if stats["low"] is None else stats["high"] - stats["low"] + 1 - stats["turns"]
            yield c, *(stats[k] for k in numbers), "".join(stats["audit"]), sha.hexdigest()

    found = _streamed(stream, digests, f"c string, {', '.join(f'{k} long' for k in numbers)}, audit string, repaired_sha256 string")
    conv_id = F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(every.schema["conv_id"].dataType).alias("conv_id")
    return found.select(conv_id, *numbers, "audit", "repaired_sha256")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """repair_report() of damaged() rows, for every conversation that rows have."""
    return repair_report(damaged(rows), rows)
