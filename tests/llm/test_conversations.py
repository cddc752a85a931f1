"""Repair of conversations against all ways to edit them, and against one fold over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lamina.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def every_way(turns):
    """(cost, audit, repaired) of the best of all edits of turns (role, text, must go, truncated)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for inserted in itertools.product(gaps, repeat=len(turns) + 1):
        for edits in itertools.product(*(["D"] if gone else ["K", "Ru", "Ra", "D"] for _, _, gone, _ in turns)):
            cost, audit, out = 0, "", []
            for ins, edit, (role, text, _, cut) in zip(inserted, edits, turns):
                out += [(C.NAMES[x], "") for x in ins]
                audit += "I" * len(ins) + edit[0]
                cost += 5 * len(ins) + {"K": 0, "R": 1, "D": 2}[edit[0]] + 5 * (cut and edit != "D")
                if edit != "D":
                    out.append((role if edit == "K" else C.NAMES[edit[1]], text))
            out += [(C.NAMES[x], "") for x in inserted[-1]]
            audit, cost = audit + "I" * len(inserted[-1]), cost + 5 * len(inserted[-1])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def by_states(turns):
    """The same by a walk over turns and states of the pattern."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    now = {0: (0, "", ())}

    def relax(table):
        for _ in range(3):
            for q, (cost, audit, out) in list(table.items()):
                for x in "ua":
                    to = step.get((q, x))
                    new = (cost + 5, audit + "I", (*out, (C.NAMES[x], "")))
                    if to is not None and (to not in table or new[:2] < table[to][:2]):
                        table[to] = new
        return table

    for role, text, gone, cut in turns:
        new = {}
        for q, (cost, audit, out) in relax(now).items():
            ways = [("D", q, 2, ())]
            if not gone:
                ways += [("K", step.get((q, role[:1])), 5 * cut, ((role, text),))] + [("R", step.get((q, x)), 1 + 5 * cut, ((C.NAMES[x], text),)) for x in "ua"]
            for edit, to, price, added in ways:
                found = (cost + price, audit + edit, (*out, *added))
                if to is not None and (to not in new or found[:2] < new[to][:2]):
                    new[to] = found
        now = new
    cost, audit, out = min((now2[q] for now2 in [relax(now)] for q in (0, 3) if q in now2), key=lambda x: x[:2])
    return cost, audit, list(out)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(conv, rows, solve=by_states):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, turns, faults = set(), [], []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
        turns.append((role, text, faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
    cost, audit, out = solve(turns)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def some_turns(rng, n):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), str(rng.random()), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def code(turn):
    role, _, gone, cut = turn
    x = role[:1] if role[:1] in C.ROLES and role else "x"
    return "d" if gone else x.upper() if cut else x


def test_all_ways():
    rng = random.Random(2)
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3, 3):
        for _ in range(12 if n < 3 else 6):
            turns = some_turns(rng, n)
            assert by_states(turns) == every_way(turns)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_blocks(size):
    """Blocks and summaries of summaries give what one walk gives."""
    rng = random.Random(size)
    for _ in range(150):
        turns = some_turns(rng, rng.randint(1, 40))
        codes = "".join(map(code, turns))
        blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
        parts = [C.summary(b) for b in blocks]
        groups = [parts[i : i + 3] for i in range(0, len(parts), 3)]
        whole = C.compose([C.compose(g)[0] for g in groups])[0]
        end = C.best_end(whole)
        ways = C.states_within([C.compose(g)[0] for g in groups], C.START, end)
        ways = [x for g, w in zip(groups, ways) for x in C.states_within(g, *w)]
        edits = [e for b, w in zip(blocks, ways) for e in C.edits_of(b, *w)]
        audit = "".join("I" * len(before) + e for e, before, _ in edits) + "I" * len(C.AFTER[end])
        cost, exp, _ = by_states(turns)
        assert audit == exp and whole[end][0] + 5 * len(C.AFTER[end]) == cost


@pytest.mark.parametrize("block,fan", [(4096, 512), (3, 2)])
def test_report(spark, block, fan):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " \n", "Hello.", "Hi", "What?", "é 中!  ", "Same.", "x" * 9000 + ".", "cut, \t"])
    rows = [(rng.choice([*range(12), None]), rng.choice([*range(9), None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "Ünï"]), text()) for _ in range(160)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(60)] + [(c, 0, "user", "Lost.") for c in range(1000, 1040)] + [(5, 3, "user", "Same."), (5, 3, "user", "Same.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, c string")
    got = C.repair_report(C.damaged(frame), frame, block, fan).collect()
    exp = [report(c, own) for c, own in damage(rows).items()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exp))
    back = defaultdict(list)
    for r in C.repaired_turns(C.damaged(frame), block, fan).collect():
        back[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    shas = {str(r.conv_id) if r.conv_id is not None else None: r.repaired_sha256 for r in got}
    nothing = hashlib.sha256(b"").hexdigest()
    assert {c: hashlib.sha256("\n".join(x for _, x in sorted(own)).encode()).hexdigest() for c, own in back.items()} == {c: h for c, h in shas.items() if h != nothing}
    assert C.damage_and_repair(frame.where("false")).count() == 0
