"""File events as keyed state: equal to all events at once for every split and order."""

import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lamina.plans import events as E
from lamina.plans.library import Library
from lamina.plans.store import EMPTY, TABLES, Store
from lamina.streaming.event_state import FileState
from lamina.streaming.intake import run_events

AS_OF, LATER = datetime(2024, 1, 1), datetime(2025, 1, 1)
KIND = "event_id long, event_type string, content_hash string, path string"


def library(spark, rows):
    leaves = spark.createDataFrame([(h, p, s, "bad" if s == "error" else None, AS_OF) for h, p, s in rows], "content_hash string, source_path string, status string, error string, updated_at timestamp")
    return Library(leaves, *(spark.createDataFrame([], EMPTY[t]) for t in TABLES[1:]))


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(("event_id", "event_type", "content_hash", "path"), r, strict=True))) + "\n" for r in rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_order(spark, tmp_path, seed):
    r = random.Random(seed)
    hashes = [f"h{i}" for i in range(12)]
    lib = library(spark, [(h, f"/r/{h}", r.choice(["ready", "error"])) for h in hashes])
    rows = [(n, r.choice(["created", "moved", "copied", "deleted", "deleted"]), r.choice([*hashes[:9], "hot", "unknown", None]), r.choice(["/r/p.md", "/r/q.txt", None, *(f"/r/{h}" for h in hashes)])) for n in range(80)]
    rows += [(100 + n, "deleted", h, f"/r/{h}") for n, h in enumerate(hashes[9:11])] + [(7, "deleted", "h0", "/r/p.md"), (7, "moved", "h0", "/r/p.md"), (7, "moved", "h0", "/r/q.txt")]
    want = E.apply_events(lib.leaves, E.since(spark.createDataFrame(rows, KIND), -1), LATER)
    want = {x.content_hash: (x.source_path, x.status) for x in want.collect()}
    r.shuffle(rows)
    store = Store(spark, str(tmp_path / "store"))
    store.commit(lib)
    for n in range(3):
        write(tmp_path / "log", n, rows[n::3])
        if n != 1:
            run_events(spark, str(tmp_path / "log"), store, str(tmp_path / "cp"), most=1)
    got = {x.content_hash: (x.source_path, x.status) for x in store.load().leaves.collect()}
    assert got == want and "gone" in {s for _, s in got.values()}
    parts = store.parts()
    run_events(spark, str(tmp_path / "log"), store, str(tmp_path / "cp"))
    assert store.parts() == parts


def test_grace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(library(spark, [("a", "/a", "ready"), ("b", "/b", "ready")]))
    run = lambda: run_events(spark, str(tmp_path / "log"), store, str(tmp_path / "cp"), grace=4)
    status = lambda: {x.content_hash: (x.source_path, x.status) for x in store.load().leaves.collect()}
    write(tmp_path / "log", 0, [(1, "deleted", "a", "/a"), (2, "deleted", "b", "/b")])
    run()
    assert status() == {"a": ("/a", "ready"), "b": ("/b", "ready")}
    write(tmp_path / "log", 1, [(3, "created", "b", "/c.txt")])
    run()
    time.sleep(5)
    write(tmp_path / "log", 2, [(4, "created", "x", "/x.txt")])
    run()
    assert status() == {"a": ("/a", "gone"), "b": ("/c.txt", "ready")}


def test_empty_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(library(spark, [("a", "/a", "ready")]))
    write(tmp_path / "log", 0, [(1, "moved", None, "/x"), (2, "moved", "a", None)])
    run_events(spark, str(tmp_path / "log"), store, str(tmp_path / "cp"))
    assert store.load().leaves.select("source_path", F.col("status")).first() == ("/a", "ready") and len(store.parts()) == 1


class _Counted:
    """A state of one key that counts calls, each of which is a round trip to the JVM in a stream."""

    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            elif name == "removeKey":
                del self.map[args[0]]
            return {"get": self.value, "getValue": self.map.get(args[0]) if args else None, "exists": bool(self.map) or self.value is not None, "containsKey": bool(args) and args[0] in self.map, "iterator": iter(list(self.map.items()))}.get(name)

        return call


def test_few_round_trips_for_each_hash():
    calls, state = [], FileState()
    state.last, state.lost = _Counted(calls), _Counted(calls)
    event = Row("path", "event_id", "deleted")

    def told(*rows):
        calls.clear()
        return [tuple(r) for r in state.handleInputRows(("h",), iter([event(*r) for r in rows]), None)]

    assert told(("/a", 1, False), ("/b", 2, False), ("/c", 3, True), ("/c", 4, False)) == [("h", "/c", True, False)] and len(calls) == 3
    assert told(("/c", 6, True), ("/c", 5, True)) == [("h", "/c", True, True)] and len(calls) == 4
    assert told(("/c", 6, True)) == [("h", "/c", True, True)] and "update" not in calls and "updateValue" not in calls
    assert told(("/d", 7, False)) == [("h", "/d", True, False)] and not state.lost.map
