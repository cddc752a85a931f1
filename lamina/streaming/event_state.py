"""File events as keyed state of a stream: events of a content hash in any order, over any number of batches."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.events import GONE
from ..plans.library import READY

#: What becomes of a path of a content hash. known: it is the file's present path; else a deletion of the path that the
#: leaf has counts, as no event says where the file is.
VERDICT = "content_hash string, path string, known boolean, gone boolean"
COMBINED = "content_hash string, path string, event_id long, deleted boolean"
_TOLD = Row("content_hash", "path", "known", "gone")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combine(events: DataFrame) -> DataFrame:
    """Events before the shuffle, batch by Arrow batch: of a hash the last one that is not a deletion, and of its paths
    the last deletion after that. Events without hash or path go."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["event_id", "path"])
            last = rows[~rows["deleted"]].drop_duplicates("content_hash", keep="last")
            lost = rows[rows["deleted"]].drop_duplicates(["content_hash", "path"], keep="last")
            since = lost["content_hash"].map(last.set_index("content_hash")["event_id"])
            yield pd.concat([last, lost[since.isna() | (lost["event_id"] > since)]])

    rows = events.where("content_hash is not null and path is not null and event_id is not null")
    return rows.select("content_hash", "path", "event_id", F.coalesce(F.col("event_type") == "deleted", F.lit(False)).alias("deleted")).mapInPandas(reduce, COMBINED)


class FileState(StatefulProcessor):
    """The last event of a hash that is not a deletion, and the deletions after it by path; older deletions are forgotten.

    With a grace, a file counts as gone only when it did not appear again for so many milliseconds."""

    def __init__(self, grace: int = 0):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, path string, gone boolean")
        self.lost = handle.getMapState("lost", "path string", "event_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # every call of a state is a round trip to the JVM, for each hash: what the rows tell is gathered first
        before, kept = self.last.get(), self.lost.exists()
        best, told = (tuple(before[:2]) if before else None), {}
        for row in rows:
            if not row.deleted:
                best = max(best, (row.event_id, row.path)) if best else (row.event_id, row.path)
            elif (best is None or row.event_id > best[0]) and row.event_id > told.get(row.path, row.event_id - 1):
                told[row.path] = row.event_id
        if best is not None:
            told = {path: number for path, number in told.items() if number > best[0]}
        for path, number in told.items():
            old = self.lost.getValue((path,)) if kept and self.lost.containsKey((path,)) else None
            if old is None or number > old[0]:
                self.lost.updateValue((path,), (number,))
        if self.grace and told:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace)
        if best is None:
            if not self.grace:
                yield from self._rows(key, sorted(told), False, True)
            return
        if kept and (before is None or best[0] > before[0]):
            for (path,) in [k for k, v in self.lost.iterator() if v[0] <= best[0]]:
                self.lost.removeKey((path,))
        gone = best[1] in told or (kept and self.lost.containsKey((best[1],)))
        shown = gone and (not self.grace or bool(before and before[1] == best[1] and before[2]))
        if before is None or (*best, shown) != tuple(before):
            self.last.update((*best, shown))
        yield from self._rows(key, [best[1]], True, shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.last.exists():
            yield from self._rows(key, [k[0] for k in self.lost.keys()], False, True)
            return
        number, path, _ = self.last.get()
        gone = self.lost.containsKey((path,))
        self.last.update((number, path, gone))
        yield from self._rows(key, [path], True, gone)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, paths: list[str], known: bool, gone: bool) -> list[Row]:
        return [_TOLD(key[0], path, known, gone) for path in paths]


def verdicts(events: DataFrame, grace: float = 0) -> DataFrame:
    """VERDICT rows for the hashes that a batch of a stream of events touches. The state store has to be PROVIDER's."""
    state = FileState(int(grace * 1000))
    return combine(events).groupBy("content_hash").transformWithState(state, VERDICT, "Update", "ProcessingTime" if grace else "None")


def apply_verdicts(leaves: DataFrame, found: DataFrame, as_of: datetime, changed_only: bool = False) -> DataFrame:
    """leaves after verdicts, as apply_events() has them after all events so far; one with an error text that comes back
    is an error again. A leaf whose file is neither moved nor gone keeps its row; changed_only leaves it out."""
    known = found.where("known").select("content_hash", F.col("path").alias("_to"), F.col("gone").alias("_gone"))
    lost = found.where("not known").select("content_hash", F.col("path").alias("source_path"), F.lit(True).alias("_lost")).distinct()
    out = leaves.join(known, "content_hash", "left").join(lost, ["content_hash", "source_path"], "left")
    gone = F.coalesce("_gone", "_lost", F.lit(False))
    again = F.when(F.col("error").isNotNull(), "error").otherwise(READY) if "error" in leaves.columns else F.lit(READY)
    status = F.when(gone, GONE).when((F.col("status") == GONE) & F.col("_to").isNotNull(), again).otherwise(F.col("status"))
    path = F.coalesce("_to", "source_path")
    changed = ~(path.eqNullSafe(F.col("source_path")) & status.eqNullSafe(F.col("status")))
    now = F.when(changed, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    if changed_only:
        out = out.where(changed)
    return out.withColumns({"status": status, "source_path": path, "updated_at": now}).select(*leaves.columns)
