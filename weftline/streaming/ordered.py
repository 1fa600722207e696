"""A stream's rows in the order of their time, however they arrive: held until the watermark, put out by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = "at long, id long, kind string"  # microseconds, the row's id and its kind
IDLE_MS = 90 * 86_400_000  # of event time without rows after which a key's state goes
STEP_MS = 60_000  # rows are put out by whole minutes


class InOrder(StatefulProcessor):
    """Counts a key's rows of one kind between those of another, in the order of time.

    A list holds the rows that the watermark has not passed, a value the rows counted
    since the last of the kind that ends a count, how many of that kind were seen, and
    the time of the key's one timer: when the watermark passes the minute of its first
    held row. The timer puts out what is due, in order of time and id, and is set for
    the next row. A key without rows for IDLE_MS begins anew.
    """

    def __init__(self, counted: str, ending: str):
        self.counted, self.ending = counted, ending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.count = handle.getValueState("count", "n long, nth long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, passed = None, timerValues.getCurrentWatermarkInMs() // STEP_MS * STEP_MS * 1000
        for part in rows:
            new = [r for r in zip(part["at"].tolist(), part["id"].tolist(), part["kind"].tolist(), strict=True) if r[0] >= passed]  # Spark itself drops late rows a batch later
            if new:
                self.held.appendList(new)
                first = min(new)[0] if first is None else min(first, min(new)[0])
        if first is not None:
            n, nth, timer = self.count.get() if self.count.exists() else (0, 0, None)
            due = first // 1000 // STEP_MS * STEP_MS + STEP_MS
            if timer is None or due < timer:
                self.wait(n, nth, timer, due)
        return iter(())

    def wait(self, n: int, nth: int, old: int | None, due: int) -> None:
        """The key's timer is at ``due`` instead of ``old``."""
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        self.count.update((n, nth, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() // STEP_MS * STEP_MS * 1000
        held = sorted(tuple(r) for r in self.held.get())
        ready, rest = [r for r in held if r[0] < due], [r for r in held if r[0] >= due]
        n, nth, _ = self.count.get() if self.count.exists() else (0, 0, None)
        if not held:  # no row came since this timer was set
            self.count.clear()
            return
        out = []
        for _, row, kind in ready:
            if kind == self.ending:
                nth += 1
                out.append((key[0], row, n, nth))
                n = 0
            elif kind == self.counted:
                n += 1
        if rest:
            if ready:
                self.held.put(rest)
            self.wait(n, nth, None, rest[0][0] // 1000 // STEP_MS * STEP_MS + STEP_MS)  # the old one has gone off
        else:
            self.held.clear()
            self.wait(n, nth, None, ready[-1][0] // 1000 + IDLE_MS)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "n", "nth"])

    def close(self) -> None:
        pass


def counts_between(events: DataFrame, key: str, time: str, row_id: str, kind: str, counted: str, ending: str, late: str) -> DataFrame:
    """key, id, n, nth: for each row of kind ``ending`` how many ``counted`` rows its key has since the one before, and the how manieth it is, by time and id.

    Put out once the watermark, ``late`` behind, has passed the row's minute, so files may come in any order
    within ``late``; later rows are dropped. Rows without a key or a time are left out.
    """
    own = events.where(F.col(kind).isin(counted, ending) & F.col(key).isNotNull() & F.col(time).isNotNull())
    own = own.select(F.col(time), F.col(key).cast("long").alias("key"), F.unix_micros(time).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(kind).alias("kind"))
    return own.withWatermark(time, late).groupBy("key").transformWithStateInPandas(InOrder(counted, ending), "key long, id long, n long, nth long", "append", "eventTime")
