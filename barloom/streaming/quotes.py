"""Last quote and staleness of every name as state of a stream: two closes a name and one timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUOTE = ("ticker string, n bigint, price double, prev_close double, last bigint, lag_seconds bigint, step int")
_STATE = ("n bigint, last bigint, day int, at bigint, id bigint, px double, day0 int, at0 bigint, id0 bigint, px0 double")
_PART = "ticker string, day int, ts timestamp, at bigint, id bigint, px double, n bigint"


def _newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Last tick of each name and day of a batch, with the count of its ticks."""
    for d in frames:
        if len(d):
            d = d.sort_values(["at", "id"], kind="stable")
            by = d.groupby(["ticker", "day"], sort=False)
            out = by.tail(1).copy()
            out["n"] = by["at"].transform("size").loc[out.index]
            yield out


class NameState(StatefulProcessor):
    """Newest two days of a name with their last ticks, and a timer that fires when the newest tick of all names is `limit_ms`
    or more ahead of the name's own. A day that the newest two push out can not come back, so the result does not depend on
    the order of arrival, and state is a row and a timer a name."""

    def __init__(self, late_ms: int, limit_ms: int):
        self.late_ms, self.limit_ms = late_ms, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("quote", _STATE)

    def _row(self, key, s, lag, step: int) -> pd.DataFrame:
        return pd.DataFrame({"ticker": [key[0]], "n": [s[0]], "price": [s[5]], "prev_close": [s[9]], "last": [s[1]],
                             "lag_seconds": pd.array([lag], "Int64"), "step": [step]})

    def _wait(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(1, at))

    def handleInputRows(self, key, rows, timerValues):
        s = self.kept.get() if self.kept.exists() else (0, 0, None, None, None, None, None, None, None, None)
        n, last = s[0], s[1]
        days = {d[0]: tuple(d[1:]) for d in (s[2:6], s[6:10]) if d[0] is not None}
        for frame in rows:
            for r in frame.itertuples(index=False):         # one row a day and part of the input
                n, last = n + int(r.n), max(last, int(r.at))
                tick = (int(r.at), int(r.id), float(r.px))
                days[int(r.day)] = max(days.get(int(r.day), tick), tick, key=lambda x: x[:2])
            days = dict(sorted(days.items())[-2:])
        found = sorted(days.items(), reverse=True)
        flat = [v for d, tick in found for v in (d, *tick)] + [None] * (8 - 4 * len(found))
        s = (n, last, *flat)
        self.kept.update(s)
        self._wait(last // 1000 - self.late_ms + self.limit_ms)
        yield self._row(key, s, None, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, s = timerValues.getCurrentWatermarkInMs(), self.kept.get()
        yield self._row(key, s, (now + self.late_ms) // 1000 - s[1] // 1_000_000, 1)
        self._wait(now + 1)

    def close(self) -> None:
        pass


def quote_state(ticks: DataFrame, late_seconds: int, limit_seconds: int = 0) -> DataFrame:
    """(ticker, n, price, prev_close, last, lag_seconds, step): a row for each name with new ticks (step 0), and a row for each
    name that is `limit_seconds` or more behind the newest tick of all (step 1), again whenever the newest tick moves on.

    `price` is the last tick of the newest day, `prev_close` of the day before it that has ticks, `last` the time of the last
    tick in microseconds. Ticks are reduced to a row a name and day in each batch before the shuffle, so a busy name is no
    hot task. Rows more than `late_seconds` behind are dropped by the engine; null times, ids or prices are left out."""
    given = ticks.filter("ticker is not null and ts is not null and id is not null and px is not null").select(
        "ticker", F.unix_date(F.col("ts").cast("timestamp_ntz").cast("date")).alias("day"), "ts", F.unix_micros("ts").alias("at"),
        F.col("id").cast("bigint").alias("id"), F.col("px").cast("double").alias("px"))
    parts = given.mapInPandas(_newest, _PART).withWatermark("ts", f"{late_seconds} seconds")
    return parts.groupBy("ticker").transformWithStateInPandas(
        NameState(late_seconds * 1000, limit_seconds * 1000), QUOTE, "Update", "EventTime")
