"""Freshness as state: a candidate's label changes when its days are over, by a timer, without a look at the pool."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyrank.functions import constants as K

#: Days after which a label no longer holds, and the last one, after which a profile counts as stale.
ENDS = (7, 60, 365)
LABELS = (*K.STATES, K.STATES[-1])
CHANGES = "candidate_id string, last timestamp, at timestamp, label string, stale boolean"


def label_after(days: int) -> tuple[str, bool]:
    """(label, stale) so many days after the last sign of life."""
    place = sum(days > e for e in ENDS)
    return LABELS[place], place == len(ENDS)


class FreshnessState(StatefulProcessor):
    """Keeps the last day that a candidate was seen and a timer for the day its label ends. Rows that are not newer change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._last = handle, handle.getValueState("last", "last timestamp")

    def _row(self, key, last, at) -> pd.DataFrame:
        label, stale = label_after((at.normalize() - last.normalize()).days)
        return pd.DataFrame({"candidate_id": [key[0]], "last": [last], "at": [at], "label": [label], "stale": [stale]})

    def _remind(self, last: pd.Timestamp, after: pd.Timestamp) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        for e in ENDS:
            end = last.normalize() + pd.Timedelta(days=e + 1)
            if end > after:
                self._handle.registerTimer(int(end.value // 10**6))
                return

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max((r["seen"].max() for r in rows if len(r)), default=None)
        last = pd.Timestamp(self._last.get()[0]) if self._last.exists() else None
        if newest is not None and newest == newest and (last is None or newest > last):
            self._last.update((newest.to_pydatetime(),))
            now = max(newest, pd.Timestamp(max(timerValues.getCurrentWatermarkInMs(), 0), unit="ms"))
            self._remind(newest, now)
            yield self._row(key, newest, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self._last.get()[0])
        now = max(pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"))
        self._remind(last, now)
        yield self._row(key, last, now)

    def close(self) -> None:
        pass


def freshness_changes(seen: DataFrame, late: str = "0 seconds") -> DataFrame:
    """CHANGES of a stream (candidate_id, seen timestamp): a row whenever a candidate is seen again or its label ends; the one with the
    latest ``at`` holds. Time is the stream's own, its watermark. The state store must be RocksDB's (``ROCKSDB``)."""
    keyed = seen.selectExpr("cast(candidate_id as string) candidate_id", "seen").filter("candidate_id is not null and seen is not null").withWatermark("seen", late)
    return keyed.groupBy("candidate_id").transformWithStateInPandas(FreshnessState(), CHANGES, outputMode="Append", timeMode="eventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
