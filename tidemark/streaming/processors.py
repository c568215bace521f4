"""Stateful streams with typed state and event-time timers: refits that a clock triggers when no row comes, and episodes that end when an asset falls silent.

State is kept by column (map, list and value state), so a batch writes the rows that are new and no more. Timers fire when the watermark passes them, whether or not their key has
rows. Queries need the RocksDB state store: call prepare(spark) first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import jump_model
from ..operators.forecast import refit_reason

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def prepare(spark: SparkSession) -> None:
    """Let the session's new queries keep their state in RocksDB, which processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(day) -> int:
    return int(pd.Timestamp(day).value // 1_000_000)


def _rows(frames: Iterator[pd.DataFrame], order: str) -> Iterator:
    """The batch's rows of a key, in order."""
    got = [f for f in frames if len(f)]
    return pd.concat(got).sort_values(order, kind="stable").itertuples() if got else iter(())


class Refits(StatefulProcessor):
    """Refits of an asset. State: its last `window` rows by number, the labels and days of the last accepted fit, and when that was."""

    def __init__(self, features: list[str], theta_ari: float, theta_run: float, window: int, least: int, penalty: float, safety_days: int, grace_days: int):
        self.features, self.thetas, self.window, self.least, self.penalty = features, (theta_ari, theta_run), window, least, penalty
        self.safety_days, self.grace_days = safety_days, grace_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "at long", "dt string, x array<double>")
        self.count = handle.getValueState("count", "n long, last string")
        self.fitted = handle.getListState("fitted", "dt string, label int")
        self.when = handle.getValueState("accepted", "dt string")

    def _window(self) -> list[tuple[str, list[float]]]:
        return [(v[0], list(v[1])) for _, v in sorted(((k[0], v) for k, v in self.seen.iterator()), key=lambda kv: kv[0])]

    def _last(self):
        if not self.when.exists():
            return None
        held = [(r[0], r[1]) for r in self.fitted.get()]
        return np.array([x for _, x in held]), [d for d, _ in held], pd.Timestamp(self.when.get()[0])

    def _judge(self, rows: list[tuple[str, list[float]]], last, today: pd.Timestamp):
        """The event of a fit of the rows, or None, and the fit to compare with from now on."""
        days = [d for d, _ in rows]
        labels, _ = jump_model.fit(np.array([x for _, x in rows], float), 2, self.penalty)
        reason, ari, run, since = refit_reason(labels, days, last, today, *self.thetas, self.safety_days)
        return (reason and (reason, ari, run, since)), (labels, days, today) if reason else last

    def _accept(self, fit) -> None:
        labels, days, today = fit
        self.fitted.put([(d, int(x)) for d, x in zip(days, labels, strict=True)])
        self.when.update((str(today.date()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_ms(today) + (self.safety_days + self.grace_days) * _DAY_MS)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["asset", "dt", "reason", "ari_now", "mrl_now", "days_since_last"])
        return frame.astype({"ari_now": "float64", "mrl_now": "float64", "days_since_last": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, latest = tuple(self.count.get()) if self.count.exists() else (0, "")
        held = last = None  # read when a row is judged
        start, out = last, []
        for row in _rows(rows, "dt"):
            day = str(pd.Timestamp(row.dt).date())
            if day <= latest:
                continue
            if row.judge and n >= self.least:
                if held is None:
                    held = self._window()
                    start = last = self._last()
                event, last = self._judge(held[-self.window :], last, pd.Timestamp(day))
                if event:
                    out.append((key[0], pd.Timestamp(day).date(), *event))
            x = [float(getattr(row, f)) for f in self.features]
            self.seen.updateValue((n,), (day, x))
            if n >= self.window:
                self.seen.removeKey((n - self.window,))
            if held is not None:
                held.append((day, x))
            n, latest = n + 1, day
        self.count.update((n, latest))
        if last is not start:
            self._accept(last)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        today = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").normalize()
        event, last = self._judge(self._window(), self._last(), today)
        self._accept(last)
        yield self._frame([(key[0], today.date(), *event)])

    def close(self) -> None:
        pass


def refit_events(rows: DataFrame, features: list[str], theta_ari: float, theta_run: float, window: int = 756, least: int = 252, penalty: float = 50.0, safety_days: int = 720, grace_days: int = 31, delay: str = "0 days") -> DataFrame:
    """(asset, dt, reason, ari_now, mrl_now, days_since_last) of a stream (asset, dt, judge, features): refits as the batch operator accepts them.

    Where no row judges within grace_days after safety_days have gone by, a timer refits on the rows that are there; its dt is the day that it was set for. So an asset without rows is refitted
    too, as soon as others move the watermark on. Days at or before the last one seen of an asset, and those older than the watermark (the latest day less `delay`), are left out.
    """
    picked = rows.select("asset", "dt", "judge", *features).dropna().withColumn("_ts", F.col("dt").cast("timestamp")).withWatermark("_ts", delay)
    return picked.groupBy("asset").transformWithStateInPandas(
        Refits(features, theta_ari, theta_run, window, least, penalty, safety_days, grace_days), "asset string, dt date, reason string, ari_now double, mrl_now double, days_since_last long", "append", "EventTime"
    )


class Episodes(StatefulProcessor):
    """Runs of equal regimes of an asset. State: the run that is open; a timer ends it when nothing has come for a while."""

    def __init__(self, idle_days: int, kind: str):
        self.idle_days, self.kind = idle_days, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"regime int, start {self.kind}, end {self.kind}, n long")

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["asset", "regime", "start", "end", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        regime, start, end, n = tuple(self.open.get()) if self.open.exists() else (None, None, None, 0)
        out = []
        for row in _rows(rows, "ts"):
            if n and (row.regime != regime or _ms(row.ts) - _ms(end) > self.idle_days * _DAY_MS):
                out.append((key[0], regime, start, end, n))
                n = 0
            if not n:
                regime, start = int(row.regime), row.ts
            end, n = row.ts, n + 1
        if n:
            self.open.update((regime, start, end, n))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(_ms(end) + self.idle_days * _DAY_MS)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.open.get())
        self.open.clear()
        yield self._frame([(key[0], *held)])

    def close(self) -> None:
        pass


def regime_episodes(labels: DataFrame, idle_days: int = 10, delay: str = "0 days") -> DataFrame:
    """(asset, regime, start, end, n) of a stream (asset, ts, regime): every run of equal regimes when the next one begins, and the last one once the watermark (the latest
    ts of any asset less `delay`) is idle_days past its end. After a silence of more than idle_days a run is another one, whatever batch its rows are in. Rows older than the watermark are left out."""
    kind = labels.schema["ts"].dataType.simpleString()
    picked = labels.select("asset", "ts", "regime").withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", delay)
    return picked.groupBy("asset").transformWithStateInPandas(Episodes(idle_days, kind), f"asset string, regime int, start {kind}, end {kind}, n long", "append", "EventTime")
