"""Stateful streams: a backtest day by day, refits that events trigger, regime episodes, and late macro prints."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import as_of
from ..operators import jump_model
from ..operators.forecast import refit_reason


def backtest_days(days: DataFrame, cost: float = 5e-4) -> DataFrame:
    """(strategy, dt, ret, turnover, leverage) of a stream of days (strategy, dt, assets array<string>, w array<double>, er array<double>, rf): the daily loop of the batch backtest.

    The state of a strategy is its last day's target and drifted weights. A batch's days are put in order; a day at or before the last one seen is left out.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        last, held, w, rest = json.loads(state.get[0]) if state.exists else (None, None, None, 0.0)
        out = []
        for row in pd.concat(list(frames)).sort_values("dt").itertuples():
            if last is not None and str(row.dt) <= last:
                continue
            er = dict(zip(row.assets, np.nan_to_num(np.asarray(row.er, float)), strict=True))
            target = {a: min(max(0.0 if x is None or x != x else float(x), 0.0), 1.0) for a, x in zip(row.assets, row.w, strict=True)}
            rf = float(row.rf or 0.0)
            if w is not None:
                turnover = sum(abs(w.get(a, 0.0) - held.get(a, 0.0)) for a in {*w, *held})
                gain = sum(x * er.get(a, 0.0) for a, x in w.items()) + rest * rf
                out.append((key[0], row.dt, gain - turnover * cost, turnover, sum(w.values())))
                grown = {a: x * (1 + er.get(a, 0.0)) for a, x in w.items()}
                value = sum(grown.values()) + rest * (1 + rf)
                held = {a: x / value if value > 0 else 0.0 for a, x in grown.items()}
            else:
                held = {a: 1 / len(er) for a in er}
            last, w, rest = str(row.dt), target, max(1 - sum(target.values()), 0.0)
        state.update((json.dumps([last, held, w, rest]),))
        yield pd.DataFrame(out, columns=["strategy", "dt", "ret", "turnover", "leverage"])

    return days.groupBy("strategy").applyInPandasWithState(update, "strategy string, dt date, ret double, turnover double, leverage double", "held string", "append", GroupStateTimeout.NoTimeout)


def refit_events(rows: DataFrame, features: list[str], theta_ari: float, theta_run: float, window: int = 756, least: int = 252, penalty: float = 50.0, safety_days: int = 720) -> DataFrame:
    """(asset, dt, reason, ari_now, mrl_now, days_since_last) of a stream (asset, dt, judge, features): refits as the batch operator accepts them.

    The state of an asset is its last `window` rows and the last accepted fit; days come in order within an asset.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        seen, days, fit = json.loads(state.get[0]) if state.exists else ([], [], None)
        out = []
        for row in pd.concat(list(frames)).sort_values("dt").itertuples():
            if row.judge and len(seen) >= least:
                labels, _ = jump_model.fit(np.array(seen, float), 2, penalty)
                reason, ari, run, since = refit_reason(labels, days, fit and (np.array(fit[0]), fit[1], pd.Timestamp(fit[2])), pd.Timestamp(row.dt), theta_ari, theta_run, safety_days)
                if reason:
                    out.append((key[0], row.dt, reason, ari, run, since))
                    fit = [labels.tolist(), list(days), str(pd.Timestamp(row.dt).date())]
            seen, days = [*seen, [float(getattr(row, f)) for f in features]][-window:], [*days, str(pd.Timestamp(row.dt).date())][-window:]
        state.update((json.dumps([seen, days, fit]),))
        yield pd.DataFrame(out, columns=["asset", "dt", "reason", "ari_now", "mrl_now", "days_since_last"]).astype({"ari_now": "float64", "mrl_now": "float64", "days_since_last": "Int64"})

    picked = rows.select("asset", "dt", "judge", *features).dropna()
    return picked.groupBy("asset").applyInPandasWithState(update, "asset string, dt date, reason string, ari_now double, mrl_now double, days_since_last long", "held string", "append", GroupStateTimeout.NoTimeout)


def regime_episodes(labels: DataFrame) -> DataFrame:
    """(asset, regime, start, end, n) of a stream (asset, ts, regime): every run of equal regimes when the next one begins. The state is the run that is open."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = labels.schema["ts"].dataType.simpleString()

    def update(key, frames, state):
        regime, start, end, n = state.get if state.exists else (-1, None, None, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if row.regime != regime:
                if n:
                    out.append((key[0], regime, start, end, n))
                regime, start, n = int(row.regime), row.ts, 0
            end, n = row.ts, n + 1
        state.update((regime, start, end, n))
        yield pd.DataFrame(out, columns=["asset", "regime", "start", "end", "n"])

    return labels.select("asset", "ts", "regime").groupBy("asset").applyInPandasWithState(update, f"asset string, regime int, start {kind}, end {kind}, n long", f"regime int, start {kind}, end {kind}, n long", "append", GroupStateTimeout.NoTimeout)


def with_macro(days: DataFrame, macro: DataFrame, values: list[str], sink: Callable[[DataFrame, int], None], day: str = "dt") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives the sink each batch of a stream of days with the macro prints as of them.

    macro is read anew for every batch, so prints that came late are in those that follow; a batch that is run again reads what is there then.
    """

    def batch(df: DataFrame, number: int) -> None:
        sink(as_of(df, macro, day, values), number)

    return batch


def resume(stream: DataFrame, path: str, checkpoint: str):
    """Write what is new since the last run to Parquet and stop: the checkpoint has what was read and written, so a run that broke off goes on where it stood."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_prints(prints: DataFrame, late: str = "30 days") -> DataFrame:
    """One row a series and day of a stream of prints (series, ts, v), the first that comes; those later than the watermark are dropped."""
    return prints.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series", "ts"]).select("series", F.to_date("ts").alias("dt"), "v")
