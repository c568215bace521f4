"""Structured Streaming: bars from ticks, sliding metrics and regime episodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bars (asset, window, o, h, l, c) of a stream (ts, asset, v); late ticks count until the watermark has passed."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "asset").agg(F.min_by("v", "ts").alias("o"), F.max("v").alias("h"), F.min("v").alias("l"), F.max_by("v", "ts").alias("c"))


def sliding_metrics(ticks: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "asset").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))


def episodes(ticks: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of activity per asset."""
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "asset").agg(F.count("v").alias("n"))


def ewm_state(ticks: DataFrame, half_life: float = 21.0) -> DataFrame:
    """(asset, ts, mean): the exponentially weighted mean of a stream (ts, asset, v), after each tick.

    Two numbers an asset are kept: the weighted sum and the weights' sum. A batch's ticks are put in order; one that comes in a later batch counts when it comes.
    Null values only age the weights.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    fade = 0.5 ** (1.0 / half_life)

    def update(key, frames, state):
        num, den = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        means = []
        for v in rows["v"].to_numpy(float):
            num, den = num * fade, den * fade
            if v == v:
                num, den = num + v, den + 1
            means.append(num / den if den else float("nan"))
        state.update((float(num), float(den)))
        yield pd.DataFrame({"asset": key[0], "ts": rows["ts"].to_numpy(), "mean": means})

    kind = ticks.schema["ts"].dataType.simpleString()
    return ticks.select("ts", "asset", "v").groupBy("asset").applyInPandasWithState(update, f"asset string, ts {kind}, mean double", "num double, den double", "append", GroupStateTimeout.NoTimeout)
