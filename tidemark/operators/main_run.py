"""The main run end to end: walk-forward forecasts with a penalty chosen at every rebalance day, strategies that read them, their daily backtest and its metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import exists, kept, upsert
from . import backtest, framework, strategies


@dataclass(frozen=True)
class MainRun:
    """forecasts (asset, dt, regime), choices (asset, rebal, penalty, sharpe, candidates), daily (strategy, dt, ret, turnover, leverage), metrics (a row a strategy)."""

    forecasts: DataFrame
    choices: DataFrame
    daily: DataFrame
    metrics: DataFrame


def forecasts(rows: DataFrame, walk: framework.Walk, penalties: Sequence[float] = framework.PENALTIES, start=None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """framework.search, kept. path: a folder that has the assets which are through, a folder an asset; a run that broke off goes on with the others, and
    one that is whole is read. An asset counts as through when its choices are there, which are written after its forecasts."""
    spark = rows.sparkSession
    if path is None:
        got, choices = framework.search(rows, walk, penalties, start=start)
        return kept(got, "forecasts"), kept(choices, "choices")
    names = {"forecasts": "dt date, regime int, asset string", "choices": "rebal date, penalty double, sharpe double, candidates long, asset string"}
    at = {name: f"{path.rstrip('/')}/{name}" for name in names}
    done = spark.read.schema(names["choices"]).parquet(at["choices"]) if exists(spark, at["choices"]) else None
    left = rows if done is None else rows.join(done.select("asset").distinct(), "asset", "left_anti")
    if not left.isEmpty():
        got, choices = framework.search(left, walk, penalties, start=start)
        upsert(got.select("dt", "regime", "asset"), at["forecasts"], ["asset"])
        upsert(choices.select("rebal", "penalty", "sharpe", "candidates", "asset"), at["choices"], ["asset"])
    out = {name: spark.read.schema(schema).parquet(at[name]) for name, schema in names.items()}
    return out["forecasts"].select("asset", "dt", "regime"), out["choices"].select("asset", "rebal", "penalty", "sharpe", "candidates")


def run(rows: DataFrame, panel: DataFrame, walk: framework.Walk, penalties: Sequence[float] = framework.PENALTIES, names: Sequence[str] = tuple(strategies.NAMES), extra: dict[str, strategies.Optimised | Callable[[DataFrame], DataFrame]] | None = None, start=None, end=None, cost: float = 5e-4, path: str | None = None) -> MainRun:
    """The whole run. rows: (asset, dt, er, features of the walk); panel: (asset, dt, er, ret, rf), whose earlier days feed covariances and means.

    Strategies trade from start (the first day if not given) to end. A day before the first forecast has none: regime strategies then do as their plain ones.
    No conditional means are given, so the regime mean-variance strategy uses the smoothed ones. path: see forecasts.
    """
    labels, choices = forecasts(rows, walk, penalties, start, path)
    whole = panel.select("asset", "dt", "er", "ret", "rf").join(labels, ["asset", "dt"], "left").withColumn("mu", F.lit(None).cast("double"))
    daily = kept(strategies.run(whole, list(names), extra, start, end, cost), "daily")
    return MainRun(labels, choices, daily, backtest.metrics(daily.join(panel.select("dt", "rf").distinct(), "dt")))
