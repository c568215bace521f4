"""Portfolio strategies by name: each turns a daily panel into target weights, and a backtest turns targets into results.

Strategies whose targets don't depend on the weights held are windows. Those that optimise see the drifted weights of the day before, which their own last target
gave, so their targets are made in order, one task a strategy; the panel of a universe is a row an asset and day. P&L is the same windowed backtest for all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import backtest, portfolio

#: Fixed values.
MINVAR_BULL, MINVAR_BEAR, BEAR_CAP = 10e-4, 0.0, -10e-4
COV_HALF_LIFE, MEAN_HALF_LIFE, LEAST_COV, LEAST_MEAN, LEAST_BULLS = 252, 1260, 63, 252, 4
FIXED_MIX = {"LargeCap": 0.10, "MidCap": 0.05, "SmallCap": 0.05, "EAFE": 0.05, "EM": 0.05, "REIT": 0.10, "HighYield": 0.10, "Commodity": 0.05, "Gold": 0.05, "Treasury": 0.10, "Corporate": 0.10, "AggBond": 0.20}


@dataclass(frozen=True)
class Optimised:
    """A strategy that solves a programme every day. mean: how expected returns are made."""

    mean: str  # constant, regime, ewm, conditional
    risk: float
    trade: float


#: Optimising strategies by name.
OPTIMISED: dict[str, Optimised] = {
    "MinVar": Optimised("constant", 10.0, 0.0),
    "MinVar(JM-XGB)": Optimised("regime", 10.0, 1.0),
    "MV": Optimised("ewm", 5.0, 0.0),
    "MV(JM-XGB)": Optimised("conditional", 10.0, 1.0),
}


def _equal(panel: DataFrame) -> DataFrame:
    return panel.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("dt")))


def _regime_equal(panel: DataFrame) -> DataFrame:
    bull = F.when(F.col("regime") == 0, 1).otherwise(0)
    bulls, known = F.sum(bull).over(Window.partitionBy("dt")), F.count("regime").over(Window.partitionBy("dt"))
    every = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("dt"))
    return panel.withColumn("w", F.when(known == 0, every).when(bulls >= LEAST_BULLS, bull / bulls).otherwise(0.0))


def fixed_mix(mix: dict[str, float]) -> Callable[[DataFrame], DataFrame]:
    def build(panel: DataFrame) -> DataFrame:
        weights = F.create_map(*[F.lit(x) for kv in mix.items() for x in kv])
        return panel.withColumn("w", F.coalesce(F.element_at(weights, F.col("asset")), F.lit(0.0)))

    return build


#: Strategies by name: panel (asset, dt, er, ret, rf, regime, mu) to the panel with w. add() puts in more.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"60/40": fixed_mix(FIXED_MIX), "EW": _equal, "EW(JM-XGB)": _regime_equal}
NAMES = ["60/40", "MinVar", "MinVar(JM-XGB)", "MV", "MV(JM-XGB)", "EW", "EW(JM-XGB)"]


def add(name: str, build: Callable[[DataFrame], DataFrame] | Optimised) -> None:
    """Register a strategy: a function of the panel, or the settings of an optimising one."""
    (OPTIMISED if isinstance(build, Optimised) else STRATEGIES)[name] = build


def sensitivity(name: str, risks: tuple[float, ...] = (5.0, 10.0, 20.0), trades: tuple[float, ...] = (0.0, 1.0)) -> dict[str, Optimised]:
    """A strategy with every pair of risk and trade aversion, by name; pass to targets(extra=...)."""
    return {f"{name}|risk={r:g}|trade={t:g}": replace(OPTIMISED[name], risk=r, trade=t) for r in risks for t in trades}


def floored(cov: np.ndarray) -> np.ndarray:
    """cov made symmetric, its eigenvalues raised to max(1e-8, 1e-12 of their mean)."""
    cov = (cov + cov.T) / 2
    val, vec = np.linalg.eigh(cov)
    return (vec * np.maximum(val, max(1e-8, 1e-12 * (np.trace(cov) / len(cov) or 1.0)))) @ vec.T


def daily_targets(x: np.ndarray, ret: np.ndarray, rf: np.ndarray, regime: np.ndarray, mu: np.ndarray, how: Optimised, first: int = 0) -> np.ndarray:
    """Targets of every day from `first` on (days x assets) from excess returns x, total returns, the rate, regimes and conditional means (NaN where there are none).

    Earlier days only feed the covariance and the mean; trading starts from equal weights.
    """
    days, n = x.shape
    fade, slow = 0.5 ** (1 / COV_HALF_LIFE), 0.5 ** (1 / MEAN_HALF_LIFE)
    weight = square = mass = 0.0
    once, second, mean = np.zeros(n), np.zeros((n, n)), np.zeros(n)
    total, squares = np.zeros(n), np.zeros(n)
    held, out, begin = np.full(n, 1 / n), np.zeros((days, n)), first
    for t in range(days):
        weight, square = weight * fade + 1, square * fade * fade + 1
        once, second = once * fade + x[t], second * fade + np.outer(x[t], x[t])
        mass, mean = mass * slow + 1, mean * slow + x[t]
        total, squares = total + x[t], squares + x[t] ** 2
        if t < begin:
            continue
        if t + 1 < LEAST_COV:
            sd = np.sqrt(np.maximum(squares - total**2 / (t + 1), 0) / t) if t else np.full(n, 0.01)
            cov = np.diag(np.maximum(sd**2, 1e-12))
        else:
            m = once / weight
            cov = floored((second / weight - np.outer(m, m)) / (1 - square / weight**2))
        known = ~np.isnan(regime[t])
        kind = how.mean if known.any() else {"regime": "constant", "conditional": "ewm"}.get(how.mean, how.mean)
        if kind == "conditional" and np.isnan(mu[t]).all():
            kind = "ewm"
        bull = regime[t] == 0
        if kind in ("regime", "conditional") and bull.sum() < LEAST_BULLS:
            w = np.zeros(n)
        else:
            if kind == "constant":
                want = np.full(n, 1e-3)
            elif kind == "regime":
                want = np.where(bull, MINVAR_BULL, MINVAR_BEAR)
            elif kind == "ewm":
                want = mean / mass if t + 1 >= LEAST_MEAN else np.zeros(n)
            else:
                want = np.nan_to_num(mu[t])
                want = np.where(bull, want, np.maximum(want, BEAR_CAP))
            # the settings of the plain strategy where a regime one falls back on it
            plain = {"constant": (10.0, 0.0), "ewm": (5.0, 0.0)}.get(kind) if kind != how.mean else None
            risk, trade = plain or (how.risk, how.trade)
            w = portfolio.solve(want, cov, held, risk, trade)
        out[t] = np.clip(w, 0, 1)
        if t + 1 < days:
            grown, rest = out[t] * (1 + ret[t + 1]), max(1 - out[t].sum(), 0.0)
            value = grown.sum() + rest * (1 + rf[t + 1])
            held = grown / value if value > 0 else np.zeros(n)
    return out[begin:]


def targets(panel: DataFrame, names: list[str] | None = None, extra: dict[str, Optimised | Callable[[DataFrame], DataFrame]] | None = None, start=None, end=None) -> DataFrame:
    """(strategy, asset, dt, er, rf, w) of each named strategy for panel (asset, dt, er, ret, rf, regime, mu); er is the total return that is earned.

    extra: more strategies by name, for this call alone, as add() takes them. Covariances and means read all days; targets are made from start to end, starting from equal weights. An unknown name is an error.
    """
    optimised = OPTIMISED | {k: v for k, v in (extra or {}).items() if isinstance(v, Optimised)}
    plain = {k: v for k, v in STRATEGIES.items() if k not in (extra or {})} | {k: v for k, v in (extra or {}).items() if k not in optimised}
    names = list(dict.fromkeys([*(NAMES if names is None else names), *(extra or {})]))
    if unknown := [x for x in names if x not in plain and x not in optimised]:
        raise ValueError(f"unknown strategies {unknown}; known: {[*plain, *optimised]}")
    inside = (F.lit(True) if start is None else F.col("dt") >= F.lit(start)) & (F.lit(True) if end is None else F.col("dt") <= F.lit(end))
    parts = [plain[x](panel.where(inside)).select(F.lit(x).alias("strategy"), "asset", "dt", F.col("ret").alias("er"), "rf", "w") for x in names if x in plain]
    chosen = [x for x in names if x not in plain]
    if chosen:
        rows = panel.withColumn("inside", inside).withColumn("strategy", F.explode(F.array(*map(F.lit, chosen))))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            name = pdf["strategy"].iloc[0]
            wide = {c: pdf.pivot(index="dt", columns="asset", values=c).sort_index().sort_index(axis=1) for c in ("er", "ret", "regime", "mu")}
            by_day = pdf.groupby("dt")[["rf", "inside"]].first().sort_index()
            x, live = wide["er"].fillna(0.0).to_numpy(float), by_day["inside"].to_numpy(bool)
            ret, rf = wide["ret"].fillna(0.0).to_numpy(float), by_day["rf"].fillna(0.0).to_numpy(float)
            first = int(live.argmax()) if live.any() else len(live)
            stop = len(live) - int(live[::-1].argmax()) if live.any() else len(live)
            w = daily_targets(x[:stop], ret[:stop], rf[:stop], wide["regime"].to_numpy(float)[:stop], wide["mu"].to_numpy(float)[:stop], optimised[name], first)
            days, assets = wide["er"].index[live], wide["er"].columns
            return pd.DataFrame({"strategy": name, "asset": np.tile(assets, len(days)), "dt": np.repeat(days, len(assets)), "er": ret[live].ravel(), "rf": np.repeat(rf[live], len(assets)), "w": w.ravel()})

        parts.append(rows.groupBy("strategy").applyInPandas(one, "strategy string, asset string, dt date, er double, rf double, w double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run(panel: DataFrame, names: list[str] | None = None, extra: dict[str, Optimised | Callable[[DataFrame], DataFrame]] | None = None, start=None, end=None, cost: float = 5e-4) -> DataFrame:
    """(strategy, dt, ret, turnover, leverage) of every strategy."""
    return backtest.run(targets(panel, names, extra, start, end), cost)
