"""Portfolio construction: targets of simple strategies as windows, and a small quadratic programme for the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COST, CAP, LEVERAGE, LEAST_BULLS = 5e-4, 0.40, 1.0, 4


def equal_weight(df: DataFrame, day: str = "dt"):
    return 1.0 / F.count(F.lit(1)).over(Window.partitionBy(day))


def regime_equal_weight(regime: str = "regime", day: str = "dt", least: int = LEAST_BULLS):
    """Equal shares of the bullish assets (regime 0); all cash where fewer than `least` are."""
    bulls = F.sum(F.when(F.col(regime) == 0, 1).otherwise(0)).over(Window.partitionBy(day))
    return F.when((bulls >= least) & (F.col(regime) == 0), 1.0 / bulls).otherwise(0.0)


def single_asset_rule(df: DataFrame, pred: str, ret: str, risk: float, trade: float, leverage: float = 1.0, cost: float = COST, key: str = "asset", order: str = "t") -> DataFrame:
    """df with position and net: leave the asset when the prediction is bearish, pay for every change of position."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("position", (1 - F.col(pred)) * F.lit(min(max(10.0 / risk, 0.0), leverage)))
    return d.withColumn("net", F.col("position") * F.col(ret) - F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))) * cost * (1 + trade))


def optimise(mu: np.ndarray, sigma: np.ndarray, before: np.ndarray, risk: float, trade: float, cost: float = COST, cap: float = CAP, leverage: float = LEVERAGE, steps: int = 2000) -> np.ndarray:
    """Weights that maximise mu w - risk w' sigma w - trade cost |w - before|, with 0 <= w <= cap and sum w <= leverage.

    Accelerated proximal gradient; the proximal step moves each weight towards `before` by at most the trading cost, and a bisection on one
    multiplier meets the leverage.
    """
    size = 1.0 / max(2 * risk * np.linalg.eigvalsh(sigma)[-1], 1e-12)
    pull = size * trade * cost

    def step(v: np.ndarray) -> np.ndarray:
        def at(m: float) -> np.ndarray:
            d = v - m - before
            return np.clip(before + np.sign(d) * np.maximum(np.abs(d) - pull, 0), 0, cap)

        w = at(0.0)
        if w.sum() <= leverage:
            return w
        lo, hi = 0.0, float(np.abs(v).max() + np.abs(before).max() + pull + 1)
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at(mid).sum() > leverage else (lo, mid)
        return at(hi)

    w = y = np.clip(before, 0, cap)
    k = 1.0
    for _ in range(steps):
        new = step(y + size * (mu - 2 * risk * sigma @ y))
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y = new + (k - 1) / nk * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w, k = new, nk
    return w


def solve(mu: np.ndarray, sigma: np.ndarray, before: np.ndarray, risk: float, trade: float, cost: float = COST, cap: float = CAP, leverage: float = LEVERAGE) -> np.ndarray:
    """What optimise() finds, by an active set: exact, and a few small linear systems where the weights held are near the answer.

    Every weight is fixed at a break of its terms (0, the weight held, the cap) or free between two of them. A step goes to the best point of the free
    weights, or to the first break on the way; there, a fixed weight that gains by moving is freed, until none does.
    """
    n, c, h, eps = len(mu), trade * cost, 2 * risk * sigma, 1e-11
    w = np.clip(before, 0, cap)
    if w.sum() > leverage:
        w = w * (leverage / w.sum())
    breaks = [sorted({0.0, cap, *([float(b)] if c and 0 < b < cap else [])}) for b in before]
    low, high = np.zeros(n), np.full(n, cap)
    side = np.zeros(n)
    fixed = np.array([min(abs(x - b) for b in bs) < 1e-12 for x, bs in zip(w, breaks, strict=True)])
    for i in np.flatnonzero(fixed):
        w[i] = min(breaks[i], key=lambda b: abs(b - w[i]))
    for i in np.flatnonzero(~fixed):
        low[i], high[i] = max(b for b in breaks[i] if b < w[i]), min(b for b in breaks[i] if b > w[i])
        side[i] = 1.0 if w[i] > before[i] else -1.0
    tight = w.sum() >= leverage - 1e-12

    def free(i: int, up: bool) -> None:
        fixed[i] = False
        side[i] = (1.0 if w[i] >= before[i] else -1.0) if up else (-1.0 if w[i] <= before[i] else 1.0)
        low[i], high[i] = (w[i], min(b for b in breaks[i] if b > w[i] + 1e-12)) if up else (max(b for b in breaks[i] if b < w[i] - 1e-12), w[i])

    for _ in range(40 * n):
        f = np.flatnonzero(~fixed)
        slope, m = mu - h @ w, 0.0
        d = np.zeros(n)
        if f.size:
            want = slope[f] - c * side[f]
            inv = np.linalg.solve(h[np.ix_(f, f)], np.column_stack([want, np.ones(f.size)]))
            if tight:
                m = inv[:, 0].sum() / inv[:, 1].sum()
                d[f] = inv[:, 0] - m * inv[:, 1]
            else:
                d[f] = inv[:, 0]
        if np.abs(d).max() > 1e-13:
            room = np.full(n, np.inf)
            room[f] = np.where(d[f] > 0, (high[f] - w[f]), (w[f] - low[f])) / np.maximum(np.abs(d[f]), 1e-300)
            k = int(room.argmin())
            whole = (leverage - w.sum()) / d.sum() if not tight and d.sum() > 1e-15 else np.inf
            step = min(1.0, room[k], max(whole, 0.0))
            w = w + step * d
            if step == room[k]:
                w[k], fixed[k] = (high[k] if d[k] > 0 else low[k]), True
            elif step == whole:
                tight = True
            continue
        up = np.where(w < cap - 1e-12, slope - np.where(w >= before, c, -c), -np.inf)
        down = np.where(w > 1e-12, slope + np.where(w <= before, c, -c), np.inf)
        if tight and not f.size:  # any multiplier between the best gain of more and the least loss of less will do
            m = max(0.0, up.max())
            if m <= down.min() + eps:
                return w
            if up.max() <= 0:
                tight = False
                continue
            i, j = int(up.argmax()), int(down.argmin())
            free(i, True)
            free(j, False)
            continue
        if tight and m < -eps:
            tight = False
            continue
        gain_up, gain_down = np.where(fixed, up - m, -np.inf), np.where(fixed, m - down, -np.inf)
        i, j = int(gain_up.argmax()), int(gain_down.argmax())
        if max(gain_up[i], gain_down[j]) <= eps:
            return w
        if gain_up[i] >= gain_down[j]:
            free(i, True)
        else:
            free(j, False)
    return optimise(mu, sigma, before, risk, trade, cost, cap, leverage)


def ewm_covariance(df: DataFrame, half_life: float = 252, key: str = "asset", order: str = "dt", value: str = "er") -> DataFrame:
    """(a, b, cov): exponentially weighted covariance of every pair of assets at the last day, bias-corrected, over days that both have.

    Weights halve every half_life days of the calendar, which is the days that any asset has: one row a day.
    """
    days = df.select(order).distinct().withColumn("_age", F.row_number().over(Window.orderBy(F.desc(order))) - 1)
    d = df.join(F.broadcast(days), order).withColumn("w", F.pow(F.lit(2.0), -F.col("_age") / half_life))
    p = d.alias("p").join(d.alias("q"), F.col(f"p.{order}") == F.col(f"q.{order}")).select(F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"), F.col("p.w").alias("w"), F.col(f"p.{value}").alias("x"), F.col(f"q.{value}").alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = p.groupBy("a", "b").agg(F.sum(w).alias("s"), F.sum(w * w).alias("s2"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"))
    return sums.select("a", "b", ((F.col("sxy") / F.col("s") - F.col("sx") * F.col("sy") / F.pow("s", 2)) / (1 - F.col("s2") / F.pow("s", 2))).alias("cov"))
