"""Forecasts of the next regime: logistic regression and boosted stumps per group, and the search for the best jump penalty."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jump_model
from .classifiers import logistic


def stumps(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.3, cuts: int = 32) -> list[tuple[int, float, float, float]]:
    """Boosted stumps under log loss: (feature, cut, value below or at the cut, value above) of each round; cuts are tried at quantiles."""
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1])) for j in range(x.shape[1])]
    below = [x[:, j, None] <= g for j, g in enumerate(grid)]
    f, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        best = (-1.0, 0, 0, 0.0, 0.0)
        for j, m in enumerate(below):
            if not m.shape[1]:
                continue
            gl, hl = g @ m, h @ m
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, rate * gl[k] / (hl[k] + 1), rate * gr[k] / (hr[k] + 1))
        _, j, k, lo, hi = best
        if best[0] < 0:
            break
        f += np.where(below[j][:, k], lo, hi)
        out.append((j, float(grid[j][k]), float(lo), float(hi)))
    return out


def stump_probability(model: list[tuple[int, float, float, float]], x: np.ndarray) -> np.ndarray:
    f = sum((np.where(x[:, j] <= cut, lo, hi) for j, cut, lo, hi in model), np.zeros(len(x)))
    return 1 / (1 + np.exp(-f))


def next_regime(df: DataFrame, features: list[str], label: str, method: str, split: float = 0.6, least: int = 50, key: str = "asset", order: str = "t") -> DataFrame:
    """(key, order, prob): probability that the next row's label is 1, for the rows after a group's first `split` share; learned from that share.

    A label of one kind only gives that kind's constant; persistence repeats the last training label. Fewer than `least` training rows repeat the present label. Rows with null features are left out.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[features].to_numpy(float), pdf[label].to_numpy(float)
        n = int(len(pdf) * split)
        train, target = x[: max(n - 1, 0)], y[1:n]
        if method == "persistence" and n:
            prob = np.full(len(x) - n, y[n - 1])  # the last known label, for all days to come
        elif len(target) < least:
            prob = y[n:]
        elif target.min() == target.max():
            prob = np.full(len(x) - n, target[0])
        else:
            mean, sd = train.mean(0), np.maximum(train.std(0), 1e-12)
            z, new = (train - mean) / sd, (x[n:] - mean) / sd
            if method == "logistic":
                b = logistic(z, target)
                prob = 1 / (1 + np.exp(-(b[0] + new @ b[1:])))
            elif method == "boosted":
                prob = stump_probability(stumps(z, target), new)
            else:
                raise ValueError(f"unknown method {method}")
        return pd.DataFrame({key: pdf[key].iloc[n:], order: pdf[order].iloc[n:], "prob": prob})

    return df.select(key, order, label, *features).dropna().groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {order} {kinds[order]}, prob double")


def penalty_search(df: DataFrame, features: list[str], penalties: list[float], split: float = 0.6, cost: float = 5e-4, key: str = "asset", order: str = "t", value: str = "er") -> DataFrame:
    """(key, penalty, sharpe) of the penalty with the best Sharpe ratio after a group's first `split` share; of equal ones the first.

    A candidate is fitted on that share; later rows take the nearest centre. The rule holds the asset the day after a bullish state and pays for changes.
    One task per group and penalty.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("penalty")) for i, p in enumerate(penalties)])).alias("g")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, order, value, *features).dropna().select("*", grid).select(key, order, value, *features, "g.i", "g.penalty")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, r = pdf[features].to_numpy(float), pdf[value].to_numpy(float)
        n, penalty = int(len(x) * split), float(pdf["penalty"].iloc[0])
        sharpe = float("nan")
        if n >= 2 and len(x) - n >= 3:
            labels, centres = jump_model.fit(x[:n], 2, penalty)
            mean = [r[:n][labels == k].mean() if (labels == k).any() else -np.inf for k in range(2)]
            state = jump_model.distances(x[n:], centres).argmin(1)
            hold = np.concatenate([[0.0], (state == int(np.argmax(mean)))[:-1]])
            net = hold * r[n:] - np.abs(np.diff(hold, prepend=0.0)) * cost
            if net.std(ddof=1) > 0:
                sharpe = float(net.mean() / net.std(ddof=1) * np.sqrt(252))
        return pd.DataFrame({key: pdf[key].iloc[:1], "i": pdf["i"].iloc[:1], "penalty": [penalty], "sharpe": [sharpe]})

    scored = rows.groupBy(key, "i").applyInPandas(one, f"{key} {kind}, i int, penalty double, sharpe double").withColumn("sharpe", F.nanvl("sharpe", F.lit(None).cast("double")))
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("sharpe"), "i"))
    return scored.withColumn("k", k).where("k = 1").select(key, "penalty", "sharpe")


def refit_reason(labels: np.ndarray, days: list, last: tuple[np.ndarray, list, pd.Timestamp] | None, today: pd.Timestamp, theta_ari: float, theta_run: float, safety_days: int) -> tuple[str | None, float | None, float, int | None]:
    """(reason or None, ari_now, mrl_now, days since the last) of a fit of `labels` on `days` against the last accepted one (labels, days, when)."""
    run_now, ari_now, since, reason = len(labels) / (1 + np.count_nonzero(np.diff(labels))), None, None, "initial"
    if last is not None:
        old, old_days, when = last
        since, place = (today - when).days, {d: i for i, d in enumerate(old_days)}
        common = [(place[d], i) for i, d in enumerate(days) if d in place]
        if len(common) > 30:
            a, b = zip(*common, strict=True)
            ari_now = adjusted_rand(old[list(a)], labels[list(b)])
        reason = "ari_collapse" if ari_now is not None and ari_now < theta_ari else "mrl_collapse" if run_now < theta_run else "calendar_safety" if since >= safety_days else None
    return reason, ari_now, float(run_now), since


def refit_events(df: DataFrame, features: list[str], evaluate: str, theta_ari: float, theta_run: float, window: int = 756, least: int = 252, penalty: float = 50.0, safety_days: int = 720, key: str = "asset", order: str = "t", day: str = "dt") -> DataFrame:
    """(key, day, reason, ari_now, mrl_now, days_since_last): evaluation days (rows where `evaluate` is true) on which a new fit is accepted.

    Reasons, the first that holds: initial; ari_collapse (agreement with the last accepted fit on common rows below theta_ari); mrl_collapse
    (mean run length below theta_run); calendar_safety (safety_days since the last). Each day is judged against the last accepted fit, so a group is one sequential call.
    """
    kind, dkind = (df.schema[c].dataType.simpleString() for c in (key, day))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        x, out, last, places = pdf[features].to_numpy(float), [], None, list(range(len(pdf)))
        for i in np.flatnonzero(pdf[evaluate].to_numpy()):
            lo = max(0, i - window)
            if i - lo < least:
                continue
            labels, _ = jump_model.fit(x[lo:i], 2, penalty)
            today = pd.Timestamp(pdf[day].iloc[i])
            reason, ari_now, run_now, since = refit_reason(labels, places[lo:i], last, today, theta_ari, theta_run, safety_days)
            if reason:
                out.append((pdf[key].iloc[0], pdf[day].iloc[i], reason, ari_now, run_now, since))
                last = (labels, places[lo:i], today)
        return pd.DataFrame(out, columns=[key, day, "reason", "ari_now", "mrl_now", "days_since_last"]).astype({"ari_now": "float64", "mrl_now": "float64", "days_since_last": "Int64"})

    needed = list(dict.fromkeys(chain([key, order, day, evaluate], features)))
    return df.select(*needed).dropna().groupBy(key).applyInPandas(one, f"{key} {kind}, {day} {dkind}, reason string, ari_now double, mrl_now double, days_since_last long")


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two labelings beyond chance; 1 where both are the same trivial partition."""
    table = np.zeros((int(a.max()) + 1, int(b.max()) + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    both, left, right, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance = left * right / every
    return 1.0 if (left + right) / 2 == chance else float((both - chance) / ((left + right) / 2 - chance))


def thresholds(df: DataFrame, features: list[str], evaluate: str, span: int = 370, least: int = 100, penalty: float = 50.0, seeds: int = 3, percentile: float = 5.0, key: str = "asset", day: str = "dt") -> DataFrame:
    """(key, theta_ari, theta_mrl): the level below which agreement and run length of quarterly fits on the last `span` calendar days rarely fall, a mean over seeds.

    Percentiles are over the fits of a key; a key with fewer than 504 rows, or without two fits that overlap on more than 30 days, has 0.5 and 30. One task a key and seed.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, day)}
    rows = df.select(key, day, evaluate, *features).dropna().withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        x, at, seed = pdf[features].to_numpy(float), pd.DatetimeIndex(pdf[day]), int(pdf["_seed"].iloc[0])
        aris, runs, last = [], [], None
        for i in np.flatnonzero(pdf[evaluate].to_numpy()) if len(pdf) >= 504 else []:
            lo = int(at.searchsorted(at[i] - pd.Timedelta(days=span)))
            if i + 1 - lo < least:
                continue
            labels, _ = jump_model.fit(x[lo : i + 1], 2, penalty, seed=seed)
            runs.append(len(labels) / (1 + np.count_nonzero(np.diff(labels))))
            if last is not None and last[0] + len(last[1]) - lo > 30:
                common = last[0] + len(last[1]) - lo
                aris.append(adjusted_rand(last[1][-common:], labels[:common]))
            last = (lo, labels)
        both = (float(np.percentile(aris, percentile)), float(np.percentile(runs, percentile))) if aris and runs else (0.5, 30.0)
        return pd.DataFrame({key: pdf[key].iloc[:1], "ari": [both[0]], "mrl": [both[1]]})

    return rows.groupBy(key, "_seed").applyInPandas(one, f"{key} {kinds[key]}, ari double, mrl double").groupBy(key).agg(F.avg("ari").alias("theta_ari"), F.avg("mrl").alias("theta_mrl"))
