"""Regimes by a jump-penalised clustering model: half squared distance to a state's centre, plus a penalty for each change of state.

A fit alternates between the best label path (dynamic programming) and the centres until the objective rests. It is iterative, so each group is one call
of applyInPandas; groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import by, upto


def best_path(cost: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of least total cost plus penalty per change; of equal ones those of lower states. Cheapest-so-far needs only the best state before each row."""
    rows, states = cost.shape
    if states == 2:
        return _best_path_of_two(cost, penalty)
    came = np.zeros((rows, states), np.int64)
    total = cost[0].copy()
    for t in range(1, rows):
        low = int(total.argmin())
        switch = total[low] + penalty
        came[t] = np.where(total <= switch, np.arange(states), low)
        total = np.minimum(total, switch) + cost[t]
    path = np.empty(rows, np.int64)
    path[-1] = total.argmin()
    for t in range(rows - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def _best_path_of_two(cost: np.ndarray, penalty: float) -> np.ndarray:
    """best_path for two states: all that matters is how much dearer state 1 is so far, which a change of state bounds by the penalty."""
    step = (cost[:, 1] - cost[:, 0]).tolist()
    gap, s = [], 0.0
    for d in step:
        s = (penalty if s > penalty else -penalty if s < -penalty else s) + d
        gap.append(s)
    label = 0 if gap[-1] >= 0 else 1
    path = [label]
    for s in reversed(gap[:-1]):
        if label == 0:
            label = 1 if s < -penalty else 0
        else:
            label = 0 if s >= penalty else 1
        path.append(label)
    return np.array(path[::-1], np.int64)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return 0.5 * ((x[:, None, :] - centres[None]) ** 2).sum(2)


def spread_centres(x: np.ndarray, states: int, rng: np.random.Generator) -> np.ndarray:
    """First centres: one row at random, each further one with a chance in proportion to its squared distance from those before."""
    picked = [int(rng.integers(len(x)))]
    for _ in range(states - 1):
        d = np.nan_to_num(2 * distances(x, x[picked]).min(1), nan=0.0, posinf=0.0, neginf=0.0)
        total = d.sum()
        if total > 0 and np.isfinite(total):
            picked.append(int(rng.choice(len(x), p=d / total)))
        else:  # rows that are all alike: any one not taken yet
            rest = np.setdiff1d(np.arange(len(x)), picked)
            picked.append(int(rng.choice(rest)) if rest.size else int(rng.integers(len(x))))
    return x[picked].copy()


def fit(x: np.ndarray, states: int = 2, penalty: float = 50.0, max_iter: int = 300, tol: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres). A state without rows gets the zero vector as its centre."""
    centres = spread_centres(x, states, np.random.default_rng(seed))
    last = np.inf
    labels = np.zeros(len(x), np.int64)
    for _ in range(max_iter):
        cost = distances(x, centres)
        labels = best_path(cost, penalty)
        value = cost[np.arange(len(x)), labels].sum() + penalty * np.count_nonzero(np.diff(labels))
        centres = np.stack([x[labels == k].mean(0) if (labels == k).any() else np.zeros(x.shape[1]) for k in range(states)])
        if abs(last - value) < tol:
            break
        last = value
    return labels, centres


def _line(cost: np.ndarray, labels: np.ndarray) -> tuple[float, int]:
    """What a path costs as a line over the penalty: its value at 0, and its changes of state."""
    return float(cost[np.arange(len(cost)), labels].sum()), int(np.count_nonzero(np.diff(labels)))


def best_paths(cost: np.ndarray, penalties: Sequence[float]) -> list[np.ndarray]:
    """best_path for every penalty (ascending), by as few searches as there are different paths, about twice.

    The least cost is concave and piecewise linear in the penalty, each piece a path. Of two paths on the lower envelope, the one where their lines cross tells: if
    none is cheaper there, nothing lies between them, and the penalties on either side of the crossing take their own; else the new path parts the interval.
    """
    out: list[np.ndarray | None] = [None] * len(penalties)
    if not len(penalties):
        return []
    ends = [(i, best_path(cost, penalties[i])) for i in dict.fromkeys((0, len(penalties) - 1))]
    for i, path in ends:
        out[i] = path
    # (first, last, path before, path after): penalties first..last lie between those that have these paths
    todo = [(1, len(penalties) - 2, ends[0][1], ends[-1][1])]
    while todo:
        lo, hi, before, after = todo.pop()
        if lo > hi:
            continue
        (a, m), (b, n) = _line(cost, before), _line(cost, after)
        if np.array_equal(before, after) or m == n and a == b:
            for i in range(lo, hi + 1):
                out[i] = before
            continue
        cross = (b - a) / (m - n) if m > n else penalties[lo]
        close = 1e-9 * max(1.0, abs(cross))
        for i in [i for i in range(lo, hi + 1) if abs(penalties[i] - cross) <= close]:  # ties are for the search itself
            out[i] = best_path(cost, penalties[i])
        path = best_path(cost, cross)
        c, k = _line(cost, path)
        closed = m > n and c + cross * k >= a + cross * m - 1e-9 * max(1.0, abs(a))
        left = [i for i in range(lo, hi + 1) if out[i] is None and penalties[i] < cross]
        right = [i for i in range(lo, hi + 1) if out[i] is None and penalties[i] >= cross]
        if closed:
            for i in left:
                out[i] = before
            for i in right:
                out[i] = after
            continue
        if len(left) + len(right) == hi - lo + 1 and k in (m, n):  # no progress by rounding: look at each
            for i in [*left, *right]:
                out[i] = best_path(cost, penalties[i])
            continue
        if left:
            todo.append((left[0], left[-1], before, path))
        if right:
            todo.append((right[0], right[-1], path, after))
    return out


def fit_all(x: np.ndarray, penalties: Sequence[float], states: int = 2, max_iter: int = 300, tol: float = 1e-6, seed: int = 0) -> list[np.ndarray]:
    """The labels of fit for every penalty. All fits begin with the same centres, and go on together for as long as their paths, and so their centres, are the same."""
    order = np.argsort(np.asarray(penalties, float), kind="stable").tolist()
    labels: list[np.ndarray] = [np.zeros(len(x), np.int64)] * len(order)
    last, rank = [np.inf] * len(order), np.argsort(order).tolist()
    together = [(spread_centres(x, states, np.random.default_rng(seed)), order)]
    for _ in range(max_iter):
        after: dict[bytes, tuple[np.ndarray, list[int]]] = {}
        for centres, members in together:
            cost = distances(x, centres)
            lines: dict[bytes, tuple[float, int]] = {}
            for i, path in zip(members, best_paths(cost, [float(penalties[i]) for i in members]), strict=True):
                labels[i], name = path, path.tobytes()
                if name not in lines:
                    lines[name] = _line(cost, path)
                value = lines[name][0] + penalties[i] * lines[name][1]
                if abs(last[i] - value) >= tol:
                    if name not in after:
                        after[name] = (np.stack([x[path == k].mean(0) if (path == k).any() else np.zeros(x.shape[1]) for k in range(states)]), [])
                    after[name][1].append(i)
                last[i] = value
        together = [(c, sorted(m, key=rank.__getitem__)) for c, m in after.values()]
        if not together:
            break
    return labels


def regimes(df: DataFrame, features: list[str], key: str = "asset", order: str = "t", value: str = "er", states: int = 2, penalty: float = 50.0, seed: int = 0) -> DataFrame:
    """(key, order, regime): 0 for the state of the highest mean value, 1 for any other. Rows with a null feature are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        labels, _ = fit(pdf[features].to_numpy(float), states, penalty, seed=seed)
        means = pdf[value].groupby(labels).mean()
        return pd.DataFrame({key: pdf[key], order: pdf[order], "regime": (labels != means.idxmax()).astype("int32")})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    return df.dropna(subset=features).select(key, order, value, *[f for f in features if f != value]).groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {order} {kinds[order]}, regime int")


def bear_labels(labels: np.ndarray, values: np.ndarray, states: int = 2) -> np.ndarray:
    """0 for rows of the state with the highest mean value, 1 for all others; states without rows don't count."""
    mean = [values[labels == k].mean() if (labels == k).any() else -np.inf for k in range(states)]
    return (labels != int(np.argmax(mean))).astype(np.int64)


def consensus(df: DataFrame, features: list[str], seeds: int = 5, penalty: float = 50.0, key: str = "asset", order: str = "t", value: str = "er") -> DataFrame:
    """(key, order, regime) on every row: the majority (one half at least) of two-state fits from `seeds` different starts, one task a key and start.

    Rows with a null feature take the last regime before them, else the first after them, else 0.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    rows = df.select(key, order, value, *features).dropna().withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        labels, _ = fit(pdf[features].to_numpy(float), 2, penalty, seed=int(pdf["_seed"].iloc[0]))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "vote": bear_labels(labels, pdf[value].to_numpy(float))})

    votes = rows.groupBy(key, "_seed").applyInPandas(one, f"{key} {kinds[key]}, {order} {kinds[order]}, vote int")
    known = votes.groupBy(key, order).agg(F.when(F.avg("vote") >= 0.5, 1).otherwise(0).alias("_r"))
    all_ = df.select(key, order).join(known, [key, order], "left")
    ahead = by(key, order).rowsBetween(0, Window.unboundedFollowing)
    return all_.select(key, order, F.coalesce(F.last("_r", ignorenulls=True).over(upto(key, order)), F.first("_r", ignorenulls=True).over(ahead), F.lit(0)).alias("regime"))


def refits(training: DataFrame, features: list[str], key: str = "asset", rebal: str = "rebal", day: str = "dt", value: str = "er", penalty: float = 50.0, seed: int = 0) -> DataFrame:
    """(key, rebal, day, state, regime, features): one fit for each key and rebal over its training rows; one task each. state: the fit's own number, regime: 0 bull, 1 bear."""
    kinds = {c: training.schema[c].dataType.simpleString() for c in (key, rebal, day)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        labels, _ = fit(pdf[features].to_numpy(float), 2, penalty, seed=seed)
        return pd.DataFrame({key: pdf[key], rebal: pdf[rebal], day: pdf[day], "state": labels, "regime": bear_labels(labels, pdf[value].to_numpy(float)), **{f: pdf[f] for f in features}})

    rows = training.select(key, rebal, day, *dict.fromkeys([value, *features])).dropna()
    return rows.groupBy(key, rebal).applyInPandas(one, f"{key} {kinds[key]}, {rebal} {kinds[rebal]}, {day} {kinds[day]}, state int, regime int, " + ", ".join(f"{f} double" for f in features))
