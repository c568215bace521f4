"""Walk-forward regime forecasts: at every rebalance day a jump model and a classifier are fitted on the years before, and forecast the days up to the next one.

The penalty of the jump model is chosen at every rebalance day by the Sharpe ratio that its forecasts earn over the validation years. Validation windows overlap, so
every (asset, start day) is fitted once for all penalties, in a task of its own; choosing, filling and scoring are joins and windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import rebalance_days
from ..sources.sinks import kept
from . import classifiers, jump_model

#: The grid of penalties, 0 and 30 more evenly spaced in their logarithm.
PENALTIES = (0.0, *(10 ** (-1 + 3 * i / 29) for i in range(30)))
#: Half-lives that smooth each asset's probabilities; assets without one are not smoothed.
SMOOTHING = {"LargeCap": 8, "MidCap": 8, "SmallCap": 8, "REIT": 8, "AggBond": 8, "Treasury": 8, "Commodity": 4, "Gold": 4, "Corporate": 2}


@dataclass(frozen=True)
class Walk:
    """What a walk-forward run is made of. cluster, classify: feature columns of the jump model and of the classifier."""

    cluster: tuple[str, ...]
    classify: tuple[str, ...]
    months: tuple[int, ...] = (1, 7)
    train_years: int = 11
    validation_years: int = 5
    least_train: int = 252
    least_rows: int = 50
    method: str = "xgboost"
    depth: int = 6
    trees: int = 100
    threshold: float = 0.5
    cost: float = 5e-4
    seed: int = 0
    smoothing: dict[str, float] = field(default_factory=dict)


def start_days(days: DataFrame, walk: Walk, day: str = "dt") -> DataFrame:
    """(start, end, rebal): blocks of forecast days, end excluded (null: to the last day). rebal is null for the regular ones, which begin on rebalance days;
    a validation window that begins inside a rebalance month, after its first day, has a first block of its own. A few rows a year."""
    w = Window.orderBy("start")  # rebalance days
    regular = rebalance_days(days, walk.months, day).select(F.col("rebal").alias("start")).withColumn("end", F.lead("start").over(w))
    open_ = days.select(F.col(day).alias("d")).join(F.broadcast(regular.select(F.col("start").alias("rebal"))), F.col("d") >= F.add_months("rebal", -12 * walk.validation_years)).where("d < rebal")
    first = open_.groupBy("rebal").agg(F.min("d").alias("start")).where(F.month("start").isin(*walk.months))
    partial = first.join(regular.select("start"), "start", "left_anti").join(F.broadcast(regular.select(F.col("start").alias("next"))), F.col("next") > F.col("start"))
    partial = partial.groupBy("rebal", "start").agg(F.min("next").alias("end"))
    return regular.withColumn("rebal", F.lit(None).cast("date")).unionByName(partial.select("start", "end", "rebal"))


def block_forecasts(df: DataFrame, blocks: DataFrame, walk: Walk, penalties: Sequence[float] = PENALTIES, key: str = "asset", day: str = "dt", value: str = "er") -> DataFrame:
    """(key, start, rebal, day, i, label): forecasts of every block by every penalty (its place i), 0 bull, 1 bear.

    A block without enough training rows has none. Fits of all penalties go on together for as long as they agree, and penalties that give the same labels share a classifier.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, day)}
    names = list(dict.fromkeys([*walk.cluster, *walk.classify]))
    window = (F.col(day) >= F.add_months("start", -12 * walk.train_years)) & (F.col("end").isNull() | (F.col(day) < F.col("end")))
    calendar = df.select(day).distinct().join(F.broadcast(blocks), window)  # days against a few blocks a year; rows then meet their windows by day
    rows = df.select(key, day, value, *[c for c in names if c != value]).join(calendar, day)
    # a window is a task's work for seconds, whatever its bytes: more partitions than windows, so that few share one
    windows = df.select(key).distinct().count() * blocks.count()
    rows = rows.repartition(min(2000, max(1, 3 * windows)), key, "start", "rebal")
    columns = [key, "start", "rebal", day, "i", "label"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        old = (pdf[day] < pdf["start"]).to_numpy()
        train, block = pdf[old], pdf[~old]
        none = pd.DataFrame({c: pd.Series(dtype="int32" if c in ("i", "label") else "object") for c in columns})
        if len(train) < walk.least_train or not len(block):
            return none
        train = train.dropna(subset=list(walk.cluster))
        if len(train) < 2:
            return none
        x, r = train[list(walk.cluster)].to_numpy(float), train[value].to_numpy(float)
        z, new = train[list(walk.classify)].to_numpy(float), block[list(walk.classify)].ffill().to_numpy(float)
        known = np.isfinite(z).all(1)
        known[-1] = False  # its next day is not in the training window
        if known.sum() < walk.least_rows:
            return none
        start, rebal = pdf["start"].iloc[0], pdf["rebal"].iloc[0]
        rebal = None if pd.isna(rebal) else rebal
        half_life, done, out = walk.smoothing.get(str(pdf[key].iloc[0]), 0), {}, []
        for states in jump_model.fit_all(x, penalties, 2, seed=walk.seed):
            labels = jump_model.bear_labels(states, r)
            name = labels.tobytes()
            if name not in done:
                p = classifiers.probabilities(walk.method, z[known], np.append(labels[1:], 0)[known], np.nan_to_num(new), walk.depth, walk.trees)
                done[name] = (classifiers.smoothed(p, half_life) >= walk.threshold).astype(np.int64)
            out.append(done[name])
        n, m = len(block), len(out)
        whole = {key: np.tile(block[key].to_numpy(), m), "start": [start] * (n * m), "rebal": pd.Series([rebal] * (n * m), dtype="object"), day: np.tile(block[day].to_numpy(), m), "i": np.repeat(np.arange(m), n), "label": np.concatenate(out)}
        return pd.DataFrame(whole)[columns]

    return rows.groupBy(key, "start", "rebal").applyInPandas(one, f"{key} {kinds[key]}, start date, rebal date, {day} {kinds[day]}, i int, label int")


def fixed_penalty(df: DataFrame, walk: Walk, penalty: float, start=None, end=None, key: str = "asset", day: str = "dt", value: str = "er") -> DataFrame:
    """(key, day, regime) from start to end: forecasts with one penalty. Days without one keep the last, or are bearish (1)."""
    days = df.select(day).distinct()
    wanted = days.where((F.lit(True) if start is None else F.col(day) >= F.lit(start)) & (F.lit(True) if end is None else F.col(day) <= F.lit(end)))
    w = Window.orderBy("start")
    blocks = rebalance_days(wanted, walk.months, day).select(F.col("rebal").alias("start")).withColumn("end", F.lead("start").over(w)).withColumn("rebal", F.lit(None).cast("date"))
    got = block_forecasts(df, blocks, walk, [penalty], key, day, value).select(key, day, "label")
    grid = df.select(key, day).join(wanted, day, "left_semi")
    return filled(grid.join(got, [key, day], "left"), [key], day).select(key, day, F.col("label").alias("regime"))


def filled(df: DataFrame, keys: list[str], day: str = "dt", label: str = "label") -> DataFrame:
    """df with label filled forward, and 1 before the first."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(label, F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(1)))


def timing_sharpe(df: DataFrame, keys: list[str], day: str = "dt", label: str = "label", value: str = "er", cost: float = 5e-4) -> DataFrame:
    """(keys, sharpe, n): Sharpe ratio of holding the asset the day after a bullish label, paying for every change of label.

    The first two days count as changes, as the day before them has no label to compare. Null with fewer than 5 days; 0 with hardly any deviation.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    d = df.withColumns({"_f1": F.lag(label).over(w), "_f2": F.lag(label, 2).over(w)})
    change = F.when(F.col("_f1").isNull() | F.col("_f2").isNull() | (F.col("_f1") != F.col("_f2")), cost).otherwise(0.0)
    net = F.when(F.col("_f1") == 0, F.col(value)).otherwise(0.0) - change
    s = d.withColumn("_net", net).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_net").alias("_m"), F.stddev_samp("_net").alias("_s"))
    ratio = F.when(F.col("n") < 5, None).when(F.col("_s") < 1e-10, 0.0).otherwise(F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0)))
    return s.select(*keys, ratio.alias("sharpe"), "n")


def _sharpe(state: np.ndarray, r: np.ndarray, cost: float) -> float | None:
    """timing_sharpe of one window."""
    if len(state) < 5:
        return None
    before = np.append(np.nan, state[:-1])
    net = np.where(before == 0, r, 0.0) - (before != np.append(np.nan, before[:-1])) * cost
    sd = net.std(ddof=1)
    return float(net.mean() / sd * np.sqrt(252)) if sd >= 1e-10 else 0.0


def scores(forecasts: DataFrame, df: DataFrame, rebalances: list, walk: Walk, n: int, key: str = "asset", day: str = "dt", value: str = "er") -> DataFrame:
    """(key, at, i, sharpe): what the forecasts of every penalty earn in the validation years before each rebalance day; one task a key and penalty.

    Only blocks that begin inside a window count there; days without a forecast keep the last one in the window, or are bearish.
    """
    kind = df.schema[key].dataType.simpleString()
    days = df.select(key, day, value).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(day)
        at, r = pd.DatetimeIndex(right[day]), right[value].fillna(0.0).to_numpy(float)
        place, label = at.get_indexer(pd.DatetimeIndex(left[day])), left["label"].to_numpy(float)
        start, own = pd.DatetimeIndex(left["start"]), pd.DatetimeIndex(left["rebal"])
        regular, out = own.isna(), []
        for x in rebalances:
            x = pd.Timestamp(x)
            first = x - pd.DateOffset(years=walk.validation_years)
            lo, hi = int(at.searchsorted(first)), int(at.searchsorted(x))
            state = np.full(len(at), np.nan)
            use = (regular | (own == x)) & (start >= first) & (place >= lo) & (place < hi)
            state[place[use]] = label[use]
            sharpe = _sharpe(pd.Series(state[lo:hi]).ffill().fillna(1.0).to_numpy(), r[lo:hi], walk.cost)
            out.append((x.date(), sharpe))
        return pd.DataFrame({key: right[key].iloc[0] if len(right) else None, "at": [o[0] for o in out], "i": right["i"].iloc[0] if len(right) else 0, "sharpe": pd.Series([o[1] for o in out], dtype="float64")})

    s = forecasts.groupBy(key, "i").cogroup(days.groupBy(key, "i")).applyInPandas(one, f"{key} {kind}, at date, i int, sharpe double")
    return s.withColumn("sharpe", F.nanvl("sharpe", F.lit(None).cast("double")))


def search(df: DataFrame, walk: Walk, penalties: Sequence[float] = PENALTIES, done: DataFrame | None = None, start=None, key: str = "asset", day: str = "dt", value: str = "er", keep=None) -> tuple[DataFrame, DataFrame]:
    """((key, day, regime) forecasts, (key, rebal, penalty, sharpe, candidates) choices) from `start` on.

    At each rebalance day the penalty with the best validation Sharpe ratio is taken (of equal ones the first; the first of all where there is no ratio, with
    a null sharpe) and forecasts the days up to the next one; days without a forecast are bearish. done: choices of an earlier run (key, ...), whose keys are left out.
    keep: a function that stores a table that is used more than once and gives it back; by default it is written to the shared folder.
    """
    keep = keep or kept
    if done is not None:
        df = df.join(done.select(key).distinct(), key, "left_anti")
    df = keep(df)
    days = df.select(day).distinct()
    blocks = start_days(days, walk, day)
    got = keep(block_forecasts(df, blocks, walk, penalties, key, day, value))
    regular = sorted(x.start for x in blocks.where("rebal IS NULL").select("start").collect() if start is None or str(x.start) >= str(start))  # a few a year
    spark = df.sparkSession
    spans = F.broadcast(spark.createDataFrame(list(zip(regular, [*regular[1:], None], strict=True)), "at date, next date"))
    each = F.broadcast(spark.createDataFrame([(i, float(p)) for i, p in enumerate(penalties)], "i int, penalty double"))
    scored = scores(got, df, regular, walk, len(penalties), key, day, value)
    w = Window.partitionBy(key, "at")
    best = scored.withColumn("candidates", F.count("sharpe").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc_nulls_last("sharpe"), "i"))).where("k = 1")
    every = df.select(key).distinct().crossJoin(spans.select("at")).join(best.select(key, "at", "i", "sharpe", "candidates"), [key, "at"], "left").withColumn("i", F.coalesce("i", F.lit(0)))
    choices = every.join(each, "i").select(key, F.col("at").alias("rebal"), "i", "penalty", "sharpe", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    ahead = got.where("rebal IS NULL").select(key, F.col("start").alias("at"), "i", day, "label")
    out = df.select(key, day).join(spans, (F.col(day) >= F.col("at")) & (F.col("next").isNull() | (F.col(day) < F.col("next"))))
    out = out.join(choices.select(key, F.col("rebal").alias("at"), "i"), [key, "at"], "left")
    forecasts = filled(out.join(ahead, [key, "at", "i", day], "left"), [key, "at"], day).select(key, day, F.col("label").alias("regime"))
    return forecasts, choices.drop("i")
