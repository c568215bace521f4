"""How well predicted regimes follow true ones: one pass of windows and one aggregate for all thirteen numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ["add", "far", "miss_rate", "cp_accuracy", "cp_balanced_accuracy", "ari", "concordance", "state_accuracy", "state_balanced_accuracy", "mrl_all", "mrl_bull", "mrl_bear", "n_runs"]


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _share(cond: Column, of: Column) -> tuple[Column, Column]:
    return F.sum(F.when(of & cond, 1).otherwise(0)), F.sum(F.when(of, 1).otherwise(0))


def _balanced(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean recall of the classes that occur; 0 if none does."""
    known = [F.when(n > 0, hit / n) for hit, n in pairs]
    some = sum((F.when(n > 0, 1).otherwise(0) for _, n in pairs), F.lit(0))
    return F.when(some > 0, sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0)) / some).otherwise(0.0)


def f1(true: Column, pred: Column) -> Column:
    """F1 of class 1 as an aggregate; 0 where undefined."""
    hit, wrong = F.sum(F.when((true == 1) & (pred == 1), 1).otherwise(0)), F.sum(F.when(true != pred, 1).otherwise(0))
    return _ratio(2 * hit, 2 * hit + wrong)


def with_changes(df: DataFrame, true: str, pred: str, keys: list[str], order: str = "t", horizon: int = 126) -> DataFrame:
    """df with _tc, _pc (whether the true and the predicted label changed; null in a key's first row) and _delay (rows until the prediction has the true label, within the horizon)."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead, row = w.rowsBetween(0, horizon - 1), F.row_number().over(w)
    d = df.withColumn("_row", row)
    nxt = lambda s: F.min(F.when(F.col(pred) == s, F.col("_row"))).over(ahead)
    return d.withColumns({
        "_tc": F.col(true) != F.lag(true).over(w), "_pc": F.col(pred) != F.lag(pred).over(w),
        "_delay": F.when(F.col(true) == 0, nxt(0)).otherwise(nxt(1)) - F.col("_row"),
    })


def aggregates(true: str, pred: str, horizon: int = 126) -> dict[str, Column]:
    """The thirteen aggregates over with_changes' columns. Labels are 0 (bull) and 1 (bear)."""
    t, p, tc, pc = F.col(true), F.col(pred), F.col("_tc"), F.col("_pc")
    changes, count = F.sum(F.when(tc, 1).otherwise(0)), F.count(F.lit(1))
    delay = F.sum(F.when(tc, F.coalesce("_delay", F.lit(horizon))))
    missed = F.sum(F.when(tc & F.col("_delay").isNull(), 1).otherwise(0))
    false_alarms = _share(pc, ~tc)
    same = F.sum(F.when(t == p, 1).otherwise(0))
    n = {(a, b): F.sum(F.when((t == a) & (p == b), 1).otherwise(0)).cast("double") for a in (0, 1) for b in (0, 1)}
    pairs = lambda x: x * (x - 1) / 2
    both = sum((pairs(x) for x in n.values()), F.lit(0.0))
    left, right = pairs(n[0, 0] + n[0, 1]) + pairs(n[1, 0] + n[1, 1]), pairs(n[0, 0] + n[1, 0]) + pairs(n[0, 1] + n[1, 1])
    chance = left * right / pairs(count.cast("double"))
    ari = F.when((left + right) / 2 == chance, 1.0).otherwise((both - chance) / ((left + right) / 2 - chance))
    state = _balanced([_share(p == k, t == k) for k in (0, 1)])
    run = F.coalesce(pc, F.lit(True))  # the first row begins a run
    runs = {k: F.sum(F.when(run & (p == k), 1).otherwise(0)) for k in (0, 1)}
    length = {k: F.sum(F.when(p == k, 1).otherwise(0)) for k in (0, 1)}
    return {
        "add": _ratio(delay, changes), "far": _ratio(*false_alarms), "miss_rate": _ratio(missed, changes),
        "cp_accuracy": _ratio(F.sum(F.when(tc == pc, 1).otherwise(0)), F.count(tc)), "cp_balanced_accuracy": _balanced([_share(pc == k, tc == k) for k in (F.lit(False), F.lit(True))]),
        "ari": ari, "concordance": _ratio(same, count), "state_accuracy": _ratio(same, count), "state_balanced_accuracy": state,
        "mrl_all": _ratio(count, runs[0] + runs[1]), "mrl_bull": _ratio(length[0], runs[0]), "mrl_bear": _ratio(length[1], runs[1]), "n_runs": runs[0] + runs[1],
    }


def summary(df: DataFrame, true: str, pred: str, keys: list[str], order: str = "t", horizon: int = 126) -> DataFrame:
    """(keys, thirteen numbers): delay, false alarms and misses of changes; accuracy of changes and states; agreement; run lengths of the predictions."""
    d = with_changes(df, true, pred, keys, order, horizon)
    return d.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates(true, pred, horizon).items()])
