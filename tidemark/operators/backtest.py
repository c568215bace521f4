"""Backtest of daily target weights: trade from the drifted weights to the target at a day's end, earn the next day's returns.

The weights before a trade follow from the last target alone, so the whole loop is windows; no state is carried from row to row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import islands


def run(targets: DataFrame, cost: float = 5e-4) -> DataFrame:
    """(strategy, dt, ret, turnover, leverage) from (strategy, dt, asset, w, er, rf), one row per asset on every day.

    w is clipped to [0, 1]; null returns count as 0. The first trade starts from equal weights. dt is the day the return is earned; the rest of the
    money earns rf. If nothing is left of the money, the weights before the next trade are 0.
    """
    own, day = Window.partitionBy("strategy", "asset").orderBy("dt"), Window.partitionBy("strategy", "dt")
    zero = F.lit(0.0)
    t = targets.select("strategy", "asset", "dt", F.least(F.greatest(F.coalesce("w", zero), zero), F.lit(1.0)).alias("w"), F.coalesce("er", zero).alias("er"), F.coalesce("rf", zero).alias("rf"))
    t = t.withColumns({"next_dt": F.lead("dt").over(own), "r": F.lead("er").over(own), "rf1": F.lead("rf").over(own)})
    t = t.withColumns({"n": F.count(F.lit(1)).over(day), "lev": F.sum("w").over(day), "grown": F.col("w") * (1 + F.col("r"))})
    t = t.withColumn("rest", F.greatest(1 - F.col("lev"), zero))
    t = t.withColumn("v", F.sum("grown").over(day) + F.col("rest") * (1 + F.col("rf1")))
    held = F.when(F.col("v") > 0, F.col("grown") / F.col("v")).otherwise(0.0)
    t = t.withColumn("held", held).withColumn("before", F.coalesce(F.lag("held").over(own), 1.0 / F.col("n")))
    days = t.where("next_dt IS NOT NULL").groupBy("strategy", F.col("next_dt").alias("dt")).agg(
        F.sum(F.col("w") * F.col("r")).alias("gain"), F.max(F.col("rest") * F.col("rf1")).alias("cash"), F.sum(F.abs(F.col("w") - F.col("before"))).alias("turnover"), F.max("lev").alias("leverage")
    )
    return days.select("strategy", "dt", (F.col("gain") + F.col("cash") - F.col("turnover") * cost).alias("ret"), "turnover", "leverage")


def metrics(days: DataFrame) -> DataFrame:
    """One row per strategy of (strategy, dt, ret, turnover, leverage, rf): yearly excess return and volatility, Sharpe, drawdown, Calmar, turnover, leverage."""
    upto = Window.partitionBy("strategy").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumn("x", F.col("ret") - F.col("rf")).withColumn("wealth", F.product(1 + F.col("x")).over(upto)).withColumn("peak", F.max("wealth").over(upto))
    year = F.sqrt(F.lit(252.0))
    s = x.groupBy("strategy").agg((F.avg("x") * 252).alias("ann_ret"), (F.stddev_samp("x") * year).alias("ann_vol"), F.min(F.col("wealth") / F.col("peak") - 1).alias("mdd"), (F.avg("turnover") * 252).alias("turnover"), F.avg("leverage").alias("leverage"))
    return s.withColumn("sharpe", F.try_divide("ann_ret", "ann_vol")).withColumn("calmar", F.try_divide(F.abs("ann_ret"), F.abs("mdd")))


def signed_ratios(df: DataFrame, keys: list[str], order: str, value: str, year: int = 252) -> DataFrame:
    """(keys, calmar, sortino): yearly mean over the deepest fall from a peak, with its sign and null where there is none; Sortino, 0 with fewer than 2 rows or hardly any fall."""
    w, x = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), F.col(value)
    d = df.withColumn("_w", F.product(1 + x).over(w)).withColumn("_fall", 1 - F.col("_w") / F.max("_w").over(w))
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    return d.groupBy(*keys).agg(F.when(F.max("_fall") > 1e-9, F.avg(x) * year / F.max("_fall")).alias("calmar"), F.when((F.count(x) >= 2) & (down >= 1e-12), F.avg(x) * year / (down * F.sqrt(F.lit(float(year))))).otherwise(0.0).alias("sortino"))


def bear_shading(df: DataFrame, label: str, key: str = "asset", day: str = "dt", order: str = "t", value: str = "er") -> DataFrame:
    """(key, start, stop, n, wealth) of every run of bear days: from its first day to the first day after it, or the last day of all; wealth at its last day."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumns({"_wealth": F.product(1 + F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead(day).over(w)})
    return islands(x, label, key, order).where(F.col(label) == 1).groupBy(key, "run").agg(F.min(day).alias("start"), F.coalesce(F.max("_next"), F.max(day)).alias("stop"), F.count(F.lit(1)).alias("n"), F.max_by("_wealth", order).alias("wealth")).drop("run")
