"""From prices and macro series to aligned daily returns, and the feature sets that models read. Windows only; one row per asset and day throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import as_of, by, downside, ewm_mean, expanding_z, forward_fill, upto

#: Half-lives of the return features, and assets whose clustering features have no downside columns.
DD_HALF_LIVES, MEAN_HALF_LIVES, SORTINO_HALF_LIVES = (5, 21), (5, 10, 21), (5, 10, 21)
NO_DOWNSIDE = ("AggBond", "Treasury", "Gold")
#: Half-lives of the macro features, and the window of the stock-bond correlation.
YIELD_HALF_LIFE, SLOPE_HALF_LIFE, SLOPE_STEP_HALF_LIFE, VIX_HALF_LIFE, CORRELATION_WINDOW = 21, 10, 21, 63, 252
MACRO_FEATURES = ["y2_diff_ewma", "slope_ewma", "slope_diff_ewma", "vix_logdiff_ewma", "stock_bond_corr"]


def on_calendar(df: DataFrame, key: str = "asset", day: str = "dt") -> DataFrame:
    """df with a row for every key on every day that any key has; keys are the fixed few of a universe."""
    grid = df.select(day).distinct().crossJoin(F.broadcast(df.select(key).distinct()))
    return grid.join(df, [key, day], "left")


def simple_returns(prices: DataFrame, price: str = "px", key: str = "asset", day: str = "dt") -> DataFrame:
    """prices with ret: exp of the log price difference less one; null without a price on the day or the one before."""
    step = F.ln(price) - F.ln(F.lag(price).over(by(key, day)))
    return prices.withColumn("ret", F.exp(step) - 1)


def percent_changes(prices: DataFrame, price: str = "px", key: str = "asset", day: str = "dt") -> DataFrame:
    """prices with change: the price over the last known one before it, less one, itself filled forward."""
    known = forward_fill(F.col(price), upto(key, day))
    filled = prices.withColumn("_px", known)
    return filled.withColumn("_raw", F.col("_px") / F.lag("_px").over(by(key, day)) - 1).withColumn("change", forward_fill(F.col("_raw"), upto(key, day))).drop("_px", "_raw")


def prepare(prices: DataFrame, macro: DataFrame, rate: str = "rf", key: str = "asset", day: str = "dt") -> DataFrame:
    """(key, day, ret, er, rf) on the prices' calendar: simple returns, the daily risk-free rate (percent a year in `rate`, as of the day), excess returns.

    Days before any excess return go. Excess returns are filled forward, and 0 before an asset's first one.
    """
    r = simple_returns(on_calendar(prices.select(key, day, "px"), key, day), "px", key, day)
    days = as_of(r.select(day).distinct(), macro, day, [rate])
    r = r.join(days.select(day, F.coalesce(F.col(rate) / 100 / 252, F.lit(0.0)).alias("rf")), day).withColumn("_er", F.col("ret") - F.col("rf"))
    first = r.where("_er IS NOT NULL").agg(F.min(day).alias("_first"))
    r = r.crossJoin(F.broadcast(first)).where(F.col(day) >= F.col("_first"))  # one row
    return r.select(key, day, "ret", F.coalesce(forward_fill(F.col("_er"), upto(key, day)), F.lit(0.0)).alias("er"), "rf")


def first_valid(df: DataFrame, value: str, key: str = "asset", day: str = "dt") -> DataFrame:
    """(key, first): the first day with a value."""
    return df.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), F.col(day))).alias("first"))


def finite(c):
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def null_nans(df: DataFrame) -> DataFrame:
    """df with null for NaN in every floating-point column."""
    return df.select(*[F.nanvl(c, F.lit(None).cast(kind)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


# ------------------------------------------------------------------------------------------------------------------- feature sets

#: Sets of features by name: functions of (panel, key, order) that add columns. register() adds one.
FEATURE_SETS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FEATURE_SETS[name] = f
        return f

    return add


def feature_columns(downside_too: bool = True) -> list[str]:
    dd = [f"log_dd_hl{h}" for h in DD_HALF_LIVES] if downside_too else []
    return [*dd, *[f"avg_ret_hl{h}" for h in MEAN_HALF_LIVES], *[f"sortino_hl{h}" for h in SORTINO_HALF_LIVES]]


def raw_return_features(panel: DataFrame, value: str = "er", key: str = "asset", order: str = "t") -> DataFrame:
    """panel with the eight return features before they are standardised."""
    er, floor = F.col(value), F.lit(1e-8)
    out = {f"log_dd_hl{h}": F.ln(F.greatest(downside(er, h, key, order), floor)) for h in DD_HALF_LIVES}
    out |= {f"avg_ret_hl{h}": ewm_mean(er, h, key, order) for h in MEAN_HALF_LIVES}
    out |= {f"sortino_hl{h}": ewm_mean(er, h, key, order) / F.greatest(downside(er, h, key, order), floor) for h in SORTINO_HALF_LIVES}
    return panel.withColumns(out)


@register("returns")
def return_features(panel: DataFrame, for_clustering: bool = True, no_downside: tuple[str, ...] = NO_DOWNSIDE, value: str = "er", key: str = "asset", order: str = "t") -> DataFrame:
    """panel with eight features standardised by what was known (expanding mean and deviation, 20 rows at least).

    For clustering, the assets in no_downside have null in the two downside columns.
    """
    raw, names = raw_return_features(panel, value, key, order), feature_columns()
    z = {c: expanding_z(F.col(c), 20, key, order) for c in names}
    if for_clustering and no_downside:
        z |= {c: F.when(~F.col(key).isin(*no_downside), z[c]) for c in names if c.startswith("log_dd")}
    return raw.withColumns(z)


def macro_features(macro: DataFrame, days: DataFrame, stock: DataFrame, bond: DataFrame, day: str = "dt", value: str = "er") -> DataFrame:
    """(day, five features) on a trading calendar: smoothed steps of the two-year yield, of the slope and its steps, of log VIX, and a year's stock-bond correlation.

    macro: (day, y2, y10, vix), read as of each day; stock, bond: (day, value). One row a day, so the calendar's own windows are not dealt out.
    """
    one = F.lit("m").alias("_m")
    m = as_of(days.select(day), macro, day, ["y2", "y10", "vix"]).select("*", one).withColumn("_t", F.row_number().over(by("_m", day)))
    w = by("_m", "_t")
    step = lambda c: c - F.lag(c).over(w)
    m = m.withColumns({"_dy": step(F.col("y2")), "_slope": F.col("y10") - F.col("y2"), "_lv": F.ln(F.greatest("vix", F.lit(1e-8)))})
    m = m.withColumns({"_ds": step(F.col("_slope")), "_dv": step(F.col("_lv"))})
    smooth = lambda c, h: ewm_mean(F.col(c), h, "_m", "_t")
    m = m.select(day, "_m", smooth("_dy", YIELD_HALF_LIFE).alias("y2_diff_ewma"), smooth("_slope", SLOPE_HALF_LIFE).alias("slope_ewma"), smooth("_ds", SLOPE_STEP_HALF_LIFE).alias("slope_diff_ewma"), smooth("_dv", VIX_HALF_LIFE).alias("vix_logdiff_ewma"))
    m = m.join(stock.select(day, F.col(value).alias("_s")), day, "left").join(bond.select(day, F.col(value).alias("_b")), day, "left")
    frame = by("_m", day).rowsBetween(1 - CORRELATION_WINDOW, 0)
    m = m.withColumns({"_s": F.when(F.col("_b").isNotNull(), F.col("_s")), "_b": F.when(F.col("_s").isNotNull(), F.col("_b"))})
    # null where either side does not move
    corr = F.try_divide(F.covar_samp("_s", "_b").over(frame), F.stddev_samp("_s").over(frame) * F.stddev_samp("_b").over(frame))
    return m.withColumn("stock_bond_corr", F.when(F.count("_s").over(frame) >= CORRELATION_WINDOW // 2, corr)).drop("_m", "_s", "_b")


def classifier_matrix(panel: DataFrame, macro: DataFrame, key: str = "asset", day: str = "dt", order: str = "t", value: str = "er") -> DataFrame:
    """(key, day, order, value, 13 features): the eight return features (always with downside) and the macro ones of the day, filled forward."""
    x = return_features(panel.select(key, day, order, value), False, (), value, key, order).join(macro, day, "left")
    names = [*feature_columns(), *MACRO_FEATURES]
    return x.select(key, day, order, value, *[forward_fill(F.col(c), upto(key, order)).alias(c) for c in names])


#: Sets of clustering features; the last three are the same, as in the reference.
CLUSTERING_SETS = ("minimal", "standard", "extended", "kitchen_sink")


def clustering_features(kind: str, downside_too: bool = True) -> list[str]:
    """Columns of a clustering set: the smoothed returns alone, or all return and macro features and the volatility."""
    if kind not in CLUSTERING_SETS:
        raise ValueError(f"unknown feature set {kind!r}; one of {CLUSTERING_SETS}")
    every = [*feature_columns(downside_too), *MACRO_FEATURES, "vol"]
    return [c for c in every if "avg_ret" in c] if kind == "minimal" else every


def with_volatility(features: DataFrame, volatility: DataFrame, estimator: str, key: str = "asset", day: str = "dt") -> DataFrame:
    """features with vol: an estimator's column of (key, day, ...), filled forward and then back."""
    x = features.join(volatility.select(key, day, F.col(estimator).alias("vol")), [key, day], "left")
    ahead = by(key, day).rowsBetween(0, Window.unboundedFollowing)
    return x.withColumn("vol", F.coalesce(forward_fill(F.col("vol"), upto(key, day)), F.first("vol", ignorenulls=True).over(ahead)))
