"""Running values of long series: a key's rows are dealt over many tasks, so that no task sorts a whole key.

Rows go to range partitions by keys and order, and are written once, so that a row's partition is settled. A running value is then the local one (a window inside partition
and key) put together with what earlier partitions of the key leave (one row a partition and key). This holds for everything that can be put together: sums, products, extremes, last values,
moments, and exponentially weighted sums, which fade by the rows in between.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .series import BLOCK

#: Running values by name: how rows are gathered, and how what came before (c) and the local value (l) make the whole.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda c, l: F.coalesce(c + l, c, l)),
    "count": (F.count, lambda c, l: F.coalesce(c, F.lit(0)) + l),
    "product": (F.product, lambda c, l: F.coalesce(c * l, c, l)),
    "max": (F.max, lambda c, l: F.greatest(c, l)),
    "min": (F.min, lambda c, l: F.least(c, l)),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda c, l: F.coalesce(l, c)),
}


def in_parts(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """df, written in range partitions by keys and order, with the number of each row's partition as _part. parts: how many; else as many as shuffles have."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return kept(df.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order)).withColumn("_part", F.spark_partition_id()), "parts")


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def running(df: DataFrame, keys: list[str], order: str, **columns: tuple[str, Column]) -> DataFrame:
    """df with a column for each of columns: name=(kind, value), the kind (see KINDS) of the value over the key's rows so far, this one too.

    Nulls count as in Spark's windows. Rows of one key and order value are put in an order of their own. df may come from in_parts, and then keeps its _part;
    else it is dealt out here. An empty table gives an empty one.
    """
    dealt = "_part" in df.columns
    p = df if dealt else in_parts(df, keys, order)
    p = p.withColumns({f"_v_{name}": value for name, (_, value) in columns.items()})
    unit = ["_part", *keys]
    local = Window.partitionBy(*unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # the last value by order: aggregates see rows as they come
    whole = lambda kind, v: F.max_by(v, F.when(v.isNotNull(), F.col(order))) if kind == "last" else KINDS[kind][0](v)
    totals = p.groupBy(*unit).agg(*[whole(kind, F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (kind, _) in columns.items()])
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition and key
    carry = totals.select(*[F.col(k).alias(f"_k_{k}") for k in unit], *[(F.sum(f"_t_{name}") if kind == "count" else KINDS[kind][0](F.col(f"_t_{name}"))).over(before).alias(f"_c_{name}") for name, (kind, _) in columns.items()])
    got = p.withColumns({f"_l_{name}": KINDS[kind][0](F.col(f"_v_{name}")).over(local) for name, (kind, _) in columns.items()}).join(carry, _same(unit, "_k_"))
    out = {name: KINDS[kind][1](F.col(f"_c_{name}"), F.col(f"_l_{name}")) for name, (kind, _) in columns.items()}
    return got.select(*df.columns, *[v.alias(name) for name, v in out.items()])


def moments_so_far(df: DataFrame, keys: list[str], order: str, value: str, name: str = "") -> DataFrame:
    """df with n, mean and sd (n - 1 in the divisor; null for fewer than two) of the value over the key's rows so far, each with name before it.

    Squares are summed about the key's mean over all rows, so that their differences keep their digits."""
    centre = df.groupBy(*keys).agg(F.avg(value).alias("_m")).select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.coalesce("_m", F.lit(0.0)).alias("_m"))
    x = F.col(value) - F.col("_m")
    joined = df.join(centre, _same(keys, "_g_")) if keys else df.crossJoin(F.broadcast(centre))  # one row
    got = running(joined.select(*df.columns, "_m"), keys, order, _n=("count", x), _s=("sum", x), _q=("sum", x * x))
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    var = F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    return got.select(*df.columns, n.alias(f"{name}n"), F.when(n > 0, F.col("_m") + s / n).alias(f"{name}mean"), F.sqrt(var).alias(f"{name}sd"))


def expanding_z(df: DataFrame, keys: list[str], order: str, value: str, name: str = "z", least: int = 20) -> DataFrame:
    """df with the value's distance from its mean so far, in deviations so far (1e-8 at least); null before `least` values."""
    got = moments_so_far(df, keys, order, value, "_z_")
    z = (F.col(value) - F.col("_z_mean")) / F.greatest("_z_sd", F.lit(1e-8))
    return got.select(*df.columns, F.when(F.col("_z_n") >= least, z).alias(name))


def drawdown(df: DataFrame, keys: list[str], order: str, value: str, name: str = "drawdown") -> DataFrame:
    """df with how far the wealth that the returns compound to lies below its peak so far (0 or less). The peak counts from the first row's wealth on."""
    p = df if "_part" in df.columns else in_parts(df, keys, order)
    p = running(p, keys, order, _wealth=("product", 1 + F.coalesce(value, F.lit(0.0))))
    p = running(p, keys, order, _peak=("max", F.col("_wealth")))
    return p.select(*df.columns, (F.col("_wealth") / F.col("_peak") - 1).alias(name))


def ewm_mean(df: DataFrame, keys: list[str], order: str, value: str, half_life: float, name: str = "ewm") -> DataFrame:
    """df with the exponentially weighted mean of the value over the key's rows so far; nulls only age the weights.

    Inside a run of BLOCK half-lives weights double, so sums stay finite; what a run leaves fades by its rows. The runs' totals, a row each, are chained a key at a time.
    """
    p = df if "_part" in df.columns else in_parts(df, keys, order)
    size, fade = int(BLOCK * half_life), 0.5 ** (1 / half_life)
    own = ["_part", *keys]
    p = p.withColumn("_row", F.row_number().over(Window.partitionBy(*own).orderBy(order)) - 1).withColumn("_run", F.floor(F.col("_row") / size))
    unit = [*own, "_run"]
    weight = F.pow(F.lit(2.0), (F.col("_row") - F.col("_run") * size) / F.lit(float(half_life)))
    v = F.col(value)
    local = Window.partitionBy(*unit).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"_w": F.when(v.isNotNull(), weight), "_x": v * weight})
    totals = p.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_mass"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_sum"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_run"])
        mass = total = 0.0
        before = []
        for n, m, s in zip(pdf["_n"], pdf["_mass"], pdf["_sum"], strict=True):
            before.append((mass, total))
            end = 0.5 ** ((n - 1) / half_life)
            mass, total = mass * fade**n + m * end, total * fade**n + s * end
        out = pdf[unit].rename(columns={k: f"_k_{k}" for k in unit})
        out["_cm"], out["_cs"] = [b[0] for b in before], [b[1] for b in before]
        return out

    kinds = dict(totals.dtypes)
    grouped = totals.groupBy(*keys) if keys else totals.groupBy(F.lit(0))
    carry = grouped.applyInPandas(chain, ", ".join(f"`_k_{k}` {kinds[k]}" for k in unit) + ", _cm double, _cs double")
    got = p.withColumns({"_lm": F.coalesce(F.sum("_w").over(local), F.lit(0.0)), "_ls": F.coalesce(F.sum("_x").over(local), F.lit(0.0))}).join(carry, _same(unit, "_k_"))
    mass = F.col("_lm") + F.col("_cm") * fade
    return got.select(*df.columns, F.when(mass > 0, (F.col("_ls") + F.col("_cs") * fade) / mass).alias(name))


def hot_join(facts: DataFrame, groups: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Left join of facts to groups (a row a key; weight: how many facts have it). Keys with 1/share of all facts or more, which are `share` at most, are broadcast; the others meet by shuffling."""
    groups = kept(groups, "groups")
    total = groups.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in groups.columns if c != key]
    side = lambda mark, few: groups.where((F.col(weight) * share >= total) == few).select(F.col(key).alias(f"_{mark}_{key}"), *[F.col(c).alias(f"_{mark}_{c}") for c in rest])
    met = facts.join(F.broadcast(side("h", True)), F.col(key) == F.col(f"_h_{key}"), "left")
    # rows that met a hot key go on without it, spread by a salt; so do rows without a key
    met = met.withColumn("_cold", F.when(F.col(f"_h_{weight}").isNull(), F.col(key))).withColumn("_salt", F.when(F.col("_cold").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(997))).otherwise(F.lit(0)).cast("int"))
    out = met.join(side("c", False).withColumn("_csalt", F.lit(0)), (F.col("_cold") == F.col(f"_c_{key}")) & (F.col("_salt") == F.col("_csalt")), "left")
    return out.select(*facts.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in rest])


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of a column over the whole table; nulls have none.

    Rows of one value are counted first (partial counts meet), so that ranks come from a running sum over distinct values, however often one occurs.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    upto = running(counts, [], column, _upto=("sum", F.col("_n")))
    ranks = upto.select(column, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"))
    return hot_join(df, ranks, column, "_n").select(*df.columns, F.col("_rank").alias(name))
