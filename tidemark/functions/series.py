"""Series functions on a panel (asset, t, ...): one window each, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(key: str = "asset", order: str = "t") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def upto(key: str = "asset", order: str = "t") -> WindowSpec:
    return by(key, order).rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int, key: str = "asset", order: str = "t") -> WindowSpec:
    return by(key, order).rowsBetween(1 - n, 0)


def forward_fill(c: Column, w: WindowSpec | None = None) -> Column:
    return F.last(c, ignorenulls=True).over(w if w is not None else upto())


#: Half-lives in a block of rows, within which weights double every half-life without overflow.
BLOCK = 512


def ewm_mean(c: Column, half_life: float, key: str = "asset", t: str = "t") -> Column:
    """Exponentially weighted mean of all rows so far; nulls only age the weights. t: an integer that counts a key's rows.

    It is the ratio of two running sums of weights that double every half_life rows. Weights start anew in every block of BLOCK half-lives, and what the block
    before leaves, 2 ** -BLOCK of its sums, is added; older rows weigh less than the last bit. So a series of any length stays finite.
    """
    rows = float(BLOCK * half_life)
    block = F.floor(F.col(t) / F.lit(rows))
    weight = F.pow(F.lit(2.0), (F.col(t) - block * F.lit(rows)) / F.lit(float(half_life)))
    inside = Window.partitionBy(key, block).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rangeBetween(-1, -1)
    # a block whose rows so far are all null goes on with what came before
    some = lambda v: F.coalesce(F.sum(v).over(inside), F.lit(0.0)) + F.coalesce(F.sum(v).over(before), F.lit(0.0)) * F.lit(2.0**-BLOCK)
    mass = some(F.when(c.isNotNull(), weight))
    return F.when(mass > 0, some(c * weight) / mass)


def full(value: Column, n: int, of: Column, w: WindowSpec) -> Column:
    """value where the frame holds n rows with `of`, else null."""
    return F.when(F.count(of).over(w) >= n, value)


def downside(c: Column, half_life: float, key: str = "asset", t: str = "t") -> Column:
    """Root of the smoothed square of what is below 0; a null row only ages the weights."""
    return F.sqrt(ewm_mean(F.when(c.isNotNull(), F.pow(F.least(c, F.lit(0.0)), 2)), half_life, key, t))


def expanding_z(c: Column, least: int = 20, key: str = "asset", t: str = "t") -> Column:
    w = upto(key, t)
    return full((c - F.avg(c).over(w)) / F.greatest(F.stddev_samp(c).over(w), F.lit(1e-8)), least, c, w)


def islands(df: DataFrame, label: str, key: str = "asset", order: str = "t") -> DataFrame:
    """df with run: the number of the run of equal labels that a row is in."""
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(by(key, order))), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(upto(key, order))).drop("_c")


def as_of(left: DataFrame, right: DataFrame, on: str, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Backward as-of join: left's rows with right's latest values, each the last that isn't null, at or before them (within equal keys). on: a date or timestamp.

    A union and one window, so rows never multiply. The window is dealt by keys and year; what earlier years leave is carried over by a table of one row a key
    and year, so a long single series is not sorted in one task.
    """
    keys, kinds = list(keys), {v: right.schema[v].dataType for v in values}
    row = F.struct(*left.columns)
    both = left.select(*keys, on, *[F.lit(None).cast(kinds[v]).alias(v) for v in values], F.lit(1).alias("_left"), row.alias("_row")).unionByName(
        right.select(*keys, on, *values).withColumn("_left", F.lit(0)).withColumn("_row", F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType))
    )
    both = both.withColumn("_year", F.year(on))
    w = Window.partitionBy(*keys, "_year").orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
    got = both.select(*keys, "_year", "_left", "_row", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("_left = 1")
    own = both.groupBy(*keys, "_year").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(on, "_left"))).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_year").alias("_y"), *[F.last(v, ignorenulls=True).over(before).alias(f"_c_{v}") for v in values])
    same = F.col("_year").eqNullSafe(F.col("_y"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return got.join(carry, same, "left").select("_row.*", *[F.coalesce(v, f"_c_{v}").alias(v) for v in values])


def average_rank(df: DataFrame, column: str, name: str, parts: int = 64) -> DataFrame:
    """df with the average rank of a column over the whole table; nulls have none.

    Values are dealt by `parts` quantiles (equal values meet), ranked within a part, and moved by the number of values in the parts below: a table of `parts` rows.
    """
    splits = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(splits))]).cast(f"array<{df.schema[column].dataType.simpleString()}>")
    d = df.withColumn("_part", F.when(F.col(column).isNotNull(), F.size(F.filter(cuts, lambda x: x < F.col(column)))))
    below = d.where(F.col(column).isNotNull()).groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"))
    w = Window.partitionBy("_part")
    own = F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy("_part", column)) - 1) / 2
    return d.withColumn(name, F.when(F.col(column).isNotNull(), own)).join(F.broadcast(below), F.col("_part") == F.col("_p"), "left").withColumn(name, F.col(name) + F.col("_below")).drop("_part", "_p", "_below")
