"""Trading calendars: rebalance days, refit blocks and the training windows that belong to them. A calendar has one row a day, so blocks are a few rows a year."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The months in which a frequency rebalances.
MONTHS = {"monthly": tuple(range(1, 13)), "quarterly": (1, 4, 7, 10), "semi-annual": (1, 7), "annual": (1,)}


def months_of(frequency: str) -> tuple[int, ...]:
    if frequency not in MONTHS:
        raise ValueError(f"unknown frequency {frequency!r}; one of {list(MONTHS)}")
    return MONTHS[frequency]


def frequencies() -> Column:
    """MONTHS as a map column."""
    return F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def slice_days(df: DataFrame, start, end, day: str = "dt") -> DataFrame:
    """The rows from start to end, both included; either may be None."""
    for bound, keep in ((start, lambda: F.col(day) >= F.lit(start)), (end, lambda: F.col(day) <= F.lit(end))):
        if bound is not None:
            df = df.where(keep())
    return df


def rebalance_days(days: DataFrame, months: tuple[int, ...] = (1, 7), day: str = "dt") -> DataFrame:
    """(rebal): the first day of each of the months."""
    return days.where(F.month(day).isin(*months)).groupBy(F.year(day), F.month(day)).agg(F.min(day).alias("rebal")).select("rebal")


def refit_blocks(days: DataFrame, months: tuple[int, ...] = (1, 7), day: str = "dt", end=None) -> DataFrame:
    """(train_end, test_start, test_end): the day before each rebalance day, that day, and the one before the next (or the last day)."""
    last = days.agg((F.lit(end) if end is not None else F.max(day)).alias("last"))
    x = rebalance_days(days, months, day).crossJoin(F.broadcast(last))  # one row
    return x.select(F.date_sub("rebal", 1).alias("train_end"), F.col("rebal").alias("test_start"), F.coalesce(F.date_sub(F.lead("rebal").over(Window.orderBy("rebal")), 1), "last").alias("test_end"))


def validation_blocks(days: DataFrame, months: tuple[int, ...] = (1, 7), years: int = 5, day: str = "dt", end=None) -> DataFrame:
    """(rebal, val_start, val_end, block_start, block_end) of every rebalance day: the years before it to choose in, and the days that the choice is for."""
    b = refit_blocks(days, months, day, end)
    return b.select(F.col("test_start").alias("rebal"), F.add_months("test_start", -12 * years).alias("val_start"), F.col("train_end").alias("val_end"), F.col("test_start").alias("block_start"), F.col("test_end").alias("block_end"))


def training_rows(panel: DataFrame, rebal: DataFrame, kind: str = "rolling", years: int = 11, rows: int = 1260, span: int = 370, least: int = 252, key: str = "asset", day: str = "dt") -> DataFrame:
    """panel's rows with each rebal they train: `rolling` (the years before), `expanding` (all before), `last` (the last `rows` of them) or `trailing` (the `span` calendar days up to that day, itself included).

    Training windows of fewer than `least` rows are left out. rebal: a few rows a year.
    """
    d, r = F.col(day), F.col("rebal")
    frames = {"rolling": (d >= F.add_months(r, -12 * years)) & (d < r), "expanding": d < r, "last": d < r, "trailing": (d >= F.date_sub(r, span)) & (d <= r)}
    if kind not in frames:
        raise ValueError(f"unknown window {kind!r}; one of {list(frames)}")
    x = panel.join(F.broadcast(rebal), frames[kind])
    w = Window.partitionBy(key, "rebal")
    if kind == "last":
        x = x.withColumn("_k", F.row_number().over(w.orderBy(F.desc(day)))).where(F.col("_k") <= rows).drop("_k")
    return x.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n")


def year_fraction(a: str, b: str) -> Column:
    return F.datediff(a, b) / 365.25


class RefitBlocks:
    """A table function over a sorted array of days: one row (train_end, test_start, test_end) for each rebalance day in the months."""

    def eval(self, days: list, months: list) -> Iterator[tuple]:
        from datetime import timedelta

        first = [d for i, d in enumerate(days) if d.month in months and (i == 0 or (d.year, d.month) != (days[i - 1].year, days[i - 1].month))]
        for i, d in enumerate(first):
            yield d - timedelta(days=1), d, (first[i + 1] - timedelta(days=1) if i + 1 < len(first) else days[-1])


def register_refit_blocks(spark, name: str = "refit_blocks"):
    """Register RefitBlocks for SQL: `SELECT ... FROM t, LATERAL refit_blocks(t.days, t.months)`."""
    return spark.udtf.register(name, F.udtf(RefitBlocks, returnType="train_end date, test_start date, test_end date"))
