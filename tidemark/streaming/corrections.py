"""Late prints that correct what was sent: a table of days with the macro values as of them, kept right while days and prints arrive as streams.

Both streams are written as they come, a folder a batch, so a batch that runs again replaces itself. What a batch changes is a span of days: its own days, or those
from each print to the series' next one. The months that hold such days are made anew from all that is known, and replaced in the result, one folder a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import as_of
from ..sources.sinks import exists, upsert


class LivePanel:
    """The table at path/panel: one row per day row, with `values` as of its day. prints: (series, day, v); a later batch's print of a series and day replaces an earlier one's."""

    def __init__(self, spark: SparkSession, path: str, days: str, values: list[str], day: str = "dt"):
        """days: the schema of the day rows, with a date column `day`; values: names of the series."""
        self.spark, self.path, self.values, self.day, self.schema = spark, path.rstrip("/"), values, day, days

    def _stored(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        schema = f"{schema}, _batch long"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _store(self, name: str, df: DataFrame, number: int) -> None:
        upsert(df.withColumn("_batch", F.lit(number).cast("long")), f"{self.path}/{name}", ["_batch"])

    def prints(self) -> DataFrame:
        """(series, day, v): the latest batch's print of each series and day."""
        w = Window.partitionBy("series", self.day).orderBy(F.desc("_batch"))
        return self._stored("prints", f"series string, {self.day} date, v double").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_batch")

    def panel(self) -> DataFrame:
        kinds = ", ".join(f"{v} double" for v in self.values)
        return self.spark.read.schema(f"{self.schema}, {kinds}, _month string").parquet(f"{self.path}/panel").drop("_month")

    def add_days(self, df: DataFrame, number: int) -> None:
        """foreachBatch function of the stream of days."""
        self._store("days", df.select(*[f"`{c}`" for c in self.spark.createDataFrame([], self.schema).columns]), number)
        self._renew(self._month(df.select(self.day)))

    def add_prints(self, df: DataFrame, number: int) -> None:
        """foreachBatch function of the stream of prints."""
        new = df.select("series", self.day, "v").where(F.col("series").isin(*self.values))
        self._store("prints", new, number)
        ahead = F.lead(self.day).over(Window.partitionBy("series").orderBy(self.day))
        spans = self.prints().withColumn("_next", ahead).join(new.select("series", self.day).distinct(), ["series", self.day], "left_semi")
        days = self._stored("days", self.schema).select(self.day).distinct()
        # a print counts up to the next one of its series: a calendar's rows against the batch's prints
        met = days.alias("d").join(spans.alias("s"), (F.col(f"d.{self.day}") >= F.col(f"s.{self.day}")) & (F.col("s._next").isNull() | (F.col(f"d.{self.day}") < F.col("s._next"))), "left_semi")
        self._renew(self._month(met))

    def _month(self, days: DataFrame) -> DataFrame:
        return days.select(F.date_format(self.day, "yyyy-MM").alias("_month")).distinct()

    def _renew(self, months: DataFrame) -> None:
        month = F.date_format(self.day, "yyyy-MM")
        days = self._stored("days", self.schema).drop("_batch").withColumn("_month", month).join(months, "_month", "left_semi")
        wide = self.prints().groupBy(self.day).agg(*[F.max(F.when(F.col("series") == v, F.col("v"))).alias(v) for v in self.values])
        upsert(as_of(days, wide, self.day, self.values), f"{self.path}/panel", ["_month"])
