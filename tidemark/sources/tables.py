"""Inputs: tables, per-series files, and the panel views that every operator works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_csv(spark: SparkSession, path: str, date_col: str, value_col: str, order_col: str | None = None) -> DataFrame:
    """One series from CSV: `.` and empty are null, rows without a date go, of equal dates the last row stays.

    The last is the one of the highest order_col (a number; equal ones by the value), or, if not given, the last as one file has them: several files need the column.
    """
    raw = spark.read.option("header", True).option("nullValue", ".").csv(path)
    raw = raw.withColumn("_seq", F.monotonically_increasing_id() if order_col is None else F.struct(F.expr(f"try_cast(`{order_col}` AS DOUBLE)").alias("o"), F.expr(f"try_cast(`{value_col}` AS DOUBLE)").alias("v")))
    rows = raw.select(F.expr(f"try_to_date(`{date_col}`)").alias("dt"), F.expr(f"try_cast(`{value_col}` AS DOUBLE)").alias("v"), "_seq").where("dt IS NOT NULL")
    return rows.groupBy("dt").agg(F.max_by("v", "_seq").alias("v"))


def has_columns(df: DataFrame, needed: list[str]) -> bool:
    """Whether a cached table still serves: all needed columns are there."""
    return set(needed) <= set(df.columns)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, dt, er, t): daily excess returns of six assets; t numbers an asset's days from 1."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("dt")).agg(F.round((F.avg("l_discount") - 0.05) / 5, 10).alias("er"))
    return d.withColumn("t", F.row_number().over(Window.partitionBy("asset").orderBy("dt")))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel with px: 100 compounded at the returns."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return panel(spark, sf_dir).withColumn("px", 100 * F.exp(F.sum(F.log1p("er")).over(w)))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, y2, y10, vix, rf) on a calendar of its own."""
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.round(F.avg(p) / 1e5, 10).alias("y2"), (F.max(p) / 1e5).alias("y10"), (10 + F.count(p)).alias("vix"), F.round(F.avg(p) / 1e5, 10).alias("rf"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, b, o, h, l, c): six-hour bars of the events' values plus one; b counts bars since 1970."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), F.col("ts"), (F.col("value") + 1).alias("v"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(21_600_000_000)).cast("long").alias("b"))
    return e.groupBy("asset", "b").agg(F.min_by("v", "ts").alias("o"), F.max("v").alias("h"), F.min("v").alias("l"), F.max_by("v", "ts").alias("c"))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, config, seed, metric, spread): one row per run of a sweep."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("asset"), F.col("o_orderpriority").alias("config"), (F.col("o_custkey") % 5).cast("int").alias("seed")).agg(F.round(F.avg("o_totalprice") / 1e5, 8).alias("metric"), F.round(F.min("o_totalprice") / 1e5, 8).alias("low"))


def outer_aligned(series: dict[str, DataFrame], day: str = "dt", value: str = "v") -> DataFrame:
    """One row a day that any series has, one column a series (each of (day, value), one row a day); null where it has none. A union and a pivot, so N series take one shuffle."""
    long = None
    for name, s in series.items():
        part = s.select(day, F.lit(name).alias("series"), F.col(value).cast("double").alias("v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(day).pivot("series", list(series)).agg(F.first("v", ignorenulls=True))


def load_series(spark: SparkSession, paths: dict[str, str], date_col: str, value_col: str) -> tuple[DataFrame, dict[str, str]]:
    """(aligned series, errors): every CSV that can be read, side by side; one that can't is left out with its error. All failing is an error."""
    good, errors = {}, {}
    for name, path in paths.items():
        try:
            good[name] = series_csv(spark, path, date_col, value_col)
        except Exception as e:  # a path that is not there, or a file without these columns
            errors[name] = str(e).splitlines()[0]
    if not good:
        raise ValueError(f"no series could be read: {errors}")
    return outer_aligned(good), errors


def cached(spark: SparkSession, path: str, make, needed: list[str]) -> DataFrame:
    """The table at path if it has the needed columns; else make()'s, which is written there first."""
    from .sinks import exists, write_results

    if exists(spark, path):
        found = spark.read.parquet(path)
        if has_columns(found, needed):
            return found
    made = make()
    if not has_columns(made, needed):
        raise ValueError(f"lacks columns {sorted(set(needed) - set(made.columns))}")
    write_results(made, path)
    return spark.read.parquet(path)


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """df with every struct column, however deep, replaced by its fields as columns named parent_field."""
    while structs := [c for c, kind in df.dtypes if kind.startswith("struct<")]:
        out = []
        for c in df.columns:
            out += [F.col(f"`{c}`.`{f}`").alias(f"{c}{sep}{f}") for f in df.schema[c].dataType.names] if c in structs else [F.col(f"`{c}`")]
        df = df.select(*out)
    return df


def from_pandas(spark: SparkSession, frame, index: str = "date") -> DataFrame:
    """A pandas series or frame as a table, its index as the first column; NaN becomes null."""
    import pandas as pd

    pdf = frame.to_frame(frame.name or "value") if isinstance(frame, pd.Series) else frame
    pdf = pdf.rename_axis(index).reset_index()
    pdf.columns = [str(c) for c in pdf.columns]
    out = spark.createDataFrame(pdf)
    return out.select(*[F.nanvl(c, F.lit(None).cast(kind)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in out.dtypes])


#: Kinds that widen into the next one.
_WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def common_type(kinds: list[str]) -> str:
    """The narrowest type that all of them go into: whole numbers and floats widen (a long with a float is a double), dates with timestamps are timestamps, anything else is text."""
    seen = sorted(set(kinds) - {"void"})
    if len(seen) <= 1:
        return seen[0] if seen else "string"
    if all(k in _WIDER for k in seen):
        top = max(_WIDER.index(k) for k in seen)
        # a float has 24 bits of a whole number
        return "double" if "float" in seen and any(k in ("int", "bigint") for k in seen) else _WIDER[top]
    if set(seen) <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp" if "timestamp" in seen else "timestamp_ntz"
    return "string"


def reconciled(frames: list[DataFrame]) -> DataFrame:
    """One table of all: columns by name, in the order that they are first met, each of the common type; null where a table lacks it."""
    columns: dict[str, list[str]] = {}
    for df in frames:
        for c, kind in df.dtypes:
            columns.setdefault(c, []).append(kind)
    wide = {c: common_type(kinds) for c, kinds in columns.items()}
    parts = [df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wide.items()]) for df in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_reconciled(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files or tables that match a pattern as one table (see reconciled), whatever their columns and types. Those of one schema are read together; schemas come from footers alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise ValueError(f"nothing matches {pattern}")
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(spark.read.parquet(name).schema.simpleString(), []).append(name)
    return reconciled([spark.read.parquet(*group) for group in groups.values()])


def one_or_parts(spark: SparkSession, path: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables that a run left at path, by part: a folder with one Parquet table a part, or a single table with a column `part` that says which rows are whose.

    A part that is not there is an error; columns that a part's rows of a single table have only nulls in go.
    """
    from .sinks import exists

    root = path.rstrip("/")
    have = [p for p in parts if exists(spark, f"{root}/{p}.parquet")]
    if have:
        if missing := [p for p in parts if p not in have]:
            raise ValueError(f"{path} lacks {missing}")
        return {p: spark.read.parquet(f"{root}/{p}.parquet") for p in parts}
    whole = spark.read.parquet(root)
    if "part" not in whole.columns:
        raise ValueError(f"{path} is neither a folder of {list(parts)} nor a table with a column part")
    rest = [c for c in whole.columns if c != "part"]
    used = {r["part"]: r for r in whole.where(F.col("part").isin(*parts)).groupBy("part").agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in rest]).collect()}
    if missing := [p for p in parts if p not in used]:
        raise ValueError(f"{path} lacks {missing}")
    return {p: whole.where(F.col("part") == p).select(*[f"`{c}`" for c in rest if used[p][c]]) for p in parts}
