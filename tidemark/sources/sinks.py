"""Outputs: result tables, runs that resume where they stopped, and a digest that tells whether two tables hold the same rows."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replaced as a whole; one folder per value of `by` if given. The committer makes files visible only when all are written."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def upsert(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the folders of the values of `by` that df has (the last columns), and no others, in a Parquet table: writing the same rows again changes nothing."""
    rest = [c for c in df.columns if c not in by]
    df.select(*rest, *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; nulls are empty."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def pending(runs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The runs that have no row in done."""
    return runs.join(done.select(*keys).distinct(), keys, "left_anti")


def digest(df: DataFrame) -> DataFrame:
    """(n, digest): one row that depends on the rows, not on their order or partitions. Columns count in name order; repeated rows count as often as they occur."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def metadata(tables: dict[str, DataFrame]) -> str:
    """JSON: rows, columns and digest of every table, for a results folder."""
    out = {}
    for name, df in tables.items():
        row = digest(df).first()
        out[name] = {"rows": row["n"], "columns": df.columns, "digest": row["digest"]}
    return json.dumps(out, sort_keys=True)


def stems(spark: SparkSession, pattern: str, prefix: str = "") -> DataFrame:
    """All Parquet tables that match a pattern, with the table's name (less the prefix) as column `source`."""
    name = F.regexp_extract(F.input_file_name(), rf"/{prefix}([^/]+?)\.parquet(?:/[^/]*)?$", 1)
    return spark.read.option("mergeSchema", True).parquet(pattern).withColumn("source", name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, in whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A report of a few lines as one text file in the folder."""
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def write_nested(tables: dict[str, DataFrame], path: str, key: str = "strategy") -> None:
    """One table a name, with the same columns, as one Parquet table with a folder a name."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(key, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    write_results(out, path, key)


def displayed(df: DataFrame, percent: tuple[str, ...] = ("ann_ret", "ann_vol", "mdd"), two_places: tuple[str, ...] = ("sharpe", "calmar", "turnover", "leverage")) -> DataFrame:
    """df with columns as text for display: shares as percent with one place, ratios with two. Columns that df lacks are passed over; null stays null."""
    text = lambda c, f, x: F.when(F.col(c).isNotNull(), F.format_string(f, x))
    new = {c: text(c, "%.1f%%", F.col(c) * 100) for c in percent if c in df.columns} | {c: text(c, "%.2f", F.col(c)) for c in two_places if c in df.columns}
    return df.withColumns(new) if new else df


def metadata_json(table: DataFrame, name: str) -> DataFrame:
    """(name, json): one row, the table's rows, columns and digest as JSON; made by the executors, so many tables are one union."""
    d = digest(table)
    return d.select(F.lit(name).alias("name"), F.to_json(F.struct("n", F.lit(", ".join(table.columns)).alias("columns"), "digest")).alias("json"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, one of this machine's own serves a local master; elsewhere that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}-{name}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it and the JVM are still there."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        return


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written to the shared folder and read back: made once, and there for good even if executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
