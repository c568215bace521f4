"""Bootstrap replicates as rows: each is drawn by a generator of its own, keyed by the series and the replicate's number, so replicates spread over tasks and a rerun repeats them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replicates that one task draws from one copy of a series.
CHUNK = 250


def generator(key: object, replicate: int, seed: int) -> np.random.Generator:
    """A counter-based generator for one replicate of one series, the same wherever it is made."""
    word = hashlib.blake2b(f"{seed}|{replicate}|{key}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(word, "little")))


def drawn(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """n places of n rows: single ones, or runs of `block` rows (the series taken as a ring), the last run cut."""
    if block <= 1:
        return rng.integers(0, n, n)
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def replicates(df: DataFrame, columns: list[str], statistic: Callable[..., float], times: int = 2000, block: int = 1, seed: int = 42, key: str = "asset", order: str = "t", chunk: int = CHUNK) -> DataFrame:
    """(key, replicate, value): the statistic of the columns over rows drawn again, `times` of each key; replicate -1 is that of the rows themselves.

    A series is copied once for every `chunk` replicates, each copy a task's work. block > 1 keeps runs of rows together, as series with memory need.
    Rows with a null in a column are left out, and rows are drawn by their place in order, so the result does not depend on partitions. A value that is not finite is null.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, order, *columns).dropna(subset=columns).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-times // chunk) - 1)))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        data, name, c = [pdf[x].to_numpy(float) for x in columns], pdf[key].iloc[0], int(pdf["_chunk"].iloc[0])
        numbers, out = range(c * chunk, min(times, (c + 1) * chunk)), []
        for r in ([-1, *numbers] if c == 0 else numbers):
            at = slice(None) if r < 0 else drawn(len(pdf), block, generator(name, r, seed))
            out.append(float(statistic(*(x[at] for x in data))))
        value = [v if np.isfinite(v) else None for v in out]
        return pd.DataFrame({key: name, "replicate": [-1, *numbers] if c == 0 else list(numbers), "value": pd.Series(value, dtype="float64")})

    n = max(1, df.select(key).distinct().count() * -(-times // chunk))
    got = rows.repartition(min(2000, 3 * n), key, "_chunk").groupBy(key, "_chunk").applyInPandas(one, f"`{key}` {kind}, replicate int, value double")
    return got.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def intervals(reps: DataFrame, level: float = 0.95, key: str = "asset") -> DataFrame:
    """(key, value, lo, hi, n): the statistic, the percentiles of its replicates around the level, and how many of them have a value."""
    drawn_ = F.when(F.col("replicate") >= 0, F.col("value"))
    tail = (1 - level) / 2
    return reps.groupBy(key).agg(F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("value"), F.percentile(drawn_, F.lit(tail)).alias("lo"), F.percentile(drawn_, F.lit(1 - tail)).alias("hi"), F.count(drawn_).alias("n"))


def sharpe(x: np.ndarray) -> float:
    """Yearly Sharpe ratio of daily returns."""
    return float(x.mean() / max(x.std(ddof=1), 1e-12) * np.sqrt(252)) if len(x) > 1 else float("nan")
