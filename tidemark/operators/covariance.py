"""Exponentially weighted covariances of wide universes, block by block of assets: no task holds more than two blocks over a span of days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept

#: Assets a block and days a span: a task's two slabs have BLOCK * SPAN numbers each, its tile BLOCK * BLOCK.
BLOCK, SPAN = 256, 512


def ewm_covariance(df: DataFrame, half_life: float = 252, key: str = "asset", day: str = "dt", value: str = "er", block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(a, b, covariance) of every pair of keys a <= b on the last day: weights halve every half_life days, corrected for bias as for a sample.

    Days are those that any key has; a key without a value on a day has 0 there, as excess returns that are filled have. Tiles of two blocks are summed over spans of days, then
    over spans; the panel is copied once a block, not once a key. Null with a single day.
    """
    rows = df.select(key, day, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL")
    # the universe and its calendar: a row a key, and a row a day
    keys = kept(rows.select(key).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1), "keys")
    days = kept(df.select(day).distinct().withColumn("_t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1), "days")
    n, last = keys.count(), days.count() - 1
    blocks = max(1, -(-n // block))
    fade = 0.5 ** (1 / half_life)
    mass, square = (1 - fade ** (last + 1)) / (1 - fade), (1 - fade ** (2 * (last + 1))) / (1 - fade**2)
    x = rows.join(keys, key).join(days, day).select((F.col("_k") / block).cast("int").alias("_i"), (F.col("_k") % block).cast("int").alias("_p"), (F.col("_t") / span).cast("int").alias("_c"), (F.col("_t") % span).cast("int").alias("_d"), "_x")
    first = F.sum(F.col("_x") * F.pow(F.lit(fade), F.lit(last) - F.col("_c") * span - F.col("_d")))
    means = x.groupBy((F.col("_i") * block + F.col("_p")).alias("_k")).agg((first / mass).alias("_m"))
    left = x.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(blocks - 1))))
    right = x.select(F.col("_i").alias("_j"), "_p", "_c", "_d", "_x", F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_i"))
    right = right.toDF(*right.columns)  # columns of its own

    def slab(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((span, block))
        out[pdf["_d"].to_numpy(), pdf["_p"].to_numpy()] = pdf["_x"].to_numpy()
        return out

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        some = a if len(a) else b
        i, j, c = (int(some[k].iloc[0]) for k in ("_i", "_j", "_c"))
        weight = fade ** (last - c * span - np.arange(span, dtype=float))
        weight[c * span + np.arange(span) > last] = 0
        return pd.DataFrame({"_i": [i], "_j": [j], "_tile": [((slab(a) * weight[:, None]).T @ slab(b)).ravel()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        s = np.sum(np.stack(pdf["_tile"].to_numpy()), 0).reshape(block, block) / mass
        a, b = np.meshgrid(i * block + np.arange(block), j * block + np.arange(block), indexing="ij")
        use = (a <= b) & (a < n) & (b < n)
        return pd.DataFrame({"_a": a[use], "_b": b[use], "_s": s[use]})

    tiles = left.groupBy("_i", "_j", "_c").cogroup(right.groupBy("_i", "_j", "_c")).applyInPandas(tile, "_i int, _j int, _tile array<double>")
    second = tiles.groupBy("_i", "_j").applyInPandas(total, "_a long, _b long, _s double")
    side = lambda c: keys.join(means, "_k").select(F.col("_k").cast("long").alias(f"_{c}"), F.col(key).alias(c), F.col("_m").alias(f"_m{c}"))
    both = second.join(side("a"), "_a").join(side("b"), "_b")
    spare = 1 - square / mass**2
    return both.select("a", "b", ((F.col("_s") - F.col("_ma") * F.col("_mb")) / (spare if spare > 1e-12 else F.lit(None).cast("double"))).alias("covariance"))
