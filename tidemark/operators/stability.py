"""How well and how steadily a series falls into clusters: validity of one partition, and change from one fit to the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import by, last_rows
from ..sources.sinks import kept


def mean_silhouette(x: np.ndarray, labels: np.ndarray, block: int = 256) -> float:
    """Mean of (b - a) / max(a, b): a, the mean distance to the own cluster's other rows; b, to the nearest other cluster's. A row alone in its cluster counts 0.

    Distances are made for `block` rows at a time, so memory is linear in the rows. NaN with fewer than two clusters.
    """
    kinds, own = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return float("nan")
    member = np.eye(len(kinds))[own]
    size = member.sum(0)
    total = 0.0
    for lo in range(0, len(x), block):
        mine = own[lo : lo + block]
        d = np.sqrt(((x[lo : lo + block, None] - x[None]) ** 2).sum(2)) @ member
        rows = np.arange(len(mine))
        a = d[rows, mine] / np.maximum(size[mine] - 1, 1)
        d = d / size
        d[rows, mine] = np.inf
        b = d.min(1)
        high = np.maximum(a, b)
        total += np.where((size[mine] > 1) & (high > 0), (b - a) / np.where(high > 0, high, 1), 0).sum()
    return float(total / len(x))


def silhouette(df: DataFrame, features: list[str], label: str, key: str = "asset") -> DataFrame:
    """(key, silhouette) of each group. A group is one training window, which one task can hold; distances are quadratic in its rows. Rows with nulls are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "silhouette": [mean_silhouette(pdf[features].to_numpy(float), pdf[label].to_numpy())]})

    return df.select(key, label, *features).dropna().groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, silhouette double")


def silhouette_tiled(df: DataFrame, features: list[str], label: str, keys: list[str], block: int = 2048, wide: int = 8) -> DataFrame:
    """(keys, silhouette, n) of groups of any size: mean_silhouette, its distances made tile by tile. Null with fewer than two clusters; rows with nulls are left out.

    Rows are packed in blocks of `block`. A task holds one block and `wide` others, and gives each row's sums of distances to each cluster there; those sums are added up over tiles.
    Work is quadratic in a group's rows, as the measure is, but is dealt over tasks; no pair of rows ever leaves one. Clusters are few: a sum each is kept for every row.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in keys}
    x = df.select(*keys, F.col(label).cast("string").alias("_l"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).dropna(subset=["_l"]).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    sizes = x.groupBy(*keys, "_l").agg(F.count(F.lit(1)).alias("_c"))
    clusters = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_l", "_c"))).alias("_all"), F.sum("_c").alias("_n"))
    # blocks are random shares of a group: about `block` rows each
    x = x.withColumn("_i", F.monotonically_increasing_id()).join(clusters.select(*keys, F.ceil(F.col("_n") / block).alias("_b")), keys)
    x = x.withColumn("_block", F.pmod(F.xxhash64("_i"), F.col("_b")))
    blocks = kept(x.groupBy(*keys, "_block").agg(F.collect_list("_l").alias("_ls"), F.collect_list("_x").alias("_xs"), F.first("_b").alias("_b")), "blocks")
    left = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - 1) / wide))))
    right = blocks.select(*keys, F.floor(F.col("_block") / wide).alias("_part"), F.col("_ls").alias("_rl"), F.col("_xs").alias("_rx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_block"))
    right = right.toDF(*right.columns)  # columns of its own
    names = clusters.select(*keys, F.col("_all._l").alias("_names"))

    def sums(one: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        row = one.iloc[0]
        mine, names_ = np.array(row["_xs"].tolist(), float), list(row["_names"])
        total = np.zeros((len(mine), len(names_)))
        for xs, ls in zip(others["_rx"], others["_rl"], strict=True):
            theirs, own = np.array(xs.tolist(), float), np.array([names_.index(v) for v in ls])
            member = np.eye(len(names_))[own]
            for lo in range(0, len(mine), 256):
                total[lo : lo + 256] += np.sqrt(((mine[lo : lo + 256, None] - theirs[None]) ** 2).sum(2)) @ member
        own = [names_.index(v) for v in row["_ls"]]
        return pd.DataFrame({**{c: [row[c]] * len(mine) for c in keys}, "_block": row["_block"], "_row": np.arange(len(mine)), "_own": own, "_d": total.tolist()})

    tile = [*keys, "_block", "_part"]
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _block long, _row int, _own int, _d array<double>"
    got = left.join(names, keys).groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(sums, schema)
    whole = got.groupBy(*keys, "_block", "_row", "_own", F.size("_d").alias("_k")).agg(F.collect_list("_d").alias("_ds"))  # one list a tile
    whole = whole.withColumn("_d", F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda c: F.aggregate("_ds", F.lit(0.0), lambda a, t: a + F.get(t, c)))).join(clusters, keys)
    size = F.get(F.col("_all._c"), F.col("_own"))
    a = F.get("_d", F.col("_own")) / F.greatest(size - 1, F.lit(1))
    b = F.array_min(F.filter(F.transform("_d", lambda v, c: F.when(c != F.col("_own"), v / F.get(F.col("_all._c"), c))), lambda v: v.isNotNull()))
    high = F.greatest(a, b)
    s = F.when(b.isNull(), None).when((size > 1) & (high > 0), (b - a) / high).otherwise(0.0)
    return whole.groupBy(*keys).agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def trailing_run_length(label: str, n: int = 252, least: int = 20, key: str = "asset", order: str = "t"):
    """Mean run length within the last n rows, the runs cut at the window's first row; null with fewer than `least` rows."""
    w = last_rows(n, key, order)
    changed = F.when(F.col(label) != F.lag(label).over(by(key, order)), 1).otherwise(0)
    return changed, lambda flag: F.when(F.count(label).over(w) >= least, F.count(label).over(w) / (1 + F.sum(flag).over(last_rows(n - 1, key, order))))


def with_trailing_run_length(df: DataFrame, label: str, name: str = "run_length", n: int = 252, least: int = 20, key: str = "asset", order: str = "t") -> DataFrame:
    changed, length = trailing_run_length(label, n, least, key, order)
    return df.withColumn("_changed", changed).withColumn(name, length("_changed")).drop("_changed")


def refit_group(run_length):
    """How often to refit: quarterly below 90 days, half-yearly below 200, else yearly. Null counts as yearly."""
    return F.when(run_length < 90, "G_Q").when(run_length < 200, "G_S").otherwise("G_A")


def centroid_drift(centres: DataFrame, features: list[str], key: str = "asset", fit: str = "fit", state: str = "y") -> DataFrame:
    """(key, fit, drift_bull, drift_bear, drift_mean): how far each state's centre moved since the fit before. centres: one row per key, fit and state (0 bull, 1 bear)."""
    w = Window.partitionBy(key, state).orderBy(fit)
    moved = F.sqrt(sum((F.pow(F.col(f) - F.lag(f).over(w), 2) for f in features), F.lit(0.0)))
    at = lambda s: F.max(F.when(F.col(state) == s, F.col("_moved")))
    d = centres.withColumn("_moved", moved).groupBy(key, fit).agg(at(0).alias("drift_bull"), at(1).alias("drift_bear"))
    return d.where("drift_bull IS NOT NULL AND drift_bear IS NOT NULL").withColumn("drift_mean", (F.col("drift_bull") + F.col("drift_bear")) / 2)


# -------------------------------------------------------------------------------------------------- from one refit to the next


def consecutive_agreement(fits: DataFrame, key: str = "asset", rebal: str = "rebal", day: str = "dt", label: str = "regime", least: int = 20) -> DataFrame:
    """(key, prev, rebal, agreement, ari, n_overlap) of every fit and the one before it, over the days that both have.

    fits: (key, rebal, day, label 0 or 1). Labels may be swapped between fits: agreement is that of the better reading, on which the adjusted Rand index does not
    depend. Null with fewer than `least` common days.
    """
    order = fits.select(key, rebal).distinct().withColumn("prev", F.lag(rebal).over(Window.partitionBy(key).orderBy(rebal))).where("prev IS NOT NULL")  # refits
    now = fits.select(key, rebal, day, F.col(label).alias("b")).join(order, [key, rebal])
    both = now.join(fits.select(key, F.col(rebal).alias("prev"), day, F.col(label).alias("a")), [key, "prev", day])
    n = {(x, y): F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0)).cast("double") for x in (0, 1) for y in (0, 1)}
    s = both.groupBy(key, "prev", rebal).agg(*[c.alias(f"n{x}{y}") for (x, y), c in n.items()], F.count(F.lit(1)).alias("n"))
    d = order.join(s, [key, "prev", rebal], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    same = (F.col("n00") + F.col("n11")) / F.col("n")
    pairs = lambda c: c * (c - 1) / 2
    c = lambda x, y: F.col(f"n{x}{y}")
    inside = sum((pairs(c(x, y)) for x in (0, 1) for y in (0, 1)), F.lit(0.0))
    left, right = sum((pairs(c(x, 0) + c(x, 1)) for x in (0, 1)), F.lit(0.0)), sum((pairs(c(0, y) + c(1, y)) for y in (0, 1)), F.lit(0.0))
    chance = left * right / pairs(F.col("n"))
    ari = F.when((left + right) / 2 == chance, 1.0).otherwise((inside - chance) / ((left + right) / 2 - chance))
    enough = F.col("n") >= least
    return d.select(key, "prev", rebal, F.when(enough, F.greatest(same, 1 - same)).alias("agreement"), F.when(enough, ari).alias("ari"), F.col("n").alias("n_overlap"))


def validity(fits: DataFrame, features: list[str], keys: list[str], label: str = "regime") -> DataFrame:
    """(keys, n, davies_bouldin, calinski_harabasz, calinski_harabasz_per_n) of every fit's partition into two; null where it is degenerate (under 4 rows, or one cluster).

    Centres, spreads and squares are aggregates; rows with a null feature are left out.
    """
    x = fits.select(*keys, label, *features).dropna()
    c = x.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_c_{f}") for f in features])
    gap2 = sum((F.pow(F.col(f) - F.col(f"_c_{f}"), 2) for f in features), F.lit(0.0))
    d = x.join(c, [*keys, label]).withColumn("_d2", gap2)  # two centres a fit
    per = d.groupBy(*keys, label).agg(F.avg(F.sqrt("_d2")).alias("_s"), F.sum("_d2").alias("_w"), F.first("_n").alias("_n"), *[F.first(f"_c_{f}").alias(f"_c_{f}") for f in features])
    pick = lambda k, name: F.max(F.when(F.col(label) == k, F.col(name)))
    # two clusters: the squares between them are n0 n1 / n times the squared gap of the centres
    between = sum((F.pow(pick(0, f"_c_{f}") - pick(1, f"_c_{f}"), 2) for f in features), F.lit(0.0))
    t = per.groupBy(*keys).agg(F.sum("_n").alias("n"), between.alias("g2"), pick(0, "_n").alias("n0"), pick(1, "_n").alias("n1"), F.sum("_w").alias("w"), (pick(0, "_s") + pick(1, "_s")).alias("s"))
    good = F.col("n0").isNotNull() & F.col("n1").isNotNull() & (F.col("n") >= 4)
    ch = F.when(good & (F.col("w") > 0), F.col("n0") * F.col("n1") / F.col("n") * F.col("g2") / (F.col("w") / (F.col("n") - 2)))
    return t.select(*keys, "n", F.when(good & (F.col("g2") > 0), F.col("s") / F.sqrt("g2")).alias("davies_bouldin"), ch.alias("calinski_harabasz"), (ch / F.col("n")).alias("calinski_harabasz_per_n"))


def validity_with_silhouette(fits: DataFrame, features: list[str], key: str = "asset", rebal: str = "rebal", label: str = "regime") -> DataFrame:
    """validity() of every (key, rebal) with silhouette; null where a cluster has a single row. One task a fit, which holds one training window."""
    kinds = {c: fits.schema[c].dataType.simpleString() for c in (key, rebal)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[features].to_numpy(float), pdf[label].to_numpy()
        size = np.unique(y, return_counts=True)[1]
        value = mean_silhouette(x, y) if len(x) >= 4 and len(size) >= 2 and size.min() >= 2 else None
        return pd.DataFrame({key: pdf[key].iloc[:1], rebal: pdf[rebal].iloc[:1], "silhouette": pd.Series([value], dtype="float64")})

    s = fits.select(key, rebal, label, *features).dropna().groupBy(key, rebal).applyInPandas(one, f"{key} {kinds[key]}, {rebal} {kinds[rebal]}, silhouette double")
    return validity(fits, features, [key, rebal], label).join(s.withColumn("silhouette", F.nanvl("silhouette", F.lit(None).cast("double"))), [key, rebal])


def has_features(fits: DataFrame, features: list[str]) -> bool:
    """Whether there are fits, and every row has all features."""
    missing = sum((F.when(F.col(f).isNull(), 1).otherwise(0) for f in features), F.lit(0))
    n, bad = fits.agg(F.count(F.lit(1)), F.sum(missing)).first()
    return n > 0 and not bad


def refit_drift(fits: DataFrame, features: list[str], key: str = "asset", rebal: str = "rebal", label: str = "regime") -> DataFrame:
    """centroid_drift() of fits: (key, rebal, drift_bull, drift_bear, drift_mean)."""
    c = fits.groupBy(key, rebal, label).agg(*[F.avg(f).alias(f) for f in features])
    return centroid_drift(c, features, key, rebal, label)


def occupancy(fits: DataFrame, key: str = "asset", rebal: str = "rebal", day: str = "dt", label: str = "regime") -> DataFrame:
    """(key, rebal, n, pct_bear, mean_run, persistence) of every fit: share of bearish days, mean run length, and that as a share of the days."""
    w = Window.partitionBy(key, rebal).orderBy(day)
    s = fits.withColumn("_start", F.when(F.col(label) == F.lag(label).over(w), 0).otherwise(1)).groupBy(key, rebal).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("pct_bear"), F.sum("_start").alias("_runs"))
    return s.select(key, rebal, "n", "pct_bear", (F.col("n") / F.col("_runs")).alias("mean_run"), (1 / F.col("_runs")).alias("persistence"))


def report(fits: DataFrame, features: list[str], key: str = "asset", rebal: str = "rebal", day: str = "dt", label: str = "regime", valid: DataFrame | None = None) -> DataFrame:
    """One row a key: mean agreement, index, drift, spread of occupancy, run length, Davies-Bouldin and Calinski-Harabasz per row over the refits (and silhouette where `valid` has it)."""
    fits = kept(fits, "fits")  # read by every part
    valid = validity(fits, features, [key, rebal], label) if valid is None else valid
    mean = lambda df, cols: df.groupBy(key).agg(*[F.avg(c).alias(n) for c, n in cols.items()])
    geometry = {c: c for c in ("silhouette", "davies_bouldin", "calinski_harabasz_per_n") if c in valid.columns}
    occ = occupancy(fits, key, rebal, day, label).groupBy(key).agg((F.stddev_samp("pct_bear") * 100).alias("occupancy_std"), F.avg("mean_run").alias("mean_run_length"))
    parts = [mean(consecutive_agreement(fits, key, rebal, day, label), {"agreement": "label_agreement", "ari": "ari"}), mean(refit_drift(fits, features, key, rebal, label), {"drift_mean": "centroid_drift"}), occ, mean(valid, geometry)]
    out = fits.select(key).distinct()
    for p in parts:
        out = out.join(p, key, "left")
    return out


def normalised(rep: DataFrame) -> DataFrame:
    """report() with every column brought to where more is better and 1 is best. occupancy_std: in percent."""
    clip = lambda c, lo, hi: F.when(F.col(c).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(c))))
    most = F.max("calinski_harabasz_per_n").over(Window.partitionBy(F.lit(0)))  # one row a key
    new = {
        "ari": clip("ari", 0, 1), "centroid_drift": 1 / (1 + F.col("centroid_drift")), "occupancy_std": 1 / (1 + F.col("occupancy_std") * 10), "mean_run_length": clip("mean_run_length", 0, 100) / 100,
        "davies_bouldin": 1 / (1 + F.col("davies_bouldin")), "calinski_harabasz_per_n": F.col("calinski_harabasz_per_n") / F.when(most != 0, most).otherwise(1.0),
    }
    if "silhouette" in rep.columns:
        new["silhouette"] = (clip("silhouette", -1, 1) + 1) / 2
    return rep.withColumns(new)
