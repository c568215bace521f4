"""Queries of stability, inference, sweeps, backtests and forecasts, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..functions.series import as_of, by, ewm_mean, forward_fill, upto
from ..operators import backtest, forecast, resampling, stability
from ..sources import tables as src
from .queries import _LBL, CONFIGS, FACT, MACRO, PANEL, SQL, UP, cal_rebalance_dates, ewm_sql, labels, query, r

BY = "(PARTITION BY asset ORDER BY t)"


def rank_of(of: str, *keys: str):
    """Average rank of a column within keys."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(of)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, of)) - 1) / 2


def rank_sql(of: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"(rank() OVER ({part}ORDER BY {of}) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{of}) - 1) / 2.0)"


# ------------------------------------------------------------------------------------------------------------ sources and alignment


@query(f"WITH {PANEL}, k AS (SELECT asset, t, product(1 + er) OVER {UP} AS c FROM panel) SELECT asset, t, round(coalesce(lag(c) OVER {BY}, c), 8) AS o, round(c * 1.001, 8) AS h, round(c * 0.999, 8) AS l, round(c, 8) AS c FROM k")
def src_synthetic_ohlc(spark, d):
    k = src.panel(spark, d).withColumn("w", F.product(1 + F.col("er")).over(upto()))
    c = F.col("w")
    return k.select("asset", "t", r(F.coalesce(F.lag("w").over(by()), c)).alias("o"), r(c * 1.001).alias("h"), r(c * 0.999).alias("l"), r(c).alias("c"))


_GRID = "grid AS (SELECT a.asset, c.dt, p.er, p.y FROM (SELECT DISTINCT asset FROM panel) a CROSS JOIN (SELECT DISTINCT dt FROM panel) c LEFT JOIN lbl p ON p.asset = a.asset AND p.dt = c.dt)"


def grid(spark, d) -> DataFrame:
    """(asset, dt, er, y) on every day of the panel; null where the asset has no row."""
    p = src.panel(spark, d)
    days = p.select("dt").distinct().crossJoin(F.broadcast(p.select("asset").distinct()))  # assets: the kinds of flag, a fixed few
    return days.join(labels(spark, d).select("asset", "dt", "er", "y"), ["asset", "dt"], "left")


@query(f"WITH {PANEL}, {_LBL}, {_GRID} SELECT asset, dt, coalesce(last_value(er IGNORE NULLS) OVER w, first_value(er IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS er FROM grid WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING)")
def aln_fill_both_ways(spark, d):
    ahead = by(order="dt").rowsBetween(0, Window.unboundedFollowing)
    return grid(spark, d).select("asset", "dt", F.coalesce(forward_fill(F.col("er"), upto(order="dt")), F.first("er", ignorenulls=True).over(ahead)).alias("er"))


@query(f"WITH {PANEL}, {_LBL}, {_GRID} SELECT asset, dt, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 1) AS y FROM grid")
def aln_labels_default_bear(spark, d):
    return grid(spark, d).select("asset", "dt", F.coalesce(forward_fill(F.col("y"), upto(order="dt")), F.lit(1)).alias("y"))


@query(f"WITH {PANEL}, {_LBL}, {_GRID} SELECT asset, dt, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 0) AS y FROM grid")
def aln_labels_default_bull(spark, d):
    """Labels on every day, filled forward, 0 before the first: what a sweep's forecasts are judged by."""
    return grid(spark, d).select("asset", "dt", F.coalesce(forward_fill(F.col("y"), upto(order="dt")), F.lit(0)).alias("y"))


@query(f"WITH {PANEL}, {MACRO}, x AS (SELECT min(dt) AS rebal FROM panel WHERE month(dt) IN (1, 7) GROUP BY year(dt), month(dt)) SELECT rebal, count(*) AS n, round(avg(y2), 8) AS mean, round(median(y2), 8) AS median FROM x JOIN macro ON dt >= rebal - INTERVAL 2 YEAR AND dt < rebal GROUP BY 1")
def sta_macro_in_training_window(spark, d):
    x = F.broadcast(cal_rebalance_dates(spark, d).select(F.col("first_day").alias("rebal")))  # two days a year
    m = src.macro(spark, d).join(x, (F.col("dt") >= F.add_months("rebal", -24)) & (F.col("dt") < F.col("rebal")))
    return m.groupBy("rebal").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y2")).alias("mean"), r(F.median("y2")).alias("median"))


# ----------------------------------------------------------------------------------------------------------- aggregates and reshaping


@query(f"WITH {FACT} SELECT coalesce(config, 'all') AS config, coalesce(seed, -1) AS seed, count(*) AS n, round(avg(metric), 7) AS mean FROM fact GROUP BY CUBE (config, seed)")
def agg_cube(spark, d):
    c = src.fact(spark, d).cube("config", "seed").agg(F.count(F.lit(1)).alias("n"), r(F.avg("metric"), 7).alias("mean"))
    return c.select(F.coalesce("config", F.lit("all")).alias("config"), F.coalesce("seed", F.lit(-1)).alias("seed"), "n", "mean")


@query(f"WITH {FACT}, m AS (SELECT config, avg(metric) AS m FROM fact GROUP BY 1) SELECT config, round(m - max(CASE WHEN config = '1-URGENT' THEN m END) OVER (), 6) AS delta FROM m")
def agg_delta_vs_reference(spark, d):
    m = src.fact(spark, d).groupBy("config").agg(F.avg("metric").alias("m"))  # one row a config from here on
    return m.select("config", r(F.col("m") - F.max(F.when(F.col("config") == "1-URGENT", F.col("m"))).over(Window.partitionBy(F.lit(0))), 6).alias("delta"))


@query(f"WITH {FACT} SELECT (SELECT round(avg(v), 7) FROM (SELECT var_samp(metric) AS v FROM fact GROUP BY config)) AS within_config, (SELECT round(avg(v), 7) FROM (SELECT var_samp(metric) AS v FROM fact GROUP BY asset)) AS within_asset")
def agg_variance_by_axis(spark, d):
    f = src.fact(spark, d)
    mean = lambda k: f.groupBy(k).agg(F.var_samp("metric").alias("v")).agg(r(F.avg("v"), 7).alias(f"within_{k}"))
    return mean("config").crossJoin(mean("asset"))  # one row each


@query(f"WITH {FACT} SELECT asset, " + ", ".join(f"count(*) FILTER (config = '{c}') AS {n}" for c, n in CONFIGS.items()) + " FROM fact WHERE metric > 1.5 GROUP BY 1")
def piv_crosstab(spark, d):
    w = src.fact(spark, d).where("metric > 1.5").groupBy("asset").pivot("config", list(CONFIGS)).count().na.fill(0)
    return w.select("asset", *[F.col(f"`{c}`").alias(n) for c, n in CONFIGS.items()])


@query(f"WITH {FACT} SELECT asset, config, seed, 'metric' AS name, round(metric, 6) AS value FROM fact WHERE metric IS NOT NULL UNION ALL SELECT asset, config, seed, 'low', round(low, 6) FROM fact WHERE low IS NOT NULL")
def piv_unpivot(spark, d):
    return src.fact(spark, d).unpivot(["asset", "config", "seed"], ["metric", "low"], "name", "value").where("value IS NOT NULL").withColumn("value", r(F.col("value"), 6))


@query(f"WITH {FACT}, m AS (SELECT asset, round(avg(metric), 8) AS mean FROM fact GROUP BY 1) SELECT asset, mean FROM m ORDER BY mean DESC, asset LIMIT 10")
def srt_top_k(spark, d):
    """The ten best assets: the limit is the feature."""
    return src.fact(spark, d).groupBy("asset").agg(r(F.avg("metric")).alias("mean")).orderBy(F.desc("mean"), "asset").limit(10)


@query(f"WITH {FACT}, m AS (SELECT config, round(avg(metric), 8) AS mean FROM fact GROUP BY 1) SELECT config, mean, CAST(coalesce(list_position(['5-LOW', '2-HIGH', '1-URGENT'], config), 0) AS INT) AS place FROM m")
def srt_listed_order(spark, d):
    place = F.array_position(F.array(*[F.lit(c) for c in ("5-LOW", "2-HIGH", "1-URGENT")]), F.col("config")).cast("int")
    return src.fact(spark, d).groupBy("config").agg(r(F.avg("metric")).alias("mean")).select("config", "mean", place.alias("place")).orderBy(F.col("place") == 0, "place", "config")


@query(f"WITH {FACT} SELECT DISTINCT config, substr(md5(config), 1, 8) AS digest, regexp_replace(config, '[^A-Za-z0-9_-]', '_', 'g') AS file_key, CAST(split_part(config, '-', 1) AS INT) AS level, lower(split_part(config, '-', 2)) AS word FROM fact")
def scl_config_keys(spark, d):
    c = F.col("config")
    return src.fact(spark, d).select("config").distinct().select("config", F.substring(F.md5(c), 1, 8).alias("digest"), F.regexp_replace(c, "[^A-Za-z0-9_-]", "_").alias("file_key"), F.split_part(c, F.lit("-"), F.lit(1)).cast("int").alias("level"), F.lower(F.split_part(c, F.lit("-"), F.lit(2))).alias("word"))


# ------------------------------------------------------------------------------------------------------------- stability of clusters


@query(f"WITH {PANEL}, {_LBL} SELECT asset, t, coalesce(lead(y) OVER {BY}, y) AS target FROM lbl")
def win_supervised_target(spark, d):
    return labels(spark, d).select("asset", "t", F.coalesce(F.lead("y").over(by()), F.col("y")).alias("target"))


_TRAIL = f"tr0 AS (SELECT *, CASE WHEN y <> lag(y) OVER {BY} THEN 1 ELSE 0 END AS ch FROM lbl), tr AS (SELECT *, CASE WHEN count(y) OVER (PARTITION BY asset ORDER BY t ROWS 251 PRECEDING) >= 20 THEN count(y) OVER (PARTITION BY asset ORDER BY t ROWS 251 PRECEDING) / (1 + sum(ch) OVER (PARTITION BY asset ORDER BY t ROWS 250 PRECEDING)) END AS mrl FROM tr0)"


@query(f"WITH {PANEL}, {_LBL}, {_TRAIL} SELECT asset, t, round(mrl, 6) AS mrl FROM tr")
def win_trailing_run_length(spark, d):
    return stability.with_trailing_run_length(labels(spark, d), "y", "mrl").select("asset", "t", r(F.col("mrl"), 6).alias("mrl"))


_GROUP = "CASE WHEN {0} < 90 THEN 'G_Q' WHEN {0} < 200 THEN 'G_S' ELSE 'G_A' END"


@query(f"""WITH {PANEL}, {_LBL}, {_TRAIL}, e AS (SELECT asset, dt, mrl FROM tr QUALIFY dt = min(dt) OVER (PARTITION BY asset, year(dt), month(dt)) AND month(dt) IN (1, 7)),
 g AS (SELECT asset, dt, mrl, CASE WHEN mrl IS NOT NULL THEN {_GROUP.format('mrl')} END AS implied FROM e)
 SELECT asset, dt, coalesce(last_value(implied IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'G_S') AS in_force, implied FROM g""")
def swp_rolling_groups(spark, d):
    """The refit group in force at each evaluation day, from the run length at the one before (half-yearly until there is one)."""
    tr = stability.with_trailing_run_length(labels(spark, d), "y", "mrl").where(F.month("dt").isin(1, 7))
    first = F.min("dt").over(Window.partitionBy("asset", F.year("dt"), F.month("dt")))
    g = tr.withColumn("f", first).where("dt = f").select("asset", "dt", F.when(F.col("mrl").isNotNull(), stability.refit_group(F.col("mrl"))).alias("implied"))
    before = by(order="dt").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("asset", "dt", F.coalesce(F.last("implied", ignorenulls=True).over(before), F.lit("G_S")).alias("in_force"), "implied")


@query(f"WITH {PANEL}, {_LBL}, {_TRAIL} SELECT asset, round(quantile_cont(mrl, 0.05), 6) AS threshold, round(avg(mrl), 6) AS mean, {_GROUP.format('avg(mrl)')} AS grp FROM tr GROUP BY 1")
def swp_trigger_threshold(spark, d):
    tr = stability.with_trailing_run_length(labels(spark, d), "y", "mrl")
    return tr.groupBy("asset").agg(r(F.percentile("mrl", 0.05), 6).alias("threshold"), r(F.avg("mrl"), 6).alias("mean"), stability.refit_group(F.avg("mrl")).alias("grp"))


@query(f"WITH {PANEL}, {_LBL}, s AS (SELECT asset, year(dt)::INT AS fit, y, CASE WHEN y = lag(y) OVER (PARTITION BY asset, year(dt) ORDER BY t) THEN 0 ELSE 1 END AS starts FROM lbl) SELECT asset, fit, round(avg(y), 7) AS pct_bear, round(count(*) / sum(starts), 6) AS mean_run, round(1.0 / sum(starts), 7) AS persistence FROM s GROUP BY 1, 2")
def stb_occupancy_persistence(spark, d):
    w = Window.partitionBy("asset", "fit").orderBy("t")
    s = labels(spark, d).withColumn("fit", F.year("dt")).withColumn("starts", F.when(F.col("y") == F.lag("y").over(w), 0).otherwise(1))
    return s.groupBy("asset", "fit").agg(r(F.avg("y"), 7).alias("pct_bear"), r(F.count(F.lit(1)) / F.sum("starts"), 6).alias("mean_run"), r(1 / F.sum("starts"), 7).alias("persistence"))


_FEAT = f"ft AS (SELECT asset, dt, t, y, er * 100 AS f1, m * 1000 AS f2 FROM (SELECT *, {ewm_sql('er', 21)} AS m FROM lbl))"


def features(spark, d) -> DataFrame:
    return labels(spark, d).select("asset", "dt", "t", "er", "y", (F.col("er") * 100).alias("f1"), (ewm_mean(F.col("er"), 21) * 1000).alias("f2"))


@query(f"""WITH {PANEL}, {_LBL}, {_FEAT}, c AS (SELECT asset, year(dt)::INT AS fit, y, avg(f1) AS f1, avg(f2) AS f2 FROM ft GROUP BY 1, 2, 3),
 m AS (SELECT asset, fit, y, sqrt(pow(f1 - lag(f1) OVER w, 2) + pow(f2 - lag(f2) OVER w, 2)) AS moved FROM c WINDOW w AS (PARTITION BY asset, y ORDER BY fit)), s AS (SELECT asset, fit, max(moved) FILTER (y = 0) AS a, max(moved) FILTER (y = 1) AS b FROM m GROUP BY 1, 2)
 SELECT asset, fit, round(a, 6) AS drift_bull, round(b, 6) AS drift_bear, round((a + b) / 2, 6) AS drift_mean FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def stb_centroid_drift(spark, d):
    c = features(spark, d).groupBy("asset", F.year("dt").alias("fit"), "y").agg(F.avg("f1").alias("f1"), F.avg("f2").alias("f2"))
    return stability.centroid_drift(c, ["f1", "f2"]).select("asset", "fit", *[r(F.col(x), 6).alias(x) for x in ("drift_bull", "drift_bear", "drift_mean")])


@query(f"""WITH {PANEL}, {_LBL}, {_FEAT}, p AS (SELECT a.asset, a.t, a.y, b.y AS z, sum(sqrt(pow(a.f1 - b.f1, 2) + pow(a.f2 - b.f2, 2))) AS s, count(*) AS n FROM ft a JOIN ft b USING (asset) GROUP BY 1, 2, 3, 4),
 q AS (SELECT asset, t, max(s / nullif(n - 1, 0)) FILTER (y = z) AS a, max(s / n) FILTER (y <> z) AS b FROM p GROUP BY 1, 2) SELECT asset, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM q GROUP BY 1""")
def stb_silhouette(spark, d):
    return stability.silhouette(features(spark, d), ["f1", "f2"], "y").select("asset", r(F.col("silhouette"), 5).alias("silhouette"))


@query(SQL["stb_silhouette"])
def stb_silhouette_tiled(spark, d):
    """The same, tile by tile: an asset's rows are dealt over tasks."""
    return stability.silhouette_tiled(features(spark, d), ["f1", "f2"], "y", ["asset"], 512).select("asset", r(F.col("silhouette"), 5).alias("silhouette"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2),
 s AS (SELECT label, avg(dist) AS s FROM (SELECT vec_id, label, sqrt(sum(pow(x - m, 2))) AS dist FROM e JOIN c USING (label, k) GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT a.label, b.label AS other, sqrt(sum(pow(a.m - b.m, 2))) AS gap FROM c a JOIN c b ON a.k = b.k AND a.label <> b.label GROUP BY 1, 2)
 SELECT round(avg(w), 4) AS davies_bouldin FROM (SELECT g.label, max((p.s + q.s) / gap) AS w FROM g JOIN s p ON p.label = g.label JOIN s q ON q.label = other GROUP BY 1)""")
def stb_davies_bouldin(spark, d):
    v = src.table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    c = v.groupBy("label", "k").agg(F.avg("x").alias("m"))  # clusters x dimensions
    dist = v.join(c, ["label", "k"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("dist"))
    s = dist.groupBy("label").agg(F.avg("dist").alias("s"))
    a, b = c.alias("a"), c.alias("b")
    g = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.label") != F.col("b.label"))).groupBy(F.col("a.label").alias("label"), F.col("b.label").alias("other")).agg(F.sqrt(F.sum(F.pow(F.col("a.m") - F.col("b.m"), 2))).alias("gap"))
    w = g.join(s, "label").join(s.select(F.col("label").alias("other"), F.col("s").alias("s2")), "other")
    return w.groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.col("gap")).alias("w")).agg(r(F.avg("w"), 4).alias("davies_bouldin"))


# ------------------------------------------------------------------------------------------------------------------------ inference


_PAIRS = "m AS (SELECT asset, config, avg(metric) AS m FROM fact GROUP BY 1, 2), dif AS (SELECT c.config, c.asset, round(c.m - b.m, 9) AS x, c.m AS cm, b.m AS bm FROM m c JOIN m b ON c.asset = b.asset AND b.config = '1-URGENT' AND c.config <> '1-URGENT')"


def paired(spark, d) -> DataFrame:
    m = src.fact(spark, d).groupBy("asset", "config").agg(F.avg("metric").alias("cm"))
    b = m.where("config = '1-URGENT'").select("asset", F.col("cm").alias("bm"))
    return m.where("config <> '1-URGENT'").join(b, "asset").withColumn("x", F.round(F.col("cm") - F.col("bm"), 9))


@query(f"""WITH {FACT}, {_PAIRS}, k AS (SELECT config, x, {rank_sql('abs(x)', 'config')} AS rk FROM dif WHERE x <> 0), s AS (SELECT config, count(*) AS n, least(sum(rk) FILTER (x > 0), sum(rk) FILTER (x < 0)) AS w FROM k GROUP BY 1)
 SELECT config, n, round(w, 3) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM s""")
def sta_wilcoxon(spark, d):
    return wilcoxon(spark, d).select("config", "n", r(F.col("w"), 3).alias("w"), r((F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24), 6).alias("z"))


def wilcoxon(spark, d) -> DataFrame:
    k = paired(spark, d).where("x <> 0").withColumn("ax", F.abs("x")).withColumn("rk", rank_of("ax", "config"))
    return k.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.least(F.sum(F.when(F.col("x") > 0, F.col("rk"))), F.sum(F.when(F.col("x") < 0, F.col("rk")))).alias("w"))


@query()
def sta_pairwise_table(spark, d):
    """Each config against the reference: signed-rank p, effect size and Holm's verdict; one row a config. Tails come from a helper row by row, Holm's steps from windows over the configs."""

    def tails(batches):
        for b in batches:
            p = [inference.wilcoxon_p(w, n) if n >= 5 else None for w, n in zip(b.w, b.n, strict=True)]
            z = [abs(inference.NormalDist().inv_cdf(min(max(x / 2, 1e-300), 0.5))) if x is not None else 0.0 for x in p]
            yield b.assign(p=p, effect=[a / math.sqrt(n) for a, n in zip(z, b.n, strict=True)])

    t = wilcoxon(spark, d).mapInPandas(tails, "config string, n long, w double, p double, effect double")
    known = Window.partitionBy(F.col("p").isNull())  # one row a config
    t = t.withColumn("left", F.when(F.col("p").isNotNull(), F.count(F.lit(1)).over(known) - F.row_number().over(known.orderBy("p", "config")) + 1))
    failed = F.max(F.when(F.col("p") <= 0.05 / F.col("left"), 0).otherwise(1)).over(known.orderBy("p", "config").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("config", "n", "w", "p", "effect", F.least(F.lit(1.0), F.col("p") * F.col("left")).alias("p_holm"), (F.col("p").isNotNull() & (failed == 0)).alias("rejected"))


@query(f"WITH {FACT}, {_PAIRS} SELECT config, round((avg(cm) - avg(bm)) / sqrt((var_samp(cm) + var_samp(bm)) / 2), 6) AS cohens_d FROM dif GROUP BY 1")
def sta_cohens_d(spark, d):
    """Difference of means over the pooled deviation; both sides have one value an asset, so pooling is the mean of the variances."""
    return paired(spark, d).groupBy("config").agg(r((F.avg("cm") - F.avg("bm")) / F.sqrt((F.var_samp("cm") + F.var_samp("bm")) / 2), 6).alias("cohens_d"))


_FRIED = f"""k AS (SELECT asset, seed, config, {rank_sql('metric', 'asset, seed')} AS rk, count(*) OVER (PARTITION BY asset, seed) AS c FROM fact),
 s AS (SELECT asset, config, sum(rk) AS s, count(*) AS n FROM k WHERE c = 5 GROUP BY 1, 2), x AS (SELECT asset, 12.0 / (max(n) * 30) * sum(s * s) - 18 * max(n) AS x FROM s GROUP BY 1), p AS (SELECT asset, round(exp(-x / 2) * (1 + x / 2), 9) AS p FROM x)"""


@query(f"""WITH {FACT}, {_FRIED}, o AS (SELECT *, row_number() OVER (ORDER BY p, asset) AS i, count(*) OVER () AS m FROM p) SELECT asset, p, round(least(1, p * m), 8) AS bonferroni, round(least(1, p * (m - i + 1)), 8) AS holm,
 max(CASE WHEN p <= 0.05 / (m - i + 1) THEN 0 ELSE 1 END) OVER (ORDER BY i) = 0 AS holm_rejects, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS bh FROM o""")
def sta_multiple_testing(spark, d):
    """Friedman's test of the five configs in every asset (four degrees of freedom: the tail is exp(-x/2) (1 + x/2)), then Bonferroni, Holm and Benjamini-Hochberg over the assets."""
    k = src.fact(spark, d).withColumn("rk", rank_of("metric", "asset", "seed")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("asset", "seed")))
    s = k.where("c = 5").groupBy("asset", "config").agg(F.sum("rk").alias("s"), F.count(F.lit(1)).alias("n"))
    x = s.groupBy("asset").agg((12 / (F.max("n") * 30) * F.sum(F.col("s") * F.col("s")) - 18 * F.max("n")).alias("x"))
    p = x.select("asset", F.round(F.exp(-F.col("x") / 2) * (1 + F.col("x") / 2), 9).alias("p"))
    all_, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("i")  # one row a test
    o = p.withColumn("i", F.row_number().over(all_.orderBy("p", "asset"))).withColumn("m", F.count(F.lit(1)).over(all_))
    left = F.col("m") - F.col("i") + 1
    one = F.lit(1.0)
    return o.select(
        "asset", "p", r(F.least(one, F.col("p") * F.col("m"))).alias("bonferroni"), r(F.least(one, F.col("p") * left)).alias("holm"),
        (F.max(F.when(F.col("p") <= 0.05 / left, 0).otherwise(1)).over(up) == 0).alias("holm_rejects"),
        r(F.least(one, F.min(F.col("p") * F.col("m") / F.col("i")).over(up.rowsBetween(0, Window.unboundedFollowing)))).alias("bh"),
    )


@query(f"""WITH {PANEL}, {_LBL}, k AS (SELECT asset, y, er, {rank_sql('er', 'asset')} AS rk FROM lbl), s AS (SELECT asset, sum(rk) FILTER (y = 0) AS r0, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1,
 avg(er) FILTER (y = 0) AS m0, avg(er) FILTER (y = 1) AS m1, var_samp(er) FILTER (y = 0) AS v0, var_samp(er) FILTER (y = 1) AS v1 FROM k GROUP BY 1)
 SELECT asset, n0, n1, round(r0 - n0 * (n0 + 1) / 2.0, 2) AS u, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) AS welch_t, round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 3) AS df FROM s""")
def sta_two_samples(spark, d):
    """Mann-Whitney's U and Welch's t of the returns in bull and bear states."""
    k = labels(spark, d).withColumn("rk", rank_of("er", "asset"))
    at = lambda f, v, c="er": f(F.when(F.col("y") == v, F.col(c)))
    s = k.groupBy("asset").agg(at(F.sum, 0, "rk").alias("r0"), at(F.count, 0).alias("n0"), at(F.count, 1).alias("n1"), at(F.avg, 0).alias("m0"), at(F.avg, 1).alias("m1"), at(F.var_samp, 0).alias("v0"), at(F.var_samp, 1).alias("v1"))
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select("asset", "n0", "n1", r(F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2, 2).alias("u"), r((F.col("m0") - F.col("m1")) / F.sqrt(a + b), 5).alias("welch_t"), r(F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n0") - 1) + F.pow(b, 2) / (F.col("n1") - 1)), 3).alias("df"))


_DM_TERMS = " + ".join(f"2 * {1 - h / 13!r} * sum(x * l{h}) / n" for h in range(1, 13))


@query(f"""WITH {PANEL}, {_LBL}, j AS (SELECT asset, t, pow(er * (1 - yhat), 2) - pow(er * (1 - y), 2) AS d FROM lbl), c AS (SELECT asset, t, d, d - avg(d) OVER (PARTITION BY asset) AS x, count(*) OVER (PARTITION BY asset) AS n, avg(d) OVER (PARTITION BY asset) AS m FROM j),
 l AS (SELECT *, {', '.join(f'lag(x, {h}) OVER {BY} AS l{h}' for h in range(1, 13))} FROM c), v AS (SELECT asset, n, m, greatest(sum(x * x) / n + {_DM_TERMS}, 1e-12) AS v FROM l GROUP BY 1, 2, 3) SELECT asset, round(m / sqrt(v / n), 5) AS dm FROM v""")
def sta_diebold_mariano(spark, d):
    """Squared daily results of two timing rules compared, with a Newey-West variance of 12 lags."""
    whole = Window.partitionBy("asset")
    j = labels(spark, d).select("asset", "t", (F.pow(F.col("er") * (1 - F.col("yhat")), 2) - F.pow(F.col("er") * (1 - F.col("y")), 2)).alias("d"))
    c = j.select("asset", "t", (F.col("d") - F.avg("d").over(whole)).alias("x"), F.count(F.lit(1)).over(whole).alias("n"), F.avg("d").over(whole).alias("m"))
    lags = c.select("asset", "n", "m", "x", *[F.lag("x", h).over(by()).alias(f"l{h}") for h in range(1, 13)])
    x, n = F.col("x"), F.col("n")
    v = sum((2 * (1 - h / 13) * F.sum(x * F.col(f"l{h}")) / n for h in range(1, 13)), F.sum(x * x) / n)
    return lags.groupBy("asset", "n", "m").agg(F.greatest(v, F.lit(1e-12)).alias("v")).select("asset", r(F.col("m") / F.sqrt(F.col("v") / F.col("n")), 5).alias("dm"))


@query(f"WITH {PANEL} SELECT asset, round(regr_slope(er, t), 12) AS slope, round(regr_intercept(er, t), 8) AS intercept FROM panel GROUP BY 1")
def sta_linear_fit(spark, d):
    return src.panel(spark, d).groupBy("asset").agg(r(F.regr_slope("er", "t"), 12).alias("slope"), r(F.regr_intercept("er", "t")).alias("intercept"))


def per_asset(df: DataFrame, schema: str, f) -> DataFrame:
    """f of each asset's rows in order of t; one training series a task."""
    return df.groupBy("asset").applyInPandas(lambda pdf: f(pdf.sort_values("t")), f"asset string, {schema}")


@query()
def sta_hac_ols(spark, d):
    """Each asset's return on its smoothed return of the day before, with Newey-West errors."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        b, se = inference.hac_ols(pdf["m"].to_numpy(), pdf["er"].to_numpy())
        return pd.DataFrame({"asset": pdf["asset"].iloc[:1], "slope": [b[1]], "se": [se[1]], "p": [inference.normal_two_sided(b[1] / se[1])]})

    p = src.panel(spark, d).withColumn("e", ewm_mean(F.col("er"), 21)).withColumn("m", F.lag("e").over(by())).dropna(subset=["m", "er"])
    return per_asset(p.select("asset", "t", "er", "m"), "slope double, se double, p double", one)


@query()
def sta_hp_filter(spark, d):
    """Trend and cycle of each asset's log wealth."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.log1p(pdf["er"].to_numpy()).cumsum()
        trend = inference.hp_trend(x) if len(x) >= 10 else np.full(len(x), np.nan)
        return pd.DataFrame({"asset": pdf["asset"], "t": pdf["t"], "trend": trend, "cycle": x - trend})

    return per_asset(src.panel(spark, d).select("asset", "t", "er"), "t int, trend double, cycle double", one)


@query()
def sta_bootstrap_sharpe(spark, d):
    """Sharpe ratio with a bootstrap interval, and Spearman's correlation of a return with the one before, likewise."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        er = pdf["er"].to_numpy()
        sharpe = lambda v: v.mean() / max(v.std(ddof=1), 1e-12) * math.sqrt(252)
        (lo, hi), (clo, chi) = inference.bootstrap(sharpe, [er]), inference.bootstrap(inference.spearman, [er[1:], er[:-1]])
        return pd.DataFrame({"asset": pdf["asset"].iloc[:1], "sharpe": [sharpe(er)], "lo": [lo], "hi": [hi], "rho": [inference.spearman(er[1:], er[:-1])], "rho_lo": [clo], "rho_hi": [chi]})

    return per_asset(src.panel(spark, d).select("asset", "t", "er"), "sharpe double, lo double, hi double, rho double, rho_lo double, rho_hi double", one)


@query()
def sta_block_bootstrap(spark, d):
    """Sharpe ratio with intervals from 2,000 replicates of single days and of runs of 21 days, each replicate drawn by a generator of its own."""
    p = src.panel(spark, d)
    kinds = [resampling.intervals(resampling.replicates(p, ["er"], resampling.sharpe, 2000, block)).withColumn("block", F.lit(block)) for block in (1, 21)]
    return kinds[0].unionByName(kinds[1])


@query()
def sta_deflated_sharpe(spark, d):
    """Probability that each asset's daily Sharpe ratio beats the best of as many unskilled trials as there are assets."""
    er = F.col("er")
    s = src.panel(spark, d).groupBy("asset").agg((F.avg(er) / F.stddev_samp(er)).alias("sharpe"), F.count(er).alias("n"), F.skewness(er).alias("skew"), (F.kurtosis(er) + 3).alias("kurt"))
    s = s.withColumn("trials", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # one row an asset

    def prob(batches):
        for b in batches:
            yield b[["asset", "sharpe"]].assign(dsr=[inference.deflated_sharpe(*x) for x in zip(b.sharpe, b.trials, b.n, b["skew"], b["kurt"], strict=True)])

    return s.mapInPandas(prob, "asset string, sharpe double, dsr double")


# --------------------------------------------------------------------------------------------------------------------------- sweeps

#: Fixed values of the joint sweep.
PENALTIES, ESTIMATORS, STATES = (25, 50, 100), ("cc", "yz"), (2, 3)
REFITS, FORECASTERS = ("mon", "qua", "sem", "ann"), ("log", "rf", "xgb")
BUDGET = 150


@query(f"WITH {FACT} SELECT asset, 'w1_l' || l || '_' || v || '_k' || k || '_' || q || '_' || f AS config, l AS penalty, v AS estimator, k AS states, q AS refit, f AS forecaster FROM (SELECT unnest([25, 50, 100]) AS l) CROSS JOIN (SELECT unnest(['cc', 'yz']) AS v) CROSS JOIN (SELECT unnest([2, 3]) AS k) CROSS JOIN (SELECT unnest(['mon', 'qua', 'sem', 'ann']) AS q) CROSS JOIN (SELECT unnest(['log', 'rf', 'xgb']) AS f) CROSS JOIN (SELECT DISTINCT asset FROM fact)")
def swp_joint_grid(spark, d):
    """The joint sweep's runs: every config for every asset that has results; more than BUDGET configs are an error."""
    sides = {"penalty": PENALTIES, "estimator": ESTIMATORS, "states": STATES, "refit": REFITS, "forecaster": FORECASTERS}
    if math.prod(map(len, sides.values())) > BUDGET:
        raise ValueError(f"more than {BUDGET} configs; shorten a dimension")
    g = src.fact(spark, d).select("asset").distinct()
    for name, values in sides.items():
        g = g.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return g.select("asset", F.concat(F.lit("w1_l"), "penalty", F.lit("_"), "estimator", F.lit("_k"), "states", F.lit("_"), "refit", F.lit("_"), "forecaster").alias("config"), *sides)


_SS = "ss AS (SELECT 'config' AS factor, sum(n * pow(m - g, 2)) AS ss FROM (SELECT count(*) AS n, avg(metric) AS m, (SELECT avg(metric) FROM fact) AS g FROM fact GROUP BY config) UNION ALL SELECT 'asset', sum(n * pow(m - g, 2)) FROM (SELECT count(*) AS n, avg(metric) AS m, (SELECT avg(metric) FROM fact) AS g FROM fact GROUP BY asset) UNION ALL SELECT 'seed', sum(n * pow(m - g, 2)) FROM (SELECT count(*) AS n, avg(metric) AS m, (SELECT avg(metric) FROM fact) AS g FROM fact GROUP BY seed))"


@query(f"WITH {FACT}, {_SS} SELECT factor, round(ss / sum(ss) OVER (), 6) AS share, row_number() OVER (ORDER BY ss DESC) AS place FROM ss")
def swp_variance_shares(spark, d):
    """Each factor's share of the squares between groups; one pass over the runs by grouping sets."""
    s = src.fact(spark, d).groupingSets([["config"], ["asset"], ["seed"], []], "config", "asset", "seed").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg("metric").alias("m"))
    one = Window.partitionBy(F.lit(0))  # one row a level of a factor
    f = s.withColumn("grand", F.max(F.when(F.col("g") == 7, F.col("m"))).over(one)).where("g <> 7")
    f = f.withColumn("factor", F.when(F.col("g") == 3, "config").when(F.col("g") == 5, "asset").otherwise("seed"))
    ss = f.groupBy("factor").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ss"))
    return ss.select("factor", r(F.col("ss") / F.sum("ss").over(one), 6).alias("share"), F.row_number().over(one.orderBy(F.desc("ss"))).alias("place"))


_VAL = "h AS (SELECT asset, round(product(1 + er) FILTER (t <= 0.6 * n), 9) AS v, round(product(1 + er) FILTER (t > 0.6 * n), 9) AS o FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM panel) GROUP BY 1)"


@query(f"WITH {PANEL}, {_VAL}, k AS (SELECT v, o, {rank_sql('v')} AS a, {rank_sql('o')} AS b FROM h) SELECT round(corr(v, o), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM k")
def swp_validation_consistency(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    p, g = src.panel(spark, d).withColumn("n", n), 1 + F.col("er")
    h = p.groupBy("asset").agg(F.round(F.product(F.when(F.col("t") <= 0.6 * F.col("n"), g)), 9).alias("v"), F.round(F.product(F.when(F.col("t") > 0.6 * F.col("n"), g)), 9).alias("o"))
    return h.select("v", "o", rank_of("v", *[]).alias("a"), rank_of("o", *[]).alias("b")).agg(r(F.corr("v", "o"), 6).alias("pearson"), r(F.corr("a", "b"), 6).alias("spearman"))


@query()
def swp_refit_events(spark, d):
    """When each asset's model is refitted if agreement with the last fit or the run length falls; judged on the first day of each quarter."""
    first = F.col("dt") == F.min("dt").over(Window.partitionBy("asset", F.year("dt"), F.quarter("dt")))
    return forecast.refit_events(features(spark, d).withColumn("judge", first), ["f1", "f2"], "judge", theta_ari=0.5, theta_run=20.0)


# --------------------------------------------------------------------------------------------------------------- regimes and forecasts


@query(f"WITH {PANEL}, {_LBL} SELECT asset, y AS state, count(*) AS n, round(avg(er), 9) AS mean_daily, round(product(1 + er) - 1, 7) AS cum_return, round(stddev_pop(er) * sqrt(252), 7) AS volatility FROM lbl GROUP BY 1, 2")
def jmp_state_stats(spark, d):
    er = F.col("er")
    return labels(spark, d).groupBy("asset", F.col("y").alias("state")).agg(F.count(er).alias("n"), r(F.avg(er), 9).alias("mean_daily"), r(F.product(1 + er) - 1, 7).alias("cum_return"), r(F.stddev_pop(er) * F.sqrt(F.lit(252.0)), 7).alias("volatility"))


@query(f"WITH {PANEL}, {_LBL}, c AS (SELECT asset, y, avg(er * 100) AS c FROM lbl GROUP BY 1, 2), n AS (SELECT l.asset, l.t, arg_min(c.y, pow(l.er * 100 - c.c, 2)) AS nearest FROM lbl l JOIN c USING (asset) GROUP BY 1, 2), b AS (SELECT asset, arg_max(y, c) AS bull FROM c GROUP BY 1) SELECT asset, t, CASE WHEN nearest = bull THEN 0 ELSE 1 END AS regime FROM n JOIN b USING (asset)")
def jmp_nearest_centre(spark, d):
    """Prediction without penalty: the nearest centre's state, renamed so that 0 is the state of the highest mean. Centres travel as one map per asset."""
    x = labels(spark, d)
    c = x.groupBy("asset", "y").agg(F.avg(F.col("er") * 100).alias("c")).groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("y", "c"))).alias("cs"), F.max_by("y", "c").alias("bull"))
    near = F.array_min(F.transform("cs", lambda s: F.struct(F.pow(F.col("er") * 100 - s["c"], 2).alias("d"), s["y"].alias("y"))))["y"]
    return x.join(F.broadcast(c), "asset").select("asset", "t", F.when(near == F.col("bull"), 0).otherwise(1).alias("regime"))  # two centres an asset


@query(f"""WITH {PANEL}, {_LBL}, w AS (SELECT asset, t, y, sum(CASE WHEN y = 0 THEN er END) OVER q AS s0, count(*) FILTER (y = 0) OVER q AS n0, sum(CASE WHEN y = 1 THEN er END) OVER q AS s1, count(*) FILTER (y = 1) OVER q AS n1, avg(er) OVER q AS m FROM lbl WINDOW q AS (PARTITION BY asset ORDER BY dt RANGE BETWEEN INTERVAL 11 YEAR PRECEDING AND CURRENT ROW))
 SELECT asset, t, round(CASE WHEN y = 0 THEN CASE WHEN n0 > 5 THEN s0 / n0 ELSE m END ELSE greatest(CASE WHEN n1 > 5 THEN s1 / n1 ELSE m END, -0.001) END, 8) AS mu FROM w""")
def jmp_conditional_forecast(spark, d):
    """Mean return of the last years' days in the present regime; the plain mean after five days or fewer; not below -10 basis points in a bear."""
    frame = "OVER (PARTITION BY asset ORDER BY dt RANGE BETWEEN INTERVAL '11' YEAR PRECEDING AND CURRENT ROW)"
    w = labels(spark, d).selectExpr("asset", "t", "y", *[f"{f}(CASE WHEN y = {k} THEN er END) {frame} AS {n}{k}" for k in (0, 1) for f, n in (("sum", "s"), ("count", "n"))], f"avg(er) {frame} AS m")
    at = lambda k: F.when(F.col(f"n{k}") > 5, F.col(f"s{k}") / F.col(f"n{k}")).otherwise(F.col("m"))
    return w.select("asset", "t", r(F.when(F.col("y") == 0, at(0)).otherwise(F.greatest(at(1), F.lit(-0.001)))).alias("mu"))


@query(f"WITH {PANEL}, p AS (SELECT asset, t, round(1 / (1 + exp(1000 * {ewm_sql('er', 21)})), 9) AS prob FROM panel), s AS (SELECT asset, t, {ewm_sql('prob', 4)} AS s FROM p) SELECT asset, t, round(s, 7) AS prob, CASE WHEN round(s, 9) >= 0.5 THEN 1 ELSE 0 END AS label FROM s")
def fct_smoothed_probability(spark, d):
    p = src.panel(spark, d).select("asset", "t", F.round(1 / (1 + F.exp(1000 * ewm_mean(F.col("er"), 21))), 9).alias("prob"))
    s = p.select("asset", "t", ewm_mean(F.col("prob"), 4).alias("s"))
    return s.select("asset", "t", r(F.col("s"), 7).alias("prob"), F.when(F.round("s", 9) >= 0.5, 1).otherwise(0).alias("label"))


@query(f"WITH {PANEL}, {_LBL}, p AS (SELECT asset, t, er, 1.0 - coalesce(lag(yhat) OVER {BY}, 1) AS pos FROM lbl), n AS (SELECT asset, pos * er - abs(pos - coalesce(lag(pos) OVER {BY}, 0)) * 0.0005 AS net FROM p) SELECT asset, round(avg(net) / stddev_samp(net) * sqrt(252), 5) AS sharpe, round(avg((net > 0)::INT), 7) AS hit_rate FROM n GROUP BY 1")
def fct_timing_sharpe(spark, d):
    """Hold the asset the day after a bullish forecast, pay for each switch."""
    p = labels(spark, d).select("asset", "t", "er", (1.0 - F.coalesce(F.lag("yhat").over(by()), F.lit(1))).alias("pos"))
    n = p.select("asset", (F.col("pos") * F.col("er") - F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(by()), F.lit(0.0))) * 0.0005).alias("net"))
    return n.groupBy("asset").agg(r(F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0)), 5).alias("sharpe"), r(F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)), 7).alias("hit_rate"))


@query(f"WITH {PANEL}, e AS (SELECT asset, t, er, {ewm_sql('er', 21)} AS m FROM panel), l AS (SELECT asset, er, lag(m) OVER {BY} AS m FROM e) SELECT asset, round(corr(er, m), 6) AS rho FROM l GROUP BY 1")
def fct_correlation(spark, d):
    e = src.panel(spark, d).withColumn("e", ewm_mean(F.col("er"), 21)).withColumn("m", F.lag("e").over(by()))
    return e.groupBy("asset").agg(r(F.corr("er", "m"), 6).alias("rho"))


def _forecast(method: str, sql: str | None = None):
    def run(spark, d):
        return forecast.next_regime(features(spark, d), ["f1", "f2"], "y", method)

    run.__name__, run.__doc__ = f"fct_{method}", f"Probability of a bear state on the next day, by {method}."
    return query(sql)(run)


_forecast("persistence", f"WITH {PANEL}, {_LBL}, n AS (SELECT asset, t, y, floor(CAST(0.6 AS DOUBLE) * count(*) OVER (PARTITION BY asset)) AS n FROM lbl) SELECT asset, t, CAST(max(CASE WHEN t = n THEN y END) OVER (PARTITION BY asset) AS DOUBLE) AS prob FROM n QUALIFY t > n")
for _m in ("logistic", "boosted"):
    _forecast(_m)


@query()
def fct_penalty_search(spark, d):
    """The jump penalty with the best validation Sharpe ratio of each asset."""
    return forecast.penalty_search(features(spark, d), ["f1", "f2"], [0.0, 1.0, 3.0, 10.0, 30.0, 100.0])


# ------------------------------------------------------------------------------------------------------------------------- backtests


_TARGETS = f"""{PANEL}, {MACRO}, {_LBL}, {_GRID}, rfd AS (SELECT c.dt, coalesce(macro.rf, 0) / 100 / 252 AS rf FROM (SELECT DISTINCT dt FROM panel) c ASOF LEFT JOIN macro ON c.dt >= macro.dt),
 g AS (SELECT asset, dt, coalesce(er, 0) AS er, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 1) AS y, rf FROM grid JOIN rfd USING (dt)),
 tg AS (SELECT 'equal' AS strategy, asset, dt, er, rf, 1.0 / count(*) OVER (PARTITION BY dt) AS w FROM g UNION ALL SELECT 'regime_equal', asset, dt, er, rf, CASE WHEN y = 0 AND sum(1 - y) OVER (PARTITION BY dt) >= 4 THEN 1.0 / sum(1 - y) OVER (PARTITION BY dt) ELSE 0 END FROM g
 UNION ALL SELECT 'mix', asset, dt, er, rf, CASE asset WHEN 'AF' THEN 0.6 WHEN 'NO' THEN 0.4 ELSE 0 END FROM g)"""
_BACKTEST = f"""{_TARGETS}, b1 AS (SELECT *, lead(dt) OVER o AS nd, lead(er) OVER o AS r1, lead(rf) OVER o AS rf1, count(*) OVER y AS n, sum(w) OVER y AS lev FROM tg WINDOW o AS (PARTITION BY strategy, asset ORDER BY dt), y AS (PARTITION BY strategy, dt)),
 b2 AS (SELECT *, w * (1 + r1) / (sum(w * (1 + r1)) OVER (PARTITION BY strategy, dt) + greatest(1 - lev, 0) * (1 + rf1)) AS held FROM b1), b3 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY strategy, asset ORDER BY dt), 1.0 / n) AS before FROM b2),
 bt AS (SELECT strategy, nd AS dt, sum(w * r1) + max(greatest(1 - lev, 0) * rf1) - sum(abs(w - before)) * 0.0005 AS ret, sum(abs(w - before)) AS turnover, max(lev) AS leverage FROM b3 WHERE nd IS NOT NULL GROUP BY 1, 2)"""


def targets(spark, d) -> DataFrame:
    """Targets of three strategies on every day: equal weights, equal weights of the bullish assets, a fixed mix."""
    days = src.panel(spark, d).select("dt").distinct()
    rf = as_of(days, src.macro(spark, d), "dt", ["rf"]).select("dt", (F.coalesce("rf", F.lit(0.0)) / 100 / 252).alias("rf"))
    g = grid(spark, d).withColumn("y", F.coalesce(forward_fill(F.col("y"), upto(order="dt")), F.lit(1))).join(rf, "dt")
    day = Window.partitionBy("dt")
    bulls = F.sum(1 - F.col("y")).over(day)
    w = g.select("asset", "dt", "er", "rf", F.lit(1.0) / F.count(F.lit(1)).over(day), F.when((F.col("y") == 0) & (bulls >= 4), 1.0 / bulls).otherwise(0.0), F.when(F.col("asset") == "AF", 0.6).when(F.col("asset") == "NO", 0.4).otherwise(0.0))
    w = w.toDF("asset", "dt", "er", "rf", "equal", "regime_equal", "mix")
    return w.unpivot(["asset", "dt", "er", "rf"], ["equal", "regime_equal", "mix"], "strategy", "w")


@query(f"WITH {_BACKTEST} SELECT strategy, dt, round(ret, 9) AS ret, round(turnover, 8) AS turnover, round(leverage, 8) AS leverage FROM bt")
def bkt_drifting_weights(spark, d):
    b = backtest.run(targets(spark, d))
    return b.select("strategy", "dt", r(F.col("ret"), 9).alias("ret"), r(F.col("turnover")).alias("turnover"), r(F.col("leverage")).alias("leverage"))


@query(f"""WITH {_BACKTEST}, x AS (SELECT bt.*, ret - rf AS x FROM bt JOIN rfd USING (dt)), k AS (SELECT *, product(1 + x) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING) AS wealth FROM x), q AS (SELECT *, max(wealth) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM k)
 SELECT strategy, round(avg(x) * 252, 7) AS ann_ret, round(stddev_samp(x) * sqrt(252), 7) AS ann_vol, round(avg(x) * 252 / (stddev_samp(x) * sqrt(252)), 5) AS sharpe, round(min(wealth / peak - 1), 7) AS mdd, round(abs(avg(x) * 252) / abs(min(wealth / peak - 1)), 5) AS calmar, round(avg(turnover) * 252, 5) AS turnover, round(avg(leverage), 7) AS leverage FROM q GROUP BY 1""")
def bkt_metric_bundle(spark, d):
    t = targets(spark, d)
    m = backtest.metrics(backtest.run(t).join(t.select("dt", "rf").distinct(), "dt"))
    return m.select("strategy", *[r(F.col(c), 5 if c in ("sharpe", "calmar", "turnover") else 7).alias(c) for c in ("ann_ret", "ann_vol", "sharpe", "mdd", "calmar", "turnover", "leverage")])


@query(f"WITH {_BACKTEST}, m AS (SELECT strategy, last_day(dt) AS m, sum(turnover) AS s FROM bt GROUP BY 1, 2) SELECT strategy, round(avg(s), 7) AS monthly_turnover FROM m GROUP BY 1")
def met_monthly_turnover(spark, d):
    return backtest.run(targets(spark, d)).groupBy("strategy", F.last_day("dt").alias("m")).agg(F.sum("turnover").alias("s")).groupBy("strategy").agg(r(F.avg("s"), 7).alias("monthly_turnover"))


@query(f"WITH {PANEL}, {_LBL}, s AS (SELECT asset, sum(abs(yhat - coalesce(lag1, 0))) AS switches, avg(abs(yhat - coalesce(lag1, 0))) AS label_turnover, sum(greatest(abs(yhat - coalesce(lag1, yhat)) - abs(y - coalesce(lag2, y)), -1)) AS extra, avg(er * (1 - yhat) - er * (1 - y)) * 252 AS gain FROM (SELECT *, lag(yhat) OVER {BY} AS lag1, lag(y) OVER {BY} AS lag2 FROM lbl) GROUP BY 1) SELECT asset, switches, round(label_turnover, 7) AS label_turnover, CASE WHEN extra > 0 THEN round(gain / extra, 9) END AS break_even FROM s")
def met_switches_break_even(spark, d):
    """Changes of the forecast (from state 0 at the start), and the cost a switch at which its extra switches over the smoother rule eat its gain."""
    x = labels(spark, d).withColumn("p", F.lag("yhat").over(by())).withColumn("q", F.lag("y").over(by()))
    step = F.abs(F.col("yhat") - F.coalesce("p", F.lit(0)))
    extra = F.sum(F.abs(F.col("yhat") - F.coalesce("p", "yhat")) - F.abs(F.col("y") - F.coalesce("q", "y")))
    gain = F.avg(F.col("er") * (1 - F.col("yhat")) - F.col("er") * (1 - F.col("y"))) * 252
    return x.groupBy("asset").agg(F.sum(step).alias("switches"), r(F.avg(step), 7).alias("label_turnover"), F.when(extra > 0, r(gain / extra, 9)).alias("break_even"))
