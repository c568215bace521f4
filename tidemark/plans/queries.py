"""One query per operator or family over the panel views, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..functions.series import as_of, average_rank, by, downside, ewm_mean, expanding_z, forward_fill, full, islands, last_rows, upto
from ..operators import jump_model, portfolio, volatility
from ..sources import sinks
from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PANEL = "panel AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt) AS t FROM (SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS dt, round((avg(l_discount) - 0.05) / 5, 10) AS er FROM lineitem GROUP BY 1, 2))"
MACRO = "macro AS (SELECT CAST(o_orderdate AS DATE) AS dt, round(avg(o_totalprice) / 1e5, 10) AS y2, max(o_totalprice) / 1e5 AS y10, 10 + count(o_totalprice) AS vix, round(avg(o_totalprice) / 1e5, 10) AS rf FROM orders GROUP BY 1)"
BARS = "bars AS (SELECT asset, b, arg_min(v, ts) AS o, max(v) AS h, min(v) AS l, arg_max(v, ts) AS c FROM (SELECT event_type AS asset, ts, value + 1 AS v, epoch_us(ts) // 21600000000 AS b FROM events) GROUP BY 1, 2)"
FACT = "fact AS (SELECT n_name AS asset, o_orderpriority AS config, CAST(o_custkey % 5 AS INT) AS seed, round(avg(o_totalprice) / 1e5, 8) AS metric, round(min(o_totalprice) / 1e5, 8) AS low FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"
UP = "(PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)"


def ewm_sql(c: str, hl: float) -> str:
    return f"(sum(({c}) * pow(2.0, t / {hl}.0)) OVER {UP} / sum(CASE WHEN ({c}) IS NOT NULL THEN pow(2.0, t / {hl}.0) END) OVER {UP})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 8):
    return F.round(c, n)


# ------------------------------------------------------------------------------------------------ sources, calendar, alignment


@query(f"WITH {PANEL} SELECT * FROM panel")
def src_panel(spark, d):
    return src.panel(spark, d)


@query(f"WITH {BARS} SELECT * FROM bars")
def src_bars_from_ticks(spark, d):
    return src.bars(spark, d)


@query(f"WITH {PANEL} SELECT year(dt)::INT AS y, month(dt)::INT AS m, min(dt) AS first_day FROM panel WHERE month(dt) IN (1, 7) GROUP BY 1, 2")
def cal_rebalance_dates(spark, d):
    return src.panel(spark, d).where(F.month("dt").isin(1, 7)).groupBy(F.year("dt").alias("y"), F.month("dt").alias("m")).agg(F.min("dt").alias("first_day"))


@query(f"WITH {PANEL}, x AS (SELECT min(dt) AS test_start FROM panel WHERE month(dt) IN (1, 7) GROUP BY year(dt), month(dt)) SELECT test_start, test_start - 1 AS train_end, coalesce(lead(test_start) OVER (ORDER BY test_start) - 1, (SELECT max(dt) FROM panel)) AS test_end FROM x")
def cal_refit_blocks(spark, d):
    p = src.panel(spark, d)
    x = cal_rebalance_dates(spark, d).select(F.col("first_day").alias("test_start"))
    end = p.agg(F.max("dt").alias("end"))
    return x.crossJoin(F.broadcast(end)).select("test_start", F.date_sub("test_start", 1).alias("train_end"), F.coalesce(F.date_sub(F.lead("test_start").over(Window.orderBy("test_start")), 1), "end").alias("test_end"))


@query(f"WITH {PANEL}, x AS (SELECT min(dt) AS rebal FROM panel WHERE month(dt) IN (1, 7) GROUP BY year(dt), month(dt)) SELECT asset, rebal, count(*) AS n, round(avg(er), 8) AS mean FROM x JOIN panel ON dt >= rebal - INTERVAL 2 YEAR AND dt < rebal GROUP BY 1, 2 HAVING count(*) >= 100")
def cal_training_slice(spark, d):
    x = F.broadcast(cal_rebalance_dates(spark, d).select(F.col("first_day").alias("rebal")))  # two days a year
    return src.panel(spark, d).join(x, (F.col("dt") >= F.add_months("rebal", -24)) & (F.col("dt") < F.col("rebal"))).groupBy("asset", "rebal").agg(F.count(F.lit(1)).alias("n"), r(F.avg("er")).alias("mean")).where("n >= 100")


@query(f"WITH {PANEL}, m AS (SELECT asset, last_day(dt) AS month_end, sum(er) AS s FROM panel GROUP BY 1, 2) SELECT asset, round(avg(s), 8) AS monthly FROM m GROUP BY 1")
def cal_month_end_resample(spark, d):
    return src.panel(spark, d).groupBy("asset", F.last_day("dt").alias("month_end")).agg(F.sum("er").alias("s")).groupBy("asset").agg(r(F.avg("s")).alias("monthly"))


@query(f"WITH {PANEL}, {MACRO}, c AS (SELECT DISTINCT dt FROM panel) SELECT c.dt, macro.y2, macro.vix FROM c ASOF LEFT JOIN macro ON c.dt >= macro.dt")
def aln_as_of_macro(spark, d):
    return as_of(src.panel(spark, d).select("dt").distinct(), src.macro(spark, d), "dt", ["y2", "vix"])


@query(f"WITH {PANEL}, c AS (SELECT DISTINCT dt FROM panel), a AS (SELECT DISTINCT asset FROM panel), g AS (SELECT a.asset, c.dt, er FROM a CROSS JOIN c LEFT JOIN panel USING (asset, dt)) SELECT asset, dt, coalesce(last_value(er IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 0.0) AS er FROM g")
def aln_reindex_fill(spark, d):
    p = src.panel(spark, d)
    grid = p.select("dt").distinct().crossJoin(F.broadcast(p.select("asset").distinct()))  # assets: the kinds of flag, a fixed few
    g = grid.join(p.select("asset", "dt", "er"), ["asset", "dt"], "left")
    return g.select("asset", "dt", F.coalesce(forward_fill(F.col("er"), upto(order="dt")), F.lit(0.0)).alias("er"))


# ---------------------------------------------------------------------------------------------------------------- joins and sets


@query(f"WITH {FACT} SELECT b.asset, c.config, round(avg(c.metric - b.metric), 8) AS delta FROM fact b JOIN fact c ON b.asset = c.asset AND b.seed = c.seed AND b.config = '1-URGENT' AND c.config <> '1-URGENT' GROUP BY 1, 2")
def join_baseline(spark, d):
    f = src.fact(spark, d)
    b = f.where("config = '1-URGENT'").select("asset", "seed", F.col("metric").alias("base"))
    return f.where("config <> '1-URGENT'").join(b, ["asset", "seed"]).groupBy("asset", "config").agg(r(F.avg(F.col("metric") - F.col("base"))).alias("delta"))


@query(f"WITH {FACT} SELECT a.config AS a, b.config AS b, count(*) AS n FROM (SELECT DISTINCT config FROM fact) a JOIN (SELECT DISTINCT config FROM fact) b ON a.config < b.config GROUP BY 1, 2")
def join_config_pairs(spark, d):
    c = src.fact(spark, d).select("config").distinct()
    return c.select(F.col("config").alias("a")).join(c.select(F.col("config").alias("b")), F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACT}, done AS (SELECT asset, config, seed FROM fact WHERE seed % 2 = 0 AND config <> '3-MEDIUM') SELECT asset, config, seed FROM fact WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.asset = fact.asset AND done.config = fact.config AND done.seed = fact.seed)")
def join_skip_done(spark, d):
    """The runs of a sweep that a first part of it has not done."""
    f = src.fact(spark, d)
    return sinks.pending(f.select("asset", "config", "seed"), f.where("seed % 2 = 0 AND config <> '3-MEDIUM'"), ["asset", "config", "seed"])


@query("SELECT r_name AS region, n_name AS asset FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_lookup(spark, d):
    return src.table(spark, d, "nation").join(F.broadcast(src.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("asset"))


@query(f"WITH {PANEL} SELECT dt FROM panel WHERE asset LIKE 'A%' INTERSECT SELECT dt FROM panel WHERE asset LIKE 'N%'")
def set_common_days(spark, d):
    p = src.panel(spark, d)
    return p.where("asset LIKE 'A%'").select("dt").intersect(p.where("asset LIKE 'N%'").select("dt"))


# ------------------------------------------------------------------------------------------------------------------- aggregation


@query(f"WITH {FACT} SELECT config, round(avg(metric), 8) AS mean, round(stddev_samp(metric), 8) AS sd, count(*) AS n, count(DISTINCT asset) AS assets, round(stddev_samp(metric) / abs(avg(metric)), 8) AS cv FROM fact GROUP BY 1")
def agg_config_summary(spark, d):
    m = F.col("metric")
    return src.fact(spark, d).groupBy("config").agg(r(F.avg(m)).alias("mean"), r(F.stddev_samp(m)).alias("sd"), F.count(m).alias("n"), F.countDistinct("asset").alias("assets"), r(F.try_divide(F.stddev_samp(m), F.abs(F.avg(m)))).alias("cv"))


@query(f"WITH {FACT}, m AS (SELECT config, seed, avg(metric) AS x FROM fact GROUP BY 1, 2) SELECT config, round(max(x) - min(x), 8) AS spread FROM m GROUP BY 1")
def agg_two_level_range(spark, d):
    return src.fact(spark, d).groupBy("config", "seed").agg(F.avg("metric").alias("x")).groupBy("config").agg(r(F.max("x") - F.min("x")).alias("spread"))


@query(f"WITH {FACT} SELECT asset, round(quantile_cont(metric, 0.05), 6) AS p05, round(median(metric), 6) AS p50, round(quantile_cont(metric, 0.95), 6) AS p95, arg_max(config, metric) AS best FROM fact GROUP BY 1")
def agg_quantiles_argmax(spark, d):
    return src.fact(spark, d).groupBy("asset").agg(r(F.percentile("metric", 0.05), 6).alias("p05"), r(F.median("metric"), 6).alias("p50"), r(F.percentile("metric", 0.95), 6).alias("p95"), F.max_by("config", "metric").alias("best"))


@query(f"WITH {PANEL}, n AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM panel), s AS (SELECT *, greatest(1, least(n - 1, round_even(0.6 * n, 0))) AS k FROM n) SELECT asset, round(product(1 + er), 8) AS wealth, round(product(CASE WHEN t <= k THEN 1 + er ELSE 1 END), 8) AS wealth_val, round(product(CASE WHEN t > k THEN 1 + er ELSE 1 END), 8) AS wealth_oos FROM s GROUP BY 1")
def agg_terminal_wealth(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    p = src.panel(spark, d).withColumn("n", n).withColumn("k", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(0.6 * F.col("n")))))
    g = 1 + F.col("er")
    return p.groupBy("asset").agg(r(F.product(g)).alias("wealth"), r(F.product(F.when(F.col("t") <= F.col("k"), g).otherwise(1.0))).alias("wealth_val"), r(F.product(F.when(F.col("t") > F.col("k"), g).otherwise(1.0))).alias("wealth_oos"))


@query(f"WITH {FACT}, x AS (SELECT metric, low, rank() OVER (ORDER BY metric) + (count(*) OVER (PARTITION BY metric) - 1) / 2.0 AS a, rank() OVER (ORDER BY low) + (count(*) OVER (PARTITION BY low) - 1) / 2.0 AS b FROM fact) SELECT round(corr(metric, low), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM x")
def agg_correlations(spark, d):
    x = average_rank(average_rank(src.fact(spark, d), "metric", "a"), "low", "b")
    return x.agg(r(F.corr("metric", "low")).alias("pearson"), r(F.corr("a", "b")).alias("spearman"))


@query(f"WITH {FACT} SELECT 'config' AS factor, round(sum(n * pow(m - g, 2)), 6) AS ss FROM (SELECT count(*) AS n, avg(metric) AS m, (SELECT avg(metric) FROM fact) AS g FROM fact GROUP BY config) UNION ALL SELECT 'asset', round(sum(n * pow(m - g, 2)), 6) FROM (SELECT count(*) AS n, avg(metric) AS m, (SELECT avg(metric) FROM fact) AS g FROM fact GROUP BY asset)")
def swp_between_group_squares(spark, d):
    f = src.fact(spark, d)
    grand = F.broadcast(f.agg(F.avg("metric").alias("g")))
    one = lambda c: f.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("m")).crossJoin(grand).agg(F.lit(c).alias("factor"), F.round(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)), 6).alias("ss"))
    return one("config").unionByName(one("asset"))


# ------------------------------------------------------------------------------------------------------------- windows and features


@query(f"WITH {PANEL} SELECT asset, t, round({ewm_sql('er', 5)}, 8) AS m5, round({ewm_sql('er', 21)}, 8) AS m21, round(sqrt({ewm_sql('pow(least(er, 0.0), 2)', 21)}), 8) AS dd21, round(ln(greatest(sqrt({ewm_sql('pow(least(er, 0.0), 2)', 5)}), 1e-8)), 5) AS log_dd5, round({ewm_sql('er', 21)} / greatest(sqrt({ewm_sql('pow(least(er, 0.0), 2)', 21)}), 1e-8), 4) AS sortino21 FROM panel WHERE t > 0")
def fea_return_features(spark, d):
    er = F.col("er")
    return src.panel(spark, d).select("asset", "t", r(ewm_mean(er, 5)).alias("m5"), r(ewm_mean(er, 21)).alias("m21"), r(downside(er, 21)).alias("dd21"), r(F.ln(F.greatest(downside(er, 5), F.lit(1e-8))), 5).alias("log_dd5"), r(ewm_mean(er, 21) / F.greatest(downside(er, 21), F.lit(1e-8)), 4).alias("sortino21"))


@query(f"WITH {PANEL} SELECT asset, t, CASE WHEN count(er) OVER {UP} >= 20 THEN round((er - avg(er) OVER {UP}) / greatest(stddev_samp(er) OVER {UP}, 1e-8), 6) END AS z FROM panel")
def fea_expanding_z(spark, d):
    return src.panel(spark, d).select("asset", "t", r(expanding_z(F.col("er")), 6).alias("z"))


@query(f"WITH m0 AS (SELECT * FROM ({MACRO.removeprefix('macro AS (')[:-1]})), m1 AS (SELECT *, 'm' AS asset, row_number() OVER (ORDER BY dt) AS t FROM m0), m AS (SELECT *, y2 - lag(y2) OVER (ORDER BY t) AS d2, y10 - y2 AS slope, ln(vix) - ln(lag(vix) OVER (ORDER BY t)) AS dv FROM m1) SELECT dt, round({ewm_sql('d2', 21)}, 7) AS d_y2, round({ewm_sql('slope', 10)}, 7) AS slope, round({ewm_sql('dv', 63)}, 7) AS d_log_vix FROM m")
def fea_macro_features(spark, d):
    w = Window.orderBy("dt")  # one macro calendar: a row a day
    m = src.macro(spark, d).withColumn("asset", F.lit("m")).withColumn("t", F.row_number().over(w))
    m = m.withColumn("d2", F.col("y2") - F.lag("y2").over(by())).withColumn("s", F.col("y10") - F.col("y2")).withColumn("dv", F.ln("vix") - F.lag(F.ln("vix")).over(by()))
    return m.select("dt", r(ewm_mean(F.col("d2"), 21), 7).alias("d_y2"), r(ewm_mean(F.col("s"), 10), 7).alias("slope"), r(ewm_mean(F.col("dv"), 63), 7).alias("d_log_vix"))


@query(f"WITH {PANEL}, j AS (SELECT a.asset AS a, b.asset AS b, a.dt, a.er AS x, b.er AS y FROM panel a JOIN panel b ON a.dt = b.dt AND a.asset < b.asset) SELECT a, b, dt, CASE WHEN count(*) OVER w >= 126 THEN round(corr(x, y) OVER w, 6) END AS rho FROM j WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS 251 PRECEDING)")
def fea_rolling_correlation(spark, d):
    """A year's correlation of every pair of assets, over the days that both have."""
    p = src.panel(spark, d)
    j = p.select("dt", F.col("asset").alias("a"), F.col("er").alias("x")).join(p.select("dt", F.col("asset").alias("b"), F.col("er").alias("y")), "dt").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(-251, 0)
    rho = F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))  # null where either side does not move
    return j.select("a", "b", "dt", F.when(F.count(F.lit(1)).over(w) >= 126, r(rho, 6)).alias("rho"))


_ROLL = "(PARTITION BY asset ORDER BY t ROWS 62 PRECEDING)"


@query(f"WITH {PANEL} SELECT asset, t, CASE WHEN count(er) OVER {_ROLL} >= 63 THEN round(avg(er) OVER {_ROLL} * 252, 9) END AS ret, CASE WHEN count(er) OVER {_ROLL} >= 63 THEN round(stddev_samp(er) OVER {_ROLL} * sqrt(252), 7) END AS vol FROM panel")
def win_rolling_metrics(spark, d):
    w, er = last_rows(63), F.col("er")
    return src.panel(spark, d).select("asset", "t", full(r(F.avg(er).over(w) * 252, 9), 63, er, w).alias("ret"), full(r(F.stddev_samp(er).over(w) * F.sqrt(F.lit(252.0)), 7), 63, er, w).alias("vol"))


def _vol_sql() -> str:
    w = "(PARTITION BY asset ORDER BY b ROWS 20 PRECEDING)"
    k = repr(0.34 / (1.34 + 22 / 20))
    whole = lambda v, of: f"CASE WHEN count({of}) OVER {w} >= 21 THEN round({v}, 6) END"
    return f"""WITH {BARS}, x AS (SELECT asset, b, ln(c) - lag(ln(c)) OVER q AS cc, ln(o) - lag(ln(c)) OVER q AS ov, ln(c) - ln(o) AS oc, pow(ln(h) - ln(l), 2) / (4 * ln(2)) AS pk,
 0.5 * pow(ln(h) - ln(l), 2) - (2 * ln(2) - 1) * pow(ln(c) - ln(o), 2) AS gk, (ln(h) - ln(o)) * (ln(h) - ln(c)) + (ln(l) - ln(o)) * (ln(l) - ln(c)) AS rs FROM bars WINDOW q AS (PARTITION BY asset ORDER BY b))
 SELECT asset, b, {whole(f'var_samp(cc) OVER {w}', 'cc')} AS cc, {whole(f'avg(pk) OVER {w}', 'pk')} AS parkinson, {whole(f'avg(gk) OVER {w}', 'gk')} AS gk, {whole(f'avg(rs) OVER {w}', 'rs')} AS rs,
 {whole(f'var_samp(ov) OVER {w} + {k} * var_samp(oc) OVER {w} + (1 - {k}) * avg(rs) OVER {w}', 'ov')} AS yz FROM x"""


@query(_vol_sql())
def vol_estimators(spark, d):
    e = volatility.estimators(src.bars(spark, d))
    return e.select("asset", "b", *[r(F.col(c), 6).alias(c) for c in ("cc", "parkinson", "gk", "rs", "yz")])


_LBL = f"lbl AS (SELECT asset, dt, t, er, CASE WHEN round({ewm_sql('er', 63)}, 9) < 0 THEN 1 ELSE 0 END AS y, CASE WHEN round({ewm_sql('er', 10)}, 9) < 0 THEN 1 ELSE 0 END AS yhat FROM panel)"


def labels(spark, d) -> DataFrame:
    sign = lambda hl: F.when(F.round(ewm_mean(F.col("er"), hl), 9) < 0, 1).otherwise(0)
    return src.panel(spark, d).select("asset", "dt", "t", "er", sign(63).alias("y"), sign(10).alias("yhat"))


_RUNS = "runs AS (SELECT *, sum(ch) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY asset ORDER BY t) THEN 0 ELSE 1 END AS ch FROM lbl))"


@query(f"WITH {PANEL}, {_LBL}, {_RUNS}, s AS (SELECT asset, run, min(y) AS y, count(*) AS n FROM runs GROUP BY 1, 2) SELECT asset, round(avg(n), 6) AS mean_run, round(avg(CASE WHEN y = 1 THEN n END), 6) AS mean_bear_run FROM s GROUP BY 1")
def win_mean_run_length(spark, d):
    s = islands(labels(spark, d), "y").groupBy("asset", "run").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("asset").agg(r(F.avg("n"), 6).alias("mean_run"), r(F.avg(F.when(F.col("y") == 1, F.col("n"))), 6).alias("mean_bear_run"))


@query(f"WITH {PANEL}, {_LBL}, {_RUNS} SELECT asset, min(dt) AS bear_start, max(dt) AS bear_end FROM runs WHERE y = 1 GROUP BY asset, run")
def win_bear_intervals(spark, d):
    return islands(labels(spark, d), "y").where("y = 1").groupBy("asset", "run").agg(F.min("dt").alias("bear_start"), F.max("dt").alias("bear_end")).drop("run")


#: The configurations of fact, and their names as columns.
CONFIGS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
_IN = ", ".join(f"'{c}'" for c in CONFIGS)


@query(f"WITH {FACT}, p AS (PIVOT (SELECT asset, config, metric, low FROM fact) ON config IN ({_IN}) USING round(avg(metric), 7) AS mean, round(stddev_samp(low), 7) AS sd GROUP BY asset) SELECT asset, " + ", ".join(f'"{c}_mean" AS {n}_mean, "{c}_sd" AS {n}_sd' for c, n in CONFIGS.items()) + " FROM p")
def piv_config_wide(spark, d):
    """Mean and deviation of every configuration side by side."""
    w = src.fact(spark, d).groupBy("asset").pivot("config", list(CONFIGS)).agg(r(F.avg("metric"), 7).alias("mean"), r(F.stddev_samp("low"), 7).alias("sd"))
    return w.select("asset", *[F.col(f"`{c}_{k}`").alias(f"{n}_{k}") for c, n in CONFIGS.items() for k in ("mean", "sd")])


@query(f"WITH {FACT}, m AS (SELECT config, asset, round(avg(metric), 10) AS m, round(avg(low), 10) AS low FROM fact GROUP BY 1, 2) SELECT asset, config, m FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY m DESC, low DESC, config) AS k FROM m) WHERE k = 1")
def srt_argmax_tie_break(spark, d):
    m = src.fact(spark, d).groupBy("config", "asset").agg(r(F.avg("metric"), 10).alias("m"), r(F.avg("low"), 10).alias("low"))
    k = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("m"), F.desc("low"), "config"))
    return m.withColumn("k", k).where("k = 1").select("asset", "config", "m")


@query(f"WITH {PANEL}, {_LBL}, c AS (SELECT asset, count(*) FILTER (y <> p) AS changes FROM (SELECT asset, y, lag(y) OVER (PARTITION BY asset ORDER BY t) AS p FROM lbl) GROUP BY 1), g AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE pow(10, -1 + 3 * (i - 1) / 29.0) END AS penalty FROM (SELECT unnest(range(31))::INT AS i)) SELECT asset, i, round(penalty, 9) AS penalty, round(penalty * changes, 6) AS cost FROM c CROSS JOIN g")
def scl_penalty_grid(spark, d):
    """The grid of penalties, and what the changes of each asset's slow rule would cost under each."""
    before = F.lag("y").over(by())
    changes = labels(spark, d).withColumn("p", before).groupBy("asset").agg(F.count(F.when(F.col("y") != F.col("p"), 1)).alias("changes"))
    g = changes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(30))))
    g = g.withColumn("penalty", F.when(F.col("i") == 0, 0.0).otherwise(F.pow(F.lit(10.0), -1 + 3 * (F.col("i") - 1) / 29)))
    return g.select("asset", "i", r(F.col("penalty"), 9).alias("penalty"), r(F.col("penalty") * F.col("changes"), 6).alias("cost"))


# --------------------------------------------------------------------------------------------------------------- metrics, diagnosis


_PERF = f"""WITH {PANEL}, w AS (SELECT asset, t, er, product(1 + er) OVER {UP} AS wealth FROM panel), k AS (SELECT *, max(wealth) OVER {UP} AS peak FROM w)
SELECT asset, round(avg(er) * 252, 7) AS ann_ret, round(stddev_samp(er) * sqrt(252), 7) AS ann_vol, round(avg(er) / stddev_samp(er) * sqrt(252), 6) AS sharpe, round(min(wealth / peak - 1), 7) AS mdd, round(min(wealth / greatest(peak, 1) - 1), 7) AS mdd_from_one,
round(avg(er) * 252 / sqrt(avg(pow(least(er, 0), 2)) * 252), 6) AS sortino FROM k GROUP BY 1"""


@query(_PERF)
def bkt_performance(spark, d):
    er = F.col("er")
    k = src.panel(spark, d).withColumn("wealth", F.product(1 + er).over(upto())).withColumn("peak", F.max("wealth").over(upto()))
    return k.groupBy("asset").agg(
        r(F.avg(er) * 252, 7).alias("ann_ret"), r(F.stddev_samp(er) * F.sqrt(F.lit(252.0)), 7).alias("ann_vol"), r(F.avg(er) / F.stddev_samp(er) * F.sqrt(F.lit(252.0)), 6).alias("sharpe"), r(F.min(F.col("wealth") / F.col("peak") - 1), 7).alias("mdd"),
        r(F.min(F.col("wealth") / F.greatest("peak", F.lit(1.0)) - 1), 7).alias("mdd_from_one"), r(F.avg(er) * 252 / F.sqrt(F.avg(F.pow(F.least(er, F.lit(0.0)), 2)) * 252), 6).alias("sortino"),
    )


@query(f"WITH {PANEL}, {_LBL}, p AS (SELECT *, CAST(1 - yhat AS DOUBLE) AS pos FROM lbl), n AS (SELECT asset, t, pos * er - abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) * 0.0005 * 2 AS net FROM p) SELECT asset, round(sum(net), 7) AS total, round(product(1 + net), 7) AS wealth FROM n GROUP BY 1")
def prt_single_asset_rule(spark, d):
    n = portfolio.single_asset_rule(labels(spark, d), "yhat", "er", risk=10.0, trade=1.0)
    return n.groupBy("asset").agg(r(F.sum("net"), 7).alias("total"), r(F.product(1 + F.col("net")), 7).alias("wealth"))


@query(f"WITH {PANEL}, {_LBL}, w AS (SELECT *, sum(1 - y) OVER (PARTITION BY dt) AS bulls FROM lbl) SELECT asset, dt, CASE WHEN bulls >= 4 AND y = 0 THEN round(1.0 / bulls, 9) ELSE 0 END AS w FROM w")
def prt_regime_equal_weight(spark, d):
    return labels(spark, d).select("asset", "dt", r(portfolio.regime_equal_weight("y"), 9).alias("w"))


def _cov_sql() -> str:
    return f"""WITH {PANEL}, cal AS (SELECT dt, row_number() OVER (ORDER BY dt DESC) - 1 AS age FROM (SELECT DISTINCT dt FROM panel)), d AS (SELECT asset, dt, er, pow(2.0, -age / 252.0) AS w FROM panel JOIN cal USING (dt)),
 s AS (SELECT p.asset AS a, q.asset AS b, sum(p.w) AS s, sum(p.w * p.w) AS s2, sum(p.w * p.er) AS sx, sum(p.w * q.er) AS sy, sum(p.w * p.er * q.er) AS sxy FROM d p JOIN d q USING (dt) GROUP BY 1, 2)
 SELECT a, b, round((sxy / s - sx * sy / pow(s, 2)) / (1 - s2 / pow(s, 2)), 11) AS cov FROM s"""


@query(_cov_sql())
def prt_ewm_covariance(spark, d):
    return portfolio.ewm_covariance(src.panel(spark, d)).select("a", "b", r(F.col("cov"), 11).alias("cov"))


@query()
def prt_min_variance(spark, d):
    """Weights of the minimum-variance programme at the last day."""
    cov = portfolio.ewm_covariance(src.panel(spark, d)).withColumn("g", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        m = s.fillna(0.0).to_numpy()
        m = (m + m.T) / 2
        val, vec = np.linalg.eigh(m)
        m = (vec * np.maximum(val, max(1e-8, 1e-12 * abs(val).max()))) @ vec.T
        return pd.DataFrame({"asset": s.index, "w": portfolio.optimise(np.full(len(m), 1e-3), m, np.full(len(m), 1 / len(m)), 10.0, 0.0)})

    return cov.groupBy("g").applyInPandas(solve, "asset string, w double")  # one row a pair of assets


@query(f"WITH {PANEL}, {_LBL}, c AS (SELECT asset, avg(CAST(y = yhat AS INT)) AS acc, avg(CASE WHEN y = 0 THEN CAST(yhat = 0 AS INT) END) AS a0, avg(CASE WHEN y = 1 THEN CAST(yhat = 1 AS INT) END) AS a1, sum(y * yhat) AS tp, sum((1 - y) * yhat) AS fp, sum(y * (1 - yhat)) AS fn FROM lbl GROUP BY 1) SELECT asset, round(acc, 7) AS acc, round((a0 + a1) / 2, 7) AS balanced, round(2 * tp / (2 * tp + fp + fn), 7) AS f1 FROM c")
def dgn_state_classification(spark, d):
    y, p = F.col("y"), F.col("yhat")
    hit = F.when(y == p, 1.0).otherwise(0.0)
    balanced = (F.avg(F.when(y == 0, hit)) + F.avg(F.when(y == 1, hit))) / 2
    tp, wrong = F.sum(y * p), F.sum((1 - y) * p) + F.sum(y * (1 - p))
    return labels(spark, d).groupBy("asset").agg(r(F.avg(hit), 7).alias("acc"), r(balanced, 7).alias("balanced"), r(2 * tp / (2 * tp + wrong), 7).alias("f1"))


@query(f"WITH {PANEL}, {_LBL}, x AS (SELECT *, lag(y) OVER (PARTITION BY asset ORDER BY t) AS py, min(CASE WHEN yhat = 0 THEN t END) OVER f AS n0, min(CASE WHEN yhat = 1 THEN t END) OVER f AS n1 FROM lbl WINDOW f AS (PARTITION BY asset ORDER BY t ROWS BETWEEN CURRENT ROW AND 125 FOLLOWING)) SELECT asset, round(avg(coalesce(CASE WHEN y = 0 THEN n0 ELSE n1 END - t, 126)), 6) AS add_days, round(avg(CASE WHEN (CASE WHEN y = 0 THEN n0 ELSE n1 END) IS NULL THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM x WHERE py IS NOT NULL AND py <> y GROUP BY 1")
def dgn_detection_delay(spark, d):
    ahead = by().rowsBetween(0, 125)
    nxt = lambda s: F.min(F.when(F.col("yhat") == s, F.col("t"))).over(ahead)
    x = labels(spark, d).withColumn("py", F.lag("y").over(by())).withColumn("hit", F.when(F.col("y") == 0, nxt(0)).otherwise(nxt(1))).where("py IS NOT NULL AND py <> y")
    return x.groupBy("asset").agg(r(F.avg(F.coalesce(F.col("hit") - F.col("t"), F.lit(126))), 6).alias("add_days"), r(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)), 6).alias("miss_rate"))


@query(f"WITH {PANEL}, {_LBL}, c AS (SELECT asset, y, yhat, count(*) AS n FROM lbl GROUP BY 1, 2, 3), i AS (SELECT asset, sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c GROUP BY 1), a AS (SELECT asset, sum(n * (n - 1) / 2.0) AS s FROM (SELECT asset, y, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), b AS (SELECT asset, sum(n * (n - 1) / 2.0) AS s FROM (SELECT asset, yhat, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1) SELECT asset, round((i.s - a.s * b.s / (n * (n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (n * (n - 1) / 2.0)), 7) AS ari FROM i JOIN a USING (asset) JOIN b USING (asset)")
def dgn_adjusted_rand(spark, d):
    c = labels(spark, d).groupBy("asset", "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2.0
    i = c.groupBy("asset").agg(F.sum(pairs(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    side = lambda k, name: c.groupBy("asset", k).agg(F.sum("n").alias("m")).groupBy("asset").agg(F.sum(pairs(F.col("m"))).alias(name))
    x = i.join(side("y", "a"), "asset").join(side("yhat", "b"), "asset")
    chance = F.col("a") * F.col("b") / pairs(F.col("n"))
    return x.select("asset", r((F.col("i") - chance) / ((F.col("a") + F.col("b")) / 2 - chance), 7).alias("ari"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), g AS (SELECT k, avg(x) AS m FROM e GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
w AS (SELECT sum(pow(x - m, 2)) AS ssw FROM e JOIN c USING (label, k)), b AS (SELECT sum(n * pow(c.m - g.m, 2)) AS ssb FROM c JOIN g USING (k) JOIN n USING (label))
SELECT round((ssb / ((SELECT count(*) FROM n) - 1)) / (ssw / ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM n))), 4) AS calinski_harabasz FROM w, b""")
def stb_calinski_harabasz(spark, d):
    v = src.table(spark, d, "embeddings")
    e = v.select("vec_id", "label", F.posexplode("embedding").alias("k", "f")).withColumn("x", F.col("f").cast("double"))
    c = e.groupBy("label", "k").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop("x") * F.count(F.lit(1))).alias("ssw"))
    c = c.withColumn("_ss", F.col("ssw"))
    g = c.groupBy("k").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    s = c.join(F.broadcast(g), "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum("_ss").alias("w"), F.countDistinct("label").alias("q"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("n"))
    return s.select(r((F.col("b") / (F.col("q") - 1)) / (F.col("w") / (F.col("n") - F.col("q"))), 4).alias("calinski_harabasz"))


@query()
def jmp_regimes(spark, d):
    """Two regimes of each asset by the jump model on two features."""
    p = src.panel(spark, d)
    f = p.select("asset", "t", "er", (expanding_z(F.col("er"))).alias("z"), (ewm_mean(F.col("er"), 21) * 1000).alias("m"))
    return jump_model.regimes(f, ["z", "m"], penalty=10.0)


@query()
def sta_friedman(spark, d):
    """Friedman's chi-square over configs, assets as blocks: ranks by a window, the tail by the helper on one row."""
    m = src.fact(spark, d).groupBy("asset", "config").agg(F.avg("metric").alias("m"))
    w = Window.partitionBy("asset")
    ranked = m.withColumn("rk", F.rank().over(w.orderBy("m")) + (F.count(F.lit(1)).over(Window.partitionBy("asset", "m")) - 1) / 2)
    s = ranked.groupBy("config").agg(F.sum("rk").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    x = s.select("k", "n", (12 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("q") - 3 * F.col("n") * (F.col("k") + 1)).alias("chi2"))

    def tail(batches):
        for b in batches:
            yield b.assign(p=[inference.chi2_tail(c, k - 1) for c, k in zip(b.chi2, b.k, strict=True)])

    return x.mapInPandas(tail, "k long, n long, chi2 double, p double")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import studies  # noqa: E402,F401  its queries join the registry above
from . import research  # noqa: E402,F401
