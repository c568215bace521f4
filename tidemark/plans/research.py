"""Queries of the walk-forward framework, strategies, sweeps, refits and preparation, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, inference, scan
from ..functions.series import as_of, by, ewm_mean, forward_fill, upto
from ..operators import backtest, covariance, diagnostics, forecast, framework, jump_model, main_run, preparation, stability, strategies, sweep, trend, volatility
from ..sources import sinks
from ..sources import tables as src
from .queries import _LBL, BARS, FACT, MACRO, PANEL, UP, ewm_sql, labels, query, r
from .studies import _GRID, _TARGETS, BY, features, grid, per_asset, rank_sql, targets

ON_DAY = "(PARTITION BY asset ORDER BY dt)"
UP_DAY = "(PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING)"
#: The assets that stand for stock and bond, and the one without downside features.
STOCK, BOND, NO_DOWNSIDE = "AF", "RF", ("RO",)


# ------------------------------------------------------------------------------------------------------------------------- calendars


@query(f"WITH {PANEL}, f AS (SELECT * FROM (VALUES ('monthly', range(1, 13)), ('quarterly', [1, 4, 7, 10]), ('semi-annual', [1, 7]), ('annual', [1])) v(frequency, months)) SELECT frequency, min(dt) AS rebal FROM panel JOIN f ON list_contains(months, month(dt)) GROUP BY frequency, year(dt), month(dt)")
def cal_frequencies(spark, d):
    """First trading days of the months of every frequency."""
    p = src.panel(spark, d).select("dt").distinct().select("dt", F.explode(calendar.frequencies()).alias("frequency", "months")).where(F.array_contains("months", F.month("dt")))
    return p.groupBy("frequency", F.year("dt"), F.month("dt")).agg(F.min("dt").alias("rebal")).select("frequency", "rebal")


_REBAL = "rb AS (SELECT min(dt) AS rebal FROM panel WHERE month(dt) IN (1, 7) GROUP BY year(dt), month(dt))"
_KINDS = {"rolling": "dt >= rebal - INTERVAL 3 YEAR AND dt < rebal", "expanding": "dt < rebal", "last": "dt < rebal", "trailing": "dt >= rebal - 370 AND dt <= rebal"}


@query(f"WITH {PANEL}, {_REBAL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, asset, rebal, count(*) AS n, min(dt) AS first_day, round(avg(er), 8) AS mean FROM (SELECT * FROM panel JOIN rb ON {c}{' QUALIFY row_number() OVER (PARTITION BY asset, rebal ORDER BY dt DESC) <= 1260' if k == 'last' else ''}) GROUP BY asset, rebal HAVING count(*) >= {100 if k == 'trailing' else 252}" for k, c in _KINDS.items()))
def cal_training_windows(spark, d):
    """The four kinds of training window at every half-yearly rebalance day."""
    p = src.panel(spark, d)
    rebal = calendar.rebalance_days(p.select("dt").distinct())
    out = None
    for kind in _KINDS:
        x = calendar.training_rows(p, rebal, kind, years=3, least=100 if kind == "trailing" else 252)
        x = x.groupBy("asset", "rebal").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_day"), r(F.avg("er")).alias("mean")).select(F.lit(kind).alias("kind"), "asset", "rebal", "n", "first_day", "mean")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"WITH {PANEL}, {_REBAL} SELECT rebal, CAST(rebal - INTERVAL 5 YEAR AS DATE) AS val_start, rebal - 1 AS val_end, rebal AS block_start, coalesce(lead(rebal) OVER (ORDER BY rebal) - 1, (SELECT max(dt) FROM panel)) AS block_end FROM rb")
def cal_validation_blocks(spark, d):
    return calendar.validation_blocks(src.panel(spark, d).select("dt").distinct())


@query(f"WITH {PANEL}, q AS (SELECT min(dt) AS test_start FROM panel WHERE month(dt) IN (1, 4, 7, 10) GROUP BY year(dt), month(dt)) SELECT test_start, test_start - 1 AS train_end, coalesce(lead(test_start) OVER (ORDER BY test_start) - 1, (SELECT max(dt) FROM panel)) AS test_end FROM q")
def cal_blocks_by_table_function(spark, d):
    """Quarterly refit blocks by a table function in SQL, from the calendar as one array (a row a day)."""
    calendar.register_refit_blocks(spark, "refit_blocks")
    days = src.panel(spark, d).agg(F.array_sort(F.collect_set("dt")).alias("days")).withColumn("months", F.array(*[F.lit(m) for m in calendar.months_of("quarterly")]))
    return spark.sql("SELECT b.test_start, b.train_end, b.test_end FROM {c} AS c, LATERAL refit_blocks(c.days, c.months) AS b", c=days)


@query(f"WITH {PANEL}, {_LBL}, {_GRID} SELECT asset, min(dt) FILTER (er IS NOT NULL) AS first, count(er) AS n FROM grid WHERE dt >= (SELECT min(dt) FROM grid WHERE er IS NOT NULL) GROUP BY 1")
def agg_first_valid(spark, d):
    g = grid(spark, d)
    return preparation.first_valid(g, "er").join(g.groupBy("asset").agg(F.count("er").alias("n")), "asset")


# ----------------------------------------------------------------------------------------------------------------------- preparation


_PRICES = f"prices AS (SELECT asset, dt, round(100 * exp(sum(ln(1 + er)) OVER {UP}), 8) AS px FROM panel)"
_ONGRID = "pg AS (SELECT a.asset, c.dt, px FROM (SELECT DISTINCT asset FROM prices) a CROSS JOIN (SELECT DISTINCT dt FROM prices) c LEFT JOIN prices USING (asset, dt))"
_RATE = "rate AS (SELECT c.dt, coalesce(macro.rf, 0) / 100 / 252 AS rf FROM (SELECT DISTINCT dt FROM panel) c ASOF LEFT JOIN macro ON c.dt >= macro.dt)"


def prices(spark, d) -> DataFrame:
    return src.prices(spark, d).select("asset", "dt", F.round("px", 8).alias("px"))


@query(f"""WITH {PANEL}, {MACRO}, {_PRICES}, {_ONGRID}, {_RATE}, x AS (SELECT asset, dt, exp(ln(px) - ln(lag(px) OVER {ON_DAY})) - 1 AS ret FROM pg), y AS (SELECT asset, dt, ret, rf, ret - rf AS e FROM x JOIN rate USING (dt))
 SELECT asset, dt, round(ret, 8) AS ret, round(coalesce(last_value(e IGNORE NULLS) OVER {UP_DAY}, 0), 8) AS er, round(rf, 11) AS rf FROM y WHERE dt >= (SELECT min(dt) FROM y WHERE e IS NOT NULL)""")
def fea_prepare(spark, d):
    """Prices and rates to returns, the rate of a day and excess returns, on the whole calendar."""
    x = preparation.prepare(prices(spark, d), src.macro(spark, d))
    return x.select("asset", "dt", r(F.col("ret")).alias("ret"), r(F.col("er")).alias("er"), r(F.col("rf"), 11).alias("rf"))


@query(f"WITH {PANEL}, {_PRICES}, {_ONGRID}, f AS (SELECT asset, dt, last_value(px IGNORE NULLS) OVER {UP_DAY} AS px FROM pg), x AS (SELECT asset, dt, px / lag(px) OVER {ON_DAY} - 1 AS c FROM f) SELECT asset, dt, round(last_value(c IGNORE NULLS) OVER {UP_DAY}, 8) AS change FROM x")
def fea_percent_changes(spark, d):
    return preparation.percent_changes(preparation.on_calendar(prices(spark, d))).select("asset", "dt", r(F.col("change")).alias("change"))


_DD, _MEAN = (lambda h: f"sqrt({ewm_sql('pow(least(er, 0.0), 2)', h)})"), (lambda h: ewm_sql("er", h))
_RAW = f"raw AS (SELECT asset, dt, t, er, " + ", ".join([f"ln(greatest({_DD(h)}, 1e-8)) AS log_dd_hl{h}" for h in (5, 21)] + [f"{_MEAN(h)} AS avg_ret_hl{h}" for h in (5, 10, 21)] + [f"{_MEAN(h)} / greatest({_DD(h)}, 1e-8) AS sortino_hl{h}" for h in (5, 10, 21)]) + " FROM panel)"
_Z = lambda c: f"CASE WHEN count({c}) OVER {UP} >= 20 THEN ({c} - avg({c}) OVER {UP}) / greatest(stddev_samp({c}) OVER {UP}, 1e-8) END"
_ZS = "zs AS (SELECT asset, dt, t, er, " + ", ".join(f"{_Z(c)} AS {c}" for c in preparation.feature_columns()) + " FROM raw)"


@query(f"WITH {PANEL}, {_RAW}, {_ZS} SELECT asset, t, " + ", ".join((f"CASE WHEN asset <> 'RO' THEN round({c}, 5) END AS {c}" if c.startswith("log") else f"round({c}, 5) AS {c}") for c in preparation.feature_columns()) + " FROM zs")
def fea_return_set(spark, d):
    """The eight return features for clustering; one asset has none of the downside ones."""
    x = preparation.FEATURE_SETS["returns"](src.panel(spark, d), True, NO_DOWNSIDE)
    return x.select("asset", "t", *[r(F.col(c), 5).alias(c) for c in preparation.feature_columns()])


_M_UP = "(ORDER BY t ROWS UNBOUNDED PRECEDING)"
_M_EWM = lambda c, h: ewm_sql(c, h).replace(UP, _M_UP)
_MACROS = f"""mc AS (SELECT *, row_number() OVER (ORDER BY dt) AS t FROM (SELECT c.dt, last_value(y2 IGNORE NULLS) OVER o AS y2, last_value(y10 IGNORE NULLS) OVER o AS y10, last_value(vix IGNORE NULLS) OVER o AS vix FROM (SELECT DISTINCT dt FROM panel) c ASOF LEFT JOIN macro ON c.dt >= macro.dt WINDOW o AS (ORDER BY c.dt ROWS UNBOUNDED PRECEDING))),
 md AS (SELECT *, y2 - lag(y2) OVER w AS dy, y10 - y2 AS slope, (y10 - y2) - lag(y10 - y2) OVER w AS ds, ln(greatest(vix, 1e-8)) - lag(ln(greatest(vix, 1e-8))) OVER w AS dv FROM mc WINDOW w AS (ORDER BY t)),
 sb AS (SELECT mc.dt, s.er AS s, b.er AS b FROM mc LEFT JOIN panel s ON s.dt = mc.dt AND s.asset = '{STOCK}' LEFT JOIN panel b ON b.dt = mc.dt AND b.asset = '{BOND}'),
 cr AS (SELECT dt, CASE WHEN count(s + b) OVER w >= 126 THEN corr(s, b) OVER w END AS stock_bond_corr FROM sb WINDOW w AS (ORDER BY dt ROWS 251 PRECEDING)),
 mf AS (SELECT dt, {_M_EWM('dy', 21)} AS y2_diff_ewma, {_M_EWM('slope', 10)} AS slope_ewma, {_M_EWM('ds', 21)} AS slope_diff_ewma, {_M_EWM('dv', 63)} AS vix_logdiff_ewma, stock_bond_corr FROM md JOIN cr USING (dt))"""


def macro_set(spark, d) -> DataFrame:
    p = src.panel(spark, d)
    return preparation.macro_features(src.macro(spark, d), p.select("dt").distinct(), p.where(F.col("asset") == STOCK), p.where(F.col("asset") == BOND))


@query(f"WITH {PANEL}, {MACRO}, {_MACROS} SELECT dt, " + ", ".join(f"round({c}, 6) AS {c}" for c in preparation.MACRO_FEATURES) + " FROM mf")
def fea_macro_set(spark, d):
    return macro_set(spark, d).select("dt", *[r(F.col(c), 6).alias(c) for c in preparation.MACRO_FEATURES])


_ALL_FEATURES = [*preparation.feature_columns(), *preparation.MACRO_FEATURES]


def matrix(spark, d) -> DataFrame:
    return preparation.classifier_matrix(src.panel(spark, d), macro_set(spark, d))


@query(f"WITH {PANEL}, {MACRO}, {_RAW}, {_ZS}, {_MACROS} SELECT asset, dt, " + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER {UP}, 5) AS {c}" for c in _ALL_FEATURES) + " FROM zs LEFT JOIN mf USING (dt)")
def fea_classifier_matrix(spark, d):
    """The classifier's thirteen columns, filled forward."""
    return matrix(spark, d).select("asset", "dt", *[r(F.col(c), 5).alias(c) for c in _ALL_FEATURES])


def ready(spark, d) -> DataFrame:
    """(asset, dt, t, er) on the whole calendar, as prepare() makes it of prices and rates: what models read."""
    x = preparation.prepare(prices(spark, d), src.macro(spark, d))
    return x.select("asset", "dt", "er", F.row_number().over(by(order="dt")).alias("t"))


def model_macro(spark, d, p: DataFrame) -> DataFrame:
    return preparation.macro_features(src.macro(spark, d), p.select("dt").distinct(), p.where(F.col("asset") == STOCK), p.where(F.col("asset") == BOND))


def with_volatilities(p: DataFrame, features: DataFrame) -> DataFrame:
    """features with vol_<estimator> of bars made from the returns of p, filled forward and then back."""
    k = p.withColumn("w", F.product(1 + F.col("er")).over(upto()))
    bars = k.select("asset", F.col("t").alias("b"), F.coalesce(F.lag("w").over(by()), "w").alias("o"), (F.col("w") * 1.001).alias("h"), (F.col("w") * 0.999).alias("l"), F.col("w").alias("c"))
    x = features.join(volatility.estimators(bars).withColumnRenamed("b", "t"), ["asset", "t"], "left")
    ahead = by().rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(forward_fill(F.col(c), upto()), F.first(c, ignorenulls=True).over(ahead))
    return x.select("asset", "dt", "t", "er", *_ALL_FEATURES, *[fill(c).alias(f"vol_{name}") for name, c in sweep.VOLATILITY_COLUMNS.items()])


def clustering(p: DataFrame, macro: DataFrame) -> DataFrame:
    """(asset, dt, t, er, return and macro features, vol_<estimator>): what the sweep's fits read."""
    x = preparation.return_features(p, True, NO_DOWNSIDE).join(macro, "dt", "left")
    x = x.select("asset", "dt", "t", "er", *[forward_fill(F.col(c), upto()).alias(c) for c in _ALL_FEATURES])
    return with_volatilities(p, x)


_OHLC = f"oh AS (SELECT asset, t, dt, coalesce(lag(w) OVER {BY}, w) AS o, w * 1.001 AS h, w * 0.999 AS l, w AS c FROM (SELECT *, product(1 + er) OVER {UP} AS w FROM panel))"


@query(f"""WITH {PANEL}, {MACRO}, {_RAW}, {_ZS}, {_MACROS}, {_OHLC}, lc AS (SELECT asset, t, ln(c) - lag(ln(c)) OVER {BY} AS x FROM oh), v0 AS (SELECT asset, t, CASE WHEN count(x) OVER w >= 21 THEN var_samp(x) OVER w END AS v FROM lc WINDOW w AS (PARTITION BY asset ORDER BY t ROWS 20 PRECEDING)),
 v AS (SELECT asset, t, coalesce(last_value(v IGNORE NULLS) OVER {UP}, first_value(v IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol FROM v0),
 f AS (SELECT asset, t, {', '.join(f'last_value({c} IGNORE NULLS) OVER {UP} AS {c}' for c in _ALL_FEATURES)} FROM zs LEFT JOIN mf USING (dt)), j AS (SELECT * FROM f JOIN v USING (asset, t))
 SELECT k.kind, asset, CASE k.kind WHEN 'minimal' THEN 3 ELSE CASE WHEN asset = 'RO' THEN 12 ELSE 14 END END AS n_columns, count(*) FILTER (avg_ret_hl21 IS NOT NULL AND (k.kind = 'minimal' OR (sortino_hl5 + {' + '.join(preparation.MACRO_FEATURES)} + vol) IS NOT NULL)) AS n_rows, round(sum(vol), 9) AS vol
 FROM j CROSS JOIN (SELECT unnest(['minimal', 'standard', 'extended', 'kitchen_sink']) AS kind) k GROUP BY ALL""")
def fea_clustering_sets(spark, d):
    """Columns and complete rows of every clustering set in every asset."""
    x, out = clustering(src.panel(spark, d), macro_set(spark, d)).withColumn("vol", F.col("vol_close_to_close")), None
    for kind in preparation.CLUSTERING_SETS:
        whole, part = preparation.clustering_features(kind), preparation.clustering_features(kind, False)
        rows = lambda names: F.count(F.when(~F.greatest(*[F.col(c).isNull() for c in names]), 1))
        bare = F.col("asset").isin(*NO_DOWNSIDE)
        one = x.groupBy("asset").agg(F.max(F.when(bare, len(part)).otherwise(len(whole))).alias("n_columns"), F.when(F.max(bare), rows(part)).otherwise(rows(whole)).alias("n_rows"), r(F.sum("vol"), 9).alias("vol"))
        one = one.select(F.lit(kind).alias("kind"), "asset", "n_columns", "n_rows", "vol")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {BARS}, x AS (SELECT asset, b, ln(c) - lag(ln(c)) OVER (PARTITION BY asset ORDER BY b) AS cc, pow(ln(h) - ln(l), 2) / (4 * ln(2)) AS pk FROM bars), v AS (SELECT asset, b, CASE WHEN count(cc) OVER w >= 21 THEN var_samp(cc) OVER w END AS cc, CASE WHEN count(pk) OVER w >= 21 THEN avg(pk) OVER w END AS pk FROM x WINDOW w AS (PARTITION BY asset ORDER BY b ROWS 20 PRECEDING))
 SELECT asset, b, CASE WHEN cc > 0 THEN round(sqrt(cc * 252), 6) END AS close_to_close, CASE WHEN pk > 0 THEN round(sqrt(pk * 252), 6) END AS parkinson FROM v""")
def vol_annualised(spark, d):
    e = volatility.estimators(src.bars(spark, d))
    return e.select("asset", "b", r(volatility.annualised("cc"), 6).alias("close_to_close"), r(volatility.annualised("parkinson"), 6).alias("parkinson"))


_W63 = "(PARTITION BY asset ORDER BY t ROWS 62 PRECEDING)"


@query(f"""WITH {PANEL}, m AS (SELECT asset, t, count(er) OVER {_W63} AS n, avg(er) OVER {_W63} * 252 AS ret, stddev_samp(er) OVER {_W63} * sqrt(252) AS vol, sqrt(avg(pow(least(er, 0), 2)) OVER {_W63}) * sqrt(252) AS dn FROM panel)
 SELECT asset, t, CASE WHEN n >= 63 THEN round(ret / greatest(vol, 1e-10), 5) END AS sharpe, CASE WHEN n >= 63 THEN round(ret / greatest(dn, 1e-10), 5) END AS sortino FROM m""")
def win_rolling_ratios(spark, d):
    """Sharpe and Sortino ratios of the last 63 days."""
    m = volatility.rolling_ratios(src.panel(spark, d))
    return m.select("asset", "t", r(F.col("rolling_sharpe"), 5).alias("sharpe"), r(F.col("rolling_sortino"), 5).alias("sortino"))


# ------------------------------------------------------------------------------------------------- projections, filters, joins, sets


@query(f"WITH {FACT} SELECT s.statistic, round(s.value, 6) AS value FROM (SELECT unnest([{{'statistic': 'count', 'value': count(metric)}}, {{'statistic': 'mean', 'value': avg(metric)}}, {{'statistic': 'std', 'value': stddev_samp(metric)}}, {{'statistic': 'min', 'value': min(metric)}}, {{'statistic': '25%', 'value': quantile_cont(metric, 0.25)}}, {{'statistic': '50%', 'value': quantile_cont(metric, 0.5)}}, {{'statistic': '75%', 'value': quantile_cont(metric, 0.75)}}, {{'statistic': 'max', 'value': max(metric)}}]) AS s FROM fact)")
def prj_describe(spark, d):
    m = F.col("metric")
    wide = src.fact(spark, d).agg(F.count(m).cast("double").alias("count"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.percentile(m, 0.25).alias("25%"), F.percentile(m, 0.5).alias("50%"), F.percentile(m, 0.75).alias("75%"), F.max(m).alias("max"))
    return wide.unpivot([], wide.columns, "statistic", "value").withColumn("value", r(F.col("value"), 6))


@query(f"WITH {PANEL}, {_RAW} SELECT asset, t, round(avg_ret_hl5, 8) AS avg_ret_hl5, round(avg_ret_hl10, 8) AS avg_ret_hl10, round(avg_ret_hl21, 8) AS avg_ret_hl21 FROM raw")
def prj_columns_like(spark, d):
    """The columns whose name has avg_ret in it, and all but the others."""
    x = preparation.raw_return_features(src.panel(spark, d))
    return x.drop(*[c for c in x.columns if c not in ("asset", "t") and "avg_ret" not in c]).select("asset", "t", *[r(F.col(f"avg_ret_hl{h}")).alias(f"avg_ret_hl{h}") for h in (5, 10, 21)])


@query(f"WITH {PANEL}, x AS (SELECT asset, t, CASE WHEN t % 7 = 0 THEN 'NaN'::DOUBLE WHEN t % 11 = 0 THEN 'Infinity'::DOUBLE ELSE er END AS v FROM panel) SELECT asset, count(*) FILTER (isfinite(v)) AS n_finite, count(*) FILTER (NOT isnan(v)) AS n_known, round(avg(v) FILTER (isfinite(v)), 9) AS mean FROM x GROUP BY 1")
def flt_finite(spark, d):
    """Masks of finite values, and NaN as null, which means pass over."""
    v = F.when(F.col("t") % 7 == 0, float("nan")).when(F.col("t") % 11 == 0, float("inf")).otherwise(F.col("er"))
    x = src.panel(spark, d).select("asset", v.alias("v"))
    y = preparation.null_nans(x).withColumn("f", preparation.finite(F.col("v")))
    return y.groupBy("asset").agg(F.count("f").alias("n_finite"), F.count("v").alias("n_known"), r(F.avg("f"), 9).alias("mean"))


_EPISODES = [("one", "1996-03-01", "1996-12-31"), ("two", "1998-01-01", "1999-06-30"), ("three", "2000-09-01", "2001-02-28")]
_EPI = "ep AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _EPISODES) + ") v(episode, lo, hi))"


@query(f"WITH {PANEL}, {_EPI} SELECT asset, coalesce(episode, 'none') AS episode, count(*) AS n, round(avg(er), 9) AS mean FROM panel LEFT JOIN ep ON dt BETWEEN lo AND hi GROUP BY 1, 2")
def flt_episodes(spark, d):
    """Days inside episodes, both ends included; the list of episodes is broadcast."""
    e = F.broadcast(spark.createDataFrame(_EPISODES, "episode string, lo string, hi string").select("episode", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi")))
    x = src.panel(spark, d).join(e, F.col("dt").between(F.col("lo"), F.col("hi")), "left")
    return x.groupBy("asset", F.coalesce("episode", F.lit("none")).alias("episode")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("er"), 9).alias("mean"))


@query(f"WITH {FACT}, a AS (SELECT asset, round(avg(metric), 8) AS mean FROM fact GROUP BY 1), b AS (SELECT asset, round(max(low), 8) AS top FROM fact WHERE seed > 1 GROUP BY 1), c AS (SELECT asset, count(*) AS n FROM fact WHERE config = '5-LOW' GROUP BY 1), e AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.asset, mean, top, n, r_name AS region FROM a LEFT JOIN b USING (asset) LEFT JOIN c USING (asset) LEFT JOIN e ON e.n_name = a.asset")
def join_multiway(spark, d):
    """Several summaries of an asset side by side, the last by a key of another name."""
    f = src.fact(spark, d)
    e = src.table(spark, d, "nation").join(src.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("region"))
    x = f.groupBy("asset").agg(r(F.avg("metric")).alias("mean")).join(f.where("seed > 1").groupBy("asset").agg(r(F.max("low")).alias("top")), "asset", "left")
    x = x.join(f.where("config = '5-LOW'").groupBy("asset").agg(F.count(F.lit(1)).alias("n")), "asset", "left")
    return x.join(e, x["asset"] == e["n_name"], "left").drop("n_name")


_GRP = "CASE WHEN {0} < 90 THEN 'G_Q' WHEN {0} < 200 THEN 'G_S' ELSE 'G_A' END"
_ASM = f"rl AS (SELECT asset, count(*) / sum(ch) AS m FROM (SELECT *, CASE WHEN y = lag(y) OVER {BY} THEN 0 ELSE 1 END AS ch FROM lbl) GROUP BY 1), gr AS (SELECT asset, m, {_GRP.format('m * 8')} AS grp FROM rl)"


def groups(spark, d) -> DataFrame:
    """(asset, m, grp): the refit group of every asset from its mean run length (times 8, so that the panel's assets fall into more than one)."""
    runs = labels(spark, d).withColumn("ch", F.when(F.col("y") == F.lag("y").over(by()), 0).otherwise(1)).groupBy("asset").agg((F.count(F.lit(1)) / F.sum("ch")).alias("m"))
    return runs.withColumn("grp", stability.refit_group(F.col("m") * 8))


@query(f"WITH {PANEL}, {_LBL}, {_ASM}, two AS (SELECT asset, dt, 'G_Q' AS grp, yhat AS label FROM lbl UNION ALL SELECT asset, dt, 'G_S', y FROM lbl UNION ALL SELECT asset, dt, 'G_A', y FROM lbl) SELECT asset, dt, grp, label FROM two JOIN gr USING (asset, grp)")
def join_group_assembly(spark, d):
    """One column a group's frequency, each asset from its own: a join to the asset's group instead of side-by-side frames."""
    x = labels(spark, d)
    freq = F.explode(F.array(F.struct(F.lit("G_Q").alias("grp"), F.col("yhat").alias("label")), F.struct(F.lit("G_S").alias("grp"), F.col("y").alias("label")), F.struct(F.lit("G_A").alias("grp"), F.col("y").alias("label"))))
    return x.select("asset", "dt", freq.alias("e")).select("asset", "dt", "e.*").join(groups(spark, d).select("asset", "grp"), ["asset", "grp"]).select("asset", "dt", "grp", "label")


@query(f"WITH {PANEL}, {_LBL}, b AS (SELECT asset, dt, 1 AS block, y AS label FROM lbl WHERE t <= 500 UNION ALL SELECT asset, dt, 2, yhat FROM lbl WHERE t > 400) SELECT asset, dt, label FROM b QUALIFY row_number() OVER (PARTITION BY asset, dt ORDER BY block DESC) = 1")
def set_latest_block(spark, d):
    """Blocks one after the other; of a day in several the last block's row stays."""
    x = labels(spark, d)
    b = x.where("t <= 500").select("asset", "dt", F.lit(1).alias("block"), F.col("y").alias("label")).unionByName(x.where("t > 400").select("asset", "dt", F.lit(2).alias("block"), F.col("yhat").alias("label")))
    return b.groupBy("asset", "dt").agg(F.max_by("label", "block").alias("label"))


@query(f"WITH {FACT} SELECT config, name, round(value, 7) AS value FROM (SELECT config, avg(metric) AS mean, stddev_samp(metric) AS std, max(low) AS low FROM fact GROUP BY 1) UNPIVOT (value FOR name IN (mean, std, low))")
def piv_transposed(spark, d):
    """Metrics of every configuration as rows instead of columns."""
    m = src.fact(spark, d).groupBy("config").agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("std"), F.max("low").alias("low"))
    return m.unpivot(["config"], ["mean", "std", "low"], "name", "value").withColumn("value", r(F.col("value"), 7))


@query(f"WITH {FACT} SELECT config, CAST(split_part(config, '-', 1) AS INT) AS level, round(metric, 6) AS metric, CAST(NULL AS DOUBLE) AS add FROM fact WHERE seed = 0")
def piv_ablation_summary(spark, d):
    """Configuration and metric columns of results, a metric that they lack as null, in the configurations' order."""
    return sweep_summary(src.fact(spark, d).where("seed = 0").withColumn("level", F.split_part("config", F.lit("-"), F.lit(1)).cast("int")).withColumn("metric", r(F.col("metric"), 6)), ["config", "level"], ["metric", "add"])


def sweep_summary(results: DataFrame, config_cols: list[str], metric_cols: list[str]) -> DataFrame:
    have = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("double")
    return results.select(*[have(c).alias(c) for c in [*config_cols, *metric_cols]]).orderBy(*config_cols)


@query(f"WITH {PANEL}, s AS (SELECT asset, avg(er) * 252 AS x, avg(er) / stddev_samp(er) * sqrt(252) AS sharpe, max(dt) AS hi, min(dt) AS lo, count(*) AS n FROM panel GROUP BY 1) SELECT asset, printf('%.1f%%', x * 100) AS ret, printf('%.2f', sharpe) AS sharpe, strftime(hi, '%Y-%m-%d') AS last_day, round((hi - lo) / 365.25, 6) AS years, CASE WHEN asset = 'AF' THEN 60 WHEN asset = 'NO' THEN 40 ELSE 0 END AS weight, '{{\"asset\":\"' || asset || '\",\"n\":' || n || '}}' AS json FROM s")
def scl_display(spark, d):
    """Numbers and days as text, years between days, a map's value with a default, a row as JSON."""
    er = F.col("er")
    s = src.panel(spark, d).groupBy("asset").agg((F.avg(er) * 252).alias("ann_ret"), (F.avg(er) / F.stddev_samp(er) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.max("dt").alias("hi"), F.min("dt").alias("lo"), F.count(F.lit(1)).alias("n"))
    mix = F.create_map(F.lit("AF"), F.lit(60), F.lit("NO"), F.lit(40))
    shown = sinks.displayed(s)
    return shown.select("asset", F.col("ann_ret").alias("ret"), "sharpe", F.date_format("hi", "yyyy-MM-dd").alias("last_day"), r(calendar.year_fraction("hi", "lo"), 6).alias("years"), F.coalesce(F.element_at(mix, F.col("asset")), F.lit(0)).alias("weight"), F.to_json(F.struct("asset", "n")).alias("json"))


@query("SELECT dt, round(y2, 8) AS y2, CAST(n AS DOUBLE) AS n, round(v, 8) AS v FROM (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) / 1e5 AS y2 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS dt, count(*) AS n FROM lineitem GROUP BY 1) USING (dt) FULL JOIN (SELECT CAST(ts AS DATE) AS dt, avg(value) AS v FROM events GROUP BY 1) USING (dt)")
def src_outer_series(spark, d):
    """Three daily series of different days side by side."""
    y = src.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("dt")).agg(r(F.avg("o_totalprice") / 1e5).alias("v"))
    n = src.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("v"))
    v = src.table(spark, d, "events").groupBy(F.to_date("ts").alias("dt")).agg(r(F.avg("value")).alias("v"))
    return src.outer_aligned({"y2": y, "n": n, "v": v})


@query("SELECT 'nation' AS source, count(*) AS n, count(n_name) AS nations, CAST(0 AS BIGINT) AS regions FROM nation UNION ALL SELECT 'region', count(*), 0, count(r_name) FROM region")
def src_stems(spark, d):
    """Several files read as one table, each row with its file's name."""
    return sinks.stems(spark, f"{d}/{{nation,region}}.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("n_name").alias("nations"), F.count("r_name").alias("regions"))


_WIDE = "u AS (SELECT CAST(o_custkey % 60 AS INT) AS asset, CAST(o_orderdate AS DATE) AS dt, round(avg(o_totalprice) / 1e5 - 1.5, 8) AS er FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_WIDE}, dy AS (SELECT dt, pow(0.5, (max(t) OVER () - t) / 252.0) AS w FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS t FROM (SELECT DISTINCT dt FROM u))), m AS (SELECT asset, sum(er * w) / (SELECT sum(w) FROM dy) AS m FROM u JOIN dy USING (dt) GROUP BY 1),
 s AS (SELECT p.asset AS a, q.asset AS b, sum(p.er * q.er * w) / (SELECT sum(w) FROM dy) AS s FROM u p JOIN u q ON p.dt = q.dt AND p.asset <= q.asset JOIN dy ON dy.dt = p.dt GROUP BY 1, 2), ks AS (SELECT x.asset AS a, y.asset AS b, x.m AS ma, y.m AS mb FROM m x JOIN m y ON x.asset <= y.asset)
 SELECT a, b, round((coalesce(s, 0) - ma * mb) / (1 - (SELECT sum(w * w) / pow(sum(w), 2) FROM dy)), 9) AS covariance FROM ks LEFT JOIN s USING (a, b)""")
def prt_wide_covariance(spark, d):
    """Exponentially weighted covariances of a universe of customers' groups, made in blocks of 16."""
    o, price = src.table(spark, d, "orders"), F.col("o_totalprice")
    u = o.groupBy((F.col("o_custkey") % 60).cast("int").alias("asset"), F.to_date("o_orderdate").alias("dt")).agg(F.round(F.avg(price) / 1e5 - 1.5, 8).alias("er"))
    return covariance.ewm_covariance(u, 252, block=16, span=256).select("a", "b", r(F.col("covariance"), 9).alias("covariance"))


@query()
def sta_two_sample_tails(spark, d):
    """p-values of the returns in bull against bear states: Mann-Whitney's U and Welch's t, one row an asset."""
    from .studies import sta_two_samples

    def tails(batches):
        for b in batches:
            yield b[["asset"]].assign(p_u=[inference.mann_whitney_p(u, int(n), int(m)) for u, n, m in zip(b.u, b.n0, b.n1, strict=True)], p_t=[inference.t_two_sided(t, f) for t, f in zip(b.welch_t, b.df, strict=True)])

    return sta_two_samples(spark, d).mapInPandas(tails, "asset string, p_u double, p_t double")


@query(f"WITH {FACT} SELECT asset, config, round(max(metric), 8) AS result_metric_top, round(min(metric), 8) AS result_metric_bottom, count(*) AS result_n FROM fact GROUP BY 1, 2")
def src_flattened(spark, d):
    """Nested results as flat columns."""
    m = src.fact(spark, d).groupBy("asset", "config").agg(F.struct(F.struct(r(F.max("metric")).alias("top"), r(F.min("metric")).alias("bottom")).alias("metric"), F.count(F.lit(1)).alias("n")).alias("result"))
    return src.flattened(m)


# --------------------------------------------------------------------------------------------------------- diagnosis and run metrics


def _summary_sql(of: str, keys: str, horizon: int = 126) -> str:
    """The thirteen numbers of diagnostics.summary over a relation (keys, t, y, p)."""
    w = f"(PARTITION BY {keys} ORDER BY t)"
    c2 = lambda x: f"(({x}) * (({x}) - 1) / 2.0)"
    n = lambda a, b: f"count(*) FILTER (y = {a} AND p = {b})"
    rec = lambda k, t, p: f"(count(*) FILTER ({t} AND {p})) / nullif(count(*) FILTER ({t}), 0)"
    bal = lambda pairs: f"coalesce(list_avg(list_filter([{', '.join(rec(0, t, p) for t, p in pairs)}], lambda x: x IS NOT NULL)), 0)"
    return f"""ds AS (SELECT *, y <> lag(y) OVER {w} AS tc, p <> lag(p) OVER {w} AS pc, CASE WHEN y = 0 THEN min(CASE WHEN p = 0 THEN k END) OVER f ELSE min(CASE WHEN p = 1 THEN k END) OVER f END - k AS delay FROM (SELECT *, row_number() OVER {w} AS k FROM {of}) WINDOW f AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING)),
 dn AS (SELECT {keys}, coalesce(sum(coalesce(delay, {horizon})) FILTER (tc) / nullif(count(*) FILTER (tc), 0), 0) AS add, coalesce(count(*) FILTER (NOT tc AND pc) / nullif(count(*) FILTER (NOT tc), 0), 0) AS far, coalesce(count(*) FILTER (tc AND delay IS NULL) / nullif(count(*) FILTER (tc), 0), 0) AS miss_rate,
 count(*) FILTER (tc = pc) / count(tc) AS cp_accuracy, {bal([('NOT tc', 'NOT pc'), ('tc', 'pc')])} AS cp_balanced_accuracy, {c2(n(0, 0))} + {c2(n(0, 1))} + {c2(n(1, 0))} + {c2(n(1, 1))} AS b, {c2('count(*) FILTER (y = 0)')} + {c2('count(*) FILTER (y = 1)')} AS l, {c2('count(*) FILTER (p = 0)')} + {c2('count(*) FILTER (p = 1)')} AS rr, {c2('count(*)')} AS a2,
 avg((y = p)::INT) AS concordance, {bal([('y = 0', 'p = 0'), ('y = 1', 'p = 1')])} AS state_balanced_accuracy, count(*) AS n, count(*) FILTER (coalesce(pc, true)) AS n_runs, coalesce(count(*) FILTER (p = 0) / nullif(count(*) FILTER (coalesce(pc, true) AND p = 0), 0), 0) AS mrl_bull, coalesce(count(*) FILTER (p = 1) / nullif(count(*) FILTER (coalesce(pc, true) AND p = 1), 0), 0) AS mrl_bear,
 coalesce(2.0 * {n(1, 1)} / nullif(2 * {n(1, 1)} + count(*) FILTER (y <> p), 0), 0) AS f1 FROM ds GROUP BY {keys})"""


_ARI = "CASE WHEN (l + rr) / 2 = l * rr / a2 THEN 1 ELSE (b - l * rr / a2) / ((l + rr) / 2 - l * rr / a2) END"


@query(f"WITH {PANEL}, {_LBL}, yp AS (SELECT asset, t, y, yhat AS p FROM lbl), {_summary_sql('yp', 'asset')} SELECT asset, round(add, 6) AS add, round(far, 7) AS far, round(miss_rate, 7) AS miss_rate, round(cp_accuracy, 7) AS cp_accuracy, round(cp_balanced_accuracy, 7) AS cp_balanced_accuracy, round({_ARI}, 7) AS ari, round(concordance, 7) AS concordance, round(concordance, 7) AS state_accuracy, round(state_balanced_accuracy, 7) AS state_balanced_accuracy, round(n / n_runs, 6) AS mrl_all, round(mrl_bull, 6) AS mrl_bull, round(mrl_bear, 6) AS mrl_bear, n_runs FROM dn")
def dgn_summary(spark, d):
    """All thirteen diagnostics of the fast rule's labels against the slow one's."""
    s = diagnostics.summary(labels(spark, d), "y", "yhat", ["asset"])
    six = ("add", "mrl_all", "mrl_bull", "mrl_bear")
    return s.select("asset", *[F.col(c) if c == "n_runs" else r(F.col(c), 6 if c in six else 7).alias(c) for c in diagnostics.NAMES])


_NET = f"nt AS (SELECT asset, dt, t, y, p, pos * er - abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) * 0.0005 * 2 AS net FROM (SELECT asset, dt, t, y, yhat AS p, er, CAST(1 - yhat AS DOUBLE) AS pos FROM lbl))"


@query(f"""WITH {PANEL}, {_LBL}, {_NET}, {_summary_sql('nt', 'asset')}, z AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER {BY} AS k, product(1 + net) OVER {UP} AS w, abs(p - coalesce(lag(p) OVER {BY}, 0)) AS st FROM nt),
 z2 AS (SELECT *, greatest(1, max(w) OVER {UP}) AS peak, least(greatest(round_even(n * 0.6, 0), 1), n - 1) AS sp FROM z),
 m AS (SELECT asset, avg(net) * 252 AS total_return, stddev_samp(net) * sqrt(252) AS volatility, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe_ratio, avg(net) * 252 / (sqrt(avg(pow(least(net, 0), 2))) * sqrt(252)) AS sortino_ratio, min(w / peak - 1) AS max_drawdown, avg(st) * 252 AS turnover, product(1 + net) AS terminal_wealth, product(CASE WHEN k <= sp THEN 1 + net ELSE 1 END) AS terminal_wealth_val, product(CASE WHEN k > sp THEN 1 + net ELSE 1 END) AS terminal_wealth_oos, sum(st) AS n_position_switches FROM z2 GROUP BY 1)
 SELECT asset, round(add, 6) AS add, round(far, 7) AS false_alarm_rate, round(f1, 7) AS f1_score, round({_ARI}, 7) AS regime_ari, round(n / n_runs, 6) AS mean_run_length, round(total_return, 8) AS total_return, round(volatility, 8) AS volatility, round(sharpe_ratio, 6) AS sharpe_ratio, round(sortino_ratio, 6) AS sortino_ratio, round(max_drawdown, 8) AS max_drawdown, round(abs(total_return) / abs(max_drawdown), 6) AS calmar_ratio, round(turnover, 6) AS turnover, round(terminal_wealth, 8) AS terminal_wealth, round(terminal_wealth_val, 8) AS terminal_wealth_val, round(terminal_wealth_oos, 8) AS terminal_wealth_oos, round(n_position_switches, 1) AS n_position_switches FROM m JOIN dn USING (asset)""")
def swp_run_metrics(spark, d):
    """A run's metrics: the fast rule's labels as predictions, the slow one's as the truth, allocated as the baseline does."""
    x = labels(spark, d).select("asset", "dt", "er", F.col("y").alias("true"), F.col("yhat").alias("pred"), F.lit(10.0).alias("gamma_risk"), F.lit(1.0).alias("gamma_trade"), F.lit(1.0).alias("leverage_max"))
    m = sweep.run_metrics(sweep.allocated(x, ["asset"]), ["asset"])
    places = {"add": 6, "false_alarm_rate": 7, "f1_score": 7, "regime_ari": 7, "mean_run_length": 6, "total_return": 8, "volatility": 8, "sharpe_ratio": 6, "sortino_ratio": 6, "max_drawdown": 8, "calmar_ratio": 6, "turnover": 6, "terminal_wealth": 8, "terminal_wealth_val": 8, "terminal_wealth_oos": 8, "n_position_switches": 1}
    return m.select("asset", *[r(F.col(c), k).alias(c) for c, k in places.items()])


@query(f"WITH {PANEL}, {_LBL}, f AS (SELECT asset, t, er, lag(yhat) OVER {BY} AS f1, lag(yhat, 2) OVER {BY} AS f2 FROM lbl), n AS (SELECT asset, CASE WHEN f1 = 0 THEN er ELSE 0 END - CASE WHEN f1 IS NULL OR f2 IS NULL OR f1 <> f2 THEN 0.0005 ELSE 0 END AS net, er, f1 FROM f) SELECT asset, count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(252), 6) AS sharpe, round(count(*) FILTER ((f1 = 0 AND er > 0) OR (f1 = 1 AND er < 0)) / (count(*) - 1), 7) AS hit_rate FROM n GROUP BY 1")
def fct_switching_sharpe(spark, d):
    """The Sharpe ratio that chooses penalties, its first two days paying as changes; and how often yesterday's forecast has the sign of the day's return."""
    x = labels(spark, d).withColumnRenamed("yhat", "label")
    f = F.lag("label").over(by())
    hit = x.withColumn("f", f).groupBy("asset").agg(r(F.count(F.when(((F.col("f") == 0) & (F.col("er") > 0)) | ((F.col("f") == 1) & (F.col("er") < 0)), 1)) / (F.count(F.lit(1)) - 1), 7).alias("hit_rate"))
    return framework.timing_sharpe(x, ["asset"], "t").select("asset", "n", r(F.col("sharpe"), 6).alias("sharpe")).join(hit, "asset")


@query(f"WITH {PANEL}, k AS (SELECT asset, t, er, product(1 + er) OVER {UP} AS w FROM panel), q AS (SELECT *, max(w) OVER {UP} AS peak FROM k) SELECT asset, CASE WHEN max(1 - w / peak) > 1e-9 THEN round(avg(er) * 252 / max(1 - w / peak), 6) END AS calmar, round(CASE WHEN count(*) >= 2 AND sqrt(avg(pow(least(er, 0), 2))) >= 1e-12 THEN avg(er) * 252 / (sqrt(avg(pow(least(er, 0), 2))) * sqrt(252)) ELSE 0 END, 6) AS sortino FROM q GROUP BY 1")
def met_signed_ratios(spark, d):
    """Calmar with its sign, null without a drawdown; Sortino, 0 where it is not defined."""
    return backtest.signed_ratios(src.panel(spark, d), ["asset"], "t", "er").select("asset", r(F.col("calmar"), 6).alias("calmar"), r(F.col("sortino"), 6).alias("sortino"))


@query(f"WITH {PANEL}, {_LBL}, x AS (SELECT asset, dt, er, y, product(1 + er) OVER {UP} AS wealth, lead(dt) OVER {BY} AS nxt, CASE WHEN y = lag(y) OVER {BY} THEN 0 ELSE 1 END AS ch FROM lbl), g AS (SELECT *, sum(ch) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT asset, min(dt) AS start, coalesce(max(nxt), max(dt)) AS stop, count(*) AS n, round(arg_max(wealth, dt), 8) AS wealth FROM g WHERE y = 1 GROUP BY asset, run")
def met_bear_shading(spark, d):
    """What a figure of wealth with shaded bear markets shows: every bear run from its first day to the first day after it (or the last day), with the wealth at its end."""
    return backtest.bear_shading(labels(spark, d), "y").select("asset", "start", "stop", "n", r(F.col("wealth")).alias("wealth"))


# ---------------------------------------------------------------------------------------------------------------- refits and stability


_FITS = f"ff AS (SELECT asset, dt, t, er * 100 AS f1, m * 1000 AS f2 FROM (SELECT *, {ewm_sql('er', 21)} AS m FROM panel)), ft0 AS (SELECT asset, rebal, dt, f1, f2, CASE WHEN round(f2 - avg(f2) OVER (PARTITION BY asset, rebal), 9) < 0 THEN 1 ELSE 0 END AS regime, count(*) OVER (PARTITION BY asset, rebal) AS n FROM ff JOIN rb ON dt >= rebal - INTERVAL 2 YEAR AND dt < rebal), fits AS (SELECT * FROM ft0 WHERE n >= 100)"


def plain_fits(spark, d) -> DataFrame:
    """(asset, rebal, dt, f1, f2, regime): a partition of each two-year window that SQL can say: bear below the window's mean of f2."""
    x = calendar.training_rows(features(spark, d), calendar.rebalance_days(src.panel(spark, d).select("dt").distinct()), "rolling", 2, least=100)
    w = Window.partitionBy("asset", "rebal")
    return x.select("asset", "rebal", "dt", "f1", "f2", F.when(F.round(F.col("f2") - F.avg("f2").over(w), 9) < 0, 1).otherwise(0).alias("regime"))


_CONSEC = """od AS (SELECT asset, rebal, lag(rebal) OVER (PARTITION BY asset ORDER BY rebal) AS prev FROM (SELECT DISTINCT asset, rebal FROM fits)), bt AS (SELECT o.asset, o.prev, o.rebal, a.regime AS a, b.regime AS b FROM od o JOIN fits b ON b.asset = o.asset AND b.rebal = o.rebal JOIN fits a ON a.asset = o.asset AND a.rebal = o.prev AND a.dt = b.dt),
 cn AS (SELECT asset, prev, rebal, count(*) AS n, count(*) FILTER (a = b) AS s, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM bt GROUP BY 1, 2, 3),
 cp AS (SELECT *, (n00 * (n00 - 1) + n01 * (n01 - 1) + n10 * (n10 - 1) + n11 * (n11 - 1)) / 2.0 AS i, ((n00 + n01) * (n00 + n01 - 1) + (n10 + n11) * (n10 + n11 - 1)) / 2.0 AS l, ((n00 + n10) * (n00 + n10 - 1) + (n01 + n11) * (n01 + n11 - 1)) / 2.0 AS rr, n * (n - 1) / 2.0 AS a2 FROM cn),
 cg AS (SELECT o.asset, o.prev, o.rebal, coalesce(n, 0) AS n_overlap, CASE WHEN n >= 20 THEN greatest(s / n, 1 - s / n) END AS agreement, CASE WHEN n >= 20 THEN CASE WHEN (l + rr) / 2 = l * rr / a2 THEN 1 ELSE (i - l * rr / a2) / ((l + rr) / 2 - l * rr / a2) END END AS ari FROM od o LEFT JOIN cp USING (asset, prev, rebal) WHERE o.prev IS NOT NULL)"""


@query(f"WITH {PANEL}, {_REBAL}, {_FITS}, {_CONSEC} SELECT asset, prev, rebal, round(agreement, 7) AS agreement, round(ari, 7) AS ari, n_overlap FROM cg")
def stb_consecutive_agreement(spark, d):
    """Agreement and adjusted Rand index of every refit with the one before it, over the days that both trained on."""
    return stability.consecutive_agreement(plain_fits(spark, d)).select("asset", "prev", "rebal", r(F.col("agreement"), 7).alias("agreement"), r(F.col("ari"), 7).alias("ari"), "n_overlap")


_VALID = """ce AS (SELECT asset, rebal, regime, count(*) AS n, avg(f1) AS c1, avg(f2) AS c2 FROM fits GROUP BY 1, 2, 3), di AS (SELECT asset, rebal, regime, avg(sqrt(q)) AS s, sum(q) AS w FROM (SELECT f.asset, f.rebal, f.regime, pow(f1 - c1, 2) + pow(f2 - c2, 2) AS q FROM fits f JOIN ce USING (asset, rebal, regime)) GROUP BY 1, 2, 3),
 vp AS (SELECT asset, rebal, sum(n) AS n, max(n) FILTER (regime = 0) AS n0, max(n) FILTER (regime = 1) AS n1, pow(max(c1) FILTER (regime = 0) - max(c1) FILTER (regime = 1), 2) + pow(max(c2) FILTER (regime = 0) - max(c2) FILTER (regime = 1), 2) AS g2, sum(w) AS w, sum(s) AS s FROM ce JOIN di USING (asset, rebal, regime) GROUP BY 1, 2),
 va AS (SELECT asset, rebal, n, s / sqrt(g2) AS davies_bouldin, n0 * n1 / n * g2 / (w / (n - 2)) AS calinski_harabasz FROM vp)"""


@query(f"WITH {PANEL}, {_REBAL}, {_FITS}, {_VALID} SELECT asset, rebal, n, round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 4) AS calinski_harabasz, round(calinski_harabasz / n, 7) AS calinski_harabasz_per_n FROM va")
def stb_validity(spark, d):
    """Validity of every refit's partition."""
    v = stability.validity(plain_fits(spark, d), ["f1", "f2"], ["asset", "rebal"])
    return v.select("asset", "rebal", "n", r(F.col("davies_bouldin"), 6).alias("davies_bouldin"), r(F.col("calinski_harabasz"), 4).alias("calinski_harabasz"), r(F.col("calinski_harabasz_per_n"), 7).alias("calinski_harabasz_per_n"))


_REPORT = f"""{_CONSEC}, {_VALID}, dr AS (SELECT asset, avg((a + b) / 2) AS d FROM (SELECT asset, rebal, max(m) FILTER (regime = 0) AS a, max(m) FILTER (regime = 1) AS b FROM (SELECT asset, rebal, regime, sqrt(pow(c1 - lag(c1) OVER w, 2) + pow(c2 - lag(c2) OVER w, 2)) AS m FROM ce WINDOW w AS (PARTITION BY asset, regime ORDER BY rebal)) GROUP BY 1, 2) GROUP BY 1),
 oc AS (SELECT asset, stddev_samp(p) * 100 AS o, avg(m) AS m FROM (SELECT asset, rebal, avg(regime) AS p, count(*) / sum(st) AS m FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY asset, rebal ORDER BY dt) THEN 0 ELSE 1 END AS st FROM fits) GROUP BY 1, 2) GROUP BY 1),
 rp AS (SELECT asset, avg(agreement) AS label_agreement, avg(ari) AS ari, any_value(d) AS centroid_drift, any_value(o) AS occupancy_std, any_value(m) AS mean_run_length, any_value(db) AS davies_bouldin, any_value(ch) AS calinski_harabasz_per_n FROM cg JOIN dr USING (asset) JOIN oc USING (asset) JOIN (SELECT asset, avg(davies_bouldin) AS db, avg(calinski_harabasz / n) AS ch FROM va GROUP BY 1) USING (asset) GROUP BY 1)"""
_REPORT_COLUMNS = ["label_agreement", "ari", "centroid_drift", "occupancy_std", "mean_run_length", "davies_bouldin", "calinski_harabasz_per_n"]


@query(f"WITH {PANEL}, {_REBAL}, {_FITS}, {_REPORT} SELECT asset, " + ", ".join(f"round({c}, 6) AS {c}" for c in _REPORT_COLUMNS) + " FROM rp")
def stb_report(spark, d):
    """Every asset's steadiness over its refits, in one row."""
    return stability.report(plain_fits(spark, d), ["f1", "f2"]).select("asset", *[r(F.col(c), 6).alias(c) for c in _REPORT_COLUMNS])


@query(f"WITH {PANEL}, {_REBAL}, {_FITS}, {_REPORT} SELECT asset, round(label_agreement, 6) AS label_agreement, round(greatest(0, least(1, ari)), 6) AS ari, round(1 / (1 + centroid_drift), 6) AS centroid_drift, round(1 / (1 + occupancy_std * 10), 6) AS occupancy_std, round(greatest(0, least(100, mean_run_length)) / 100, 6) AS mean_run_length, round(1 / (1 + davies_bouldin), 6) AS davies_bouldin, round(calinski_harabasz_per_n / max(calinski_harabasz_per_n) OVER (), 6) AS calinski_harabasz_per_n FROM rp")
def stb_normalised(spark, d):
    return stability.normalised(stability.report(plain_fits(spark, d), ["f1", "f2"])).select("asset", *[r(F.col(c), 6).alias(c) for c in _REPORT_COLUMNS])


def jump_fits(spark, d) -> DataFrame:
    x = calendar.training_rows(features(spark, d), calendar.rebalance_days(src.panel(spark, d).select("dt").distinct()), "rolling", 11)
    return jump_model.refits(x, ["f1", "f2"], penalty=10.0)


@query()
def stb_jump_refits(spark, d):
    """Agreement of the jump model's half-yearly refits on the eleven years before."""
    return stability.consecutive_agreement(jump_fits(spark, d))


@query()
def stb_jump_validity(spark, d):
    """Validity with silhouettes of the jump model's refits, averaged over an asset's refits."""
    v = stability.validity_with_silhouette(jump_fits(spark, d), ["f1", "f2"])
    return v.groupBy("asset").agg(*[F.avg(c).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "calinski_harabasz_per_n")], F.count(F.lit(1)).alias("refits"))


@query()
def jmp_consensus(spark, d):
    """The majority of five fits from different starts."""
    return jump_model.consensus(features(spark, d), ["f1", "f2"], penalty=10.0)


@query()
def swp_thresholds(spark, d):
    """Levels of agreement and run length that trigger a refit, from quarterly fits."""
    first = F.col("dt") == F.min("dt").over(Window.partitionBy("asset", F.year("dt"), F.quarter("dt")))
    return forecast.thresholds(features(spark, d).withColumn("judge", first), ["f1", "f2"], "judge", penalty=10.0)


@query()
def sta_window_size_slopes(spark, d):
    """How the Calinski-Harabasz index of a refit moves with its rows, for expanding windows and for the last 1,260 rows, with Newey-West errors."""
    import numpy as np
    import pandas as pd

    days = calendar.rebalance_days(src.panel(spark, d).select("dt").distinct(), calendar.months_of("quarterly"))
    x, w = features(spark, d), Window.partitionBy("asset", "rebal")
    design = lambda kind: stability.validity(calendar.training_rows(x, days, kind).withColumn("regime", F.when(F.col("f2") < F.avg("f2").over(w), 1).otherwise(0)), ["f1", "f2"], ["asset", "rebal"]).select("asset", "rebal", F.col("n").cast("double").alias(f"n_{kind}"), F.col("calinski_harabasz").alias(f"ch_{kind}"))
    both = design("expanding").join(design("last"), ["asset", "rebal"]).dropna()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"asset": [pdf["asset"].iloc[0]]}
        for kind in ("expanding", "last"):
            n, ch = pdf[f"n_{kind}"].to_numpy(float), pdf[f"ch_{kind}"].to_numpy(float)
            usable = len(pdf) >= 8 and np.ptp(n) > 0
            b, se = inference.hac_ols(n, ch) if usable else ([0, None], [0, None])
            out |= {f"slope_{kind}": [b[1]], f"p_{kind}": [inference.normal_two_sided(b[1] / se[1]) if usable and se[1] > 0 else None]}
        return pd.DataFrame(out).astype({c: "float64" for c in out if c != "asset"})

    return both.groupBy("asset").applyInPandas(one, "asset string, slope_expanding double, p_expanding double, slope_last double, p_last double")


_TREND = f"""RECURSIVE {MACRO}, {PANEL}, mn AS (SELECT dt, vix, row_number() OVER (ORDER BY dt) AS n FROM macro),
k AS (SELECT n, dt, vix::DOUBLE AS y, vix::DOUBLE AS a1, (SELECT vix FROM mn WHERE n = 1)::DOUBLE AS a2, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22 FROM mn WHERE n = 2 UNION ALL
 SELECT n, dt, y, ahead + v11 / (v11 + 1) * (y - ahead), b1 + v12 / (v11 + 1) * (y - ahead), v11 / (v11 + 1), v12 / (v11 + 1), o11 - v12 / (v11 + 1) * v12 FROM
 (SELECT mn.n, mn.dt, mn.vix::DOUBLE AS y, 2 * k.a1 - k.a2 AS ahead, k.a1 AS b1, k.p11 AS o11, 4 * k.p11 - 4 * k.p12 + k.p22 + 1 / 1.6e6 AS v11, 2 * k.p11 - k.p12 AS v12 FROM k JOIN mn ON mn.n = k.n + 1))"""


@query(f"WITH {_TREND}, x AS (SELECT min(dt) AS rebal FROM panel WHERE month(dt) IN (1, 7) GROUP BY year(dt), month(dt)) SELECT rebal, mn.n, CASE WHEN mn.n >= 10 THEN round(a1, 6) END AS trend, CASE WHEN mn.n >= 10 THEN round(y - a1, 6) END AS cycle FROM x ASOF JOIN mn ON x.rebal >= mn.dt LEFT JOIN k ON k.n = mn.n")
def sta_trend_at_date(spark, d):
    """Trend and cycle of the smoothed macro series at every rebalance day, from what was known by then: one pass over the series gives all dates."""
    m = trend.trend_so_far(src.macro(spark, d).select(F.lit("vix").alias("series"), "dt", F.col("vix").cast("double").alias("v")), ["series"], "dt", "v")
    days = calendar.rebalance_days(src.panel(spark, d).select("dt").distinct())
    at = as_of(days.withColumnRenamed("rebal", "dt"), m, "dt", ["n", "trend", "cycle"]).where("n IS NOT NULL")
    return at.select(F.col("dt").alias("rebal"), "n", *[F.when(F.col("n") >= 10, r(F.col(c), 6)).alias(c) for c in ("trend", "cycle")])


@query(f"WITH {PANEL} SELECT asset, t, n, round(mean, 8) AS mean, round(sd, 8) AS sd, CASE WHEN n >= 20 THEN round((er - mean) / greatest(sd, 1e-8), 6) END AS z, round(w / max(w) OVER {UP} - 1, 8) AS drawdown, round(ewm, 8) AS ewm FROM (SELECT *, count(er) OVER {UP} AS n, avg(er) OVER {UP} AS mean, stddev_samp(er) OVER {UP} AS sd, product(1 + er) OVER {UP} AS w, {ewm_sql('er', 21)} AS ewm FROM panel)")
def win_scans(spark, d):
    """Expanding moments, drawdown and smoothed mean of every asset's returns by two-level scans: an asset's days are dealt over tasks."""
    p = scan.in_parts(src.panel(spark, d).select("asset", "t", "er"), ["asset"], "t")
    x = scan.moments_so_far(p, ["asset"], "t", "er")
    x = scan.ewm_mean(scan.drawdown(x, ["asset"], "t", "er"), ["asset"], "t", "er", 21)
    z = F.when(F.col("n") >= 20, r((F.col("er") - F.col("mean")) / F.greatest("sd", F.lit(1e-8)), 6))
    return x.select("asset", "t", "n", *[r(F.col(c)).alias(c) for c in ("mean", "sd")], z.alias("z"), r(F.col("drawdown")).alias("drawdown"), r(F.col("ewm")).alias("ewm"))


@query("WITH e AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) AS t FROM events) SELECT event_id, t, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS peak, last_value(CASE WHEN value > 100 THEN event_id END IGNORE NULLS) OVER w AS last_large FROM e WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def win_one_long_series(spark, d):
    """All events as one series: rows numbered, running sum, peak and the last large event, with no task that holds the whole series."""
    e = src.table(spark, d, "events").select("event_id", "value", F.struct(F.col("ts"), F.col("event_id")).alias("at"))
    x = scan.running(e, [], "at", t=("count", F.lit(1)), total=("sum", F.col("value")), peak=("max", F.col("value")), last_large=("last", F.when(F.col("value") > 100, F.col("event_id"))))
    return x.select("event_id", "t", r(F.col("total"), 4).alias("total"), "peak", "last_large")


@query("SELECT l_quantity AS quantity, count(*) AS n, (min(rk) + max(rk)) / 2 AS average_rank FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS rk FROM lineitem WHERE l_quantity IS NOT NULL) GROUP BY 1")
def agg_tied_ranks(spark, d):
    """Average ranks of a column of a few values, each in a large share of all rows."""
    x = scan.average_rank(src.table(spark, d, "lineitem").select("l_quantity"), "l_quantity", "rk").where("rk IS NOT NULL")
    return x.groupBy(F.col("l_quantity").alias("quantity")).agg(F.count(F.lit(1)).alias("n"), F.avg("rk").alias("average_rank"))


# -------------------------------------------------------------------------------------------------------------------- statistics


_FR = f"m AS (SELECT asset, config, avg(metric) AS m FROM fact GROUP BY 1, 2), k AS (SELECT asset, config, {rank_sql('m', 'asset')} AS rk, pow(count(*) OVER (PARTITION BY asset, m), 2) - 1 AS tie, count(*) OVER (PARTITION BY asset) AS c FROM m), s AS (SELECT config, sum(rk) AS s, count(*) AS n, sum(tie) AS tie FROM k WHERE c = 5 GROUP BY 1), f AS (SELECT count(*) AS k, max(n) AS n, (12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1)) / (1 - sum(tie) / (max(n) * (pow(count(*), 3) - count(*)))) AS chi2 FROM s)"


@query(f"WITH {FACT}, {_FR} SELECT k, n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 8) AS p FROM f")
def sta_friedman_configs(spark, d):
    """Friedman's test of the five configurations, assets as blocks; the tail with four degrees of freedom is exp(-x/2) (1 + x/2)."""
    f = sweep.friedman(src.fact(spark, d), "metric", [])
    return f.select("k", "n", r(F.col("chi2"), 6).alias("chi2"), r(F.exp(-F.col("chi2") / 2) * (1 + F.col("chi2") / 2)).alias("p"))


@query(f"""WITH {PANEL}, e AS (SELECT asset, t, er, {ewm_sql('er', 21)} AS m FROM panel), x AS (SELECT asset, t, er AS y, lag(m) OVER {BY} AS x FROM e), z AS (SELECT * FROM x WHERE x IS NOT NULL), b AS (SELECT asset, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, sum(x) AS sx, sum(x * x) AS sxx, greatest(2, ceil(pow(count(*), 0.25))) AS q FROM z GROUP BY 1),
 u AS (SELECT z.asset, t, x, y - b0 - b1 * x AS e, q FROM z JOIN b USING (asset)), s0 AS (SELECT asset, sum(e * e) AS a, sum(e * e * x) AS b, sum(e * e * x * x) AS c FROM u GROUP BY 1),
 lg AS (SELECT p.asset, sum((1 - h / (p.q + 1)) * 2 * p.e * o.e) AS a, sum((1 - h / (p.q + 1)) * p.e * o.e * (p.x + o.x)) AS b, sum((1 - h / (p.q + 1)) * 2 * p.e * o.e * p.x * o.x) AS c FROM u p JOIN (SELECT unnest(range(1, 20)) AS h) hh ON h <= p.q JOIN u o ON o.asset = p.asset AND o.t = p.t - h GROUP BY 1),
 ss AS (SELECT asset, s0.a + lg.a AS a, s0.b + lg.b AS b, s0.c + lg.c AS c FROM s0 JOIN lg USING (asset)), v AS (SELECT asset, b1, (sx * sx * a - 2 * sx * n * b + n * n * c) / pow(n * sxx - sx * sx, 2) AS v FROM b JOIN ss USING (asset)) SELECT asset, round(b1, 6) AS slope, round(sqrt(v), 6) AS se, round(b1 / sqrt(v), 5) AS z FROM v""")
def sta_hac_statistics(spark, d):
    """Slope and Newey-West error of each asset's return on its smoothed return of the day before."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        b, se = inference.hac_ols(pdf["m"].to_numpy(), pdf["er"].to_numpy())
        return pd.DataFrame({"asset": pdf["asset"].iloc[:1], "slope": [b[1]], "se": [se[1]]})

    p = src.panel(spark, d).withColumn("e", ewm_mean(F.col("er"), 21)).withColumn("m", F.lag("e").over(by())).dropna(subset=["m", "er"])
    h = per_asset(p.select("asset", "t", "er", "m"), "slope double, se double", one)
    return h.select("asset", r(F.col("slope"), 6).alias("slope"), r(F.col("se"), 6).alias("se"), r(F.col("slope") / F.col("se"), 5).alias("z"))


@query(f"WITH {PANEL}, m AS (SELECT asset, count(*) AS n, avg(er) AS a, stddev_samp(er) AS s FROM panel GROUP BY 1), q AS (SELECT asset, any_value(n) AS n, any_value(a) AS a, any_value(s) AS s, avg(pow(er - a, 2)) AS m2, avg(pow(er - a, 3)) AS m3, avg(pow(er - a, 4)) AS m4 FROM panel JOIN m USING (asset) GROUP BY 1) SELECT asset, n, round(a / s, 8) AS sharpe, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurt, round(sqrt((1 + 0.5 * pow(a / s, 2) - m3 / pow(m2, 1.5) * a / s + (m4 / (m2 * m2) - 1) / 4) / (n - 1)), 8) AS error FROM q")
def sta_sharpe_moments(spark, d):
    """What the deflated Sharpe ratio is made of: the ratio, its moments and its standard error."""
    er = F.col("er")
    s = src.panel(spark, d).groupBy("asset").agg(F.count(er).alias("n"), (F.avg(er) / F.stddev_samp(er)).alias("x"), F.skewness(er).alias("g"), (F.kurtosis(er) + 3).alias("k"))
    error = F.sqrt((1 + 0.5 * F.pow("x", 2) - F.col("g") * F.col("x") + (F.col("k") - 1) / 4) / (F.col("n") - 1))
    return s.select("asset", "n", r(F.col("x")).alias("sharpe"), r(F.col("g"), 6).alias("skew"), r(F.col("k"), 6).alias("kurt"), r(error).alias("error"))


@query()
def sta_all_pairs(spark, d):
    """Every pair of configurations compared over assets, with p-values and stars."""
    return sweep.all_pairs(src.fact(spark, d), "metric")


# --------------------------------------------------------------------------------------------------------------------------- sweeps


_RES = f"res AS (SELECT *, 'S' || (seed % 2) AS ablation_id, low AS max_drawdown FROM fact)"


def results(spark, d) -> DataFrame:
    return src.fact(spark, d).select("*", F.concat(F.lit("S"), (F.col("seed") % 2).cast("string")).alias("ablation_id"), F.col("low").alias("max_drawdown"))


@query(f"WITH {FACT} SELECT ablation_id, n, n * (SELECT count(DISTINCT asset) * count(DISTINCT seed) FROM fact) AS runs FROM (VALUES ('A1', 7), ('A2', 5), ('A3', 3), ('B1', 6), ('B2', 4), ('C1', 5), ('C2', 5), ('D1', 4), ('I1', 9), ('I2', 9), ('W1', 144)) v(ablation_id, n)")
def swp_config_counts(spark, d):
    """Configurations of every ablation, and its runs over the assets and seeds that have results."""
    each = src.fact(spark, d).agg((F.countDistinct("asset") * F.countDistinct("seed")).alias("each"))
    n = sweep.config_table(spark).groupBy("ablation_id").agg(F.countDistinct("name").cast("int").alias("n"))
    return n.join(F.broadcast(each)).select("ablation_id", "n", (F.col("n") * F.col("each")).alias("runs"))  # one row


@query(f"WITH {FACT}, {_RES} SELECT ablation_id, config, round(avg(metric), 8) AS metric, round(avg(max_drawdown), 8) AS max_drawdown, row_number() OVER (PARTITION BY ablation_id ORDER BY avg(metric) DESC, avg(max_drawdown) DESC, config) AS place FROM res GROUP BY 1, 2")
def swp_ranking(spark, d):
    return sweep.ranking(results(spark, d), "metric", by=["ablation_id"]).select("ablation_id", "config", r(F.col("metric")).alias("metric"), r(F.col("max_drawdown")).alias("max_drawdown"), "place")


_COMP = f"""{_RES}, ma AS (SELECT ablation_id, asset, config, avg(metric) AS v FROM res GROUP BY 1, 2, 3), pr AS (SELECT c.ablation_id, c.config, c.asset, b.v AS b, c.v AS v, round(c.v - b.v, 12) AS d FROM ma c JOIN ma b ON b.ablation_id = c.ablation_id AND b.asset = c.asset AND b.config = '1-URGENT' AND c.config <> '1-URGENT'),
 rk AS (SELECT ablation_id, config, d, {rank_sql('abs(d)', 'ablation_id, config')} AS rk FROM pr WHERE d <> 0), wx AS (SELECT ablation_id, config, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM rk GROUP BY 1, 2),
 cm AS (SELECT ablation_id, config, count(*) AS n, avg(b) AS mb, avg(v) AS mv, CASE WHEN sqrt((var_samp(v) + var_samp(b)) / 2) > 1e-12 THEN (avg(v) - avg(b)) / sqrt((var_samp(v) + var_samp(b)) / 2) ELSE 0 END AS cd FROM pr GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query(f"WITH {FACT}, {_COMP} SELECT ablation_id, config, n, round(mb, 7) AS mean_baseline, round(mv, 7) AS mean_config, round(mv - mb, 7) AS mean_diff, round(w, 2) AS wilcoxon, round(cd, 6) AS cohens_d FROM cm JOIN wx USING (ablation_id, config)")
def swp_comparisons(spark, d):
    """Every configuration against the first, over assets."""
    c = sweep.comparisons(sweep.paired(results(spark, d), "metric", "1-URGENT", ["ablation_id"]), ["ablation_id", "config"])
    return c.select("ablation_id", "config", "n", r(F.col("mean_baseline"), 7).alias("mean_baseline"), r(F.col("mean_config"), 7).alias("mean_config"), r(F.col("mean_diff"), 7).alias("mean_diff"), r(F.col("wilcoxon"), 2).alias("wilcoxon"), r(F.col("cohens_d"), 6).alias("cohens_d"))


_SPLIT = "vs AS (SELECT ablation_id, t.v, c.x AS c, a.x AS a FROM (SELECT ablation_id, var_samp(metric) AS v FROM res GROUP BY 1) t JOIN (SELECT ablation_id, avg(x) AS x FROM (SELECT ablation_id, config, var_samp(m) AS x FROM (SELECT ablation_id, asset, config, avg(metric) AS m FROM res GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) c USING (ablation_id) JOIN (SELECT ablation_id, avg(x) AS x FROM (SELECT ablation_id, asset, var_samp(m) AS x FROM (SELECT ablation_id, asset, config, avg(metric) AS m FROM res GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) a USING (ablation_id))"


@query(f"WITH {FACT}, {_RES}, {_SPLIT} SELECT ablation_id, round(c / v, 6) AS config_contribution, round(a / v, 6) AS asset_contribution, round(greatest(0, 1 - (c + a) / greatest(v, 1e-12)), 6) AS residual FROM vs")
def swp_variance_split(spark, d):
    s = sweep.variance_split(results(spark, d), "metric", ["ablation_id"])
    return s.select("ablation_id", *[r(F.col(c), 6).alias(c) for c in ("config_contribution", "asset_contribution", "residual")])


@query(f"""WITH {FACT}, {_COMP}, {_SPLIT}, tp AS (SELECT ablation_id, config, avg(metric) AS m FROM res GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ablation_id ORDER BY avg(metric) DESC, avg(max_drawdown) DESC, config) = 1), mx AS (SELECT ablation_id, arg_max(config, abs(mv - mb)) AS bc, arg_max(mv - mb, abs(mv - mb)) AS bd, max(abs(cd)) AS me FROM cm GROUP BY 1)
 SELECT ablation_id, (SELECT count(DISTINCT config) FROM res r WHERE r.ablation_id = vs.ablation_id) AS n_configs, bc AS best_config_vs_baseline, round(bd, 7) AS mean_diff_vs_baseline, tp.config AS argmax_config, round(tp.m, 7) AS argmax_metric_value, round(c / v, 6) AS variance_explained, round(me, 6) AS max_effect_size, row_number() OVER (ORDER BY c / v DESC, ablation_id) AS rank FROM vs JOIN tp USING (ablation_id) JOIN mx USING (ablation_id)""")
def swp_compare(spark, d):
    """Ablations by the variance that their configurations explain."""
    c = sweep.compare(results(spark, d), "metric")
    return c.select("ablation_id", "n_configs", "best_config_vs_baseline", r(F.col("mean_diff_vs_baseline"), 7).alias("mean_diff_vs_baseline"), "argmax_config", r(F.col("argmax_metric_value"), 7).alias("argmax_metric_value"), r(F.col("variance_explained"), 6).alias("variance_explained"), r(F.col("max_effect_size"), 6).alias("max_effect_size"), "rank")


@query()
def swp_analysis(spark, d):
    """Friedman's test, and every configuration against the baseline with Holm's correction, in each ablation."""
    return sweep.analysis(results(spark, d), "metric")


_SHARPE = lambda c, name: f"SELECT asset, '{name}' AS config, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, count(*) FILTER ((f1 = 0 AND er > 0) OR (f1 = 1 AND er < 0)) / (count(*) - 1) AS hit FROM (SELECT asset, er, f1, CASE WHEN f1 = 0 THEN er ELSE 0 END - CASE WHEN f1 IS NULL OR f2 IS NULL OR f1 <> f2 THEN 0.0005 ELSE 0 END AS net FROM (SELECT asset, er, lag({c}) OVER {BY} AS f1, lag({c}, 2) OVER {BY} AS f2 FROM lbl)) GROUP BY 1"


@query(f"WITH {PANEL}, {_LBL}, {_ASM}, sc AS ({_SHARPE('yhat', 'fine')} UNION ALL {_SHARPE('y', 'base')}), atr AS (SELECT grp, count(DISTINCT asset) AS n_assets, avg(sharpe) FILTER (config = 'fine') - avg(sharpe) FILTER (config = 'base') AS ds, avg(hit) FILTER (config = 'fine') - avg(hit) FILTER (config = 'base') AS dh FROM sc JOIN gr USING (asset) GROUP BY 1) SELECT grp, n_assets, round(ds, 6) AS delta_sharpe, round(dh, 7) AS delta_hit_rate FROM atr")
def swp_group_attribution(spark, d):
    """What the fine labels gain over the base ones, by refit group."""
    two = labels(spark, d).unpivot(["asset", "t", "er"], ["yhat", "y"], "config", "label").withColumn("config", F.when(F.col("config") == "yhat", "fine").otherwise("base"))
    f = F.lag("label").over(Window.partitionBy("asset", "config").orderBy("t"))
    hit = two.withColumn("f", f).groupBy("asset", "config").agg((F.count(F.when(((F.col("f") == 0) & (F.col("er") > 0)) | ((F.col("f") == 1) & (F.col("er") < 0)), 1)) / (F.count(F.lit(1)) - 1)).alias("hit"))
    s = framework.timing_sharpe(two, ["asset", "config"], "t").join(hit, ["asset", "config"]).join(groups(spark, d).select("asset", "grp"), "asset")
    gain = lambda c: F.avg(F.when(F.col("config") == "fine", F.col(c))) - F.avg(F.when(F.col("config") == "base", F.col(c)))
    return s.groupBy("grp").agg(F.countDistinct("asset").alias("n_assets"), r(gain("sharpe"), 6).alias("delta_sharpe"), r(gain("hit"), 7).alias("delta_hit_rate"))


@query(f"""WITH {PANEL}, {_LBL}, lg AS (SELECT asset, dt, t, er, lag(y) OVER {BY} AS a, lag(yhat) OVER {BY} AS b FROM lbl), dy AS (SELECT 'base' AS config, dt, avg(CASE WHEN a = 0 THEN er ELSE 0 END) AS x FROM lg GROUP BY dt UNION ALL SELECT 'fine', dt, avg(CASE WHEN b = 0 THEN er ELSE 0 END) FROM lg GROUP BY dt),
 k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY dt) AS k, count(*) OVER (PARTITION BY config) AS n, product(1 + x) OVER (PARTITION BY config ORDER BY dt ROWS UNBOUNDED PRECEDING) AS w FROM dy), q AS (SELECT *, max(w) OVER (PARTITION BY config ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak, least(greatest(round_even(n * 0.6, 0), 1), n - 1) AS sp FROM k)
 SELECT config, round(product(1 + x), 8) AS terminal_wealth, round(product(CASE WHEN k <= sp THEN 1 + x ELSE 1 END), 8) AS terminal_wealth_val, round(product(CASE WHEN k > sp THEN 1 + x ELSE 1 END), 8) AS terminal_wealth_oos, CASE WHEN max(1 - w / peak) > 1e-9 THEN round(avg(x) * 252 / max(1 - w / peak), 6) END AS calmar FROM q GROUP BY 1""")
def swp_static_groups(spark, d):
    """Wealth of the equally weighted 0/1 rules of two configurations, in the choosing share of the days and after it."""
    two = labels(spark, d).unpivot(["asset", "dt", "t", "er"], ["y", "yhat"], "config", "label").withColumn("config", F.when(F.col("config") == "yhat", "fine").otherwise("base"))
    f = F.lag("label").over(Window.partitionBy("asset", "config").orderBy("t"))
    x = two.withColumn("f", f).groupBy("config", "dt").agg(F.avg(F.when(F.col("f") == 0, F.col("er")).otherwise(0.0)).alias("x"))
    w, g = Window.partitionBy("config").orderBy("dt"), 1 + F.col("x")
    k = x.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("config"))})
    k = k.withColumn("sp", F.least(F.greatest(F.bround(F.col("n") * sweep.VALIDATION), F.lit(1)), F.col("n") - 1))
    wealth = k.groupBy("config").agg(r(F.product(g)).alias("terminal_wealth"), r(F.product(F.when(F.col("k") <= F.col("sp"), g).otherwise(1.0))).alias("terminal_wealth_val"), r(F.product(F.when(F.col("k") > F.col("sp"), g).otherwise(1.0))).alias("terminal_wealth_oos"))
    return wealth.join(backtest.signed_ratios(x, ["config"], "dt", "x").select("config", r(F.col("calmar"), 6).alias("calmar")), "config")


def sweep_run(spark, d, ablation_ids: list[str], seeds: int = 1) -> DataFrame:
    p = ready(spark, d)
    x = clustering(p, model_macro(spark, d, p))
    names = [c for c in _ALL_FEATURES if not c.startswith("log_dd")]  # which all assets have
    truth = jump_model.consensus(x, names, order="dt")
    return sweep.run(x.drop("t"), truth, sweep.config_table(spark, ablation_ids), seeds, start="1998-01-01")


@query()
def swp_run_allocation(spark, d):
    """Both allocation ablations and their interaction, run through all three stages: their configurations share one fit an asset."""
    return sweep_run(spark, d, ["C1", "C2", "I2"])


@query()
def swp_run_models(spark, d):
    """The forecaster ablation, run through all three stages."""
    return sweep_run(spark, d, ["B1"])


# --------------------------------------------------------------------------------------------------- walk-forward and strategies


def walk_rows(spark, d) -> DataFrame:
    """(asset, dt, er, cluster features c_*, the classifier's columns)."""
    names = preparation.feature_columns()
    p = ready(spark, d)
    c = preparation.return_features(p, True, ()).select("asset", "dt", *[F.col(x).alias(f"c_{x}") for x in names])
    return preparation.classifier_matrix(p, model_macro(spark, d, p)).select("asset", "dt", "er", *_ALL_FEATURES).join(c, ["asset", "dt"])


WALK = framework.Walk(cluster=tuple(f"c_{x}" for x in preparation.feature_columns()), classify=tuple(_ALL_FEATURES), method="logistic_regression", smoothing={"AF": 8, "NO": 4, "RF": 2})


@query()
def fct_fixed_penalty(spark, d):
    """Walk-forward forecasts with one penalty and boosted trees."""
    from dataclasses import replace

    return framework.fixed_penalty(walk_rows(spark, d), replace(WALK, method="xgboost"), 50.0, start="1999-01-01")


@query()
def fct_dated_penalty_search(spark, d):
    """The penalty of all 31 that every asset takes at every half-yearly rebalance day, by five years of validation; logistic regression forecasts, so that the query ends in seconds."""
    return framework.search(walk_rows(spark, d), WALK)[1]


@query()
def fct_walk_forward(spark, d):
    """The forecasts that chosen penalties make for the days up to the next choice, with all 31 penalties to choose from at every rebalance day; logistic regression."""
    return framework.search(walk_rows(spark, d), WALK)[0]


#: The panel's own assets in place of 60/40's.
MIX = strategies.fixed_mix({"AF": 0.3, "NF": 0.3, "RF": 0.2, "AO": 0.1, "NO": 0.05, "RO": 0.05})


@query()
def bkt_main_run(spark, d):
    """The main run: forecasts by boosted trees, of all 31 penalties at every rebalance day, into the seven strategies and their metrics."""
    from dataclasses import replace

    panel = preparation.prepare(prices(spark, d), src.macro(spark, d)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return main_run.run(walk_rows(spark, d), panel, replace(WALK, method="xgboost"), extra={"60/40": MIX}).metrics


def strategy_panel(spark, d) -> DataFrame:
    """(asset, dt, er, ret, rf, regime, mu) on every day: the slow rule's labels as forecasts, and the mean of the days in the same state so far as the conditional mean."""
    g = preparation.prepare(prices(spark, d), src.macro(spark, d)).join(labels(spark, d).select("asset", "dt", "y"), ["asset", "dt"], "left")
    g = g.withColumn("regime", F.coalesce(forward_fill(F.col("y"), upto(order="dt")), F.lit(1)))
    same = Window.partitionBy("asset", "regime").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("asset", "dt", "er", F.coalesce("ret", F.lit(0.0)).alias("ret"), "rf", "regime", F.avg("er").over(same).alias("mu"))


@query()
def bkt_strategies(spark, d):
    """All seven strategies through the daily backtest, with their metrics."""
    p = strategy_panel(spark, d)
    return backtest.metrics(strategies.run(p, strategies.NAMES[1:], {"mix": MIX}).join(p.select("dt", "rf").distinct(), "dt"))


@query()
def prt_sensitivity(spark, d):
    """The regime mean-variance strategy under every pair of risk and trade aversion."""
    p = strategy_panel(spark, d)
    return backtest.metrics(strategies.run(p, [], strategies.sensitivity("MV(JM-XGB)")).join(p.select("dt", "rf").distinct(), "dt"))


@query(f"WITH {_TARGETS}, s AS (SELECT strategy, dt, asset, round(w, 9) AS w FROM tg) SELECT strategy, count(*) AS n, round(sum(w), 6) AS invested, count(*) FILTER (w > 0) AS held FROM s GROUP BY 1")
def bkt_plain_targets(spark, d):
    """Targets of the strategies that need no state."""
    t = targets(spark, d).withColumn("w", F.round("w", 9))
    return t.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w"), 6).alias("invested"), F.count(F.when(F.col("w") > 0, 1)).alias("held"))
