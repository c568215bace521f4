"""Sweeps of configurations: the registry, runs of all three stages, resuming, and the statistics over their results.

A run is an asset, a configuration and a seed. Configurations that differ in the allocation only share their fits: each distinct (asset, fit, seed) is one task that walks
through its refit blocks; allocation, diagnostics and metrics of all runs are then windows and aggregates over one table of predictions.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..functions.calendar import months_of, refit_blocks
from ..sources.sinks import delete, exists, upsert
from . import classifiers, diagnostics, jump_model
from .portfolio import COST
from .preparation import clustering_features

#: Most configurations of the joint sweep, the share of a run's days that serves to choose, seeds of a run.
BUDGET, VALIDATION, SEEDS = 150, 0.60, 20


@dataclass(frozen=True)
class Config:
    """One configuration; the defaults are the baseline."""

    name: str = "baseline"
    ablation_id: str = ""
    lambda_penalty: float = 50.0
    n_regimes: int = 2
    vol_estimator: str = "close_to_close"
    feature_set: str = "standard"
    forecaster_type: str = "xgboost"
    max_depth: int = 5
    n_estimators: int = 100
    gamma_risk: float = 10.0
    gamma_trade: float = 1.0
    leverage_max: float = 1.0
    recal_frequency: str = "semi-annual"


#: Names of the components, and short names of values in configuration names.
COMPONENTS = {
    "A1": "Jump Penalty λ", "A2": "Volatility Estimator", "A3": "Number of Regimes k", "B1": "Forecasting Model", "B2": "Feature Set", "C1": "Risk Aversion γ_risk",
    "C2": "Trade Aversion γ_trade", "D1": "Recalibration Frequency", "I1": "λ × Estimator (Interaction)", "I2": "γ_risk × γ_trade (Interaction)", "W1": "Joint Hyperparameter Sweep (wealth objective)",
}
ESTIMATORS = {"close_to_close": "cc", "parkinson": "pk", "yang_zhang": "yz", "garman_klass": "gk", "rogers_satchell": "rs"}
VOLATILITY_COLUMNS = {"close_to_close": "cc", "parkinson": "parkinson", "garman_klass": "gk", "rogers_satchell": "rs", "yang_zhang": "yz"}
FREQUENCIES = {"monthly": "mon", "quarterly": "qua", "semi-annual": "sem", "annual": "ann"}
FORECASTERS = {"logistic_regression": "log", "random_forest": "rf", "xgboost": "xgb", "decision_tree": "tree", "persistence": "pers"}


def _joint(budget: int = BUDGET) -> list[Config]:
    sides = [(25.0, 50.0, 100.0), ("close_to_close", "yang_zhang"), (2, 3), tuple(FREQUENCIES), ("logistic_regression", "random_forest", "xgboost")]
    if math.prod(map(len, sides)) > budget:
        raise ValueError(f"more than {budget} configurations; shorten a dimension")
    return [
        Config(f"w1_l{p:g}_{ESTIMATORS[v]}_k{k}_{FREQUENCIES[q]}_{FORECASTERS[f]}", "W1", lambda_penalty=p, vol_estimator=v, n_regimes=k, recal_frequency=q, forecaster_type=f)
        for p in sides[0] for v in sides[1] for k in sides[2] for q in sides[3] for f in sides[4]
    ]


def _registry() -> dict[str, list[Config]]:
    one = lambda a, field, pairs: [Config(n, a, **{field: v}) for n, v in pairs]
    pairs = lambda a, names, f, xs, g, ys: [Config(names(x, y), a, **{f: x, g: y}) for x in xs for y in ys]
    return {
        "A1": one("A1", "lambda_penalty", [(f"lambda_{p}", float(p)) for p in (10, 25, 50, 75, 100, 150, 200)]),
        "A2": one("A2", "vol_estimator", [("vol_cc", "close_to_close"), ("vol_parkinson", "parkinson"), ("vol_gk", "garman_klass"), ("vol_rs", "rogers_satchell"), ("vol_yz", "yang_zhang")]),
        "A3": one("A3", "n_regimes", [(f"k{k}", k) for k in (2, 3, 4)]),
        "B1": [Config("persistence", "B1", forecaster_type="persistence"), Config("logistic", "B1", forecaster_type="logistic_regression"), *[Config(f"tree_d{d}", "B1", forecaster_type="decision_tree", max_depth=d) for d in (3, 5)], Config("rf_100", "B1", forecaster_type="random_forest"), Config("xgb_default", "B1")],
        "B2": one("B2", "feature_set", [(s, s) for s in ("minimal", "standard", "extended", "kitchen_sink")]),
        "C1": one("C1", "gamma_risk", [(f"grisk_{g}", float(g)) for g in (5, 10, 15, 20, 30)]),
        "C2": one("C2", "gamma_trade", [(f"gtrade_{g:g}", g) for g in (0.0, 0.5, 1.0, 2.0, 5.0)]),
        "D1": one("D1", "recal_frequency", [(f"recal_{q.replace('-', '')}", q) for q in FREQUENCIES]),
        "I1": pairs("I1", lambda p, v: f"i1_l{p:g}_{ESTIMATORS[v]}", "lambda_penalty", (25.0, 50.0, 100.0), "vol_estimator", ("close_to_close", "parkinson", "yang_zhang")),
        "I2": pairs("I2", lambda r, t: f"i2_gr{r:g}_gt{t:g}", "gamma_risk", (5.0, 10.0, 20.0), "gamma_trade", (0.0, 1.0, 2.0)),
        "W1": _joint(),
    }


CONFIGS = _registry()


def configs_of(ablation_id: str) -> list[Config]:
    if ablation_id not in CONFIGS:
        raise ValueError(f"unknown ablation {ablation_id!r}; one of {list(CONFIGS)}")
    return CONFIGS[ablation_id]


def component(ablation_id: str) -> str:
    return COMPONENTS.get(ablation_id, ablation_id)


def config_table(spark: SparkSession, ablation_ids: list[str] | None = None) -> DataFrame:
    """All configurations as rows; the registry's own size."""
    rows = [tuple(asdict(c).values()) for a in (ablation_ids or list(CONFIGS)) for c in configs_of(a)]
    kinds = {"str": "string", "float": "double", "int": "int"}
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Config)))


FIT = ["lambda_penalty", "n_regimes", "vol_estimator", "feature_set", "forecaster_type", "max_depth", "n_estimators", "recal_frequency"]


def _fit_key(c: DataFrame) -> DataFrame:
    """c with what its fits depend on made canonical: three feature sets are one, and only some classifiers have a depth or a number of trees."""
    f = F.col("forecaster_type")
    return c.withColumns({"feature_set": F.when(F.col("feature_set") == "minimal", "minimal").otherwise("standard"), "max_depth": F.when(f.isin("decision_tree", "xgboost"), F.col("max_depth")).otherwise(0), "n_estimators": F.when(f.isin("random_forest", "xgboost"), F.col("n_estimators")).otherwise(0)})


def blocks_of_events(events: DataFrame, last, key: str = "asset", day: str = "dt") -> DataFrame:
    """(key, test_start, test_end): from every accepted refit to the day before the key's next one, or to `last`."""
    after = F.lead(day).over(Window.partitionBy(key).orderBy(day))
    return events.select(key, F.col(day).alias("test_start"), F.coalesce(F.date_sub(after, 1), F.to_date(F.lit(last))).alias("test_end"))


def predictions(features: DataFrame, fits: DataFrame, start=None, key: str = "asset", day: str = "dt", value: str = "er", least_train: int = 252, least_rows: int = 100, own_blocks: DataFrame | None = None) -> DataFrame:
    """(key, FIT columns, seed, day, pred): for every distinct fit, the forecasts of its refit blocks from `start` on; 0 bull, 1 bear. fits with the key as a column are those of that key alone.

    A key's features go to a few tasks (as many as the cluster can use, however long the list of fits), each of which loops over its share of the fits.

    features: (key, day, value, the columns of clustering_features() but vol, and a column vol_<estimator> each); fits: FIT columns and seed, a row a fit.
    Each block trains on all days before it. Days with a null feature before the first known one have no forecast. own_blocks: (key, test_start, test_end), blocks of
    each key in place of those of the fit's frequency.
    """
    spark = features.sparkSession
    every = [c for c in features.columns if c not in (key, day, value)]
    kinds = {c: features.schema[c].dataType.simpleString() for c in (key, day)}
    days = features.select(day).distinct()
    if start is not None:
        days = days.where(F.col(day) >= F.lit(start))
    blocks = {}
    for q in [r[0] for r in fits.select("recal_frequency").distinct().collect()]:  # four at most
        blocks[q] = sorted(tuple(r) for r in refit_blocks(days, months_of(q), day).collect())  # a few rows a year
    shared = spark.sparkContext.broadcast(blocks)
    if key not in fits.columns:
        fits = features.select(key).distinct().join(fits, how="cross")  # keys of a universe, fits of a sweep
    keys_n, fits_n = max(1, features.select(key).distinct().count()), fits.count()
    slots = max(1, min(-(-fits_n // keys_n), -(-4 * spark.sparkContext.defaultParallelism // keys_n)))
    shares = fits.select(key, *FIT, "seed").withColumn("_slot", (F.row_number().over(Window.partitionBy(key).orderBy(*FIT, "seed")) % slots).cast("int"))  # a sweep's own size
    rows = features.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    columns = [key, *FIT, "seed", day, "pred"]
    empty = pd.DataFrame({x: pd.Series(dtype="object") for x in columns})

    def one(pdf: pd.DataFrame, c: pd.Series, own: list | None = None) -> pd.DataFrame:
        at = pdf[day].to_numpy()
        names = [x for x in clustering_features(c["feature_set"], pdf["log_dd_hl5"].notna().any()) if x != "vol"]
        x = pdf[names].assign(vol=pdf["vol_" + c["vol_estimator"]]) if c["feature_set"] != "minimal" else pdf[names]
        x, r, out = x.to_numpy(float), pdf[value].to_numpy(float), []
        whole = np.isfinite(x).all(1)
        for lo, hi in [x[1:] for x in shared.value[c["recal_frequency"]]] if own is None else own:
            train, test = np.flatnonzero((at < lo) & whole), np.flatnonzero((at >= lo) & (at <= hi) & whole)
            if (at < lo).sum() < least_train or len(train) < least_rows or not len(test):
                continue
            labels, _ = jump_model.fit(x[train], int(c["n_regimes"]), float(c["lambda_penalty"]), seed=int(c["seed"]))
            y = jump_model.bear_labels(labels, r[train], int(c["n_regimes"]))
            if c["forecaster_type"] == "persistence":
                pred = np.full(len(test), y[-1])
            else:
                target = np.append(y[1:], y[-1])
                pred = (classifiers.probabilities(c["forecaster_type"], x[train], target, x[test], int(c["max_depth"]), int(c["n_estimators"])) >= 0.5).astype(int)
            out.append(pd.DataFrame({day: at[test], "pred": pred}))
        if not out:
            return empty
        return pd.concat(out).assign(**{k: c[k] for k in [key, *FIT, "seed"]})[columns]

    def share(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        left = left.sort_values(day)
        own = None
        if "_own" in right.columns:
            own = sorted((x["test_start"], x["test_end"]) for x in (right["_own"].iloc[0] if right["_own"].iloc[0] is not None else []))
        got = [one(left, c, own) for _, c in right.iterrows()]
        got = [g for g in got if len(g)]
        return pd.concat(got) if got else empty

    if own_blocks is not None:
        given = own_blocks.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("test_start", "test_end")).alias("_own"))  # a key's refits
        shares = shares.join(given, F.col(key) == F.col("_key"), "left").drop("_key")
    shares = shares.toDF(*shares.columns)  # columns of its own
    schema = f"{key} {kinds[key]}, " + ", ".join(f"{c} {fits.schema[c].dataType.simpleString()}" for c in [*FIT, "seed"]) + f", {day} {kinds[day]}, pred int"
    dealt = lambda x: x.repartition(min(2000, 3 * slots * keys_n), key, "_slot")  # noqa: E731  a share is a task's work for seconds, whatever its bytes
    return dealt(rows).groupBy(key, "_slot").cogroup(dealt(shares).groupBy(key, "_slot")).applyInPandas(share, schema)


#: Metrics of a run, in the order of the results table.
METRICS = [
    "add", "miss_rate", "false_alarm_rate", "cp_accuracy", "cp_balanced_accuracy", "accuracy", "state_accuracy", "state_balanced_accuracy", "f1_score", "total_return", "volatility", "sharpe_ratio",
    "sortino_ratio", "max_drawdown", "calmar_ratio", "turnover", "terminal_wealth", "terminal_wealth_val", "terminal_wealth_oos", "n_position_switches", "regime_ari", "regime_agreement", "mean_run_length",
]


def allocated(days: DataFrame, keys: list[str], day: str = "dt", value: str = "er", cost: float = COST) -> DataFrame:
    """days (keys, day, pred, value, gamma_risk, gamma_trade, leverage_max) with net: hold 10 / gamma_risk of the asset, leverage at most, on bullish days; pay for changes of position."""
    w = Window.partitionBy(*keys).orderBy(day)
    scale = F.when(F.col("gamma_risk") > 0, 10.0 / F.col("gamma_risk")).otherwise(1.0)
    position = (1 - F.col("pred")) * F.greatest(F.lit(0.0), F.least(scale, F.greatest(F.col("leverage_max"), F.lit(0.0))))
    d = days.withColumn("_pos", position)
    return d.withColumn("net", F.col("_pos") * F.col(value) - F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(w), F.lit(0.0))) * cost * (1 + F.col("gamma_trade"))).drop("_pos")


def run_metrics(days: DataFrame, keys: list[str], rate: float = 0.0, day: str = "dt") -> DataFrame:
    """(keys, METRICS) of allocated days (keys, day, true, pred, net); rate: the mean daily risk-free rate."""
    w, whole = Window.partitionBy(*keys).orderBy(day), Window.partitionBy(*keys)
    d = diagnostics.with_changes(days, "true", "pred", keys, day)
    g, n = 1 + F.col("net"), F.count(F.lit(1))
    d = d.withColumns({"_n": n.over(whole), "_k": F.row_number().over(w), "_wealth": F.product(g).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    # round half to even
    share = F.bround(F.col("_n") * VALIDATION)
    split = F.least(F.greatest(share, F.lit(1)), F.col("_n") - 1)
    x, year = F.col("net") - F.lit(rate), F.sqrt(F.lit(252.0))
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    sd, mdd = F.stddev_samp("net"), F.min(F.col("_wealth") / F.col("_peak") - 1)
    step = F.abs(F.col("pred") - F.coalesce(F.lag("pred").over(w), F.lit(0)))
    d = d.withColumn("_step", step).withColumn("_split", split)
    a = diagnostics.aggregates("true", "pred")
    columns = {
        "add": a["add"], "miss_rate": a["miss_rate"], "false_alarm_rate": a["far"], "cp_accuracy": a["cp_accuracy"], "cp_balanced_accuracy": a["cp_balanced_accuracy"], "accuracy": a["state_accuracy"],
        "state_accuracy": a["state_accuracy"], "state_balanced_accuracy": a["state_balanced_accuracy"], "f1_score": diagnostics.f1(F.col("true"), F.col("pred")), "total_return": F.avg("net") * 252, "volatility": sd * year,
        "sharpe_ratio": F.when((n >= 2) & (sd >= 1e-12), F.avg(x) / sd * year).otherwise(0.0), "sortino_ratio": F.when((n >= 2) & (down >= 1e-12), F.avg(x) * 252 / (down * year)).otherwise(0.0), "max_drawdown": mdd,
        "calmar_ratio": F.when(F.abs(mdd) >= 1e-10, F.abs(F.avg(x) * 252) / F.abs(mdd)).otherwise(0.0), "turnover": F.avg("_step") * 252, "terminal_wealth": F.product(g),
        "terminal_wealth_val": F.when(n >= 2, F.product(F.when(F.col("_k") <= F.col("_split"), g).otherwise(1.0))), "terminal_wealth_oos": F.when(n >= 2, F.product(F.when(F.col("_k") > F.col("_split"), g).otherwise(1.0))),
        "n_position_switches": F.sum("_step").cast("double"), "regime_ari": a["ari"], "regime_agreement": a["concordance"], "mean_run_length": a["mrl_all"],
    }
    return d.groupBy(*keys).agg(*[columns[m].alias(m) for m in METRICS])


def run(features: DataFrame, truth: DataFrame, configs: DataFrame, seeds: int = SEEDS, done: DataFrame | None = None, rate: float = 0.0, start=None, key: str = "asset", day: str = "dt", value: str = "er", own_blocks: DataFrame | None = None) -> DataFrame:
    """(ablation_id, key, config, seed, METRICS), one row for every run that has a forecast: assets x configurations x seeds, less those in done (key, config, seed, and ablation_id if it has that).

    truth: (key, day, regime), the labels that predictions are judged by; filled forward, 0 before the first. configs: rows of config_table(). own_blocks: as in predictions(); with
    blocks_of_events(), runs refit when events say so.
    """
    c = _fit_key(configs).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    runs = features.select(key).distinct().crossJoin(F.broadcast(c)).withColumnRenamed("name", "config")  # assets x a sweep's own size
    if done is not None:
        same = [c for c in ("ablation_id", key, "config", "seed") if c in done.columns]
        runs = runs.join(done.select(*same).distinct(), same, "left_anti")
    fits = runs.select(key, *FIT, "seed").distinct()
    pred = predictions(features, fits, start, key, day, value, own_blocks=own_blocks)
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    known = features.select(key, day, value).join(truth.select(key, day, F.col("regime").alias("_t")), [key, day], "left").withColumn("true", F.coalesce(F.last("_t", ignorenulls=True).over(w), F.lit(0)))
    days = pred.join(known.select(key, day, F.coalesce(value, F.lit(0.0)).alias(value), "true"), [key, day])
    keys = ["ablation_id", key, "config", "seed"]
    all_days = days.join(F.broadcast(runs.select(*keys, *[x for x in FIT], "gamma_risk", "gamma_trade", "leverage_max")), [key, *FIT, "seed"])  # assets x a sweep's own size
    return run_metrics(allocated(all_days, keys, day, value), keys, rate, day)


def ledger(features: DataFrame, truth: DataFrame, configs: DataFrame, path: str, seeds: int = SEEDS, batch: int = 64, key: str = "asset", **settings) -> DataFrame:
    """run(), committed batch by batch at path: results, one folder a configuration and seed, and the runs that are through. A sweep that is killed goes on with the runs that are left, and gives the same table.

    A batch is `batch` (configuration, seed) pairs, in order. Its results are written first, replacing what a batch that broke off left there; then its runs are entered, with or without a
    forecast. Batches whose runs are all entered are not run again.
    """
    spark, root = features.sparkSession, path.rstrip("/")
    entered = "ablation_id string, config string, seed int"
    pairs = configs.select("ablation_id", F.col("name").alias("config")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    if exists(spark, f"{root}/entered"):
        pairs = pairs.join(spark.read.schema(entered).parquet(f"{root}/entered"), ["ablation_id", "config", "seed"], "left_anti")
    left = sorted(tuple(r) for r in pairs.collect())  # a sweep's own size
    for lo in range(0, len(left), batch):
        now = spark.createDataFrame(left[lo : lo + batch], entered)
        some = configs.join(now.select("ablation_id", F.col("config").alias("name")).distinct(), ["ablation_id", "name"], "left_semi").select(*configs.columns)
        # of these configurations, the runs of other seeds count as done
        every = some.select(F.col("name").alias("config"), "ablation_id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
        others = every.join(now, ["ablation_id", "config", "seed"], "left_anti").join(features.select(key).distinct(), how="cross")
        got = run(features, truth, some, seeds, done=others.select("ablation_id", key, "config", "seed"), key=key, **settings)
        upsert(got.select(key, *METRICS, "ablation_id", "config", "seed"), f"{root}/results", ["ablation_id", "config", "seed"])
        now.coalesce(1).write.mode("append").parquet(f"{root}/entered")
    schema = ", ".join([f"{key} {features.schema[key].dataType.simpleString()}", *[f"{m} double" for m in METRICS], entered])
    found = spark.read.schema(schema).parquet(f"{root}/results") if exists(spark, f"{root}/results") else spark.createDataFrame([], schema)
    return found.select("ablation_id", key, "config", "seed", *METRICS)


def study(features: DataFrame, truth: DataFrame, folder: str, ablation_ids: list[str] | None = None, **settings) -> dict[str, DataFrame]:
    """Every ablation's results, one Parquet table each in the folder; a table that is there already is read, not run again, and one that broke off half-way goes on from its ledger."""
    from ..sources.sinks import write_results

    spark, out = features.sparkSession, {}
    for a in ablation_ids or list(CONFIGS):
        path = f"{folder.rstrip('/')}/ablation_{a}.parquet"
        if not exists(spark, path):
            begun = f"{folder.rstrip('/')}/_begun_{a}"
            write_results(ledger(features, truth, config_table(spark, [a]), begun, **settings), path)
            delete(spark, begun)
        out[a] = spark.read.parquet(path)
    return out


# ------------------------------------------------------------------------------------------------------------------------ statistics

#: Metrics of which less is better.
LOWER = {"add", "miss_rate", "false_alarm_rate", "max_drawdown", "volatility", "turnover", "n_position_switches"}


def ranking(results: DataFrame, metric: str, tie_breaks: tuple[tuple[str, bool], ...] = (("max_drawdown", True), ("turnover", False)), higher: bool | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, config, mean of the metric and of the tie-breaks, place): configurations by their mean, best first; ties by the tie-breaks (column, whether higher is better), then by name."""
    higher, by = metric not in LOWER if higher is None else higher, by or []
    ties = [(c, up) for c, up in tie_breaks if c in results.columns and c != metric]
    m = results.groupBy(*by, "config").agg(F.avg(metric).alias(metric), *[F.avg(c).alias(c) for c, _ in ties])
    order = [F.desc_nulls_last(metric) if higher else F.asc_nulls_last(metric), *[F.desc_nulls_last(c) if up else F.asc_nulls_last(c) for c, up in ties], F.col("config")]
    return m.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def paired(results: DataFrame, metric: str, baseline: str, by: list[str] | None = None, key: str = "asset") -> DataFrame:
    """(by, config, key, base, value): each configuration's mean of the metric in an asset beside the baseline's."""
    by = by or []
    m = results.where(F.col(metric).isNotNull()).groupBy(*by, key, "config").agg(F.avg(metric).alias("value"))
    b = m.where(F.col("config") == baseline).select(*by, key, F.col("value").alias("base"))
    return m.where(F.col("config") != baseline).join(b, [*by, key])


def comparisons(pairs: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """(by, n, mean_baseline, mean_config, mean_diff, wilcoxon, ties, cohens_d) of pairs (by, base, value); groups of fewer than `least` pairs are left out.

    wilcoxon: the smaller signed-rank sum of the differences that are not 0 (rounded to 12 places, so that equal ones tie); ties: whether any are equal in size or 0.
    """
    d = pairs.withColumn("_d", F.round(F.col("value") - F.col("base"), 12))
    w = Window.partitionBy(*by, F.col("_d") != 0)
    d = d.withColumn("_a", F.abs("_d")).withColumn("_rk", F.rank().over(w.orderBy("_a")) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "_a")) - 1) / 2)
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("_rk"))), F.lit(0.0))
    used = F.count(F.when(F.col("_d") != 0, 1))
    pooled = F.sqrt((F.var_samp("value") + F.var_samp("base")) / 2)
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), used.alias("n_used"), F.avg("base").alias("mean_baseline"), F.avg("value").alias("mean_config"), F.least(side(F.col("_d") > 0), side(F.col("_d") < 0)).alias("wilcoxon"),
        ((F.countDistinct("_a") < F.count(F.lit(1))) | (used < F.count(F.lit(1)))).alias("ties"), F.when(pooled > 1e-12, (F.avg("value") - F.avg("base")) / pooled).otherwise(0.0).alias("cohens_d"))
    return a.where(F.col("n") >= least).withColumn("mean_diff", F.col("mean_config") - F.col("mean_baseline"))


def friedman(results: DataFrame, metric: str, by: list[str], key: str = "asset") -> DataFrame:
    """(by, k, n, chi2): Friedman's statistic over configurations, with assets that have all of them as blocks and ties corrected for."""
    m = results.groupBy(*by, key, "config").agg(F.avg(metric).alias("_m")).where("_m IS NOT NULL")
    block = Window.partitionBy(*by, key)
    m = m.withColumn("_k", F.count(F.lit(1)).over(block)).withColumn("_all", F.max("_k").over(Window.partitionBy(*by)) if by else F.max("_k").over(Window.partitionBy(F.lit(0)))).where("_k = _all")
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, key, "_m"))
    r = m.withColumn("_rk", F.rank().over(block.orderBy("_m")) + (tied - 1) / 2).withColumn("_tie", F.pow(tied, 2) - 1)
    s = r.groupBy(*by, "config").agg(F.sum("_rk").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("_tie").alias("tie"))
    t = s.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("tie").alias("tie"))
    raw = 12 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("q") - 3 * F.col("n") * (F.col("k") + 1)
    fix = 1 - F.col("tie") / (F.col("n") * (F.pow("k", 3) - F.col("k")))
    return t.select(*by, "k", "n", F.when(fix > 0, raw / fix).alias("chi2"))


def variance_split(results: DataFrame, metric: str, by: list[str], key: str = "asset") -> DataFrame:
    """(by, config_contribution, asset_contribution, residual): mean sample variance over assets within a configuration, and over configurations within an asset, as shares of all runs' variance."""
    total = results.groupBy(*by).agg(F.var_samp(metric).alias("v"))
    m = results.groupBy(*by, key, "config").agg(F.avg(metric).alias("m"))
    mean = lambda k, name: m.groupBy(*by, k).agg(F.var_samp("m").alias("x")).groupBy(*by).agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias(name))
    d = total.join(mean("config", "c"), by).join(mean(key, "a"), by)
    share = lambda x: F.when(F.col("v") > 0, F.col(x) / F.col("v")).otherwise(0.0)
    return d.select(*by, share("c").alias("config_contribution"), share("a").alias("asset_contribution"), F.greatest(F.lit(0.0), 1 - (F.col("c") + F.col("a")) / F.greatest("v", F.lit(1e-12))).alias("residual"))


def analysis(results: DataFrame, metric: str, by: str = "ablation_id", alpha: float = 0.05, baseline: str | None = None) -> DataFrame:
    """(by, n_configs, friedman_p, significant, config, p_value, p_holm, rejected, ...): every comparison with the baseline in each ablation, one row a configuration.

    The baseline is `baseline`, or the first name. An ablation whose Friedman test isn't significant has its comparisons too, with rejected false. p-values come
    from a helper over the comparisons, which are one row a configuration.
    """
    base = results.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("config") == (baseline or "baseline"), F.col("config"))), F.min("config")).alias("_base"), F.countDistinct("config").alias("n_configs"))
    m = results.where(F.col(metric).isNotNull()).join(F.broadcast(base), by).groupBy(by, "asset", "config", "_base").agg(F.avg(metric).alias("value"))  # one row an ablation
    b = m.where("config = _base").select(by, "asset", F.col("value").alias("base"))
    c = comparisons(m.where("config <> _base").join(b, [by, "asset"]), [by, "config"]).join(friedman(results, metric, [by]).select(by, "k", "chi2"), by).join(F.broadcast(base), by)
    schema = f"{by} string, config string, vs_baseline string, n_configs long, friedman_p double, significant boolean, n long, mean_diff double, wilcoxon double, p_value double, p_holm double, rejected boolean, cohens_d double"

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = inference.chi2_tail(float(pdf["chi2"].iloc[0]), int(pdf["k"].iloc[0]) - 1) if pdf["k"].iloc[0] >= 3 and pdf["chi2"].notna().iloc[0] else 1.0
        p = [inference.wilcoxon_p(w, int(n), bool(t)) for w, n, t in zip(pdf["wilcoxon"], pdf["n_used"], pdf["ties"], strict=True)]
        order = np.argsort(p, kind="stable")
        held, adjusted, rejected = True, [0.0] * len(p), [False] * len(p)
        for k, i in enumerate(order.tolist()):
            held = held and p[i] <= alpha / (len(p) - k)
            adjusted[i], rejected[i] = min(1.0, p[i] * (len(p) - k)), held
        return pd.DataFrame({by: pdf[by].astype(str), "config": pdf["config"], "vs_baseline": pdf["_base"], "n_configs": pdf["n_configs"], "friedman_p": fp, "significant": fp < alpha, "n": pdf["n"], "mean_diff": pdf["mean_diff"], "wilcoxon": pdf["wilcoxon"], "p_value": p, "p_holm": adjusted, "rejected": [x and fp < alpha for x in rejected], "cohens_d": pdf["cohens_d"]})

    return c.groupBy(by).applyInPandas(judge, schema)


def compare(results: DataFrame, metric: str, by: str = "ablation_id") -> DataFrame:
    """One row an ablation, by the share of variance its configurations explain: size, best configuration by mean, largest difference and effect against the baseline, place."""
    v = variance_split(results, metric, [by])
    top = ranking(results, metric, by=[by]).where("place = 1").select(by, F.col("config").alias("argmax_config"), F.col(metric).alias("argmax_metric_value"))
    base = results.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("config") == "baseline", F.col("config"))), F.min("config")).alias("_base"), F.countDistinct("config").alias("n_configs"))
    m = results.where(F.col(metric).isNotNull()).join(F.broadcast(base), by).groupBy(by, "asset", "config", "_base").agg(F.avg(metric).alias("value"))  # one row an ablation
    c = comparisons(m.where("config <> _base").join(m.where("config = _base").select(by, "asset", F.col("value").alias("base")), [by, "asset"]), [by, "config"])
    most = c.groupBy(by).agg(F.max_by(F.struct("config", "mean_diff"), F.struct(F.abs("mean_diff"), "config")).alias("b"), F.max(F.abs("cohens_d")).alias("max_effect_size"))
    d = base.join(v, by).join(top, by).join(most, by, "left")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("config_contribution"), by))  # one row an ablation
    return d.select(by, "n_configs", F.coalesce("b.config", F.lit("baseline")).alias("best_config_vs_baseline"), F.coalesce("b.mean_diff", F.lit(0.0)).alias("mean_diff_vs_baseline"), "argmax_config", "argmax_metric_value", F.col("config_contribution").alias("variance_explained"), F.coalesce("max_effect_size", F.lit(0.0)).alias("max_effect_size"), place.alias("rank"))


def all_pairs(results: DataFrame, metric: str, key: str = "asset", alpha: float = 0.05) -> DataFrame:
    """(config_a, config_b, mean_a, mean_b, delta, wilcoxon, n, p_value, cohens_d, reject_h0, significance) of every pair of configurations, paired by asset."""
    m = results.where(F.col(metric).isNotNull()).groupBy(key, "config").agg(F.avg(metric).alias("value"))
    a = m.select(key, F.col("config").alias("config_b"), F.col("value").alias("base"))
    b = m.select(key, F.col("config").alias("config_a"), "value")
    c = comparisons(b.join(a, key).where("config_a < config_b"), ["config_a", "config_b"], 1)

    def tails(batches):
        for x in batches:
            p = [inference.wilcoxon_p(w, int(n), bool(t)) if k >= 5 else None for w, n, t, k in zip(x["wilcoxon"], x["n_used"], x["ties"], x["n"], strict=True)]
            yield x[["config_a", "config_b"]].assign(p_value=p)

    p = c.select("config_a", "config_b", "wilcoxon", "n_used", "ties", "n").mapInPandas(tails, "config_a string, config_b string, p_value double")
    d = c.join(p, ["config_a", "config_b"])
    stars = F.when(F.col("p_value").isNull(), "n.a.").when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("ns")
    return d.select("config_a", "config_b", F.col("mean_config").alias("mean_a"), F.col("mean_baseline").alias("mean_b"), F.col("mean_diff").alias("delta"), "wilcoxon", "n", "p_value", "cohens_d", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("reject_h0"), stars.alias("significance"))
