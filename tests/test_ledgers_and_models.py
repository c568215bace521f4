"""Sweeps that resume in the middle, silhouettes tile by tile, replicates as rows, estimators that are saved, copied and cross-validated, tables of differing types."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tidemark.operators import covariance, estimators, preparation, resampling, stability, sweep
from tidemark.sources import tables

R = np.random.default_rng(31)


def sweep_input(spark, n: int = 420):
    days, parts = pd.bdate_range("2010-01-04", periods=n), []
    names = [*preparation.feature_columns(), *preparation.MACRO_FEATURES]
    for a in range(2):
        bear = (np.arange(n) // 50 + a) % 2
        er = np.where(bear, -0.004, 0.004) + R.normal(0, 0.004, n)
        f = pd.Series(er).ewm(halflife=5).mean().to_numpy() * 100
        data = {c: f * (i + 1) ** 0.5 + R.normal(size=n) * 0.1 for i, c in enumerate(names)} | {f"vol_{v}": np.abs(er) * 50 + i for i, v in enumerate(sweep.VOLATILITY_COLUMNS)}
        parts.append(pd.DataFrame({"asset": f"a{a}", "dt": [d.date() for d in days], "er": er, **data}))
    pdf = pd.concat(parts, ignore_index=True)
    truth = pdf[["asset", "dt"]].assign(regime=(np.tile(np.arange(n), 2) // 50) % 2)
    return spark.createDataFrame(pdf), spark.createDataFrame(truth)


def rows_of(df):
    return sorted(tuple(None if isinstance(v, float) and np.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_a_killed_sweep_goes_on(spark, tmp_path, monkeypatch):
    """Killed after the second of three batches, whose results were written but not entered: the rest is run, nothing twice in the table."""
    features, truth = sweep_input(spark)
    configs = sweep.config_table(spark, ["B1", "C1"]).where("name in ('persistence', 'logistic', 'grisk_5')").withColumn("forecaster_type", F.when(F.col("ablation_id") == "C1", "logistic_regression").otherwise(F.col("forecaster_type")))
    path, whole, calls = str(tmp_path / "sweep"), sweep.run, []

    def counted(*args, **settings):
        calls.append(settings)
        return whole(*args, **settings)

    monkeypatch.setattr(sweep, "run", counted)
    put = sweep.upsert

    def dies(df, where, by):
        put(df, where, by)
        if len(calls) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(sweep, "upsert", dies)
    with pytest.raises(KeyboardInterrupt):
        sweep.ledger(features, truth, configs, path, seeds=2, batch=2, start="2011-03-01")
    assert spark.read.parquet(f"{path}/entered").count() == 2 and len(calls) == 2
    monkeypatch.setattr(sweep, "upsert", put)
    got = sweep.ledger(features, truth, configs, path, seeds=2, batch=2, start="2011-03-01")
    assert len(calls) == 4  # the second batch again, then the third
    want = whole(features, truth, configs, 2, start="2011-03-01").select(*got.columns)
    assert rows_of(got) == rows_of(want) and got.count() == 2 * 3 * 2
    sweep.ledger(features, truth, configs, path, seeds=2, batch=2, start="2011-03-01")
    assert len(calls) == 4


def test_features_are_copied_once_a_share(spark):
    """30 fits an asset travel in few shares: what a fit sees does not depend on how they are dealt."""
    features, truth = sweep_input(spark)
    configs = sweep.config_table(spark, ["B1"]).where("name in ('persistence', 'logistic')")
    few = sweep.run(features, truth, configs, 3, start="2011-03-01")
    alone = [sweep.run(features.where(F.col("asset") == a), truth, configs, 3, start="2011-03-01") for a in ("a0", "a1")]
    assert rows_of(few) == sorted(rows_of(alone[0]) + rows_of(alone[1])) and few.count() == 12


@pytest.mark.parametrize(("block", "wide"), [(16, 1), (64, 3), (4096, 8)])
def test_tiled_silhouette(spark, block, wide):
    parts = []
    for k, n, kinds in (("a", 300, 3), ("b", 50, 2), ("c", 20, 1)):
        y = R.integers(0, kinds, n)
        x = R.normal(size=(n, 3)) + y[:, None]
        parts.append(pd.DataFrame({"k": k, "y": y, "f": x[:, 0], "g": x[:, 1], "h": x[:, 2]}))
    parts.append(pd.DataFrame({"k": "d", "y": [0, 1, 1], "f": [1.0, 1.0, 1.0], "g": [0.0, 0.0, 0.0], "h": [0.0, 0.0, 0.0]}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", 1, None, 1.0, 1.0)], "k string, y int, f double, g double, h double")).repartition(3)
    got = {r.k: r for r in stability.silhouette_tiled(df, ["f", "g", "h"], "y", ["k"], block, wide).collect()}
    for k, g in pdf.groupby("k"):
        want = stability.mean_silhouette(g[["f", "g", "h"]].to_numpy(), g.y.to_numpy())
        assert got[k].n == len(g) and (got[k].silhouette is None if np.isnan(want) else got[k].silhouette == pytest.approx(want))


def test_replicates(spark):
    """The same on any partitions and in any chunks; by plain loops; runs of rows stay together."""
    x = {"a": R.normal(0.001, 0.01, 120), "b": R.normal(0, 0.02, 40)}
    df = spark.createDataFrame([(k, i, float(v)) for k in x for i, v in enumerate(x[k])] + [("b", 99, None)], "asset string, t int, er double")
    for block in (1, 7):
        one = rows_of(resampling.replicates(df.repartition(1), ["er"], resampling.sharpe, 60, block))
        assert one == rows_of(resampling.replicates(df.repartition(7, "t"), ["er"], resampling.sharpe, 60, block, chunk=13)) and len(one) == 2 * 61
        for k, r, v in one:
            at = np.arange(len(x[k])) if r < 0 else resampling.drawn(len(x[k]), block, resampling.generator(k, r, 42))
            assert v == pytest.approx(resampling.sharpe(x[k][at]), abs=1e-8)
    at = resampling.drawn(40, 10, resampling.generator("a", 0, 1))
    assert len(at) == 40 and ((np.diff(at) % 40 == 1).sum() >= 36) and len(resampling.drawn(45, 10, resampling.generator("a", 0, 1))) == 45
    i = {r.asset: r for r in resampling.intervals(resampling.replicates(df, ["er"], resampling.sharpe, 400)).collect()}
    assert i["a"].lo < i["a"].value < i["a"].hi and i["a"].n == 400 and i["a"].value == pytest.approx(resampling.sharpe(x["a"]))
    assert resampling.replicates(df, ["er"], resampling.sharpe, 0).count() == 2


def series(spark, n: int = 260):
    parts = []
    for a in range(2):
        bear = (np.arange(n) // 40 + a) % 2
        er = np.where(bear, -0.004, 0.004) + R.normal(0, 0.003, n)
        parts.append(pd.DataFrame({"asset": f"a{a}", "t": np.arange(n), "er": er, "f1": pd.Series(er).ewm(halflife=4).mean() * 100, "f2": er * 50, "fold": np.arange(n) * 2 // n}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = series(spark)
    jump = estimators.JumpModel(["f1", "f2"], penalty=3.0, seed=1)
    jump.write().overwrite().save(str(tmp_path / "jump"))
    again = estimators.JumpModel.load(str(tmp_path / "jump"))
    assert again.uid == jump.uid and {p.name: again.getOrDefault(p) for p in again.params} == {p.name: jump.getOrDefault(p) for p in jump.params}
    model = again.fit(df)
    model.save(str(tmp_path / "model"))
    back = estimators.JumpModelModel.load(str(tmp_path / "model"))
    assert rows_of(back.transform(df)) == rows_of(model.transform(df)) and rows_of(back.labels) == rows_of(model.labels) and back.getOrDefault("penalty") == 3.0
    dear = jump.copy({jump.penalty: 1e6})
    assert dear.getOrDefault("penalty") == 1e6 and jump.getOrDefault("penalty") == 3.0 and dear.fit(df).labels.groupBy("asset").agg(F.countDistinct("state").alias("n")).where("n > 1").count() == 0
    target = df.withColumn("target", F.when(F.col("f1") < 0, 1).otherwise(0))
    for rows in (target, target.withColumn("target", F.lit(1))):
        path = str(tmp_path / f"trees{rows is target}")
        fitted = estimators.RegimeForecaster(["f1", "f2"], trees=3, depth=2, smooth=2.0, key="asset").fit(rows)
        fitted.write().overwrite().save(path)
        assert rows_of(estimators.RegimeForecasterModel.load(path).transform(rows)) == rows_of(fitted.transform(rows))


def test_models_in_a_pipeline(spark, tmp_path):
    """Regimes and then forecasts of them as one pipeline, saved whole; the penalty chosen by cross-validation over blocks of days."""
    df = series(spark)
    pipe = Pipeline(stages=[estimators.JumpModel(["f1", "f2"], penalty=3.0), estimators.RegimeForecaster(["f1", "f2"], label="state", trees=2, depth=2, smooth=0.0)])
    fitted = pipe.fit(df)
    fitted.write().overwrite().save(str(tmp_path / "pipe"))
    assert rows_of(PipelineModel.load(str(tmp_path / "pipe")).transform(df)) == rows_of(fitted.transform(df))
    jump = estimators.JumpModel(["f1", "f2"])
    grid = ParamGridBuilder().addGrid(jump.penalty, [2.0, 1e6]).build()
    best = CrossValidator(estimator=jump, estimatorParamMaps=grid, evaluator=estimators.TimingEvaluator(), numFolds=2, foldCol="fold").fit(df)
    assert best.bestModel.getOrDefault("penalty") == 2.0 and best.avgMetrics[0] > best.avgMetrics[1]
    two = df.where("asset = 'a0' and t < 3").select("asset", "t", F.lit(0.01).alias("er"), F.lit(0).alias("regime"))
    assert estimators.TimingEvaluator(cost=0.001).evaluate(two) == pytest.approx(np.mean([0, 0.009, 0.01]) / np.std([0, 0.009, 0.01], ddof=1) * 252**0.5)


def test_tables_of_differing_types(spark, tmp_path):
    a = spark.createDataFrame([(1, 2, "x", dt.date(2020, 1, 2))], "k int, v int, s string, d date")
    b = spark.createDataFrame([(2**40, 2.5, dt.datetime(2020, 1, 2, 3))], "k long, v double, d timestamp")
    c = spark.createDataFrame([(7, True, 1.5)], "s int, v boolean, extra float")
    for i, df in enumerate((a, a, b, c)):
        df.coalesce(1).write.parquet(str(tmp_path / f"t{i}.parquet"))
    two = tables.read_reconciled(spark, str(tmp_path / "t[0-2].parquet"))
    assert dict(two.dtypes) == {"k": "bigint", "v": "double", "s": "string", "d": "timestamp"} and two.count() == 3
    assert sorted(r.v for r in two.collect()) == [2.0, 2.0, 2.5] and two.where("k > 9").first().s is None
    every = tables.read_reconciled(spark, str(tmp_path / "t*.parquet"))
    assert dict(every.dtypes)["v"] == "string" and {r.s for r in every.collect()} == {"x", None, "7"}
    assert [tables.common_type(x) for x in (["int", "float"], ["smallint", "float"], ["int", "bigint"], [], ["void", "int"], ["decimal(5,2)", "int"])] == ["double", "float", "bigint", "string", "int", "string"]
    with pytest.raises(ValueError):
        tables.read_reconciled(spark, str(tmp_path / "none*.parquet"))


def test_one_table_or_a_folder_of_two(spark, tmp_path):
    r, m = spark.createDataFrame([(1, 0.5)], "t int, er double"), spark.createDataFrame([(1, 3.0), (2, 4.0)], "t int, vix double")
    r.write.parquet(str(tmp_path / "two/returns.parquet"))
    m.write.parquet(str(tmp_path / "two/macro.parquet"))
    tables.reconciled([r.withColumn("part", F.lit("returns")), m.withColumn("part", F.lit("macro"))]).write.parquet(str(tmp_path / "one"))
    for where in ("two", "one"):
        got = tables.one_or_parts(spark, str(tmp_path / where), ("returns", "macro"))
        assert [(p, df.columns, sorted(map(tuple, df.collect()))) for p, df in got.items()] == [("returns", ["t", "er"], [(1, 0.5)]), ("macro", ["t", "vix"], [(1, 3.0), (2, 4.0)])]
        with pytest.raises(ValueError):
            tables.one_or_parts(spark, str(tmp_path / where), ("returns", "prices"))


def test_series_of_several_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/b.csv").write_text("DATE,VALUE,AT\n2020-01-01,1,2\n2020-01-02,5,1\n")
    (tmp_path / "s/a.csv").write_text("DATE,VALUE,AT\n2020-01-01,9,1\n2020-01-02,.,3\n")
    got = tables.series_csv(spark, str(tmp_path / "s"), "DATE", "VALUE", "AT").orderBy("dt").collect()
    assert [r.v for r in got] == [1.0, None]


def test_covariances_by_blocks(spark):
    """A universe of seven keys in blocks of three, 40 days in spans of 16, with days that a key lacks: pandas' ewm covariance of the filled panel."""
    days = pd.bdate_range("2020-01-01", periods=40)
    x = pd.DataFrame(R.normal(size=(40, 7)), index=days, columns=[f"k{i}" for i in range(7)])
    x["k1"] += x["k0"]
    x = x.mask(R.random(x.shape) < 0.1)
    rows = [(k, d.date(), None if np.isnan(v) else float(v)) for k in x for d, v in x[k].items()]
    df = spark.createDataFrame(rows, "asset string, dt date, er double").repartition(3)
    want = x.fillna(0).ewm(halflife=9).cov().iloc[-7:].to_numpy()
    for block, span in ((3, 16), (256, 512), (1, 40)):
        got = covariance.ewm_covariance(df, 9, block=block, span=span).collect()
        assert len(got) == 28 and all(r.covariance == pytest.approx(want[int(r.a[1]), int(r.b[1])], abs=1e-10) for r in got)
    assert covariance.ewm_covariance(df.where("dt = '2020-01-01'"), 9).where("covariance is not null").count() == 0


def test_a_universe_of_two_thousand(spark):
    """2,000 assets over 30 days: 36 tiles, no group over two blocks of 256; the diagonal against aggregates."""
    u = spark.range(2000).select(F.col("id").alias("asset"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t")).select("asset", F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("t")).alias("dt"), (F.pmod(F.xxhash64("asset", "t"), F.lit(1000)) / 1000.0).alias("er"))
    c = covariance.ewm_covariance(u, 1e9)
    assert c.count() == 2000 * 2001 // 2
    plain = u.groupBy("asset").agg(F.var_samp("er").alias("v"))
    off = c.where("a = b").join(plain, F.col("a") == F.col("asset")).agg(F.max(F.abs(F.col("covariance") - F.col("v")))).first()[0]
    assert off < 1e-6
