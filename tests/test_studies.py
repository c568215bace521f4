"""Operators that SQL can't express against brute force, streams against batches, and sinks by reading back."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import inference
from tidemark.operators import framework, backtest, forecast, stability
from tidemark.plans import queries as plans
from tidemark.sources import sinks
from tidemark.sources import tables as src
from tidemark.streaming import bars

DATA = "/root/testdata/sf0.001"


def test_hp_trend():
    x = np.random.default_rng(0).normal(size=60).cumsum()
    d = np.diff(np.eye(60), 2, axis=0)
    assert np.allclose(inference.hp_trend(x, 100.0), np.linalg.solve(np.eye(60) + 100.0 * d.T @ d, x))
    line = np.arange(12.0)
    assert np.allclose(inference.hp_trend(line), line) and list(inference.hp_trend(line[:2])) == [0, 1]


def test_signed_rank_p():
    for n in (5, 8):
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in (0, 3, 7):
            assert inference.wilcoxon_p(w, n) == pytest.approx(min(1.0, 2 * np.mean(np.array(sums) <= w)))
    assert inference.wilcoxon_p(0, 0) == 1.0


def test_deflated_sharpe():
    assert inference.deflated_sharpe(0.0, 1, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert inference.deflated_sharpe(0.1, 50, 100, 0.0, 3.0) < inference.deflated_sharpe(0.1, 2, 100, 0.0, 3.0)
    assert inference.deflated_sharpe(1.0, 0, 100, 0.0, 3.0) == 0.0


def test_silhouette():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(40, 3)), r.integers(0, 3, 40)
    y[0] = 9  # a cluster of one row
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(40):
        own = [j for j in range(40) if y[j] == y[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, y == k].mean() for k in set(y) - {y[i]})
        want.append((b - a) / max(a, b))
    assert stability.mean_silhouette(x, y, block=7) == pytest.approx(np.mean(want))
    assert np.isnan(stability.mean_silhouette(x, np.zeros(40)))


def test_adjusted_rand():
    a = np.array([0, 0, 0, 1, 1, 1, 0, 0])
    assert forecast.adjusted_rand(a, 1 - a) == pytest.approx(1.0)
    assert forecast.adjusted_rand(a, np.zeros(8, int)) == pytest.approx(0.0)
    assert forecast.adjusted_rand(np.zeros(4, int), np.zeros(4, int)) == 1.0


def test_classifiers():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 2))
    y = (x[:, 0] + 0.3 * r.normal(size=400) > 0).astype(float)
    b = forecast.logistic(x, y)
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert np.allclose(x.T @ (y - p), b[1:], atol=1e-6)  # the gradient of the penalised likelihood is zero
    assert ((forecast.stump_probability(forecast.stumps(x, y), x) >= 0.5) == y).mean() > 0.9


def test_next_regime(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"asset": "A", "t": range(200), "f": r.normal(size=200), "y": r.integers(0, 2, 200)})
    one = pd.DataFrame({"asset": "B", "t": range(200), "f": r.normal(size=200), "y": 1})
    few = pd.DataFrame({"asset": "C", "t": range(20), "f": r.normal(size=20), "y": [0, 1] * 10})
    df = spark.createDataFrame(pd.concat([pdf, one, few]))
    got = forecast.next_regime(df, ["f"], "y", "logistic").toPandas()
    assert got.groupby("asset").size().to_dict() == {"A": 80, "B": 80, "C": 8}
    assert (got[got.asset == "B"].prob == 1).all() and got.prob.between(0, 1).all()
    assert list(got[got.asset == "C"].sort_values("t").prob) == [0, 1] * 4  # the present label again
    assert forecast.next_regime(df.where("false"), ["f"], "y", "boosted").count() == 0


def test_penalty_search_and_events(spark):
    q = plans.QUERIES["fct_penalty_search"](spark, DATA).toPandas()
    assert q.asset.is_unique and q.penalty.isin([0.0, 1.0, 3.0, 10.0, 30.0, 100.0]).all()
    e = plans.QUERIES["swp_refit_events"](spark, DATA).toPandas().sort_values(["asset", "dt"])
    for _, g in e.groupby("asset"):
        assert g.reason.iloc[0] == "initial" and (g.reason.iloc[1:] != "initial").all()
        for x in g.itertuples():
            assert x.reason != "ari_collapse" or x.ari_now < 0.5
            assert x.reason != "mrl_collapse" or x.mrl_now < 20
            assert x.reason != "calendar_safety" or x.days_since_last >= 720


def test_dated_penalty_search(spark):
    r = np.random.default_rng(7)
    days = pd.bdate_range("2010-01-04", "2014-03-31")
    bear = np.repeat(np.arange(20) % 2, 60)[: len(days)]
    bear = np.append(bear, np.zeros(len(days) - len(bear), int))
    er = np.where(bear, -0.01, 0.01) + r.normal(0, 0.002, len(days))
    df = spark.createDataFrame(pd.DataFrame({"asset": "a", "dt": [x.date() for x in days], "er": er, "f1": er * 100}))
    walk = framework.Walk(("f1",), ("f1",), train_years=2, validation_years=1)
    forecasts, choices = framework.search(df, walk, [0.0, 5.0, 1e6])
    q = choices.toPandas().sort_values("rebal")
    firsts = pd.Series(days, index=days).groupby([days.year, days.month]).first()
    assert list(pd.to_datetime(q.rebal)) == [firsts[y, m] for y in range(2010, 2015) for m in (1, 7) if (y, m) in firsts.index]
    assert q.candidates.iloc[0] == 0 and q.penalty.iloc[0] == 0.0 and (q.candidates.iloc[2:] == 3).all()
    late = q[pd.to_datetime(q.rebal) >= "2012-07-01"]
    assert (late.penalty < 1e6).all() and (late.sharpe > 3).all()
    f = forecasts.toPandas().sort_values("dt")
    assert len(f) == len(days) and (f.regime[:252] == 1).all()  # no forecast yet: bearish
    ahead = f.regime.to_numpy()[700:-1]
    assert (ahead == bear[700:-1]).mean() > 0.95
    few = spark.createDataFrame([("a", i, x, v) for i, (x, v) in enumerate(zip([0, 0, 1, 0, 0], [9.0, 0.01, 0.03, 9.0, 0.02], strict=True))], "asset string, t int, label int, er double")
    net = [-0.001, 0.009, 0.03, -0.001, 0.019]
    assert framework.timing_sharpe(few, ["asset"], "t", cost=0.001).first().sharpe == pytest.approx(np.mean(net) / np.std(net, ddof=1) * 252**0.5)
    assert "fct_dated_penalty_search" in plans.QUERIES


def test_backtest_loop(spark):
    r = np.random.default_rng(4)
    n, k = 30, 3
    er, w, rf = r.normal(0, 0.01, (n, k)), r.uniform(-0.1, 0.5, (n, k)), r.uniform(0, 1e-4, n)
    er[5, 1] = np.nan
    days = pd.date_range("2020-01-01", periods=n).date
    rows = [("s", f"a{j}", days[i], float(w[i, j]), None if np.isnan(er[i, j]) else float(er[i, j]), float(rf[i])) for i in range(n) for j in range(k)]
    got = backtest.run(spark.createDataFrame(rows, "strategy string, asset string, dt date, w double, er double, rf double")).toPandas().sort_values("dt")
    before, want = np.full(k, 1 / k), []
    for i in range(n - 1):
        t, x = np.clip(w[i], 0, 1), np.nan_to_num(er[i + 1])
        cash, trade = max(1 - t.sum(), 0), np.abs(t - before).sum()
        want.append((t @ x + cash * rf[i + 1] - trade * 5e-4, trade))
        before = t * (1 + x) / ((t * (1 + x)).sum() + cash * (1 + rf[i + 1]))
    assert np.allclose(got[["ret", "turnover"]], want) and list(got.dt) == list(days[1:])


def test_centroid_drift(spark):
    c = spark.createDataFrame([("A", 1, 0, 0.0, 0.0), ("A", 2, 0, 3.0, 4.0), ("A", 1, 1, 1.0, 1.0), ("A", 2, 1, 1.0, 2.0)], "asset string, fit int, y int, f double, g double")
    assert [tuple(x) for x in stability.centroid_drift(c, ["f", "g"]).collect()] == [("A", 2, 5.0, 1.0, 3.0)]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def _stream(spark, tmp_path):
    e = src.table(spark, DATA, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), (F.col("value") + 1).alias("v"))
    e.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/ticks")
    return e, spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ticks")


def _drain(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_bars(spark, tmp_path):
    _, s = _stream(spark, tmp_path)
    got = _drain(bars.tick_bars(s), tmp_path, "tick_bars", "complete").toPandas()
    want = src.bars(spark, DATA).toPandas()
    key = lambda d: sorted(map(tuple, d[["asset", "o", "h", "l", "c"]].round(9).to_numpy()))
    assert key(got) == key(want)


def test_streamed_windows(spark, tmp_path):
    e, s = _stream(spark, tmp_path)
    got = _drain(bars.sliding_metrics(s), tmp_path, "sliding", "complete")
    assert got.agg(F.sum("n")).first()[0] == 4 * e.count()  # every tick is in four windows
    got = _drain(bars.episodes(s), tmp_path, "episodes", "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()


def test_streamed_mean(spark, tmp_path):
    e, s = _stream(spark, tmp_path)
    got = _drain(bars.ewm_state(s, 5.0), tmp_path, "ewm", "append").toPandas().sort_values(["asset", "ts"])
    pdf = e.toPandas().sort_values(["asset", "ts"])
    want = pdf.groupby("asset").v.transform(lambda v: v.ewm(halflife=5.0).mean())
    assert np.allclose(got["mean"], want)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None), ("b", 2, None)], "k string, i int, x double")
    for name, by in (("t_one", None), ("t_two", None), ("by_k", "k")):
        sinks.write_results(df, f"{tmp_path}/{name}.parquet", by)
        assert sinks.digest(spark.read.parquet(f"{tmp_path}/{name}.parquet")).first() == sinks.digest(df).first()
    assert sinks.digest(df.distinct()).first() != sinks.digest(df).first()
    assert json.loads(sinks.metadata({"t": df}))["t"]["rows"] == 3
    assert [x.k for x in sinks.pending(df, df.where("k = 'b'"), ["k"]).collect()] == ["a"]
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3
    assert {x.source for x in sinks.stems(spark, f"{tmp_path}/t_*.parquet", "t_").select("source").distinct().collect()} == {"one", "two"}
