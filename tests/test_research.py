"""The walk-forward framework, strategies, sweeps, estimators and stateful streams against plain loops and pandas."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, inference, series
from tidemark.operators import backtest, classifiers, estimators, forecast, framework, jump_model, portfolio, preparation, stability, strategies, sweep
from tidemark.sources import sinks, tables
from tidemark.streaming import states

R = np.random.default_rng(12)


def panel(spark, assets: int, n: int, start="2010-01-04", seed=0):
    """(asset, dt, t, er, f1, f2) with regimes of 60 days, and the same as pandas."""
    r, days = np.random.default_rng(seed), pd.bdate_range(start, periods=n)
    parts = []
    for a in range(assets):
        bear = (np.arange(n) // 60 + a) % 2
        er = np.where(bear, -0.004, 0.004) + r.normal(0, 0.004, n)
        f = pd.Series(er).ewm(halflife=5).mean().to_numpy() * 100
        parts.append(pd.DataFrame({"asset": f"a{a}", "dt": [x.date() for x in days], "t": np.arange(1, n + 1), "er": er, "f1": f, "f2": er * 50}))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def test_ewm_of_a_long_series(spark):
    x = pd.Series(R.normal(size=7000))
    x[R.random(7000) < 0.1] = np.nan
    x[:5] = np.nan
    df = spark.createDataFrame([("a", i, None if v != v else float(v)) for i, v in enumerate(x)], "asset string, t int, v double")
    got = df.select("t", series.ewm_mean(F.col("v"), 3).alias("m")).orderBy("t").toPandas()["m"]
    want = x.ewm(halflife=3, ignore_na=False).mean().ffill()
    assert np.allclose(got.astype(float), want, equal_nan=True, rtol=1e-9, atol=1e-12)


def test_as_of_with_keys(spark):
    days = pd.date_range("2014-01-01", "2019-12-31", freq="3D")
    left = pd.DataFrame([(k, d) for k in "ab" for d in days], columns=["k", "dt"])
    right = pd.DataFrame({"k": R.choice(list("ab"), 60), "dt": R.choice(pd.date_range("2014-06-01", "2018-01-01"), 60, replace=False), "v": R.normal(size=60)})
    right.loc[::7, "v"] = np.nan
    want = pd.merge_asof(left.sort_values("dt"), right.dropna().sort_values("dt"), on="dt", by="k").sort_values(["k", "dt"])
    mine = lambda f: spark.createDataFrame(f.assign(dt=f["dt"].dt.date))
    got = series.as_of(mine(left), mine(right).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))), "dt", ["v"], ("k",)).orderBy("k", "dt").toPandas()
    assert np.allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_average_rank(spark):
    x = pd.Series(R.integers(0, 40, 500).astype(float))
    x[::50] = np.nan
    df = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in enumerate(x)], "i int, v double").repartition(4)
    assert np.allclose(series.average_rank(df, "v", "rk", 8).orderBy("i").toPandas()["rk"].astype(float), x.rank(), equal_nan=True)


def test_calendar(spark):
    with pytest.raises(ValueError):
        calendar.months_of("daily")
    df, pdf = panel(spark, 1, 900)
    assert calendar.slice_days(df, "2010-02-01", "2010-02-28").count() == sum("2010-02-01" <= str(d) <= "2010-02-28" for d in pdf.dt)
    rebal = spark.createDataFrame([(pdf.dt[800],)], "rebal date")
    n = lambda **k: calendar.training_rows(df, rebal, **k).count()
    assert (n(kind="expanding"), n(kind="last", rows=300), n(kind="rolling", years=1)) == (800, 300, sum(pd.Timestamp(pdf.dt[800]) - pd.DateOffset(years=1) <= pd.Timestamp(d) for d in pdf.dt[:800]))
    assert n(kind="expanding", least=801) == 0
    with pytest.raises(ValueError):
        n(kind="other")


def test_prepare(spark):
    days = pd.bdate_range("2020-01-01", periods=40)
    px = pd.DataFrame(100 * np.exp(np.cumsum(R.normal(0, 0.01, (40, 3)), 0)), index=days, columns=list("abc"))
    px.iloc[:7, 1] = np.nan
    px.iloc[20, 2] = np.nan
    rate = pd.Series(R.uniform(1, 3, 6), index=days[[0, 3, 9, 15, 22, 30]] - pd.Timedelta(days=1))
    ret = np.exp(np.log(px / px.shift(1))) - 1
    rf = (rate.reindex(rate.index.union(days)).ffill().reindex(days) / 100 / 252).fillna(0.0)
    er = ret.sub(rf, axis=0).iloc[1:].ffill().fillna(0.0)
    long = px.stack().rename("px").rename_axis(["dt", "asset"]).reset_index().assign(dt=lambda f: f["dt"].dt.date)
    macro = pd.DataFrame({"dt": [d.date() for d in rate.index], "rf": rate.to_numpy()})
    got = preparation.prepare(spark.createDataFrame(long), spark.createDataFrame(macro)).toPandas()
    wide = got.pivot(index="dt", columns="asset", values="er")
    assert np.allclose(wide, er, atol=1e-12) and np.allclose(got[got.asset == "a"].sort_values("dt").rf, rf[1:])


def test_features_registry(spark):
    df, pdf = panel(spark, 2, 60)

    @preparation.register("doubled")
    def doubled(p, **_):
        return p.withColumn("x2", F.col("er") * 2)

    assert "x2" in preparation.FEATURE_SETS["doubled"](df).columns and set(preparation.FEATURE_SETS) >= {"returns", "doubled"}
    x = preparation.return_features(df, True, ("a1",)).toPandas()
    assert x[x.asset == "a1"].log_dd_hl5.isna().all() and x[x.asset == "a0"].log_dd_hl5.notna().sum() == 41
    assert preparation.clustering_features("minimal") == ["avg_ret_hl5", "avg_ret_hl10", "avg_ret_hl21"]
    with pytest.raises(ValueError):
        preparation.clustering_features("none")


def test_trees():
    x = R.normal(size=(60, 3))
    y = (x[:, 1] + 0.5 * R.normal(size=60) > 0).astype(float)
    best = min(((sum(((y[s] - y[s].mean()) ** 2).sum() for s in (x[:, j] <= c, x[:, j] > c)), j, c) for j in range(3) for v in [np.sort(x[:, j])] for c in (v[1:] + v[:-1]) / 2))
    low = x[:, best[1]] <= best[2]
    assert np.allclose(classifiers.decision_tree(x, y, x, 1), np.where(low, y[low].mean(), y[~low].mean()))
    assert np.allclose(classifiers.decision_tree(x, y, x, None), y)
    # one round of boosting, one level: a leaf is 0.3 * sum (y - 1/2) / (sum 1/4 + 1)
    g = [(((y[s] - 0.5).sum()) ** 2 / (s.sum() / 4 + 1)) for j in range(3) for v in [np.sort(x[:, j])] for c in (v[1:] + v[:-1]) / 2 for s in (x[:, j] <= c, x[:, j] > c) if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 4]
    top = max(a + b for a, b in zip(g[::2], g[1::2], strict=True))
    p = classifiers.boosted(x, y, x, rounds=1, depth=1)
    f = np.log(p / (1 - p)) / 0.3
    assert sum((y[s] - 0.5).sum() * f[s][0] for s in [f == v for v in np.unique(f)]) == pytest.approx(top)
    assert ((classifiers.forest(x, y, x, 30) >= 0.5) == y).mean() > 0.95
    for m in classifiers.CLASSIFIERS:
        assert (classifiers.probabilities(m, x, np.ones(60), x[:5]) == 1).all()
    with pytest.raises(ValueError):
        classifiers.probabilities("oracle", x, y, x)
    assert np.allclose(classifiers.smoothed(y, 4), pd.Series(y).ewm(halflife=4).mean())


@pytest.mark.parametrize("states", [2, 3])
def test_best_path(states):
    for _ in range(40):
        cost, penalty = R.random((7, states)), float(R.choice([0, 0.2, 1, 5]))
        value = lambda p: sum(cost[i, k] for i, k in enumerate(p)) + penalty * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert value(jump_model.best_path(cost, penalty)) == pytest.approx(min(map(value, itertools.product(range(states), repeat=7))))
    assert len(jump_model.fit(np.ones((5, 2)), 3, 1.0)[0]) == 5  # rows that are all alike


def test_programme_exactly():
    for _ in range(60):
        n = int(R.integers(2, 9))
        a = R.normal(size=(n, n + 3)) * 0.01
        s, mu, b = a @ a.T + 1e-8 * np.eye(n), R.normal(size=n) * 1e-3, R.dirichlet(np.ones(n)) * R.choice([0, 0.5, 1])
        value = lambda w: mu @ w - 10 * w @ s @ w - 5e-4 * np.abs(w - b).sum()  # noqa: E731, B023
        w = portfolio.solve(mu, s, b, 10.0, 1.0)
        assert w.min() >= -1e-12 and w.max() <= 0.4 + 1e-12 and w.sum() <= 1 + 1e-9
        assert value(w) >= value(portfolio.optimise(mu, s, b, 10.0, 1.0, steps=20_000)) - 1e-12


def test_strategies(spark):
    n, k = 120, 5
    days = pd.bdate_range("2020-01-01", periods=n)
    er = pd.DataFrame(R.normal(0.0003, 0.01, (n, k)), index=days, columns=[f"a{i}" for i in range(k)])
    rf = pd.Series(R.uniform(0, 1e-4, n), index=days)
    regime, mu = pd.DataFrame(R.integers(0, 2, (n, k)) * (R.random((n, k)) < 0.5), index=days, columns=er.columns), pd.DataFrame(R.normal(0, 1e-3, (n, k)), index=days, columns=er.columns)
    ret = er.add(rf, axis=0)
    rows = [(a, d.date(), float(er.loc[d, a]), float(ret.loc[d, a]), float(rf[d]), int(regime.loc[d, a]), float(mu.loc[d, a])) for d in days for a in er.columns]
    p = spark.createDataFrame(rows, "asset string, dt date, er double, ret double, rf double, regime int, mu double")
    got = strategies.targets(p, strategies.NAMES, strategies.sensitivity("MinVar", (5.0,), (0.0, 1.0))).toPandas()
    wide = {s: g.pivot(index="dt", columns="asset", values="w").sort_index().to_numpy() for s, g in got.groupby("strategy")}
    assert set(wide) == {*strategies.NAMES, "MinVar|risk=5|trade=0", "MinVar|risk=5|trade=1"}
    assert np.allclose(wide["EW"], 1 / k)
    held = np.full(k, 1 / k)
    for t in range(n):
        hist, bull = er.iloc[: t + 1], regime.iloc[t].to_numpy() == 0
        if t + 1 < 63:
            cov = np.diag(np.maximum(hist.std(ddof=1).fillna(0.01).to_numpy() ** 2, 1e-12))
        else:
            cov = hist.ewm(halflife=252).cov().iloc[-k:].to_numpy()
            val, vec = np.linalg.eigh((cov + cov.T) / 2)
            cov = vec @ np.diag(np.maximum(val, max(1e-8, 1e-12 * np.trace(cov) / k))) @ vec.T
        assert np.allclose(wide["MinVar"][t], portfolio.solve(np.full(k, 1e-3), cov, np.zeros(k), 10.0, 0.0), atol=1e-6)
        want = np.zeros(k) if bull.sum() < 4 else portfolio.solve(np.where(bull, mu.iloc[t], np.maximum(mu.iloc[t], -10e-4)), cov, held, 10.0, 1.0)
        assert np.allclose(wide["MV(JM-XGB)"][t], want, atol=1e-6)
        assert np.allclose(wide["EW(JM-XGB)"][t], bull / bull.sum() if bull.sum() >= 4 else 0)
        if t + 1 < n:
            w, x = wide["MV(JM-XGB)"][t], ret.iloc[t + 1].to_numpy()
            value = (w * (1 + x)).sum() + max(1 - w.sum(), 0) * (1 + rf.iloc[t + 1])
            held = w * (1 + x) / value
    late = strategies.targets(p, ["MinVar", "EW"], start=str(days[80].date())).toPandas()
    assert len(late) == 2 * k * (n - 80)
    assert np.allclose(late[late.strategy == "MinVar"].pivot(index="dt", columns="asset", values="w").to_numpy(), wide["MinVar"][80:], atol=1e-9)
    with pytest.raises(ValueError):
        strategies.targets(p, ["60/41"])
    strategies.add("all in", strategies.fixed_mix({"a0": 1.0}))
    assert backtest.metrics(strategies.run(p, ["all in"]).join(p.select("dt", "rf").distinct(), "dt")).first().leverage == 1.0


def test_fixed_penalty(spark):
    df, pdf = panel(spark, 2, 700)
    walk = framework.Walk(("f1", "f2"), ("f1", "f2"), method="decision_tree", depth=3, smoothing={"a1": 3})
    got = framework.fixed_penalty(df, walk, 2.0, start="2011-01-01").toPandas()
    for a, g in pdf.groupby("asset"):
        g = g.reset_index(drop=True)
        day = pd.DatetimeIndex(g.dt)
        first = [i for i in range(len(g)) if day[i] >= pd.Timestamp("2011-01-01") and day[i].month in (1, 7) and (day[i - 1].month != day[i].month or day[i - 1] < pd.Timestamp("2011-01-01"))]
        want = {}
        for i, end in zip(first, [*first[1:], len(g)], strict=True):
            x = g[["f1", "f2"]].to_numpy()
            if i < 252:
                continue
            y = jump_model.bear_labels(jump_model.fit(x[:i], 2, 2.0)[0], g.er.to_numpy()[:i])
            p = classifiers.smoothed(classifiers.probabilities("decision_tree", x[: i - 1], y[1:], x[i:end], 3), 3 if a == "a1" else 0)
            want |= {g.dt[k]: int(v >= 0.5) for k, v in zip(range(i, end), p, strict=True)}
        mine = got[got.asset == a].set_index("dt").regime.to_dict()
        assert mine == {d: want.get(d, 1) for d in g.dt if str(d) >= "2011-01-01"}


def test_search_resumes(spark):
    df, _ = panel(spark, 2, 600)
    walk = framework.Walk(("f1", "f2"), ("f1", "f2"), method="logistic_regression", train_years=2, validation_years=1)
    forecasts, choices = framework.search(df, walk, [0.0, 3.0])
    assert choices.count() == 2 * 5 and forecasts.count() == 2 * 600
    again = framework.search(df, walk, [0.0, 3.0], done=choices.where("asset = 'a0'"))[1]
    key = lambda c: sorted((x.asset, x.rebal, x.penalty) for x in c.collect())
    assert key(again) == [x for x in key(choices) if x[0] == "a1"]


def test_sweep(spark, tmp_path):
    assert [len(c) for c in sweep.CONFIGS.values()] == [7, 5, 3, 6, 4, 5, 5, 4, 9, 9, 144] and sweep.configs_of("W1")[0].name == "w1_l25_cc_k2_mon_log"
    with pytest.raises(ValueError):
        sweep.configs_of("Z9")
    with pytest.raises(ValueError):
        sweep._joint(100)
    df, pdf = panel(spark, 2, 520)
    names = [*preparation.feature_columns(), *preparation.MACRO_FEATURES]
    data = {c: pdf["f1"] * (i + 1) ** 0.5 + R.normal(size=len(pdf)) * 0.1 for i, c in enumerate(names)} | {f"vol_{v}": np.abs(pdf["f2"]) + i for i, v in enumerate(sweep.VOLATILITY_COLUMNS)}
    pdf = pdf[["asset", "dt", "er"]].assign(**data)
    f = spark.createDataFrame(pdf)
    truth = spark.createDataFrame(pdf[["asset", "dt"]].assign(regime=(np.tile(np.arange(520), 2) // 60) % 2))
    configs = sweep.config_table(spark, ["B1", "C1"]).where("name in ('persistence', 'tree_d3', 'logistic', 'grisk_5', 'grisk_20')").withColumn("forecaster_type", F.when(F.col("ablation_id") == "C1", "logistic_regression").otherwise(F.col("forecaster_type")))
    got = sweep.run(f, truth, configs, seeds=2, start="2011-03-01").toPandas()
    assert len(got) == 2 * 5 * 2 and set(got.columns) == {"ablation_id", "asset", "config", "seed", *sweep.METRICS}
    g = pdf[pdf.asset == "a0"].reset_index(drop=True)
    x, day = g[names].assign(v=g.vol_close_to_close).to_numpy(), pd.DatetimeIndex(g.dt)
    first = [i for i in range(1, len(g)) if day[i] >= pd.Timestamp("2011-03-01") and day[i].month in (1, 7) and day[i - 1].month != day[i].month]
    pred = []
    for i, end in zip(first, [*first[1:], len(g)], strict=True):
        y = jump_model.bear_labels(jump_model.fit(x[:i], 2, 50.0, seed=1)[0], g.er.to_numpy()[:i])
        pred += (classifiers.probabilities("decision_tree", x[:i], np.append(y[1:], y[-1]), x[i:end], 3) >= 0.5).astype(int).tolist()
    pred, er, true = np.array(pred), g.er.to_numpy()[first[0] :], ((np.arange(520) // 60) % 2)[first[0] :]
    pos = 1.0 - pred
    net = pos * er - np.abs(np.diff(pos, prepend=0.0)) * 5e-4 * 2
    one = got[(got.asset == "a0") & (got.config == "tree_d3") & (got.seed == 1)].iloc[0]
    split = min(max(round(len(net) * 0.6), 1), len(net) - 1)
    assert one.terminal_wealth == pytest.approx(np.prod(1 + net)) and one.terminal_wealth_val == pytest.approx(np.prod(1 + net[:split])) and one.state_accuracy == pytest.approx((pred == true).mean())
    assert one.n_position_switches == np.abs(np.diff(pred, prepend=0)).sum()
    twice = got[got.config.isin(["grisk_5", "grisk_20"])].pivot(index=["asset", "seed"], columns="config", values="total_return")
    assert np.allclose(got[got.config == "grisk_5"].state_accuracy.to_numpy(), got[got.config == "grisk_20"].state_accuracy.to_numpy()) and (twice["grisk_5"] != twice["grisk_20"]).all()
    done = spark.createDataFrame(got[got.seed == 0][["asset", "config", "seed"]])
    assert sweep.run(f, truth, configs, seeds=2, done=done, start="2011-03-01").select("seed").distinct().collect() == [(1,)]
    events = spark.createDataFrame([("a0", g.dt[i]) for i in first] + [("a1", g.dt[300])], "asset string, dt date")
    own = sweep.run(f, truth, configs.where("name = 'tree_d3'"), seeds=2, start="2011-03-01", own_blocks=sweep.blocks_of_events(events, str(g.dt[519]))).toPandas()
    same = own[(own.asset == "a0") & (own.seed == 1)].iloc[0]
    assert len(own) == 4 and same.terminal_wealth == pytest.approx(one.terminal_wealth) and same["add"] == one["add"]
    wrote = sweep.study(f, truth, str(tmp_path), ["A3"], seeds=1, start="2011-03-01")
    before = wrote["A3"].count()
    assert before == 2 * 3 and sweep.study(f, truth, str(tmp_path), ["A3"])["A3"].count() == before  # read, not run again


def test_comparison_statistics(spark):
    rows = [(f"a{i}", c, float(R.normal(0.3 * j, 1))) for i in range(9) for j, c in enumerate(("x", "y", "z"))]
    df = spark.createDataFrame(rows, "asset string, config string, metric double").withColumn("ablation_id", F.lit("A"))
    wide = pd.DataFrame(rows, columns=["asset", "config", "m"]).pivot(index="asset", columns="config", values="m")
    got = {(r.config_a, r.config_b): r for r in sweep.all_pairs(df, "metric").collect()}
    for a, b in itertools.combinations("xyz", 2):
        d = wide[a] - wide[b]
        rk = d.abs().rank()
        w = min(rk[d > 0].sum(), rk[d < 0].sum())
        r = got[(a, b)]
        assert r.wilcoxon == w and r.p_value == pytest.approx(inference.wilcoxon_p(w, 9)) and r.delta == pytest.approx(d.mean())
        assert r.significance == ("***" if r.p_value < 0.001 else "**" if r.p_value < 0.01 else "*" if r.p_value < 0.05 else "ns")
    ranks = wide.rank(axis=1).sum()
    chi = 12 / (9 * 3 * 4) * (ranks**2).sum() - 3 * 9 * 4
    rows = {r.config: r for r in sweep.analysis(df, "metric").collect()}
    assert rows["y"].friedman_p == pytest.approx(np.exp(-chi / 2)) and rows["y"].vs_baseline == "x" and set(rows) == {"y", "z"}
    assert rows["y"].significant == (np.exp(-chi / 2) < 0.05) and (rows["y"].significant or not rows["y"].rejected)


def test_refits_and_validity(spark):
    df, pdf = panel(spark, 1, 500)
    rebal = spark.createDataFrame([(pdf.dt[300],), (pdf.dt[400],)], "rebal date")
    fits = jump_model.refits(calendar.training_rows(df, rebal, "rolling", 1, least=100), ["f1", "f2"], penalty=2.0)
    x = fits.orderBy("rebal", "dt").toPandas()
    one = x[x.rebal == pdf.dt[300]]
    labels, _ = jump_model.fit(one[["f1", "f2"]].to_numpy(), 2, 2.0)
    assert (one.state.to_numpy() == labels).all()
    v = {r.rebal: r for r in stability.validity_with_silhouette(fits, ["f1", "f2"]).collect()}[pdf.dt[300]]
    assert v.silhouette == pytest.approx(stability.mean_silhouette(one[["f1", "f2"]].to_numpy(), one.regime.to_numpy()))
    assert stability.has_features(fits, ["f1"]) and not stability.has_features(fits.withColumn("f1", F.lit(None).cast("double")), ["f1"]) and not stability.has_features(fits.where("false"), ["f1"])
    a = stability.consecutive_agreement(fits).first()
    both = x[x.rebal == pdf.dt[300]].merge(x[x.rebal == pdf.dt[400]], on="dt")
    same = (both.regime_x == both.regime_y).mean()
    assert a.agreement == pytest.approx(max(same, 1 - same)) and a.ari == pytest.approx(forecast.adjusted_rand(both.regime_x.to_numpy(), both.regime_y.to_numpy())) and a.n_overlap == len(both)
    c = jump_model.consensus(df, ["f1", "f2"], penalty=2.0).toPandas().sort_values("t")
    xs = pdf[["f1", "f2"]].to_numpy()
    votes = np.mean([jump_model.bear_labels(jump_model.fit(xs, 2, 2.0, seed=s)[0], pdf.er.to_numpy()) for s in range(5)], 0)
    assert (c.regime.to_numpy() == (votes >= 0.5)).all()


def test_thresholds(spark):
    df, pdf = panel(spark, 1, 600)
    day = pd.DatetimeIndex(pdf.dt)
    judge = [i == 0 or (day[i].month in (1, 4, 7, 10) and day[i].month != day[i - 1].month) for i in range(600)]
    x = pdf[["f1", "f2"]].to_numpy()
    aris, runs = [[], [], []], [[], [], []]
    for s in range(3):
        last = None
        for i in np.flatnonzero(judge):
            lo = int(day.searchsorted(day[i] - pd.Timedelta(days=370)))
            if i + 1 - lo < 100:
                continue
            labels, _ = jump_model.fit(x[lo : i + 1], 2, 2.0, seed=s)
            runs[s].append(len(labels) / (1 + np.count_nonzero(np.diff(labels))))
            if last and last[1] - lo > 30:
                aris[s].append(forecast.adjusted_rand(last[2][lo - last[0] :], labels[: last[1] - lo]))
            last = (lo, i + 1, labels)
    flag = spark.createDataFrame([(d, bool(j)) for d, j in zip(pdf.dt, judge, strict=True)], "dt date, judge boolean")
    got = forecast.thresholds(df.join(flag, "dt"), ["f1", "f2"], "judge", penalty=2.0).first()
    assert got.theta_ari == pytest.approx(np.mean([np.percentile(a, 5) for a in aris])) and got.theta_mrl == pytest.approx(np.mean([np.percentile(r, 5) for r in runs]))


def test_estimators(spark):
    df, pdf = panel(spark, 2, 300)
    model = estimators.JumpModel(["f1", "f2"], penalty=2.0).fit(df)
    for a, g in pdf.groupby("asset"):
        labels, centres = jump_model.fit(g[["f1", "f2"]].to_numpy(), 2, 2.0)
        mine = model.labels.where(F.col("asset") == a).orderBy("t").toPandas()
        assert (mine.state.to_numpy() == labels).all() and (mine.regime.to_numpy() == jump_model.bear_labels(labels, g.er.to_numpy())).all()
        near = model.transform(df).where(F.col("asset") == a).orderBy("t").toPandas()
        assert (near.state.to_numpy() == jump_model.distances(g[["f1", "f2"]].to_numpy(), centres).argmin(1)).all()
        s = {r.state: r for r in model.stats(df).where(F.col("asset") == a).collect()}
        assert s[0].mean_daily == pytest.approx(g.er[labels == 0].mean()) and s[1].volatility == pytest.approx(g.er[labels == 1].std(ddof=0) * 252**0.5)
    one = df.where("asset = 'a0'").withColumn("target", F.when(F.col("f1") < 0, 1).otherwise(0))
    f = estimators.RegimeForecaster(["f1", "f2"], trees=5, depth=2, smooth=2.0).fit(one).transform(one).toPandas()
    assert f.prob.between(0, 1).all() and ((f.regime == (f.prob >= 0.5)).all())
    assert estimators.RegimeForecaster(["f1"]).fit(one.withColumn("target", F.lit(1))).transform(one).agg(F.min("prob")).first()[0] == 1.0
    with pytest.raises(ValueError):
        estimators.RegimeForecaster(["f1"]).fit(one.where("false"))


def drain(stream, name, checkpoint, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def streamed(spark, df, path, by: str, parts: int = 3):
    """df as a stream of several batches in order of `by`."""
    rows = df.orderBy(by).collect()
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streamed_backtest(spark, tmp_path):
    n, k = 20, 3
    days = pd.date_range("2021-01-01", periods=n).date
    rows = [("s", f"a{j}", days[i], float(R.uniform(-0.1, 0.5)), float(R.normal(0, 0.01)), 1e-5 * i) for i in range(n) for j in range(k)]
    batch = spark.createDataFrame(rows, "strategy string, asset string, dt date, w double, er double, rf double")
    packed = batch.groupBy("strategy", "dt").agg(F.sort_array(F.collect_list(F.struct("asset", "w", "er"))).alias("x"), F.first("rf").alias("rf")).select("strategy", "dt", F.col("x.asset").alias("assets"), F.col("x.w").alias("w"), F.col("x.er").alias("er"), "rf")
    got = drain(states.backtest_days(streamed(spark, packed, tmp_path / "days", "dt")), "days_out", tmp_path / "c1").orderBy("dt").toPandas()
    want = backtest.run(batch).orderBy("dt").toPandas()
    assert list(got.dt) == list(want.dt) and np.allclose(got[["ret", "turnover", "leverage"]], want[["ret", "turnover", "leverage"]])


def test_streamed_refits_and_episodes(spark, tmp_path):
    df, pdf = panel(spark, 1, 500)
    rows = df.withColumn("judge", F.col("t") % 50 == 0)
    stream = streamed(spark, rows.select("asset", "dt", "judge", "f1", "f2"), tmp_path / "rows", "dt")
    got = drain(states.refit_events(stream, ["f1", "f2"], 0.5, 20.0, window=200, least=100, penalty=2.0), "events_out", tmp_path / "c2").orderBy("dt").toPandas()
    want = forecast.refit_events(rows, ["f1", "f2"], "judge", 0.5, 20.0, window=200, least=100, penalty=2.0).orderBy("dt").toPandas()
    assert list(zip(got.dt, got.reason, strict=True)) == list(zip(want.dt, want.reason, strict=True)) and len(got) >= 1
    assert np.allclose(got.mrl_now, want.mrl_now) and np.allclose(got.ari_now.astype(float), want.ari_now.astype(float), equal_nan=True)
    labels = df.select("asset", F.col("dt").cast("timestamp").alias("ts"), F.when(F.col("f1") < 0, 1).otherwise(0).alias("regime"))
    mine = drain(states.regime_episodes(streamed(spark, labels, tmp_path / "labels", "ts")), "episodes_out", tmp_path / "c3").orderBy("start").toPandas()
    y = (pdf.f1 < 0).astype(int).to_numpy()
    runs = [(k, len(list(g))) for k, g in itertools.groupby(y)][:-1]  # the last is still open
    assert list(zip(mine.regime, mine.n, strict=True)) == runs


def test_streamed_macro_and_resume(spark, tmp_path):
    days = spark.createDataFrame([(d.date(),) for d in pd.date_range("2020-01-01", periods=9)], "dt date")
    prints = spark.createDataFrame([(pd.Timestamp("2020-01-02").date(), 1.0), (pd.Timestamp("2020-01-06").date(), 2.0)], "dt date, v double")
    got = []
    stream = streamed(spark, days, tmp_path / "m", "dt")
    stream.writeStream.foreachBatch(states.with_macro(days, prints, ["v"], lambda df, k: got.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start().awaitTermination()
    assert [r.v for r in sorted(got)] == [None, 1, 1, 1, 1, 2, 2, 2, 2]
    out, check = str(tmp_path / "out"), str(tmp_path / "c5")
    states.resume(stream, out, check).awaitTermination()
    days.limit(2).write.mode("append").parquet(str(tmp_path / "m"))
    states.resume(stream, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 11
    late = streamed(spark, spark.createDataFrame(pd.DataFrame({"series": "s", "ts": pd.to_datetime(["2020-01-01", "2020-01-01", "2020-01-03"]), "v": [1.0, 9.0, 2.0]})), tmp_path / "p", "v", 1)
    assert drain(states.late_prints(late), "late_out", tmp_path / "c6").count() == 2


def test_sources_and_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,VALUE\n2020-01-01,1.5\n2020-01-02,.\nnot a day,3\n2020-01-03,4\n2020-01-03,5\n")
    (tmp_path / "b.csv").write_text("DATE,VALUE\n2020-01-02,7\n")
    got, errors = tables.load_series(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv"), "c": str(tmp_path / "none.csv")}, "DATE", "VALUE")
    assert [(str(r.dt), r.a, r.b) for r in got.orderBy("dt").collect()] == [("2020-01-01", 1.5, None), ("2020-01-02", None, 7.0), ("2020-01-03", 5.0, None)] and list(errors) == ["c"]
    with pytest.raises(ValueError):
        tables.load_series(spark, {"c": str(tmp_path / "none.csv")}, "DATE", "VALUE")
    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([(1, 2)], "x int, y int")
    path = str(tmp_path / "cache")
    assert tables.cached(spark, path, make, ["x"]).columns == ["x", "y"] and tables.cached(spark, path, make, ["y"]).count() == 1 and len(calls) == 1
    with pytest.raises(ValueError):
        tables.cached(spark, path, make, ["z"])
    s = tables.from_pandas(spark, pd.Series([1.0, np.nan], index=pd.date_range("2020-01-01", periods=2), name="v"))
    assert s.columns == ["date", "v"] and [r.v for r in s.collect()] == [1.0, None]
    nested = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 3)) AS s")
    assert tables.flattened(nested).first().asDict() == {"a": 1, "s_x": 2, "s_y_z": 3}
    m = spark.createDataFrame([("s", 0.1234, None, 1.005)], "strategy string, ann_ret double, mdd double, sharpe double")
    shown = spark.createDataFrame([("s", 0.1234, -0.0567, 1.2345), ("u", -0.05, None, -0.127), ("v", None, 0.0, None)], "strategy string, ann_ret double, mdd double, sharpe double")
    assert [tuple(r) for r in sinks.displayed(shown).collect()] == [("s", "12.3%", "-5.7%", "1.23"), ("u", "-5.0%", None, "-0.13"), ("v", None, "0.0%", None)]
    assert tuple(sinks.displayed(m).first())[:3] == ("s", "12.3%", None)
    sinks.write_text(spark, ["a = 1", "b = 2"], f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["a = 1", "b = 2"]
    sinks.write_nested({"EW": m.drop("strategy"), "MV": m.drop("strategy", "mdd")}, f"{tmp_path}/nested")
    assert spark.read.parquet(f"{tmp_path}/nested").where("strategy = 'MV'").first().mdd is None and sinks.exists(spark, f"{tmp_path}/nested") and not sinks.exists(spark, f"{tmp_path}/no")
    assert '"n":1' in sinks.metadata_json(m, "m").first().json
