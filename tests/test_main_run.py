"""The main run against plain loops from the first fit to the last metric; the parametric penalty search; two-level scans; ranks with ties; trends so far."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import inference, scan
from tidemark.operators import classifiers, framework, jump_model, main_run, portfolio, strategies, trend

R = np.random.default_rng(21)


def universe(assets: int, n: int):
    days = pd.bdate_range("2010-01-04", periods=n)
    out = {}
    for a in range(assets):
        r = np.random.default_rng(50 + a)
        bear = ((np.arange(n) + 17 * a) // 55) % 2
        er = np.where(bear, -0.004, 0.004) + r.normal(0, 0.005, n)
        f1 = pd.Series(er).ewm(halflife=5).mean().to_numpy() * 100
        f2 = er * 50
        if a == 1:
            f2[:30] = np.nan
        out[f"a{a}"] = pd.DataFrame({"er": er, "f1": f1, "f2": f2}, index=days)
    return days, out


def block_starts(days, months, lo, hi):
    """First days, inside [lo, hi), of the walk's months."""
    inside = days[(days >= lo) & (days < hi)]
    firsts = {}
    for d in inside:
        firsts.setdefault((d.year, d.month), d)
    return [d for (_, m), d in firsts.items() if m in months]


def forecast_by_loops(g, days, months, walk, penalty, half_life, lo, hi, ends):
    """Labels of the days in [lo, hi): a fit at every block's start on the years before; the last one kept where there is none, 1 before the first."""
    label = {}
    for s in block_starts(days, months, lo, hi):
        end = min([e for e in ends if e > s], default=None)
        train = g[(g.index >= s - pd.DateOffset(years=walk.train_years)) & (g.index < s)]
        block = g[(g.index >= s) & ((g.index < end) if end is not None else True)]
        if len(train) < walk.least_train:
            continue
        train = train.dropna()
        x = train[["f1", "f2"]].to_numpy()
        y = jump_model.bear_labels(jump_model.fit(x, 2, penalty)[0], train.er.to_numpy())
        p = classifiers.probabilities(walk.method, x[:-1], y[1:], block[["f1", "f2"]].to_numpy(), walk.depth, walk.trees)
        p = classifiers.smoothed(p, half_life)
        label |= {d: int(v >= 0.5) for d, v in zip(block.index, p, strict=True) if lo <= d < hi}
    inside = days[(days >= lo) & (days < hi)]
    return pd.Series([label.get(d) for d in inside], index=inside, dtype=float).ffill().fillna(1.0)


def sharpe_by_loops(state, er, cost):
    net, s = [], state.to_numpy()
    for t in range(len(s)):
        before = s[t - 1] if t >= 1 else None
        earlier = s[t - 2] if t >= 2 else None
        gain = er.iloc[t] if before == 0 else 0.0
        net.append(gain - (cost if before is None or earlier is None or before != earlier else 0.0))
    sd = np.std(net, ddof=1)
    return np.mean(net) / sd * 252**0.5 if sd >= 1e-10 else 0.0


def test_main_run_by_plain_loops(spark, tmp_path):
    days, data = universe(5, 620)
    walk = framework.Walk(("f1", "f2"), ("f1", "f2"), train_years=2, validation_years=1, least_train=130, method="xgboost", depth=2, trees=6, smoothing={"a1": 3})
    penalties = [0.0, 1.0, 4.0, 60.0]
    last = days[-1] + pd.Timedelta(days=1)
    regular = block_starts(days, walk.months, days[0], last)
    forecasts, choices = {}, {}
    for a, g in data.items():
        out, half_life = [], walk.smoothing.get(a, 0)
        for i, at in enumerate(regular):
            if at < days[200]:
                continue
            first = at - pd.DateOffset(years=walk.validation_years)
            # a block belongs to a window if it begins there; a first one, inside a month, has the window's own start
            got = []
            for p in penalties:
                window = days[(days >= first) & (days < at)]
                state = forecast_by_loops(g, days, walk.months, walk, p, half_life, first, at, regular) if len(window) else pd.Series(dtype=float)
                got.append(sharpe_by_loops(state, g.er.loc[window], walk.cost) if len(window) >= 5 else None)
            best = max((k for k, v in enumerate(got) if v is not None), key=lambda k: got[k], default=0)
            choices[a, at.date()] = (penalties[best], got[best])
            out.append(forecast_by_loops(g, days, walk.months, walk, penalties[best], half_life, at, regular[i + 1] if i + 1 < len(regular) else last, regular))
        forecasts[a] = pd.concat(out)
    rf = pd.Series(np.full(len(days), 1e-5), index=days)
    rows = [(a, d.date(), float(x.er), *(None if np.isnan(v) else float(v) for v in (x.f1, x.f2)), float(x.er + rf[d]), float(rf[d])) for a, g in data.items() for d, x in g.iterrows()]
    df = spark.createDataFrame(rows, "asset string, dt date, er double, f1 double, f2 double, ret double, rf double")
    mix = {"mix": strategies.fixed_mix({"a0": 0.5, "a1": 0.3})}
    path = str(tmp_path / "run")
    start = str(days[200].date())
    got = main_run.run(df, df, walk, penalties, ["MinVar(JM-XGB)", "MV", "MV(JM-XGB)", "EW(JM-XGB)"], mix, start=start, path=path)
    mine = {(r.asset, r.rebal): (r.penalty, r.sharpe) for r in got.choices.collect()}
    assert set(mine) == set(choices)
    for k, (p, s) in choices.items():
        assert mine[k][0] == p and (s is None) == (mine[k][1] is None) and (s is None or mine[k][1] == pytest.approx(s, rel=1e-9))
    assert len({p for p, _ in choices.values()}) > 1
    f = got.forecasts.toPandas().pivot(index="dt", columns="asset", values="regime").sort_index()
    want = pd.DataFrame(forecasts)
    assert (f.to_numpy() == want.to_numpy()).all() and 0 < want.to_numpy().mean() < 1
    # the backtest: every day's targets from weights that drifted, one strategy after the other
    er, k = pd.DataFrame({a: g.er for a, g in data.items()}), len(data)
    ret = er.add(rf, axis=0)
    daily = {n: x.set_index("dt").sort_index() for n, x in got.daily.toPandas().groupby("strategy")}
    assert set(daily) == {"MinVar(JM-XGB)", "MV", "MV(JM-XGB)", "EW(JM-XGB)", "mix"}
    for name, x in daily.items():
        held, first = np.full(k, 1 / k), 200
        for t in range(first, len(days) - 1):
            hist = er.iloc[: t + 1]
            cov = hist.ewm(halflife=252).cov().iloc[-k:].to_numpy() if name.startswith("M") else None
            if cov is not None:
                val, vec = np.linalg.eigh((cov + cov.T) / 2)
                cov = vec @ np.diag(np.maximum(val, max(1e-8, 1e-12 * np.trace(cov) / k))) @ vec.T
            bull = want.loc[days[t]].to_numpy() == 0 if days[t] in want.index else None
            mean = hist.ewm(halflife=1260).mean().iloc[-1].to_numpy() if t + 1 >= 252 else np.zeros(k)
            if name == "mix":
                w = np.array([0.5, 0.3, 0, 0, 0])
            elif bull is None:  # no forecast yet: as the plain strategy
                w = np.full(k, 1 / k) if name == "EW(JM-XGB)" else portfolio.solve(np.full(k, 1e-3), cov, held, 10.0, 0.0) if name == "MinVar(JM-XGB)" else portfolio.solve(mean, cov, held, 5.0, 0.0)
            elif name == "EW(JM-XGB)":
                w = bull / bull.sum() if bull.sum() >= 4 else np.zeros(k)
            elif name == "MinVar(JM-XGB)":
                w = np.zeros(k) if bull.sum() < 4 else portfolio.solve(np.where(bull, 10e-4, 0.0), cov, held, 10.0, 1.0)
            else:
                w = portfolio.solve(mean, cov, held, 5.0, 0.0)  # without conditional means both mean-variance strategies are the plain one
            w = np.clip(w, 0, 1)
            turnover, rest, nxt = np.abs(w - held).sum(), max(1 - w.sum(), 0.0), ret.iloc[t + 1].to_numpy()
            row = x.loc[days[t + 1].date()]
            assert row.turnover == pytest.approx(turnover, abs=2e-5) and row.ret == pytest.approx(w @ nxt + rest * rf.iloc[t + 1] - turnover * 5e-4, abs=1e-6), (name, t)
            grown = w * (1 + nxt)
            held = grown / (grown.sum() + rest * (1 + rf.iloc[t + 1]))
    m = {r.strategy: r for r in got.metrics.collect()}
    for name, x in daily.items():
        over = x.ret - 1e-5
        wealth = (1 + over).cumprod()
        assert m[name].sharpe == pytest.approx(over.mean() * 252 / (over.std() * 252**0.5)) and m[name].mdd == pytest.approx((wealth / wealth.cummax() - 1).min())
    # a run that broke off after some assets: the rest is made, what is there is read
    shutil.rmtree(f"{path}/choices/asset=a3")
    again = main_run.forecasts(df, walk, penalties, start, path)[1]
    assert {(r.asset, r.rebal): r.penalty for r in again.collect()} == {k: v[0] for k, v in mine.items()}
    with pytest.raises(ValueError):
        strategies.targets(df, ["mix"])  # extra strategies are for one call alone


def test_all_penalties_at_once():
    """31 fits, each on its own, and the fits that go on together: the same labels, with features on a grid (ties) too."""
    for seed in range(12):
        r = np.random.default_rng(seed)
        n = int(r.integers(3, 700))
        x = np.cumsum(r.normal(size=(n, 3)), 0) * 0.2 + r.normal(size=(n, 3))
        x = np.round(x) if seed % 4 == 0 else x
        got = jump_model.fit_all(x, framework.PENALTIES, seed=seed)
        assert all(np.array_equal(a, jump_model.fit(x, 2, float(p), seed=seed)[0]) for a, p in zip(got, framework.PENALTIES, strict=True))
    x = R.normal(size=(60, 2))
    assert all(np.array_equal(a, jump_model.fit(x, 3, p)[0]) for a, p in zip(jump_model.fit_all(x, [5.0, 0.0, 1.0, 0.2], 3), [5.0, 0.0, 1.0, 0.2], strict=True))
    assert jump_model.best_paths(np.zeros((4, 2)), []) == []


def test_two_level_scans(spark):
    """Keys of 6,000, 40 and 1 rows over 16 partitions, with nulls: as pandas has them."""
    n = {"a": 6000, "b": 40, "c": 1}
    pdf = pd.concat([pd.DataFrame({"k": k, "t": np.arange(m), "v": np.where(R.random(m) < 0.1, np.nan, R.normal(1.0, 0.01, m) - 1)}) for k, m in n.items()])
    rows = [(k, int(t), None if np.isnan(v) else float(v)) for k, t, v in pdf.itertuples(index=False)] + [(None, 1, 0.5), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    p = scan.in_parts(df, ["k"], "t", 16)
    assert p.where("k = 'a'").select("_part").distinct().count() > 8 and p.groupBy("_part").count().agg(F.max("count")).first()[0] < 2000
    x = scan.running(p, ["k"], "t", s=("sum", F.col("v")), c=("count", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), prod=("product", 1 + F.col("v")), last=("last", F.col("v")))
    x = scan.ewm_mean(scan.drawdown(scan.moments_so_far(x, ["k"], "t", "v"), ["k"], "t", "v"), ["k"], "t", "v", 3)
    x = scan.expanding_z(x, ["k"], "t", "v").cache()
    for k, g in pdf.groupby("k"):
        got, v = x.where(F.col("k") == k).orderBy("t").toPandas(), g.v.reset_index(drop=True)
        same = lambda a, b: np.allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-11, equal_nan=True)
        assert same(got.s, v.cumsum().ffill()) and list(got.c) == list(v.notna().cumsum()) and same(got.hi, v.cummax().ffill()) and same(got.lo, v.cummin().ffill()) and same(got["last"], v.ffill())
        wealth = (1 + v.fillna(0)).cumprod()
        assert same(got["prod"], (1 + v).cumprod().ffill()) and same(got.drawdown, wealth / wealth.cummax() - 1)
        assert same(got["mean"], v.expanding().mean()) and same(got.sd, v.expanding().std())
        z = ((v - v.expanding().mean()) / np.maximum(v.expanding().std(), 1e-8)).where(v.notna().cumsum() >= 20)
        assert same(got["z"], z) and same(got["ewm"], v.ewm(halflife=3, ignore_na=False).mean().ffill())
    assert [r.s for r in x.where("k is null").orderBy("t").collect()] == [0.5, 0.5]
    assert scan.running(df.limit(0), ["k"], "t", s=("sum", F.col("v"))).count() == 0


def test_ranks_with_heavy_ties(spark):
    """One value in nine rows of ten, nulls, and values that occur once: pandas' average ranks, and no task with more than its share."""
    v = np.where(R.random(5000) < 0.9, 7.0, np.round(R.normal(7, 3, 5000), 2))
    v[R.random(5000) < 0.05] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)], "i int, v double").repartition(4)
    ranked = scan.average_rank(df, "v", "rk")
    got = ranked.orderBy("i").toPandas()
    assert np.allclose(got.rk.astype(float), pd.Series(v).rank(), equal_nan=True)
    assert scan.average_rank(df.limit(0), "v", "rk").count() == 0


def test_trend_so_far(spark):
    x = np.cumsum(R.normal(size=90))
    for penalty in (10.0, 1.6e6):
        want = [inference.hp_trend(x[: t + 1], penalty)[-1] for t in range(len(x))]
        assert np.allclose(inference.trend_so_far(x, penalty), want, rtol=1e-7, atol=1e-7)
    assert inference.trend_so_far(np.array([3.0, 5.0])).tolist() == [3.0, 5.0] and inference.trend_so_far(np.array([])).tolist() == []
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("s", 200, None), ("u", 1, 2.0)], "k string, t int, v double")
    got = trend.trend_so_far(df, ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r.n for r in got] == [*range(1, 91), 1] and got[-1].trend == 2.0 and got[89].trend + got[89].cycle == pytest.approx(x[-1])
