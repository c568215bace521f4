"""Values of queries that SQL does not say, on the smallest tables, against pandas loops over their inputs."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import calendar, inference
from tidemark.operators import stability
from tidemark.plans import queries as plans
from tidemark.plans import research, studies
from tidemark.sources import tables

DATA = "/root/testdata/sf0.001"


def partition_measures(x: np.ndarray, y: np.ndarray):
    """(Davies-Bouldin, Calinski-Harabasz) of a partition into 0 and 1."""
    a, b = x[y == 0], x[y == 1]
    ca, cb = a.mean(0), b.mean(0)
    spread = np.linalg.norm(a - ca, axis=1).mean() + np.linalg.norm(b - cb, axis=1).mean()
    inside = ((a - ca) ** 2).sum() + ((b - cb) ** 2).sum()
    between = len(a) * ((ca - x.mean(0)) ** 2).sum() + len(b) * ((cb - x.mean(0)) ** 2).sum()
    return spread / np.linalg.norm(ca - cb), between / (inside / (len(x) - 2))


def test_jump_validity(spark):
    fits = research.jump_fits(spark, DATA).toPandas()
    want = {}
    for (asset, _), g in fits.groupby(["asset", "rebal"]):
        x, y = g[["f1", "f2"]].to_numpy(), g.regime.to_numpy()
        if len(set(y)) == 2 and len(x) >= 4:
            size = np.bincount(y)
            s = stability.mean_silhouette(x, y) if size.min() >= 2 else np.nan
            want.setdefault(asset, []).append((s, *partition_measures(x, y)))
    got = {r.asset: r for r in plans.QUERIES["stb_jump_validity"](spark, DATA).collect()}
    assert set(got) == set(fits.asset)
    for a, rows in want.items():
        mean = np.nanmean(np.array(rows), 0)
        assert got[a].silhouette == pytest.approx(mean[0]) and got[a].davies_bouldin == pytest.approx(mean[1]) and got[a].calinski_harabasz == pytest.approx(mean[2])


def test_window_size_slopes(spark):
    p = studies.features(spark, DATA).toPandas().sort_values(["asset", "dt"])
    days = sorted(r.rebal for r in calendar.rebalance_days(tables.panel(spark, DATA).select("dt").distinct(), calendar.months_of("quarterly")).collect())
    got = {r.asset: r for r in plans.QUERIES["sta_window_size_slopes"](spark, DATA).collect()}
    assert got
    for asset, g in p.groupby("asset"):
        points = []
        for d in days:
            whole = g[g.dt < d]
            pair = []
            for rows in (whole, whole.tail(1260)):
                y = np.where(rows.f2 < rows.f2.mean(), 1, 0)
                rows, y = rows[["f1", "f2"]].to_numpy(float), y
                ok = np.isfinite(rows).all(1)
                rows, y = rows[ok], y[ok]
                if len(rows) >= 252 and len(set(y)) == 2:
                    pair.append((len(rows), partition_measures(rows, y)[1]))
            if len(pair) == 2:
                points.append(pair)
        if len(points) >= 8:
            for k, kind in enumerate(("expanding", "last")):
                n, ch = (np.array([x[k][j] for x in points], float) for j in (0, 1))
                if np.ptp(n) > 0:
                    b, se = inference.hac_ols(n, ch)
                    assert got[asset][f"slope_{kind}"] == pytest.approx(b[1], rel=1e-6) and got[asset][f"p_{kind}"] == pytest.approx(inference.normal_two_sided(b[1] / se[1]), rel=1e-5, abs=1e-12)


def test_strategy_metrics(spark):
    """EW and the fixed mix of bkt_strategies: daily loops over the panel, then the metrics."""
    p = research.strategy_panel(spark, DATA).toPandas()
    wide = {c: p.pivot(index="dt", columns="asset", values=c).sort_index() for c in ("ret", "rf")}
    ret, rf = wide["ret"].fillna(0.0), wide["rf"].iloc[:, 0]
    mix = {"AF": 0.3, "NF": 0.3, "RF": 0.2, "AO": 0.1, "NO": 0.05, "RO": 0.05}
    got = {r.strategy: r for r in plans.QUERIES["bkt_strategies"](spark, DATA).collect()}
    assert set(got) == {"mix", "MinVar", "MinVar(JM-XGB)", "MV", "MV(JM-XGB)", "EW", "EW(JM-XGB)"}
    for name, target in (("mix", np.array([mix[a] for a in ret.columns])), ("EW", np.full(ret.shape[1], 1 / ret.shape[1]))):
        held, over, traded = np.full(ret.shape[1], 1 / ret.shape[1]), [], []
        for t in range(len(ret) - 1):
            turnover, rest, x = np.abs(target - held).sum(), max(1 - target.sum(), 0.0), ret.iloc[t + 1].to_numpy()
            over.append(target @ x + rest * rf.iloc[t + 1] - turnover * 5e-4 - rf.iloc[t + 1])
            traded.append(turnover)
            grown = target * (1 + x)
            held = grown / (grown.sum() + rest * (1 + rf.iloc[t + 1]))
        over = pd.Series(over)
        wealth = (1 + over).cumprod()
        r = got[name]
        assert r.ann_ret == pytest.approx(over.mean() * 252) and r.sharpe == pytest.approx(over.mean() / over.std() * 252**0.5) and r.mdd == pytest.approx((wealth / wealth.cummax() - 1).min()) and r.turnover == pytest.approx(np.mean(traded) * 252)
    assert all(0 <= r.leverage <= 1 + 1e-9 for r in got.values())
