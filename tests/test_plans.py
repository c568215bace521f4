"""Every query against its DuckDB SQL on the smallest tables, and the numeric operators against plain loops."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.functions import inference
from tidemark.operators import jump_model, portfolio
from tidemark.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    key = lambda d: Counter(tuple("" if v is None or v != v else round(v, 5) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v for v in row) for row in d[cols].astype(object).itertuples(index=False))
    assert key(mine) == key(theirs)


def test_jump_model():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(2, 0.1, (200, 2)), r.normal(-2, 0.1, (200, 2))])
    labels, _ = jump_model.fit(x, 2, 10.0)
    assert len(set(labels[:200])) == len(set(labels[200:])) == 1 and labels[0] != labels[-1]
    assert np.count_nonzero(np.diff(jump_model.fit(r.normal(size=(100, 3)), 2, 1e6)[0])) <= 1
    assert jump_model.fit(r.normal(size=(300, 4)), 2, 0.0)[1].shape == (2, 4)


def test_programme():
    r = np.random.default_rng(4)
    a = r.normal(size=(4, 4))
    s = a @ a.T / 4 + 1e-4 * np.eye(4)
    w = portfolio.optimise(np.array([0.001, 0.002, -0.001, 0.0005]), s, np.zeros(4), 10.0, 0.0)
    assert (w >= 0).all() and w.sum() <= 1 + 1e-9 and (w <= 0.4 + 1e-9).all()
    assert portfolio.optimise(np.full(4, -0.01), 1e-4 * np.eye(4), np.zeros(4), 10.0, 0.0).sum() < 0.05


def test_tails():
    assert abs(inference.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(inference.normal_two_sided(1.959963984540054) - 0.05) < 1e-9
    assert abs(inference.t_two_sided(2.228138851964939, 10) - 0.05) < 1e-9 and abs(inference.t_two_sided(12.706204736432095, 1) - 0.05) < 1e-9
    assert abs(inference.f_tail(4.964602743730711, 1, 10) - 0.05) < 1e-9 and abs(inference.f_tail(3.3258345304130117, 5, 10) - 0.05) < 1e-7
    assert abs(inference.mann_whitney_p(23, 10, 10) - 0.0451) < 5e-4 and inference.mann_whitney_p(50, 10, 10) == 1.0
    assert inference.holm([0.01, 0.04, 0.03]) == [(0.01, 0.03, True), (0.03, 0.06, False), (0.04, 0.04, False)]
