"""Streams with timers and corrections against the batch operators."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.series import as_of
from tidemark.operators import forecast
from tidemark.sources import sinks
from tidemark.streaming import corrections, processors

R = np.random.default_rng(11)


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.prepare(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def drained(spark, stream, name, checkpoint):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def batches(spark, parts, schema, path):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def rows_of(asset: str, days, judge_every: int):
    state = np.repeat(R.integers(0, 2, len(days) // 20 + 1), 20)[: len(days)]
    return [(asset, d.date(), i % judge_every == 0, float(state[i] + R.normal(0, 0.3)), float(R.normal())) for i, d in enumerate(days)]


ROWS = "asset string, dt date, judge boolean, f1 double, f2 double"
SETTINGS = {"window": 120, "least": 60, "penalty": 2.0, "safety_days": 100}


def test_refits_equal_the_batch_operator(rocksdb, tmp_path):
    """Two assets judged every 10 days: all reasons, calendar_safety too, come from rows, as they do in a batch; a day that comes again is left out."""
    days = pd.date_range("2020-01-01", periods=400)
    whole = sorted(rows_of("a", days, 10) + rows_of("b", days, 10), key=lambda r: r[1])
    parts = [whole[:300], [whole[299], *whole[300:500]], whole[500:]]
    stream = batches(rocksdb, parts, ROWS, tmp_path / "rows")
    got = drained(rocksdb, processors.refit_events(stream, ["f1", "f2"], 0.2, 2.0, **SETTINGS), "refits", tmp_path / "c").orderBy("asset", "dt").toPandas()
    df = rocksdb.createDataFrame([(*r, i) for i, r in enumerate(whole)], ROWS + ", t long")
    want = forecast.refit_events(df, ["f1", "f2"], "judge", 0.2, 2.0, **SETTINGS).orderBy("asset", "dt").toPandas()
    assert list(zip(got.asset, got.dt, got.reason, strict=True)) == list(zip(want.asset, want.dt, want.reason, strict=True))
    assert {"initial", "calendar_safety"} <= set(got.reason)
    assert np.allclose(got[["ari_now", "mrl_now"]].astype(float), want[["ari_now", "mrl_now"]].astype(float), equal_nan=True)


def test_a_timer_refits_an_asset_without_rows(rocksdb, tmp_path):
    """Asset a stops after 100 days; as b goes on, a's safety refits come by timer, one every safety_days + grace days."""
    days = pd.date_range("2020-01-01", periods=460)
    a, b = rows_of("a", days[:100], 10), rows_of("b", days, 10)
    parts = [a + b[:100], b[100:200], b[200:300], b[300:459], b[459:]]
    stream = batches(rocksdb, parts, ROWS, tmp_path / "rows")
    got = drained(rocksdb, processors.refit_events(stream, ["f1", "f2"], -1.0, 0.0, grace_days=20, **SETTINGS), "timed", tmp_path / "c").where("asset = 'a'").orderBy("dt").collect()
    assert [r.reason for r in got] == ["initial"] + ["calendar_safety"] * (len(got) - 1) and len(got) >= 3
    assert all((y.dt - x.dt).days == 120 and y.days_since_last == 120 for x, y in itertools.pairwise(got))
    assert all(r.ari_now == 1.0 for r in got[2:])  # the same rows again


def test_episodes_are_flushed(rocksdb, tmp_path):
    days = pd.date_range("2021-01-01", periods=60)
    y = {"a": [0] * 10 + [1] * 15 + [0] * 5, "b": [1] * 20 + [0] * 25 + [1] * 15}
    rows = sorted(((k, d, v) for k in y for d, v in zip(days.to_pydatetime(), y[k], strict=False)), key=lambda r: r[1])
    rows.append(("a", days[55].to_pydatetime(), 0))  # after a silence of 25 days: another run, though of the same regime
    rows.sort(key=lambda r: r[1])
    parts = [rows[:25], rows[25:70], rows[70:], [("c", pd.Timestamp("2022-01-01").to_pydatetime(), 1)], [("c", pd.Timestamp("2022-01-02").to_pydatetime(), 1)]]
    stream = batches(rocksdb, parts, "asset string, ts timestamp, regime int", tmp_path / "labels")
    got = drained(rocksdb, processors.regime_episodes(stream, idle_days=10), "episodes", tmp_path / "c").where("asset <> 'c'").orderBy("asset", "start").collect()
    want = [(k, v, len(list(g))) for k in y for v, g in itertools.groupby(y[k])]
    want.insert(3, ("a", 0, 1))
    assert [(r.asset, r.regime, r.n) for r in got] == want
    assert (got[0].start, got[0].end) == (days[0].to_pydatetime(), days[9].to_pydatetime())


def test_late_prints_correct_what_was_sent(spark, tmp_path):
    """Days and prints in any order, prints late by months, one corrected, one batch run again: the table equals a batch as-of join at the end, and other months stay as written."""
    days = [(d.date(), int(i)) for i, d in enumerate(pd.date_range("2020-01-01", periods=150))]
    at = lambda i: days[i][0]
    live = corrections.LivePanel(spark, str(tmp_path / "live"), "dt date, n long", ["cpi", "rate"])
    frame = lambda rows: spark.createDataFrame(rows, "series string, dt date, v double")
    live.add_prints(frame([("cpi", at(0), 1.0), ("rate", at(3), 5.0), ("other", at(1), 9.0)]), 0)
    live.add_days(spark.createDataFrame(days[:100], "dt date, n long"), 0)
    live.add_days(spark.createDataFrame(days[100:], "dt date, n long"), 1)
    live.add_days(spark.createDataFrame(days[100:], "dt date, n long"), 1)
    before = {p.name: [f.stat().st_mtime_ns for f in p.iterdir()] for p in (tmp_path / "live/panel").glob("_month=*")}
    live.add_prints(frame([("cpi", at(120), 3.0)]), 1)
    live.add_prints(frame([("cpi", at(95), 2.0), ("rate", at(3), 6.0)]), 2)
    live.add_prints(frame([("rate", at(40), 7.0)]), 3)
    live.add_prints(frame([("cpi", at(95), 2.5)]), 4)
    live.add_prints(frame([("rate", at(40), 7.0)]), 3)
    prints = [(at(0), 1.0, None), (at(95), 2.5, None), (at(120), 3.0, None), (at(3), None, 6.0), (at(40), None, 7.0)]
    want = as_of(spark.createDataFrame(days, "dt date, n long"), spark.createDataFrame(prints, "dt date, cpi double, rate double"), "dt", ["cpi", "rate"])
    assert sorted(live.panel().collect()) == sorted(want.collect()) and live.panel().where("cpi = 2.5").count() == 25
    after = {p.name: [f.stat().st_mtime_ns for f in p.iterdir()] for p in (tmp_path / "live/panel").glob("_month=*")}
    assert after.keys() == before.keys() and after != before
    live.add_prints(frame([("cpi", at(149), 4.0)]), 5)
    last = {p.name: [f.stat().st_mtime_ns for f in p.iterdir()] for p in (tmp_path / "live/panel").glob("_month=*")}
    assert [k for k in last if last[k] != after[k]] == ["_month=2020-05"]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    sinks.upsert(spark.createDataFrame([(3, "b")], "v int, k string"), path, ["k"])
    assert {(r.v, r.k) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
