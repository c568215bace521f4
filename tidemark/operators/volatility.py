"""Range-based rolling variance estimators over bars (asset, b, o, h, l, c)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import by, last_rows


def estimators(bars: DataFrame, n: int = 21) -> DataFrame:
    """bars with cc, parkinson, gk, rs, yz: rolling variances; null before n bars (n + 1 where the last close is needed)."""
    o, h, lo, c = (F.ln(F.col(x)) for x in "ohlc")
    prev = F.lag(F.ln("c")).over(by("asset", "b"))
    d = bars.withColumns({"_cc": c - prev, "_on": o - prev, "_oc": c - o, "_pk": F.pow(h - lo, 2) / (4 * math.log(2)), "_gk": 0.5 * F.pow(h - lo, 2) - (2 * math.log(2) - 1) * F.pow(c - o, 2), "_rs": (h - o) * (h - c) + (lo - o) * (lo - c)})
    w, k = last_rows(n, "asset", "b"), 0.34 / (1.34 + (n + 1) / (n - 1))
    whole = lambda v, of: F.when(F.count(of).over(w) >= n, v)
    rs = F.avg("_rs").over(w)
    return d.select("asset", "b", whole(F.var_samp("_cc").over(w), "_cc").alias("cc"), whole(F.avg("_pk").over(w), "_pk").alias("parkinson"), whole(F.avg("_gk").over(w), "_gk").alias("gk"), whole(rs, "_rs").alias("rs"), whole(F.var_samp("_on").over(w) + k * F.var_samp("_oc").over(w) + (1 - k) * rs, "_on").alias("yz"))


def rolling_ratios(df: DataFrame, value: str = "er", window: int = 63, year: int = 252, key: str = "asset", order: str = "t") -> DataFrame:
    """df with rolling_ret, rolling_vol, rolling_sharpe and rolling_sortino of the last `window` rows; null before there are as many."""
    w, x = last_rows(window, key, order), F.col(value)
    whole = lambda v: F.when(F.count(x).over(w) >= window, v)
    ret, vol = F.avg(x).over(w) * year, F.stddev_samp(x).over(w) * F.sqrt(F.lit(float(year)))
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)).over(w)) * F.sqrt(F.lit(float(year)))
    floor = F.lit(1e-10)
    return df.withColumns({"rolling_ret": whole(ret), "rolling_vol": whole(vol), "rolling_sharpe": whole(ret / F.greatest(vol, floor)), "rolling_sortino": whole(ret / F.greatest(down, floor))})


def annualised(variance: str, days: int = 252):
    """Volatility a year of a variance a period; null where it isn't positive."""
    return F.when(F.col(variance) > 0, F.sqrt(F.col(variance) * days))
