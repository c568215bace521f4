"""Trends of series as they were known at each date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import inference


def trend_so_far(df: DataFrame, keys: list[str], order: str, value: str, penalty: float = 1.6e6) -> DataFrame:
    """(keys, order, n, trend, cycle): for every row, the trend that the key's rows up to it have there, and the value less that; n counts these rows.

    One pass over a key's rows, a task a key: nothing is solved anew for a date. Rows with a null value are left out.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*keys, order]}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        trend = inference.trend_so_far(x, penalty)
        return pdf[[*keys, order]].assign(n=np.arange(1, len(x) + 1), trend=trend, cycle=x - trend)

    rows = df.select(*keys, order, value).dropna(subset=[value])
    return rows.groupBy(*keys).applyInPandas(one, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n long, trend double, cycle double")
