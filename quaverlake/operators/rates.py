"""Smoothed rates over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ewma(rows: DataFrame, key: str, at: Column, value: Column, alpha: float) -> DataFrame:
    """``(key, ewma)``: the exponentially weighted mean of a key's values in order of time.

    Values are to be pre-aggregated into time steps, which bounds a key's array by their number.
    Negative values count as 0.
    """
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.greatest(value, F.lit(0.0)).alias("v")))).alias("s"))
    return g.select(key, F.aggregate("s", F.lit(0.0), lambda m, x: x.v * alpha + m * (1 - alpha)).alias("ewma"))
