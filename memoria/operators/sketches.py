"""Mergeable roll-ups: a day's counts, different keys and values kept as sketches, which add up to those of any span of days.

HyperLogLog for numbers of keys, theta for keys that two spans share, KLL for quantiles. A day's row is made once and has a bounded size however many rows the day has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch sizes (2 to that power), the relative error of counts that three deviations allow, and the error of a quantile's rank.
LG = 12
COUNT_ERROR, RANK_ERROR = 0.05, 0.02


def daily(rows: DataFrame, time: str, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, day, n, keys, key_set, quantiles) of rows(by, time, key, value)."""
    return rows.groupBy(*(by or []), F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, LG).alias("keys"), F.theta_sketch_agg(key, LG).alias("key_set"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("quantiles")
    )


def merged(days: DataFrame, *span: Column | str) -> DataFrame:
    """The days' sketches added up for each span."""
    return days.groupBy(*span).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.theta_union_agg("key_set").alias("key_set"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def n_keys() -> Column:
    return F.hll_sketch_estimate("keys")


def n_shared(a: str, b: str) -> Column:
    """Keys that are in both sets, about."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def quantile(p: float, sketch: str = "quantiles") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def drift(before: str, after: str, steps: int = 10) -> Column:
    """The largest distance that a quantile moved, over `steps` even ranks, in spreads: of the inner nine tenths of the values before. Null without a spread."""
    ranks = [i / steps for i in range(1, steps)]
    spread = quantile(0.95, before) - quantile(0.05, before)
    return F.greatest(*(F.abs(quantile(p, after) - quantile(p, before)) for p in ranks)) / F.nullif(spread, F.lit(0.0))
