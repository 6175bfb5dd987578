"""Derived scores: normalised by size, against a panel of other targets, and their long form with a status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(score: Column, atoms: Column, power: float, intercept: float, slope: float) -> dict[str, Column]:
    """per_size, per_power and residual of a score where less is stronger; null without atoms."""
    known = lambda c: F.when(atoms > 0, c)
    return {"per_size": known(-score / atoms), "per_power": known(-score / F.pow(atoms, F.lit(power))), "residual": known(intercept + slope * atoms - score)}


def metric_rows(df: DataFrame, key: str, metrics: Mapping[str, Column]) -> DataFrame:
    """key, metric, value, status: the long form; values that are missing or not finite are UNSCORABLE."""
    from .gates import finite

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])).alias("x")
    rows = df.select(key, each).select(key, "x.metric", "x.value")
    return rows.withColumn("status", F.when(finite(F.col("value")), "OK").otherwise("UNSCORABLE")).withColumn("value", F.when(F.col("status") == "OK", F.col("value")))


def specificity(df: DataFrame, key: str, is_target: Column, score: str) -> DataFrame:
    """key, delta_score (target less the panel's mean) and panel_win_count (panel scores at least as strong, less being
    stronger); keys need scores of both. The target's mean is joined back once, as wins need it."""
    rows = df.select(key, score, is_target.alias("__t"))
    target = rows.filter("__t").groupBy(key).agg(F.max(key).alias("__k"), F.avg(score).alias("__s")).drop(key)
    panel = rows.filter(~F.col("__t")).join(target, F.col(key) == F.col("__k"))
    return panel.groupBy(key).agg((F.max("__s") - F.avg(score)).alias("delta_score"), F.count_if(F.col(score) <= F.col("__s")).alias("panel_win_count"))


def proportions(df: DataFrame, key: str, value: str, enter: float) -> DataFrame:
    """key, proportion of rows below the threshold, their mean, and the least, largest and middle value."""
    near, v = F.col(value) < enter, F.col(value)
    return df.groupBy(key).agg((F.count_if(near) / F.count(F.lit(1))).alias("proportion"), F.avg(F.when(near, v)).alias("mean_in_contact"), F.min(v).alias("low"), F.max(v).alias("high"), F.median(v).alias("mid"))
