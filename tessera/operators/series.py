"""Series and trajectory analytics over (series, position, value) tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def moving_average(df: DataFrame, series: str, order: list[str], value: str, width: int) -> DataFrame:
    """Means of full windows only: the first width - 1 rows of a series have none."""
    w = Window.partitionBy(series).orderBy(*order)
    n = F.row_number().over(w)
    mean = F.avg(value).over(w.rowsBetween(-(width - 1), 0))
    return df.withColumn("moving_average", F.when(n >= width, mean))


def _numbered(df: DataFrame, series: str, order: list[str]) -> DataFrame:
    """Rows with __i, their number in the series, and __n, its length; long series are ranked in ranges."""
    rows = ranked(df, [series], order, "__i")
    total = rows.groupBy(series).agg(F.max(series).alias("__s"), F.count(F.lit(1)).alias("__n")).drop(series)
    return rows.join(total, F.col(series).eqNullSafe(F.col("__s"))).drop("__s")


def drift(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series, n, head_mean, tail_mean, drift (tail - head), fluctuation: the tail is the final third of a series."""
    rows = _numbered(df.select(series, *order, value), series, order).withColumn("__i", F.col("__i") - 1)
    tail = F.col("__i") >= F.col("__n") - F.floor(F.col("__n") / 3)
    out = rows.groupBy(series).agg(
        F.max("__n").alias("n"), F.avg(F.when(~tail, F.col(value))).alias("head_mean"), F.avg(F.when(tail, F.col(value))).alias("tail_mean"), F.stddev_samp(F.when(tail, F.col(value))).alias("fluctuation")
    )
    return out.withColumn("drift", F.col("tail_mean") - F.col("head_mean"))


def hysteresis(df: DataFrame, series: str, order: list[str], value: str, enter: float, leave: float) -> DataFrame:
    """Adds in_contact: on from a value below ``enter`` until one above ``leave``; between the two it stays as it was."""
    w = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    signal = F.when(F.col(value) < enter, 1).when(F.col(value) > leave, 0)
    return df.withColumn("in_contact", F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(0)) == 1)


def unique_so_far(df: DataFrame, series: str, order: list[str], item: str) -> DataFrame:
    """Adds the number of distinct items up to each row: a running sum over first sights."""
    by_item = Window.partitionBy(series, item).orderBy(*order)
    run = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__first", (F.row_number().over(by_item) == 1).cast("bigint")).withColumn("unique_so_far", F.sum("__first").over(run)).drop("__first")


def histogram(df: DataFrame, series: str, value: str, low: float, width: float, bins: int) -> DataFrame:
    """series, bin, p: normalised counts over half-open bins; values outside are dropped."""
    b = F.floor((F.col(value) - low) / width).cast("int")
    counts = df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(series, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(series, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(series))).alias("p"))


def adjacent_overlap(hist: DataFrame, series: str, flag_below: float = 0.10) -> DataFrame:
    """left_series, right_series, overlap (sum of the lesser shares) and flagged, for each two series that follow in order."""
    names = hist.select(series).distinct()
    after = names.select(F.col(series).alias("left_series"), F.lead(series).over(Window.orderBy(series)).alias("right_series")).filter("right_series is not null")  # one row a series
    a = hist.select(F.col(series).alias("ls"), F.col("bin").alias("lb"), F.col("p").alias("lp"))
    b = hist.select(F.col(series).alias("rs"), F.col("bin").alias("rb"), F.col("p").alias("rp"))
    both = after.join(a, F.col("left_series") == F.col("ls"), "left").join(b, (F.col("right_series") == F.col("rs")) & (F.col("lb") == F.col("rb")), "left")
    out = both.groupBy("left_series", "right_series").agg(F.sum(F.least("lp", F.coalesce("rp", F.lit(0.0)))).alias("overlap"))
    return out.withColumn("flagged", F.col("overlap") < flag_below)


def prefix_means(df: DataFrame, series: str, order: list[str], value: str, parts: int) -> DataFrame:
    """series, part, n, mean over the first part/parts of each series: how an estimate settles as data grow."""
    rows = _numbered(df.select(series, *order, value), series, order).withColumn("part", F.ceil(F.col("__i") * parts / F.col("__n")).cast("int"))
    cells = rows.groupBy(series, "part").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("c"), F.sum(value).alias("s"))
    whole = cells.select(series, "n", "c", "s", F.explode(F.sequence(F.col("part"), F.lit(parts))).alias("part"))  # a cell counts for itself and all after it
    return whole.groupBy(series, "part").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"))


def repeats(df: DataFrame, repeat: str, bound: str, unbound: str, error: str) -> DataFrame:
    """n, mean, stderr of the repeats' differences of means, and the pooled error sqrt(sum of squares / n)."""
    per = df.groupBy(repeat).agg((F.avg(bound) - F.avg(unbound)).alias("d"), F.avg(error).alias("e"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("stderr"), F.sqrt(F.sum(F.col("e") * F.col("e")) / F.count(F.lit(1))).alias("pooled_error"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Left rows with the latest value of the right side at or before them: one sort of both sides by key and time."""
    cols = [c for c in left.columns]
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    for c in cols:
        if c not in (key, at):
            b = b.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(f"{value}_as_of", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*cols, f"{value}_as_of")


def weighted_window(df: DataFrame, series: str, order: list[str], value: str, weights: list[float]) -> DataFrame:
    """Adds smoothed: the weighted sum of a full window around each row (an odd number of weights); its ends have none.

    With the weights of a least-squares polynomial this is Savitzky-Golay smoothing.
    """
    if len(weights) % 2 == 0:
        raise ValueError("an odd number of weights")
    half, w = len(weights) // 2, Window.partitionBy(series).orderBy(*order)
    terms = [F.lead(value, i).over(w) if i >= 0 else F.lag(value, -i).over(w) for i in range(-half, half + 1)]
    return df.withColumn("smoothed", sum((t * F.lit(float(c)) for t, c in zip(terms, weights, strict=True)), F.lit(0.0)))


def poisson_bootstrap(df: DataFrame, key: str, value: str, rounds: int, seed: str, most: int = 12) -> DataFrame:
    """mean, spread of the means of ``rounds`` resamples: a row counts in each as often as a Poisson number of mean 1,
    drawn by a hash of seed, round and key, so it does not depend on partitions. One aggregate by round, no sampling
    with state; numbers above ``most`` (below one in 10**9) count as that."""
    cuts, p, c = [], math.exp(-1), 0.0
    for k in range(most):
        c += p / math.factorial(k)
        cuts.append(c)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("__r").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.filter(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("__r")).withColumn("__n", times)
    means = rows.groupBy("__r").agg((F.sum(F.col("__n") * F.col(value)) / F.nullif(F.sum("__n"), F.lit(0))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("spread"))
