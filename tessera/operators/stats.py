"""Statistics of decisions: rank and agreement measures with intervals, order statistics, enrichment, conformal rates."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulative

Z95 = 1.959963984540054


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """positives, negatives, auc, se: chance that a positive outscores a negative (ties half), and its standard error.

    Null without both classes. Rows are first counted by score, so ties cost nothing.
    """
    by_score = df.filter(F.col(score).isNotNull() & positive.isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    ranked = cumulative(by_score, "s", ["q"])
    out = ranked.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0)).alias("wins"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    a = F.when(both, F.col("wins") / (F.col("positives") * F.col("negatives")))
    return out.select("positives", "negatives", a.alias("auc")).withColumn("se", auc_se(F.col("auc"), F.col("positives"), F.col("negatives")))


def auc_se(a: Column, positives: Column, negatives: Column) -> Column:
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    variance = (a * (1 - a) + (positives - 1) * (q1 - a * a) + (negatives - 1) * (q2 - a * a)) / (positives * negatives)
    return F.when(a.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), variance)))


def wilson(hits: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share; exactly 0 and 1 at the ends, null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = hits / n
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(trials == 0, None).when(hits == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / scale))
    high = F.when(trials == 0, None).when(hits == trials, 1.0).otherwise(F.least(F.lit(1.0), (centre + half) / scale))
    return low, high


def confusion(df: DataFrame, call: Column, truth: Column) -> DataFrame:
    """tp, fp, tn, fn, sensitivity, specificity, youden and its bounds from the two Wilson intervals."""
    n = df.agg(F.count_if(call & truth).alias("tp"), F.count_if(call & ~truth).alias("fp"), F.count_if(~call & ~truth).alias("tn"), F.count_if(~call & truth).alias("fn"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    (sl, sh), (cl, ch) = wilson(F.col("tp"), pos), wilson(F.col("tn"), neg)
    rate = lambda a, b: F.when(b > 0, a / b)
    out = n.withColumn("sensitivity", rate(F.col("tp"), pos)).withColumn("specificity", rate(F.col("tn"), neg))
    return out.withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1).withColumn("youden_low", sl + cl - 1).withColumn("youden_high", sh + ch - 1)


def cohen_kappa(df: DataFrame, left: str, right: str) -> DataFrame:
    """n, agreement, kappa, se of two raters; (0, 0) where chance agreement is 1."""
    cells = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("l") == F.col("r"), F.col("c")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy("l").agg(F.sum("c").alias("a")), cells.groupBy("r").agg(F.sum("c").alias("b"))
    chance = rows.join(cols, F.col("l") == F.col("r")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    out = n.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("ab") / (F.col("n") * F.col("n"))).alias("pe"))  # one row each
    sure = 1 - F.col("pe") < 1e-12
    kappa = F.when(sure, 0.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    se = F.when(sure, 0.0).otherwise(F.sqrt(F.col("po") * (1 - F.col("po")) / (F.col("n") * (1 - F.col("pe")) * (1 - F.col("pe")))))
    return out.select("n", F.col("po").alias("agreement"), kappa.alias("kappa"), se.alias("se"))


def fleiss_kappa(votes: DataFrame, record: str, vote: str) -> DataFrame:
    """records, raters, kappa; null unless every record has the same number of at least two raters."""
    cells = votes.groupBy(record, vote).agg(F.count(F.lit(1)).alias("c"))
    per = cells.groupBy(record).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    agreed = per.agg(F.count(F.lit(1)).alias("records"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg((F.col("sq") - F.col("m")) / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0))).alias("p"))
    shares = cells.groupBy(vote).agg(F.sum("c").alias("c"))
    total = shares.agg((F.sum(F.col("c").cast("double") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    out = agreed.crossJoin(total)  # one row each
    kappa = F.when((F.col("lo") != F.col("hi")) | (F.col("lo") < 2), None).when(1 - F.col("pe") < 1e-12, 0.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe")))
    return out.select("records", F.col("hi").alias("raters"), kappa.alias("kappa"))


def effective_votes(mean_correlation: float | None, seats: int) -> float:
    """Seats that as many independent ones would be worth."""
    if seats <= 1 or mean_correlation is None or mean_correlation <= 0:
        return float(seats)
    return seats / (1 + (seats - 1) * mean_correlation)


def mid_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the mean rank (from 1) of each row's value; ties share it."""
    counts = df.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = cumulative(counts, "__v", ["__n"]).select("__v", (F.col("before___n") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranked, F.col(value).cast("double") == F.col("__v")).drop("__v")


def spearman(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """n, rho, low, high over complete pairs; null with fewer than ``least``."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(x, y)
    ranked = mid_ranks(mid_ranks(pairs, x, "__rx"), y, "__ry")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("__rx", "__ry") / F.nullif(F.stddev_pop("__rx") * F.stddev_pop("__ry"), F.lit(0.0))).alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    z, se = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho")))), 1 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))
    return out.withColumn("low", F.tanh(z - 1.96 * se)).withColumn("high", F.tanh(z + 1.96 * se))


def _counted(df: DataFrame, value: Column) -> DataFrame:
    """v, n, before_n: counts of the finite values, and how many are smaller."""
    counts = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, "v", ["n"])


def _at(counted: DataFrame, index: int) -> float | None:
    hit = counted.filter((F.col("before_n") <= index) & (F.col("before_n") + F.col("n") > index)).select("v").first()
    return None if hit is None else hit[0]


def order_statistic(df: DataFrame, value: str, index: int, ascending: bool = True) -> float | None:
    """The value at a 0-based rank among finite ones: counted by value, then read off the cumulative counts."""
    v = F.col(value).cast("double")
    found = _at(_counted(df, v if ascending else -v), index)
    return found if found is None or ascending else -found


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of finite values, the mean of the middle two of an even number: two look-ups in one table of counts."""
    counted = _counted(df, value.cast("double"))
    n = counted.agg(F.sum("n")).first()[0]
    if not n:
        return None
    return (_at(counted, (n - 1) // 2) + _at(counted, n // 2)) / 2


def percentile_threshold(df: DataFrame, value: str, keep: float, lower_is_stronger: bool) -> float | None:
    """The score that keeps the best share: best first, at rank ceil(keep * n) - 1. The scores are counted once."""
    v = F.col(value).cast("double")
    counted = _counted(df, v if lower_is_stronger else -v)
    n = counted.agg(F.sum("n")).first()[0]
    if not n:
        return None
    found = _at(counted, min(n - 1, max(0, math.ceil(keep * n) - 1)))
    return found if lower_is_stronger else -found


def percentile_of(panel: DataFrame, population: DataFrame, value: str) -> DataFrame:
    """Panel rows with share: the part of the population's values that are not larger."""
    both = population.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("n")).unionByName(panel.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("n")))
    counts = both.filter("v is not null").groupBy("v").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = cumulative(counts, "v", ["n"]).crossJoin(F.broadcast(total))  # one row
    return panel.join(shares.select("v", ((F.col("before_n") + F.col("n")) / F.col("total")).alias("share")), F.col(value).cast("double") == F.col("v")).drop("v")


def enrichment(df: DataFrame, score: str, key: str, active: Column, fractions: list[float]) -> DataFrame:
    """fraction, k, hits, base_rate, factor and the hits' Wilson interval, for the top round(f * n) rows by score.

    Ties of the score go by key. Scores are counted, not sorted; only the ties at a cut are ranked by key, in ranges.
    """
    spark = df.sparkSession
    known = df.filter(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(key).alias("k"), active.alias("a"))
    by = known.groupBy((-F.col("s")).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("a"))
    before = cumulative(by, "v", ["n", "a"])
    n, actives = before.agg(F.sum("n"), F.sum("a")).first()
    rows = []
    for f in fractions if n else []:
        k = max(1, round(n * f))
        edge = before.filter((F.col("before_n") < k) & (F.col("before_n") + F.col("n") >= k)).first()
        hits, left = edge["before_a"], k - edge["before_n"]
        if left == edge["n"]:
            hits += edge["a"]
        else:
            ties = known.filter(F.col("s") == -edge["v"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("a"))
            hits += cumulative(ties, "k", ["n"]).filter(F.col("before_n") < left).agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
        rows.append((float(f), n, k, hits, actives / n))
    out = spark.createDataFrame(rows, "fraction double, n bigint, k bigint, hits bigint, base_rate double")
    low, high = wilson(F.col("hits"), F.col("k"))
    factor = F.when(F.col("base_rate") > 0, F.col("hits") / F.col("k") / F.col("base_rate"))
    return out.withColumn("factor", factor).withColumn("low", low).withColumn("high", high).select("fraction", "n", "k", "hits", "base_rate", "factor", "low", "high")


def conformal_rank(n: int, alpha: float) -> int:
    """1-based rank of the finite-sample quantile."""
    return min(n, max(1, math.ceil((n + 1) * (1 - alpha))))


def cost_quote(charges: list[float], configured: float) -> float:
    """max(configured, the ceil(0.9 n)-th positive charge)."""
    positive = sorted(c for c in charges if c > 0)
    return max(configured, positive[math.ceil(0.9 * len(positive)) - 1]) if positive else configured


def share_not_above(sorted_values: list[float], x: float) -> float | None:
    return bisect_right(sorted_values, x) / len(sorted_values) if sorted_values else None
