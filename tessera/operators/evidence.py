"""Rulings over evidence: votes, admission, attribution, calibration and skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulative
from .sizes import small


def vote_outcomes(votes: DataFrame, record: str, vote: str) -> DataFrame:
    """record, outcome: agreement can only add a refusal, and clearing never certifies."""
    n = votes.groupBy(record).agg(F.count_if(F.col(vote) == "refuse").alias("__r"), F.count_if(F.col(vote) == "clear").alias("__c"))
    outcome = F.when((F.col("__r") > 0) & (F.col("__c") > 0), "SPLIT").when(F.col("__r") > 0, "REFUSED").when(F.col("__c") > 0, "CLEARED_BUT_UNCERTIFIED").otherwise("NO_VOTE")
    return n.select(record, outcome.alias("outcome"))


def active_waivers(waivers: DataFrame, on: Column, expires: str) -> DataFrame:
    """Waivers that hold on a date: up to and with the day they expire; there is no lower bound."""
    return waivers.filter(on <= F.col(expires))


def attribute(observations: DataFrame, bands: DataFrame, record: str, value: str) -> DataFrame:
    """record, candidates, verdict: which bands [lower, upper] an observed divergence fits.

    ``bands`` has fault, lower and upper; a null upper bound can never be exceeded. No value is
    NO_FAULT_OBSERVED, no fitting band UNEXPLAINED, one ATTRIBUTED, more AMBIGUOUS.
    """
    fits = (F.abs(F.col(value)) >= F.col("lower")) & (F.col("upper").isNull() | (F.abs(F.col(value)) <= F.col("upper")))
    out = observations.join(small(bands), fits, "left").groupBy(record).agg(F.sort_array(F.collect_list("fault")).alias("candidates"), F.max(value).alias("__v"))
    n = F.size("candidates")
    verdict = F.when(F.col("__v").isNull(), "NO_FAULT_OBSERVED").when(n == 0, "UNEXPLAINED").when(n == 1, "ATTRIBUTED").otherwise("AMBIGUOUS")
    return out.select(record, F.array_join("candidates", ",").alias("candidates"), verdict.alias("verdict"))


def conformal(rows: DataFrame, group: str, predicted: str, observed: str, spread: str, alpha: float, floor: float, least: int) -> DataFrame:
    """n, quantile, marginal, worst_group, median_half_width of nonconformity abs(residual) / (spread + floor).

    The quantile has finite-sample rank ceil((n + 1)(1 - alpha)), at most n. Groups with fewer than ``least`` rows
    don't count for the worst; without any it is 1.
    """
    from .stats import conformal_rank, median, order_statistic

    scored = rows.filter(F.col(predicted).isNotNull() & F.col(observed).isNotNull()).withColumn("score", F.abs(F.col(observed) - F.col(predicted)) / (F.col(spread) + floor))
    n = scored.count()
    if not n:
        return scored.sparkSession.createDataFrame([], "n bigint, quantile double, marginal double, worst_group double, median_half_width double")
    q = order_statistic(scored, "score", conformal_rank(n, alpha) - 1)
    by = scored.groupBy(group).agg(F.count(F.lit(1)).alias("c"), F.avg((F.col("score") <= q).cast("double")).alias("share"), F.sum((F.col("score") <= q).cast("bigint")).alias("inside"))
    out = by.agg(F.sum("c").alias("n"), (F.sum("inside") / F.sum("c")).alias("marginal"), F.coalesce(F.min(F.when(F.col("c") >= least, F.col("share"))), F.lit(1.0)).alias("worst_group"))
    half = median(scored, (F.col(spread) + floor) * q)
    return out.select("n", F.lit(q).alias("quantile"), "marginal", "worst_group", F.lit(half).alias("median_half_width"))


def leave_one_out(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, skill: 1 - SSE of predicting each value by the others' group mean over that by the others' overall mean.

    Both means are totals less the row itself; no row meets another.
    """
    total = rows.agg(F.count(value).alias("tn"), F.sum(value).alias("ts"))
    g = rows.groupBy(group).agg(F.max(group).alias("g"), F.count(value).alias("gn"), F.sum(value).alias("gs")).drop(group)
    both = rows.filter(F.col(value).isNotNull()).join(g, F.col(group) == F.col("g")).crossJoin(F.broadcast(total)).filter("gn > 1 and tn > 1")  # total: one row
    v = F.col(value)
    own = v - (F.col("gs") - v) / (F.col("gn") - 1)
    base = v - (F.col("ts") - v) / (F.col("tn") - 1)
    out = both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(own * own).alias("a"), F.sum(base * base).alias("b"))
    return out.select(group, "n", F.when(F.col("b") > 0, 1 - F.col("a") / F.col("b")).alias("skill"))


def admission_rate(rows: DataFrame, group: str, admitted: Column) -> DataFrame:
    """group, rate: the mean of a Beta(1, 1) posterior, (1 + admitted) / (2 + seen)."""
    return rows.groupBy(group).agg(((1 + F.count_if(admitted)) / (2 + F.count(F.lit(1)))).alias("rate"))


def admit(candidates: DataFrame, known: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Candidates with status: KNOWN if key or content is in the pool, DUPLICATE after the first of its content, else ACCEPTED.

    The first of a content is an aggregate with partial results, so very many copies don't meet in one task.
    """
    least = candidates.groupBy(content).agg(F.max(content).alias("__cc"), F.min(F.struct(order, key)).alias("__f")).drop(content)
    first = F.col(order).eqNullSafe(F.col(f"__f.{order}")) & F.col(key).eqNullSafe(F.col(f"__f.{key}"))
    keys = known.select(F.col(key).alias("__k")).distinct().withColumn("__has_key", F.lit(True))
    contents = known.select(F.col(content).alias("__c")).distinct().withColumn("__has_content", F.lit(True))
    out = candidates.join(least, F.col(content) == F.col("__cc"), "left").join(keys, F.col(key) == F.col("__k"), "left").join(contents, F.col(content) == F.col("__c"), "left")
    pool = F.coalesce("__has_key", "__has_content", F.lit(False))
    return out.withColumn("status", F.when(pool, "KNOWN").when(first, "ACCEPTED").otherwise("DUPLICATE")).select(*candidates.columns, "status")


def cost_quotes(rows: DataFrame, group: str, charge: str, configured: float) -> DataFrame:
    """group, quote: the larger of the configured cost and the ceil(0.9 n)-th positive charge.

    Charges are counted by value; ranks come from the counts, in ranges where a group is large.
    """
    counts = rows.filter(F.col(charge) > 0).groupBy(group, F.col(charge).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    before = cumulative(counts, "v", ["n"], [group])
    total = before.groupBy(group).agg(F.max(group).alias("__g"), F.ceil(F.sum("n") * F.lit(9) / F.lit(10)).alias("__r")).drop(group)
    at = before.join(total, F.col(group).eqNullSafe(F.col("__g"))).filter((F.col("before_n") < F.col("__r")) & (F.col("before_n") + F.col("n") >= F.col("__r")))
    quotes = at.groupBy(group).agg(F.max("v").alias("__q"))
    least = F.lit(float(configured))
    return rows.select(group).distinct().join(quotes, group, "left").select(group, F.greatest(least, F.coalesce("__q", least)).alias("quote"))
