"""Evidence gates: each annotates a population once; survivors and decision rows are projections of that frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """Inclusive numeric window; with ``exclusive_maximum`` the upper end is outside."""

    minimum: float | None = None
    maximum: float | None = None
    exclusive_maximum: bool = False

    def __post_init__(self) -> None:
        given = [x for x in (self.minimum, self.maximum) if x is not None]
        if not given or any(x != x or x in (float("inf"), float("-inf")) for x in given):
            raise ValueError("a window needs at least one finite bound")
        if len(given) == 2 and self.minimum > self.maximum:
            raise ValueError("minimum exceeds maximum")


def finite(value: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def verdict(value: Column, bounds: Bounds, prefix: str) -> Column:
    """The reason code of a value: missing, below, above, or pass, asked in this order."""
    v = value.cast("double")
    out = F.when(~finite(value), f"{prefix}_MISSING")
    if bounds.minimum is not None:
        out = out.when(v < bounds.minimum, f"{prefix}_BELOW_MINIMUM")
    if bounds.maximum is not None:
        out = out.when((v >= bounds.maximum) if bounds.exclusive_maximum else (v > bounds.maximum), f"{prefix}_ABOVE_MAXIMUM")
    return out.otherwise(f"{prefix}_PASS")


def best_of_group(rows: DataFrame, key: str, score: str, rank: str, lower_is_stronger: bool = True) -> DataFrame:
    """key, best, best_rank, n: the strongest finite score of a key, its rank (the least one on ties), and how many rows.

    Aggregates with partial results; nothing is sorted.
    """
    sign = 1 if lower_is_stronger else -1
    known = F.when(finite(F.col(score)), F.struct((F.col(score).cast("double") * sign).alias("s"), F.col(rank).alias("r")))
    out = rows.groupBy(key).agg(F.min(known).alias("b"), F.count(F.lit(1)).alias("n"))
    return out.select(key, (F.col("b.s") * sign).alias("best"), F.col("b.r").alias("best_rank"), "n")


def numeric_gate(parents: DataFrame, evidence: DataFrame, key: str, value: str, bounds: Bounds, prefix: str) -> DataFrame:
    """Every parent with its evidence (at most one row a key), reason_code and passed."""
    joined = parents.join(evidence, key, "left")
    return joined.withColumn("reason_code", verdict(F.col(value), bounds, prefix)).withColumn("passed", F.col("reason_code") == f"{prefix}_PASS")


def status_gate(rows: DataFrame, status: str, value: str, bounds: Bounds, accept_unscorable: bool, prefix: str = "DERIVED_METRIC") -> DataFrame:
    """As the numeric verdict, but a status other than OK decides by policy and the value is not looked at."""
    ok = F.col(status) == "OK"
    odd = F.lit(f"{prefix}_UNSCORABLE_ACCEPTED") if accept_unscorable else F.concat(F.lit(f"{prefix}_"), F.coalesce(F.col(status), F.lit("MISSING")))
    reason = F.when(ok, verdict(F.col(value), bounds, prefix)).otherwise(odd)
    passed = (ok & (reason == f"{prefix}_PASS")) | (~F.coalesce(ok, F.lit(False)) & F.lit(accept_unscorable))
    return rows.withColumn("reason_code", reason).withColumn("passed", F.coalesce(passed, F.lit(False)))


def window_verdict(windows: Mapping[str, Bounds]) -> Column:
    """Tri-state over several properties: any outside, else any missing (unknown), else within."""
    codes = [verdict(F.col(c), b, "W") for c, b in windows.items()]
    outside = reduce(lambda a, b: a | b, [c.isin("W_BELOW_MINIMUM", "W_ABOVE_MAXIMUM") for c in codes])
    missing = reduce(lambda a, b: a | b, [c == "W_MISSING" for c in codes])
    return F.when(outside, "outside").when(missing, "unknown").otherwise("within")


def rules_passed(rules: Mapping[str, Column], mode: str = "ALL", at_least: int = 0) -> Column:
    """Whether ANY, ALL or AT_LEAST so many named rules hold; an unknown rule doesn't hold."""
    n = reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(False)).cast("int") for r in rules.values()])
    need = {"ALL": len(rules), "ANY": 1, "AT_LEAST": at_least}[mode]
    return n >= need


def demerits(rules: Mapping[str, tuple[Column, int]]) -> Column:
    """Sum of the demerits of the rules that hold."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in rules.values()])


def decisions(gated: DataFrame, key: str, stage: str, kind: str = "PARENT", warns: Sequence[str] = ()) -> DataFrame:
    """Decision rows of a gate's frame: one terminal row an entity, and a WARN beside the PASS for reasons in ``warns``."""
    warn = F.col("reason_code").isin(list(warns)) if warns else F.lit(False)
    outcome = F.when(F.col("passed"), F.when(warn, F.array(F.lit("WARN"), F.lit("PASS"))).otherwise(F.array(F.lit("PASS")))).otherwise(F.array(F.lit("REJECT")))
    rows = gated.select(F.col(key).cast("string").alias("entity_id"), F.lit(kind).alias("entity_kind"), F.lit(stage).alias("stage_id"), F.explode(outcome).alias("outcome"), "reason_code")
    return rows.withColumn("reason_code", F.when((F.col("outcome") == "PASS") & F.col("reason_code").isin(list(warns)), F.concat_ws("_", F.lit(stage), F.lit("PASS"))).otherwise(F.col("reason_code")) if warns else F.col("reason_code"))


def digest(decided: DataFrame, max_buckets: int = 256, sample: int = 5) -> DataFrame:
    """entity_kind, outcome, reason_code, n, sample_ids: the largest buckets (ties by key), with total_n and untracked_n.

    Totals of (entity_kind, outcome) are exact whatever is cut off; untracked_n is what buckets beyond the cap hold of
    them, and a kind and outcome all of whose buckets are cut has one row without a reason. sample_ids holds up to
    ``sample`` ids of a bucket: the least of each of as many hash classes, so it comes from one aggregate.
    """
    part = F.pmod(F.conv(F.substring(F.md5("entity_id"), 1, 4), 16, 10).cast("int"), F.lit(sample))
    ids = F.array_sort(F.array_compact(F.array(*[F.min(F.when(part == i, F.col("entity_id"))) for i in range(sample)])))
    buckets = decided.groupBy("entity_kind", "outcome", "reason_code").agg(F.count(F.lit(1)).alias("n"), ids.alias("sample_ids"))
    totals = decided.groupBy("entity_kind", "outcome").agg(F.count(F.lit(1)).alias("total_n"))
    kept = buckets.orderBy(F.desc("n"), "entity_kind", "outcome", "reason_code").limit(max_buckets)
    held = kept.groupBy("entity_kind", "outcome").agg(F.sum("n").alias("__h"))
    totals = totals.join(held, ["entity_kind", "outcome"], "left").withColumn("untracked_n", F.col("total_n") - F.coalesce("__h", F.lit(0))).drop("__h")
    return totals.join(kept, ["entity_kind", "outcome"], "left").select("entity_kind", "outcome", "reason_code", F.coalesce("n", F.lit(0)).alias("n"), "sample_ids", "total_n", "untracked_n")


def orphans(parents: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Evidence rows whose key is no parent."""
    return evidence.join(parents.select(key), key, "left_anti")


def only_identity(evidence: DataFrame, parents: DataFrame, key: str, identity: str) -> str:
    """The one identity (engine, model, ...) among a population's evidence; an error if there are none or several."""
    found = [r[0] for r in evidence.join(parents.select(key), key, "left_semi").select(identity).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{identity}: expected exactly one, found {found or 'none'}")
    return found[0]
