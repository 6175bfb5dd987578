"""Joins over decisions: policy joins of branches, funnels, recall, registration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CoverageError(ValueError):
    """Branches that don't decide on exactly the population, or contradict themselves."""


def branch_problems(parents: DataFrame, branches: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """branch, problem, n: unknown branches and parents, missing parents, parents both passed and rejected. Empty if all is well.

    ``branches`` has branch, key, outcome for all branches; one aggregation by (branch, parent) serves all checks. A
    branch of ``names`` without rows misses every parent, which is no problem where the population is empty.
    """
    per = branches.filter("outcome <> 'WARN'").groupBy("branch", key).agg(F.countDistinct("outcome").alias("kinds"))
    known = parents.select(F.col(key).alias("p")).withColumn("known", F.lit(1))
    seen = per.join(known, per[key] == known["p"], "left")
    total = parents.agg(F.count(F.lit(1)).alias("total"))
    sums = seen.groupBy("branch").agg(
        F.count_if(F.col("known").isNull()).alias("unknown_parent"), F.count_if(F.col("kinds") > 1).alias("contradiction"), F.count_if(F.col("known").isNotNull()).alias("covered")
    )
    expected = parents.sparkSession.createDataFrame([(n,) for n in names], "branch string").withColumn("expected", F.lit(1))
    sums = sums.join(expected, "branch", "full").crossJoin(F.broadcast(total)).na.fill(0, ["unknown_parent", "contradiction", "covered", "expected"])  # one row a branch
    sums = sums.withColumn("missing_parent", F.when(F.col("expected") == 1, F.col("total") - F.col("covered")).otherwise(0)).withColumn("unknown_branch", 1 - F.col("expected"))
    problems = ["unknown_branch", "unknown_parent", "missing_parent", "contradiction"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).cast("bigint").alias("n")) for n in problems])).alias("x")
    return sums.select("branch", pairs).select("branch", "x.problem", "x.n").filter("n > 0")


def decision_join(parents: DataFrame, branches: DataFrame, key: str, names: Sequence[str], mode: str = "ALL", at_least: int = 0) -> DataFrame:
    """Every parent with passes, rejects and passed by policy: ALL, ANY or AT_LEAST k of the branches called ``names``.

    Fails closed: raises CoverageError before any row is decided if a branch is incomplete or contradicts itself.
    An empty population has no decisions, and that is complete.
    """
    if mode == "AT_LEAST" and not 1 <= at_least <= len(names):
        raise ValueError("at_least is out of range")
    if problems := [tuple(r) for r in branch_problems(parents, branches, key, names).limit(20).collect()]:
        raise CoverageError(f"branches {list(names)}: {problems}")
    return count_votes(parents, branches, key, len(names), mode, at_least)


def count_votes(parents: DataFrame, branches: DataFrame, key: str, n_branches: int, mode: str = "ALL", at_least: int = 0) -> DataFrame:
    votes = branches.groupBy(key).agg(F.count_if(F.col("outcome") == "PASS").alias("passes"), F.count_if(F.col("outcome") == "REJECT").alias("rejects"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = parents.join(votes, key, "left").select(*parents.columns, zero("passes"), zero("rejects"))
    rule = {"ALL": (F.col("rejects") == 0) & (F.col("passes") == n_branches), "ANY": F.col("passes") >= 1, "AT_LEAST": F.col("passes") >= at_least}[mode]
    return out.withColumn("passed", rule)


def funnel(population: DataFrame, tiers: Mapping[str, Column]) -> DataFrame:
    """tier_no, tier, entering, surviving, removed, in one aggregate: each tier sees its predecessors' survivors."""
    alive, aggs = F.lit(True), []
    for i, (_, test) in enumerate(tiers.items()):
        ok = F.coalesce(test, F.lit(False))
        aggs += [F.count_if(alive).alias(f"e{i}"), F.count_if(alive & ok).alias(f"s{i}")]
        alive = alive & ok
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("tier_no"), F.lit(t).alias("tier"), F.col(f"e{i}").alias("entering"), F.col(f"s{i}").alias("surviving")) for i, t in enumerate(tiers)])).alias("x")
    return population.agg(*aggs).select(rows).select("x.*").withColumn("removed", F.col("entering") - F.col("surviving"))


def recall_by_tier(population: DataFrame, panel: Column, tiers: Mapping[str, Column]) -> DataFrame:
    """The funnel of the panel's members, and retention = surviving / entering (null where none entered)."""
    out = funnel(population.filter(panel), tiers)
    return out.withColumn("retention", F.when(F.col("entering") > 0, F.col("surviving") / F.col("entering")))


def lost(population: DataFrame, key: str, panel: Column, tiers: Mapping[str, Column]) -> DataFrame:
    """key, tier: panel members and the first tier that removed them."""
    first = F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(t)) for t, test in tiers.items()])
    return population.filter(panel).select(key, first.alias("tier")).filter("tier is not null")


def register(sources: DataFrame, source_id: str, identity: Column, registration: Column) -> tuple[DataFrame, DataFrame]:
    """Parents and the source map of a registration.

    A parent is a group of sources of one identity: duplicate_count counts its sources, the least source id is PRIMARY
    and the others DUPLICATE. refined marks parents that share their registration key with another parent. One
    aggregation by identity with partial results; the map is one join back, whose hot keys adaptive execution splits.
    """
    named = sources.select(F.col(source_id), identity.alias("parent_id"), registration.alias("registration_key"))
    parents = named.groupBy("parent_id").agg(F.max("parent_id").alias("pid"), F.count(F.lit(1)).alias("duplicate_count"), F.min(source_id).alias("primary_id"), F.min("registration_key").alias("registration_key"))
    shared = parents.groupBy("registration_key").agg(F.max("registration_key").alias("rk"), F.count(F.lit(1)).alias("n_parents")).select("rk", "n_parents")
    parents = parents.drop("parent_id").join(shared, F.col("registration_key") == F.col("rk"), "left")
    parents = parents.select(F.col("pid").alias("parent_id"), "primary_id", "duplicate_count", "registration_key", (F.coalesce("n_parents", F.lit(1)) > 1).alias("refined"))
    ids = parents.select(F.col("parent_id").alias("pid"), "primary_id")
    mapped = named.join(ids, F.col("parent_id") == F.col("pid"))
    relation = F.when(F.col(source_id) == F.col("primary_id"), "PRIMARY").otherwise("DUPLICATE")
    return parents, mapped.select(source_id, "parent_id", relation.alias("relation"))


def survivors(kept: Sequence[DataFrame], removed: Sequence[DataFrame] = ()) -> DataFrame:
    """Keys that every branch kept and no list removed: set operations on one-column tables, each key once."""
    out = kept[0].distinct()
    for other in kept[1:]:
        out = out.intersect(other)
    for other in removed:
        out = out.subtract(other)
    return out
