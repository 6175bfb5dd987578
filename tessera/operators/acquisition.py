"""Choosing what to measure next, planning funnels, and learning from groups that were held out."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import materialise
from .planning import retention, rho_for_multiplier
from .sizes import small


def acquire(candidates: DataFrame, seen: DataFrame, key: str, scaffold: str, mean: str, width: str, budget: int, kappa: float, explore: float, penalty: float) -> DataFrame:
    """key, rank, score, reason of a batch: reserved places for unseen scaffolds, then greedily by mean + kappa * width.

    floor(budget * explore) places go to scaffolds that ``seen`` doesn't hold, the widest interval of each. After that a
    sibling of a scaffold that is taken scores mean - penalty. The first of a scaffold to be chosen is the one of highest
    score, and no sibling comes before it, so the greedy choice is a sort by a score that is known beforehand: aggregates
    by scaffold and a top-N. Ties go to the least key.
    """
    if budget < 1 or not 0 <= explore <= 1 or kappa < 0:
        raise ValueError("budget must be positive, explore in [0, 1], kappa not negative")
    rows = candidates.select(F.col(key).alias("k"), F.nullif(F.col(scaffold).cast("string"), F.lit("")).alias("s"), F.col(mean).alias("m"), F.col(width).alias("w")).withColumn("u", F.col("m") + kappa * F.col("w"))
    known = seen.select(F.col(scaffold).cast("string").alias("q")).distinct()
    widest = rows.filter("s is not null").join(known, F.col("s") == F.col("q"), "left_anti").groupBy("s").agg(F.min(F.struct((-F.col("w")).alias("w"), "k")).alias("b"))
    reserved = widest.orderBy("b.w", "b.k").limit(int(budget * explore)).select(F.col("s").alias("rs"), F.col("b.k").alias("rk"))
    first = rows.filter("s is not null").groupBy("s").agg(F.min(F.struct((-F.col("u")).alias("u"), "k")).alias("b")).select(F.col("s").alias("fs"), F.col("b.k").alias("fk"))
    marked = rows.join(F.broadcast(reserved), F.col("s") == F.col("rs"), "left").join(first, F.col("s") == F.col("fs"), "left")  # reserved: at most the budget
    own = F.col("rk").eqNullSafe(F.col("k")) & F.col("rk").isNotNull()
    sibling = F.col("s").isNotNull() & (F.col("rs").isNotNull() | (F.col("fk") != F.col("k")))
    scored = marked.select("k", "w", "m", own.alias("own"), F.when(own, F.col("u")).when(sibling, F.col("m") - penalty).otherwise(F.col("u")).alias("score"), F.when(own, "unseen_scaffold").when(sibling, "diversity").otherwise("potency").alias("reason"))
    order = [F.desc("own"), F.when(F.col("own"), -F.col("w")).otherwise(-F.col("score")), F.col("k")]
    top = scored.orderBy(*order).limit(budget)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.col("k").alias(key), "rank", "score", "reason")  # the budget's rows


def rank_variants(arms: DataFrame, observed: DataFrame, key: str, features: Sequence[str], reward: str, cost: str, beta: float = 1.0, ridge: float = 1.0, noise: float = 0.5) -> DataFrame:
    """key, mean, std, score, rank of arms not observed yet: a Bayesian linear model's upper bound, at least 0, by cost.

    The moments come from one aggregate; only a matrix as wide as the features is inverted on the driver.
    """
    n = len(features)
    x = [F.col(f).cast("double") for f in features]
    sums = [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(a * F.col(reward)).alias(f"r{i}") for i, a in enumerate(x)]
    got = observed.join(arms.select(key, *features), key).agg(*sums).first()
    precision = ridge * np.eye(n) + np.array([[got[f"p{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)]) / noise**2
    cover = np.linalg.inv(precision)
    weights = cover @ (np.array([got[f"r{i}"] or 0.0 for i in range(n)]) / noise**2)
    mean = sum((F.lit(float(w)) * a for w, a in zip(weights, x, strict=True)), F.lit(0.0))
    variance = sum((F.lit(float(cover[i, j])) * x[i] * x[j] for i in range(n) for j in range(n)), F.lit(0.0))
    left = arms.join(observed.select(key).distinct(), key, "left_anti").select(key, cost, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("std"))
    scored = left.withColumn("score", F.greatest(F.lit(0.0), F.col("mean") + beta * F.col("std")) / F.col(cost))
    from .ranks import ranked

    return ranked(scored.select(key, "mean", "std", "score"), [], [F.desc("score"), F.col(key)], "rank")


def spanning_forest(edges: DataFrame, a: str, b: str, weight: str, max_rounds: int = 40) -> DataFrame:
    """a, b, weight of a spanning forest of highest weight (ties by the names), undirected.

    Boruvka's rounds: every tree takes its best edge to another one, and trees that edges join become one; their number at
    least halves a round. Each round is written to the shared folder.
    """
    from .graph import connected_components

    e = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(weight).cast("double").alias("w")).groupBy("u", "v").agg(F.max("w").alias("w"))
    left, chosen = materialise(e.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges"), None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        ends = left.select(F.col("cu").alias("c"), "u", "v", "w").unionByName(left.select(F.col("cv").alias("c"), "u", "v", "w"))
        best = ends.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("w"), "u", "v")).alias("m")).select("m.u", "m.v", (-F.col("m.w")).alias("w")).distinct()
        best = materialise(best, "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
        trees = connected_components(chosen.select(F.col("u").alias("a"), F.col("v").alias("b")))
        tree = lambda n: trees.select(F.col("node").alias(f"n{n}"), F.col("component").alias(f"t{n}"))
        moved = left.select("u", "v", "w").join(tree("u"), F.col("u") == F.col("nu")).join(tree("v"), F.col("v") == F.col("nv"))
        left = materialise(moved.filter("tu <> tv").select("u", "v", "w", F.col("tu").alias("cu"), F.col("tv").alias("cv")), "edges")
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    out = chosen if chosen is not None else e.limit(0)
    return out.distinct().select(F.col("u").alias(a), F.col("v").alias(b), F.col("w").alias(weight))


def tree_edges(rows: DataFrame, key: str, body: str, name: str = "id", children: str = "children") -> DataFrame:
    """key, depth, parent, child of nested JSON trees, walked without recursion; a body that is no tree has none."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for k, text in zip(part[key], part[body], strict=True):
                try:
                    todo = [(0, json.loads(text))] if text else []
                except ValueError:
                    continue
                while todo:
                    depth, node = todo.pop()
                    if not isinstance(node, dict):
                        continue
                    for child in node.get(children) or []:
                        if isinstance(child, dict):
                            out.append((k, depth, str(node.get(name)), str(child.get(name))))
                            todo.append((depth + 1, child))
            yield pd.DataFrame(out, columns=[key, "depth", "parent", "child"])

    return rows.select(F.col(key).cast("bigint"), body).mapInPandas(walk, f"{key} bigint, depth int, parent string, child string")


def group_log_loss(rows: DataFrame, group: str, condition: str, outcome: str, n_outcomes: int) -> DataFrame:
    """group, n, log_loss of predicting each outcome from other groups' counts under the same condition, plus one each.

    Others' counts are totals less the group's own: no group meets another.
    """
    own = rows.groupBy(group, condition, outcome).agg(F.count(F.lit(1)).alias("__c"))
    total = own.groupBy(condition, outcome).agg(F.max(condition).alias("__tc"), F.max(outcome).alias("__to"), F.sum("__c").alias("__t")).drop(condition, outcome)
    mine = own.groupBy(group, condition).agg(F.max(group).alias("__gg"), F.max(condition).alias("__gc"), F.sum("__c").alias("__gn")).drop(group, condition)
    whole = own.groupBy(condition).agg(F.max(condition).alias("__ac"), F.sum("__c").alias("__an")).drop(condition)
    both = own.join(total, (F.col(condition) == F.col("__tc")) & (F.col(outcome) == F.col("__to"))).join(mine, (F.col(group) == F.col("__gg")) & (F.col(condition) == F.col("__gc"))).join(small(whole), F.col(condition) == F.col("__ac"))
    p = (F.col("__t") - F.col("__c") + 1) / (F.col("__an") - F.col("__gn") + n_outcomes)
    return both.groupBy(group).agg(F.sum("__c").alias("n"), (-F.sum(F.col("__c") * F.log(p)) / F.sum("__c")).alias("log_loss"))


#: What a trial's status may follow.
TRIAL_STEPS = {"proposed": (None,), "validated": ("proposed",), "trial": ("validated",), "reported": ("trial",), "promoted": ("reported",), "retired": ("proposed", "validated", "trial", "reported", "promoted")}


def trial_states(events: DataFrame, trial: str, order: Sequence[str], status: str, steps: dict[str, tuple] = TRIAL_STEPS) -> DataFrame:
    """trial, status (the last legal one), illegal: events whose status may not follow the one before."""
    w = Window.partitionBy(trial).orderBy(*order)
    rows = events.withColumn("__b", F.lag(status).over(w)).withColumn("__i", F.row_number().over(w))
    legal = F.lit(False)
    for s, before in steps.items():
        follows = F.col("__b").isin([b for b in before if b]) if any(before) else F.lit(False)
        legal = legal | ((F.col(status) == s) & F.coalesce(follows | (F.col("__b").isNull() & F.lit(None in before)), F.lit(False)))
    return rows.groupBy(trial).agg(F.max_by(F.when(legal, F.col(status)), F.when(legal, F.col("__i"))).alias(status), F.count_if(~legal).alias("illegal"))


def evidence_query(sources: dict[str, DataFrame], text: str, needle: str) -> DataFrame:
    """source, n, found: how many records of each source there are, and how many hold the text, whatever the case.

    A source without records has a row of zeros: what was not there to be searched shows.
    """
    out = None
    for name, df in sources.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.lower(text), F.lit(needle.lower()))).alias("found")).select(F.lit(name).alias("source"), "n", "found")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


@dataclass(frozen=True)
class Stage:
    """A tier that may be planned: hours a molecule, its rank correlation (none: a filter that rejects by validity)."""

    name: str
    hours: float
    spearman: float | None = None
    decoy_rejection: float = 0.0
    active_rejection: float = 0.0
    question: str = "ranking"


def _walk(stages: Sequence[Stage], keeps: Sequence[float], pool: float, active: float) -> tuple[list[tuple], float]:
    """(stage, in, out, keep, retained share of actives) by tier, and the hours of all."""
    rows, hours, n, share, kept, left = [], 0.0, float(pool), active, 1.0, list(keeps)
    for s in stages:
        hours += n * s.hours
        if s.spearman is None:
            stay = 1 - s.active_rejection
            keep = share * stay + (1 - share) * (1 - s.decoy_rejection)
        else:
            keep = left.pop(0)
            stay = retention(s.spearman, keep, share, 400) if 0 < keep < 1 else 1.0
        out = n * keep
        share = min(1.0, share * stay / keep) if keep > 0 else 0.0
        kept *= stay
        rows.append((s.name, n, out, keep, kept))
        n = out
    return rows, hours


def plan_funnel(spark: SparkSession, pool: int, stages: Sequence[Stage], budget: float, active: float, final: int, resolvable: float = 0.0) -> tuple[DataFrame, dict[str, str], bool]:
    """Tiers (stage, molecules in and out, keep fraction, share of actives retained, hours), refused stages with reasons,
    and whether the budget pays for it.

    A stage that ranks no better than one before it that answers the same question, by more than the panel resolves, is
    refused. Keep fractions multiply to what reaches the final count; shares move between tiers as long as that retains
    more actives within the budget. Planning is arithmetic over a handful of stages, on the driver.
    """
    if pool < 1 or not 1 <= final <= pool or budget <= 0 or not 0 < active < 1:
        raise ValueError("a funnel needs a pool that holds its final count, a budget, and an active share in (0, 1)")
    refused, usable, best = {}, [], {}
    for s in stages:
        if s.spearman is not None and s.spearman <= best.get(s.question, 0.0) + resolvable:
            refused[s.name] = "NOT_RESOLVABLY_BETTER"
            continue
        if s.spearman is not None:
            best[s.question] = s.spearman
        usable.append(s)
    n = sum(s.spearman is not None for s in usable)
    schema = "tier int, stage string, molecules_in double, molecules_out double, keep double, retained double, hours double"
    rows, _ = _walk(usable, [1.0] * n, pool, active)
    valid = math.prod(r[3] for r, s in zip(rows, usable, strict=True) if s.spearman is None)
    target = math.log(min(1.0, final / (pool * valid)))
    logs = [target / n] * n if n else []

    def merit(logs: Sequence[float]) -> tuple[float, float]:
        rows, hours = _walk(usable, [math.exp(x) for x in logs], pool, active)
        return -max(0.0, hours - budget), rows[-1][4] if rows else 0.0

    now, step = merit(logs), -target / 2 if n > 1 else 0.0
    while step > 1e-4:
        moves = []
        for i in range(n):
            for j in range(n):
                if i != j and logs[i] + step <= 0:
                    tried = [x + step if k == i else x - step if k == j else x for k, x in enumerate(logs)]
                    moves.append((merit(tried), tried))
        better = max(moves, default=(now, logs))
        if better[0] > now:
            now, logs = better
        else:
            step /= 2
    rows, _ = _walk(usable, [math.exp(x) for x in logs], pool, active)
    out = [(i, *r, r[1] * s.hours) for i, (r, s) in enumerate(zip(rows, usable, strict=True))]
    return spark.createDataFrame(out, schema), refused, bool(usable) and now[0] == 0.0


def advise(spark: SparkSession, pool: int, stages: Sequence[Stage], budget: float, active: float, final: int, resolvable: float, knobs: Sequence[tuple[str, str, float | None, float | None, float]]) -> DataFrame:
    """knob, stage, gain (actives at the end), reason: knobs (name, stage, added correlation or enrichment multiplier,
    added hours) by what they would add; those that can't be placed, or that the panel could not see, have a reason instead."""
    base, _, feasible = plan_funnel(spark, pool, stages, budget, active, final, resolvable)
    last = lambda df: max((r["tier"], r["retained"]) for r in df.collect())[1]  # noqa: E731  a handful of tiers
    before, by_name, rows = (last(base) if feasible else None), {s.name: s for s in stages}, []
    for name, target, added, multiplier, hours in knobs:
        s = by_name.get(target)
        if before is None:
            rows.append((name, target, None, "BASELINE_NOT_AFFORDABLE"))
        elif s is None:
            rows.append((name, target, None, "STAGE_NOT_IN_FUNNEL"))
        elif s.spearman is None or (added is None and multiplier is None):
            rows.append((name, target, None, "NO_MEASURED_EFFECT"))
        else:
            after = min(1.0, s.spearman + added) if added is not None else rho_for_multiplier(s.spearman, multiplier, 0.01, active)
            if after - s.spearman < resolvable:
                rows.append((name, target, None, "BELOW_RESOLUTION"))
                continue
            tuned, _, ok = plan_funnel(spark, pool, [replace(x, spearman=after, hours=x.hours + hours) if x is s else x for x in stages], budget, active, final, resolvable)
            rows.append((name, target, (last(tuned) - before) * pool * active if ok else None, None if ok else "NOT_AFFORDABLE"))
    return spark.createDataFrame(rows, "knob string, stage string, gain double, reason string").orderBy(F.desc_nulls_last("gain"), "knob")


def retained(rho: Column, keep: Column, active: Column) -> Column:
    """Share of actives among the kept, for columns of correlations, keep fractions and active shares."""

    @F.pandas_udf("double")
    def share(r: pd.Series, k: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([retention(*x) if all(map(math.isfinite, x)) and 0 < x[1] <= 1 and 0 < x[2] < 1 else None for x in zip(r, k, a, strict=True)], dtype="float64")

    return share(rho.cast("double"), keep.cast("double"), active.cast("double"))
