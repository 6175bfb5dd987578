"""Reachability, spanning forests and planning over small weighted graphs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import materialise


def reachable(edges: DataFrame, start: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """node, hops of all nodes within ``depth`` directed hops of the start nodes (column node). One join a hop."""
    links = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("__a")).select(F.col("__b").alias("node")).distinct()
        frontier = materialise(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def cycle_rank(edges: DataFrame, components: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges, nodes, components, cycles = E - V + C, of an undirected graph without repeated edges."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct().agg(F.count(F.lit(1)).alias("edges"))
    v = components.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("components"))
    return e.crossJoin(v).withColumn("cycles", F.col("edges") - F.col("nodes") + F.col("components"))  # one row each


def spanning_network(edges: Iterable[tuple[str, str, float]], min_core: float, spares: int) -> tuple[list[tuple[str, str]], int]:
    """Edges of a spanning forest in the order (-core, names), then ``spares`` more that close cycles; and the cycles.

    For planning on the driver: the molecules of one series, tens to hundreds.
    """
    usable = sorted((e for e in edges if e[2] >= min_core), key=lambda e: (-e[2], e[0], e[1]))
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest, rest = [], []
    for a, b, _ in usable:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            forest.append((a, b))
        else:
            rest.append((a, b))
    chosen = forest + rest[:spares]
    return chosen, len(chosen) - len(forest)


def greedy_batch(scores: Sequence[tuple[str, str, float, float]], budget: int, kappa: float, penalty: float, explore: float, seen: Iterable[str] = ()) -> list[str]:
    """Ids of a batch from (id, scaffold, mean, half_width) offers.

    First floor(budget * explore) unseen scaffolds, the widest interval each; then greedily by mean + kappa * width,
    less kappa * width + penalty where the scaffold is taken. Ties go by id. A driver-side step over a shortlist.
    """
    taken, out = set(seen), []
    widest: dict[str, tuple[float, str]] = {}
    for i, scaffold, _, width in sorted(scores):
        if scaffold not in taken and (scaffold not in widest or width > widest[scaffold][0]):
            widest[scaffold] = (width, i)
    for width, i in sorted(widest.values(), key=lambda x: (-x[0], x[1]))[: int(budget * explore)]:
        out.append(i)
    by_id = {s[0]: s for s in scores}
    taken |= {by_id[i][1] for i in out}
    left = [s for s in scores if s[0] not in set(out)]
    while left and len(out) < budget:
        value = lambda s: s[2] + kappa * s[3] - (kappa * s[3] + penalty if s[1] in taken else 0.0)
        best = min(left, key=lambda s: (-value(s), s[0]))
        left.remove(best)
        out.append(best[0])
        taken.add(best[1])
    return out
