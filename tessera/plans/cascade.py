"""Cascades: tiers of gates over a population, with policy modes, decisions and a funnel; and kernels behind seams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import content_id
from ..operators import gates, policy
from ..operators.graph import materialise

#: A gate: the entering population to the same rows with reason_code and passed, one row a key.
Gate = Callable[[DataFrame], DataFrame]


class Kernel(Protocol):
    """A batch function behind a seam: rows in, rows out (1 to N); ``schema`` is the result's, ``config`` its identity."""

    schema: str
    config: dict

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame: ...


@dataclass
class KernelRegistry:
    """Kernels by name; a name is registered once, and only registered kernels run."""

    kernels: dict[str, Kernel] = field(default_factory=dict)

    def register(self, name: str, kernel: Kernel) -> None:
        if name in self.kernels:
            raise ValueError(f"{name} is registered already")
        self.kernels[name] = kernel

    def apply(self, name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Runs a kernel over Arrow batches of just ``columns``."""
        kernel = self.kernels[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield kernel(rows)

        return df.select(*columns).mapInPandas(run, kernel.schema)


@dataclass(frozen=True)
class Tier:
    """SERIAL: each gate sees its predecessor's survivors. ALL, ANY, AT_LEAST: every gate sees the tier's population."""

    name: str
    gates: dict[str, Gate]
    mode: str = "SERIAL"
    at_least: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("SERIAL", "ALL", "ANY", "AT_LEAST") or not self.gates:
            raise ValueError(f"tier {self.name}: unknown mode or no gates")
        if self.mode == "AT_LEAST" and not 1 <= self.at_least <= len(self.gates):
            raise ValueError(f"tier {self.name}: at_least is out of range")


@dataclass(frozen=True)
class Run:
    """survivors has the population's columns; decisions one terminal row an entity and gate; funnel one row a tier."""

    survivors: DataFrame
    decisions: DataFrame
    funnel: DataFrame


def run_cascade(population: DataFrame, key: str, tiers: Sequence[Tier]) -> Run:
    """Runs the tiers in order. What a tier leaves is written once; its decisions and its survivors read that.

    Raises CoverageError where a gate doesn't decide on each entering entity exactly once.
    """
    columns, decided, steps = population.columns, [], []
    alive = population
    for i, tier in enumerate(tiers):
        entering, parts = alive, []
        for name, gate in tier.gates.items():
            judged = materialise(gate(alive if tier.mode == "SERIAL" else entering).select(*columns, "reason_code", "passed"), "gate")
            parts.append(gates.decisions(judged, key, f"{tier.name}.{name}"))
            if tier.mode == "SERIAL":
                alive = judged.filter("passed").select(*columns)
            else:
                branch = judged.select(key, F.lit(name).alias("branch"), F.when(F.col("passed"), "PASS").otherwise("REJECT").alias("outcome"))
                parts[-1] = (parts[-1], branch)
        if tier.mode != "SERIAL":
            votes = parts[0][1]
            for _, b in parts[1:]:
                votes = votes.unionByName(b)
            joined = policy.decision_join(entering, votes, key, list(tier.gates), tier.mode, tier.at_least)
            alive = materialise(joined.filter("passed").select(*columns), "tier")
            parts = [p for p, _ in parts]
        decided += parts
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
        steps.append(count(entering).select(F.lit(i).alias("tier_no"), F.lit(tier.name).alias("tier"), F.col("n").alias("entering")).crossJoin(count(alive).select(F.col("n").alias("surviving"))))  # one row each
    decisions, funnel = decided[0], steps[0]
    for d in decided[1:]:
        decisions = decisions.unionByName(d)
    for s in steps[1:]:
        funnel = funnel.unionByName(s)
    return Run(alive, decisions, funnel.withColumn("removed", F.col("entering") - F.col("surviving")))


def plan_id(key: str, tiers: Sequence[Tier], configs: dict) -> str:
    """Content id of a cascade: names, modes and the gates' declared configurations."""
    return content_id({"key": key, "tiers": [{"name": t.name, "mode": t.mode, "at_least": t.at_least, "gates": sorted(t.gates)} for t in tiers], "configs": configs})
