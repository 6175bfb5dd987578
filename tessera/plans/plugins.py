"""Stages behind descriptors: typed ports, closed kinds, checked cardinality; cascades as flat stages; model bundles."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, content_id
from ..operators import gates
from .cascade import Tier
from .registry import query
from .registry import table as _t

#: Closed vocabularies of descriptors.
KINDS = ("SOURCE", "FILTER", "TRANSFORM", "ENRICH", "CLUSTER", "SELECT", "POLICY", "SINK")
CARDINALITIES = ("ONE_TO_ONE", "FILTER", "ONE_TO_MANY", "MANY_TO_ONE")
DETERMINISM = ("DETERMINISTIC", "SEEDED", "BEST_EFFORT")


class StageError(ValueError):
    """A stage whose inputs or outputs are not what its descriptor says."""


@dataclass(frozen=True)
class Port:
    """``columns``: names that a table on this port must have; ``key``: what tells its entities apart."""

    name: str
    columns: tuple[str, ...]
    key: str | None = None


@dataclass(frozen=True)
class Descriptor:
    name: str
    version: int
    kind: str
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    cardinality: str = "ONE_TO_ONE"
    determinism: str = "DETERMINISTIC"

    def __post_init__(self) -> None:
        for value, known in ((self.kind, KINDS), (self.cardinality, CARDINALITIES), (self.determinism, DETERMINISM)):
            if value not in known:
                raise ValueError(f"{value} is not one of {known}")
        for ports in (self.inputs, self.outputs):
            if len({p.name for p in ports}) != len(ports):
                raise ValueError("a port is named twice")

    @property
    def id(self) -> str:
        """Content id of all that the descriptor says."""
        port = lambda p: [p.name, list(p.columns), p.key]
        return content_id([self.name, self.version, self.kind, list(map(port, self.inputs)), list(map(port, self.outputs)), self.cardinality, self.determinism])


class Plugin(Protocol):
    """A stage: named tables in, named tables out."""

    descriptor: Descriptor

    def execute(self, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]: ...


@dataclass
class Registry:
    """Plugins by name and version; each is registered once."""

    plugins: dict[tuple[str, int], Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        key = plugin.descriptor.name, plugin.descriptor.version
        if key in self.plugins:
            raise ValueError(f"{key} is registered already")
        self.plugins[key] = plugin

    def table(self, spark: SparkSession) -> DataFrame:
        """name, version, kind, cardinality, determinism, inputs, outputs of what is registered."""
        rows = [(d.name, d.version, d.kind, d.cardinality, d.determinism, ",".join(p.name for p in d.inputs), ",".join(p.name for p in d.outputs)) for d in (p.descriptor for p in self.plugins.values())]
        return spark.createDataFrame(sorted(rows), "name string, version int, kind string, cardinality string, determinism string, inputs string, outputs string")

    def run(self, name: str, version: int, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The stage's outputs, once ports and cardinality hold: one aggregate a table, no row is moved for it."""
        plugin = self.plugins[name, version]
        d = plugin.descriptor
        _check(d.inputs, inputs)
        out = plugin.execute(inputs)
        _check(d.outputs, out)
        first_in, first_out = (d.inputs or (None,))[0], (d.outputs or (None,))[0]
        if first_in and first_out and first_in.key and first_out.key and d.cardinality != "ONE_TO_MANY":
            n = inputs[first_in.name].agg(F.countDistinct(first_in.key)).first()[0]
            rows, keys = out[first_out.name].agg(F.count(F.lit(1)), F.countDistinct(first_out.key)).first()
            if rows != keys or (rows != n if d.cardinality == "ONE_TO_ONE" else rows > n):
                raise StageError(f"{name}: {d.cardinality}, but {n} entities became {rows} rows of {keys}")
        return out


def _check(ports: Sequence[Port], tables: Mapping[str, DataFrame]) -> None:
    if {p.name for p in ports} != set(tables):
        raise StageError(f"ports {sorted(tables)}, expected {sorted(p.name for p in ports)}")
    for p in ports:
        if lost := [c for c in p.columns if c not in tables[p.name].columns]:
            raise StageError(f"{p.name} lacks {lost}")


@dataclass(frozen=True)
class GatePlugin:
    """A numeric gate as a stage: survivors and decisions."""

    descriptor: Descriptor
    column: str
    bounds: gates.Bounds
    prefix: str

    def execute(self, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        port = self.descriptor.inputs[0]
        rows = inputs[port.name]
        judged = rows.withColumn("reason_code", gates.verdict(F.col(self.column), self.bounds, self.prefix)).withColumn("passed", F.col("reason_code") == f"{self.prefix}_PASS")
        return {"primary": judged.filter("passed").select(*rows.columns), "decisions": gates.decisions(judged, port.key, self.descriptor.name)}


def lower(tiers: Sequence[Tier]) -> list[tuple[int, str, str, list[str]]]:
    """(number, stage, kind, the stages it reads) of a cascade as a flat list in which every stage follows its inputs.

    In a serial tier each gate reads the one before; else all read what entered the tier, and a policy stage joins them.
    """
    out, alive = [], "population"
    for tier in tiers:
        names = [f"{tier.name}.{g}" for g in tier.gates]
        if tier.mode == "SERIAL":
            for name in names:
                out.append((len(out), name, "FILTER", [alive]))
                alive = name
        else:
            out += [(len(out) + i, name, "FILTER", [alive]) for i, name in enumerate(names)]
            out.append((len(out), f"{tier.name}.policy", "POLICY", names))
            alive = f"{tier.name}.policy"
    return out


@dataclass(frozen=True)
class ModelBundle:
    """A linear model as a file with a manifest: features, weights, intercept, and the digest of them that names it."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    @property
    def digest(self) -> str:
        return hashlib.sha256(canonical_json([list(self.features), list(self.weights), self.intercept])).hexdigest()

    def dump(self) -> str:
        return json.dumps({"features": self.features, "weights": self.weights, "intercept": self.intercept, "digest": self.digest})

    @classmethod
    def load(cls, body: str) -> ModelBundle:
        raw = json.loads(body)
        made = cls(tuple(raw["features"]), tuple(map(float, raw["weights"])), float(raw["intercept"]))
        if len(made.features) != len(made.weights) or made.digest != raw["digest"]:
            raise StageError("the bundle does not hold what its manifest says")
        return made

    def predict(self) -> Callable:
        """The model as a batch function of a struct of its features; rows without a feature have no prediction."""
        names, weights, intercept = self.features, self.weights, self.intercept

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return sum((rows[n].astype("float64") * w for n, w in zip(names, weights, strict=True)), start=pd.Series(intercept, index=rows.index))

        return lambda: score(F.struct(*names))


_PARENT = Port("parents", ("p_partkey", "p_size"), "p_partkey")


def size_gate() -> GatePlugin:
    d = Descriptor("size_gate", 1, "FILTER", (_PARENT,), (Port("primary", ("p_partkey", "p_size"), "p_partkey"), Port("decisions", ("entity_id", "outcome", "reason_code"))), "FILTER")
    return GatePlugin(d, "p_size", gates.Bounds(5, 45), "SIZE")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_size BETWEEN 5 AND 45 THEN 'PASS' ELSE 'REJECT' END AS outcome, CASE WHEN p_size < 5 THEN 'SIZE_BELOW_MINIMUM' WHEN p_size > 45 THEN 'SIZE_ABOVE_MAXIMUM' ELSE 'SIZE_PASS' END AS reason_code FROM part")
def stage_plugin(spark: SparkSession, d: str) -> DataFrame:
    registry = Registry()
    registry.register(size_gate())
    return registry.run("size_gate", 1, {"parents": _t(spark, d, "part").select("p_partkey", "p_size")})["decisions"].select("entity_id", "outcome", "reason_code")


@query("SELECT 'size_gate' AS name, 1 AS version, 'FILTER' AS kind, 'FILTER' AS cardinality, 'DETERMINISTIC' AS determinism, 'parents' AS inputs, 'primary,decisions' AS outputs")
def plugin_registry(spark: SparkSession, d: str) -> DataFrame:
    registry = Registry()
    registry.register(size_gate())
    return registry.table(spark)


@query("SELECT * FROM (VALUES (0, 'cheap.size', 'FILTER', 'population'), (1, 'cheap.price', 'FILTER', 'cheap.size'), (2, 'vote.low', 'FILTER', 'cheap.price'), (3, 'vote.small', 'FILTER', 'cheap.price'), (4, 'vote.policy', 'POLICY', 'vote.low,vote.small')) t(number, stage, kind, reads)")
def cascade_stages(spark: SparkSession, d: str) -> DataFrame:
    same = lambda df: df
    rows = lower([Tier("cheap", {"size": same, "price": same}), Tier("vote", {"low": same, "small": same}, "ANY")])
    return spark.createDataFrame([(i, s, k, ",".join(r)) for i, s, k, r in rows], "number int, stage string, kind string, reads string")


@query("SELECT p_partkey, 2.5::DOUBLE + 0.5::DOUBLE * p_size - 0.001::DOUBLE * p_retailprice AS predicted FROM part")
def model_bundle(spark: SparkSession, d: str) -> DataFrame:
    bundle = ModelBundle.load(ModelBundle(("p_size", "p_retailprice"), (0.5, -0.001), 2.5).dump())
    return _t(spark, d, "part").select("p_partkey", bundle.predict()().alias("predicted"))
