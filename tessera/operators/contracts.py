"""Versioned table contracts: schema, primary key, enumerations and non-empty groups, checked in one aggregate."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ID = re.compile(r"[a-z][a-z0-9_]*/v[1-9][0-9]*")


class ContractError(ValueError):
    """A table that breaks its contract; ``violations`` says how."""

    def __init__(self, contract: str, violations: list[str]) -> None:
        super().__init__(f"{contract}: " + "; ".join(violations))
        self.violations = violations


@dataclass(frozen=True)
class Contract:
    """``nonempty``: groups of columns of which a row must have at least one that isn't blank."""

    id: str
    schema: T.StructType
    key: tuple[str, ...]
    enums: Mapping[str, Sequence[str]] = field(default_factory=dict)
    nonempty: Sequence[tuple[str, ...]] = ()

    def __post_init__(self) -> None:
        if not _ID.fullmatch(self.id):
            raise ValueError(f"contract id {self.id!r} is not name/vN")
        unknown = {*self.key, *self.enums, *(c for g in self.nonempty for c in g)} - set(self.schema.names)
        if unknown or not self.key:
            raise ValueError(f"{self.id}: unknown or missing columns {sorted(unknown)}")

    def schema_differences(self, df: DataFrame) -> list[str]:
        have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in self.schema}
        out = [f"missing column {n}" for n in want if n not in have] + [f"unexpected column {n}" for n in have if n not in want]
        return out + [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]

    def violations(self, df: DataFrame) -> DataFrame:
        """check, n: rows that break each check. Column checks take one pass; key uniqueness one aggregation by key."""
        checks = {f"null:{f.name}": F.col(f.name).isNull() for f in self.schema if not f.nullable}
        checks |= {f"enum:{c}": F.col(c).isNotNull() & ~F.col(c).isin(list(v)) for c, v in self.enums.items()}
        blank = lambda c: F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)) == 0
        checks |= {"nonempty:" + "|".join(g): reduce(lambda a, b: a & b, map(blank, g)) for g in self.nonempty}
        repeated = df.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).cast("bigint").alias("n"))
        out = repeated.select(F.lit("key:" + "|".join(self.key)).alias("check"), "n")
        if checks:
            counted = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")
            out = counted.select(pairs).select("x.check", "x.n").unionByName(out)
        return out

    def require(self, df: DataFrame) -> DataFrame:
        """``df`` itself, or ContractError before anything is published."""
        if wrong := self.schema_differences(df):
            raise ContractError(self.id, wrong)
        if wrong := [f"{r['check']}: {r['n']} rows" for r in self.violations(df).filter("n > 0").collect()]:
            raise ContractError(self.id, wrong)
        return df


class Registry:
    """Contracts by their exact id."""

    def __init__(self, contracts: Sequence[Contract] = ()) -> None:
        self._by_id: dict[str, Contract] = {}
        for c in contracts:
            self.add(c)

    def add(self, contract: Contract) -> None:
        if contract.id in self._by_id:
            raise ValueError(f"{contract.id} is registered already")
        self._by_id[contract.id] = contract

    def __getitem__(self, contract_id: str) -> Contract:
        return self._by_id[contract_id]

    def __iter__(self):
        return iter(sorted(self._by_id))


DECISION = Contract(
    "decision/v1",
    T.StructType([
        T.StructField("entity_id", T.StringType(), False), T.StructField("entity_kind", T.StringType(), False),
        T.StructField("stage_id", T.StringType(), False), T.StructField("outcome", T.StringType(), False),
        T.StructField("reason_code", T.StringType(), False), T.StructField("rule_id", T.StringType()), T.StructField("detail", T.StringType()),
    ]),
    ("entity_id", "entity_kind", "stage_id", "reason_code"),
    {"entity_kind": ("SOURCE_RECORD", "PARENT", "STATE"), "outcome": ("PASS", "REJECT", "WARN")},
)
