"""Append-only journals: effective sets under rewinds, balances, claims, cursors."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LedgerError(ValueError):
    """A journal that cannot have been written by the rules."""


def live_rounds(entries: Iterable[tuple[int, str, str, str | None]]) -> list[str]:
    """Rounds in force after (sequence, kind, round, target) entries: ``rewind`` restores what held right after its target.

    An abandoned branch can be restored: every round remembers the whole set it made. A repeated round or an unknown
    target is an error.
    """
    live: list[str] = []
    after: dict[str, tuple[str, ...]] = {}
    for _, kind, name, target in sorted(entries):
        if kind == "round":
            if name in after:
                raise LedgerError(f"round {name} twice")
            live.append(name)
            after[name] = tuple(live)
        elif kind == "rewind":
            if target not in after:
                raise LedgerError(f"rewind to unknown {target}")
            live = list(after[target])
    return live


def effective_set(events: DataFrame, journal: str, sequence: str, kind: str, name: str, target: str) -> DataFrame:
    """journal, position, round in force, per journal. The fold is a stack machine, so a journal is one task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        entries = rows[[sequence, kind, name, target]].itertuples(index=False, name=None)
        live = live_rounds([(s, k, n, None if pd.isna(t) else t) for s, k, n, t in entries])
        return pd.DataFrame({journal: [rows[journal].iloc[0]] * len(live), "position": range(len(live)), "round": live})

    keyed = events.select(F.col(journal).cast("bigint"), F.col(sequence).cast("bigint"), kind, F.col(name).cast("string"), F.col(target).cast("string"))
    return keyed.groupBy(journal).applyInPandas(fold, f"{journal} bigint, position bigint, round string")


def balance(actions: DataFrame, group: str, cost: str, status: str, budget: float) -> DataFrame:
    """group, spent (finished), reserved (reserved or running) and remaining."""
    amount = F.coalesce(F.col(cost), F.lit(0.0))
    out = actions.groupBy(group).agg(
        F.sum(F.when(F.col(status).isin("reserved", "running"), amount).otherwise(0.0)).alias("reserved"), F.sum(F.when(F.col(status) == "done", amount).otherwise(0.0)).alias("spent")
    )
    return out.withColumn("remaining", F.lit(budget) - F.col("spent") - F.col("reserved"))


def audit_reservations(actions: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Adds running_cost and admitted: whether the requests so far, taken in order, stay within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = actions.withColumn("running_cost", F.sum(cost).over(w))
    return out.withColumn("admitted", F.col("running_cost") <= budget)


def first_claims(claims: DataFrame, item: str, order: list[str], who: str) -> DataFrame:
    """item, who: compare-and-set as a batch; the first claim of an item holds."""
    first = F.min(F.struct(*[F.col(c) for c in order], F.col(who))).alias("f")
    return claims.groupBy(item).agg(first).select(item, F.col(f"f.{who}").alias(who))


def page(df: DataFrame, order: list[str], after: dict[str, object] | None, limit: int) -> DataFrame:
    """Rows behind a cursor in a total order: a filter and a top-N, not an offset."""
    if after:
        test = F.lit(False)
        for i, c in enumerate(order):
            here = F.col(c) > F.lit(after[c])
            for p in order[:i]:
                here = here & (F.col(p) == F.lit(after[p]))
            test = test | here
        df = df.filter(test)
    return df.orderBy(*order).limit(limit)


def productivity(chunks: DataFrame, model: str, order: list[str]) -> DataFrame:
    """model, delivery, uniqueness, per_hour, trend from requested, delivered, unique, seconds of ordered chunks.

    trend: uniqueness share of the last third of chunks less that of the first (one chunk at least).
    """
    w = Window.partitionBy(model)
    rows = chunks.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("__n") / 3))
    part = lambda test, c: F.sum(F.when(test, F.col(c)))
    head, tail = F.col("__i") < third, F.col("__i") >= F.col("__n") - third
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.groupBy(model).agg(
        ratio(F.sum("delivered"), F.sum("requested")).alias("delivery"), ratio(F.sum("unique"), F.sum("delivered")).alias("uniqueness"),
        ratio(F.sum("unique") * 3600.0, F.sum("seconds")).alias("per_hour"),
        (ratio(part(tail, "unique"), part(tail, "delivered")) - ratio(part(head, "unique"), part(head, "delivered"))).alias("trend"),
    )


def search(df: DataFrame, text: Column, needle: str, fields: dict[str, object]) -> DataFrame:
    """Rows whose text holds the needle, whatever the case, and whose fields equal the given values."""
    out = df.filter(F.contains(F.lower(text), F.lit(needle.lower()))) if needle else df
    for name, value in fields.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def fold(rows: DataFrame, key: str, order: str, step: str, sep: str = ">") -> DataFrame:
    """key, steps (how many) and path (their names in order, joined): what a subject went through. A key's steps are one row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(step).cast("string").alias("s"))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.array_join(F.transform(ordered, lambda t: t["s"]), sep).alias("path"))
