"""Ranks and running sums over whole tables and hot groups, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialise

#: Rows that one task sorts; larger tables are dealt into ranges of about as many.
RANGE_ROWS = 500_000


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> tuple[DataFrame, bool]:
    """``df`` with __b, the number of its range by group and order, and whether there are several. Ranges are written
    once, so their numbers stay; equal keys share a range."""
    parts = -(-n // RANGE_ROWS)
    if parts <= 1:
        return df.withColumn("__b", F.lit(0)), False
    return materialise(df.repartitionByRange(parts, *by, *order).withColumn("__b", F.spark_partition_id()), "ranges"), True


def _with_offsets(rows: DataFrame, by: Sequence[str], sums: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """Rows with the sums of their group's earlier ranges: one small row a group and range."""
    totals = rows.groupBy(*by, "__b").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    same = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(offsets, same).select(*columns, *[f"__o_{n}" for n in sums])


def cumulative(df: DataFrame, value: str, counts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds before_<c>: the sum of c over all rows of the group with a smaller value; (group, value) must be distinct.

    The table, of counts by value as a rule, is written once. A large one is dealt into ranges: windows run inside them,
    and one over the ranges' totals.
    """
    kept = materialise(df, "values")
    rows, several = _ranged(kept, by, [value], kept.count())
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__i_{c}" for c in counts}
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, n in names.items()})
    if not several:
        return rows.select(*df.columns, *[F.col(n).alias(f"before_{c}") for c, n in names.items()])
    out = _with_offsets(rows, by, {c: F.sum(c) for c in counts}, [*df.columns, *names.values()])
    return out.select(*df.columns, *[(F.col(f"__o_{c}") + F.col(n)).alias(f"before_{c}") for c, n in names.items()])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Adds the row's number in its group, from 1, in a total order. Groups of any size: large tables are dealt into ranges."""
    rows, several = _ranged(df, by, order, df.select(*by).count() if by else df.count())
    number = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)).cast("bigint")
    if not several:
        return rows.withColumn(out, number).drop("__b")
    inside = f"__i_{out}"  # unlike any name that a caller asks for
    rows = _with_offsets(rows.withColumn(inside, number), by, {"n": F.count(F.lit(1))}, [*df.columns, inside])
    return rows.withColumn(out, F.col(inside) + F.col("__o_n")).drop(inside, "__o_n")
