"""Batched look-ups, dossiers and facet filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_lookups(keys: DataFrame, answered: DataFrame, key: str, lane: Column, size: int, source: str) -> DataFrame:
    """lane, batch, keys, request_id for keys without an answer, in batches of ``size`` a lane.

    request_id hashes the source and the sorted keys, so a repeated plan asks nothing twice. Lanes (a hash of the key,
    say) keep windows small.
    """
    left = keys.select(F.col(key), lane.alias("lane")).distinct().join(answered.select(key), key, "left_anti")
    ranked = left.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("lane").orderBy(key)) - 1) / size).cast("bigint"))
    out = ranked.groupBy("lane", "batch").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("keys"))
    return out.withColumn("request_id", F.sha2(F.concat_ws("\n", F.lit(source), F.array_join("keys", "\n")).cast("binary"), 256))


def dossier(measurements: DataFrame, compounds: DataFrame, documents: DataFrame, compound: str, document: str, kind: Column) -> DataFrame:
    """compound, n, n_documents and a count per kind, for every compound, also those with nothing or only negatives."""
    rows = measurements.join(documents.select(document).distinct().withColumn("__in", F.lit(True)), document, "left")
    per = rows.groupBy(compound).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("__in"), F.col(document))).alias("n_documents"), F.count_if(kind).alias("n_kind"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return compounds.select(compound).distinct().join(per, compound, "left").select(compound, zero("n"), zero("n_documents"), zero("n_kind"))


def facets(df: DataFrame, body: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose JSON members match every facet; a facet matches any of its values, against a scalar or a list."""
    out = df
    for name, values in wanted.items():
        raw = F.get_json_object(body, f"$.{name}")
        listed = F.from_json(raw, "array<string>")
        out = out.filter(F.coalesce(F.arrays_overlap(listed, F.array(*map(F.lit, values))), F.lit(False)) | F.coalesce(raw.isin(list(values)), F.lit(False)))
    return out


def ranges_to_rows(ranges: DataFrame, low: str, high: str, shift: str, limit: int = 100_000) -> DataFrame:
    """One row a position of inclusive ranges, with the position it maps to; ranges longer than ``limit`` are an error."""
    checked = ranges.withColumn("__n", F.when(F.col(high) - F.col(low) >= limit, F.raise_error(F.lit("range too long"))).otherwise(F.col(high)))
    return checked.withColumn("position", F.explode(F.sequence(F.col(low), F.col("__n")))).withColumn("mapped", F.col("position") + F.col(shift)).drop("__n")
