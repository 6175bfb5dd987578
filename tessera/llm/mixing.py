"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with n rows and the share w of the wanted size m gets the mean repetition rate m * w / n. A document's number
of copies is the inverse of the Poisson distribution of that mean at a uniform number hashed from the seed and its id,
so that it doesn't depend on partitions, order or retries. Copies are exploded and dealt out by a hash of seed, id and
copy, then sorted by it within partitions: a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, require

SEED = 20_240_229
#: Without given targets a source weighs its rows to this power: large sources are thinned, small ones repeated.
POWER = 0.7
#: Rates above this would need too long tables: their whole part is copied as it is, and only the rest is drawn.
MAX_RATE = 500.0
#: Up to so many sources their rates are broadcast; beyond it both sides are shuffled.
BROADCAST_SOURCES = 10_000
HEX_DIGITS = 13


def hashed(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, power: float = POWER) -> DataFrame:
    """source, n_rows, rate, whole, and cdf: P(copies - whole <= k) for k = 0, 1, ... as far as a double tells it from 1.

    ``size`` is the wanted size as a multiple of the input's rows. With ``weights``, sources that it doesn't name get
    rate 0. Null is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(power)))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)))
    total = weighed.agg(F.sum("n_rows").alias("rows"), F.sum("weight").alias("weight")).first()
    if total["weight"]:
        rate = F.lit(float(size)) * F.lit(total["rows"]) * F.col("weight") / F.lit(total["weight"]) / F.col("n_rows")
    else:
        rate = F.lit(0.0)
    out = weighed.select("source", "n_rows", rate.alias("rate"))
    out = out.withColumn("whole", F.when(F.col("rate") > MAX_RATE, F.floor("rate")).otherwise(0).cast("bigint")).withColumn("drawn", F.col("rate") - F.col("whole"))
    cdf = F.expr(
        "transform(aggregate(sequence(1, cast(ceil(drawn + 12 * sqrt(drawn) + 24) as int)),"
        " array(named_struct('p', exp(-drawn), 'c', exp(-drawn))),"
        " (a, k) -> concat(a, array(named_struct('p', element_at(a, -1).p * drawn / k,"
        " 'c', element_at(a, -1).c + element_at(a, -1).p * drawn / k)))), x -> x.c)"
    )
    return out.withColumn("cdf", cdf).drop("drawn")


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, seed: int = SEED, partitions: int | None = None
) -> DataFrame:
    """Rows of ``docs`` repeated to the target weights and globally shuffled; adds rate, n_copies and copy (from 1).

    Documents whose number of copies is 0 go: that is the sampling asked for. Rows with a null id draw by their text's
    hash; rows that share an id draw alike. A null source is a source. An empty table gives an empty result. Added
    columns replace columns of the same name (rate, n_copies, copy); columns of any other name pass unchanged.

    The counts need one aggregation with partial sums; rates are joined by broadcast where there are at most
    BROADCAST_SOURCES sources, else by a shuffle that adaptive execution splits where one source is hot. The only
    exchange of whole rows is the global shuffle, by a key without hot values.
    """
    require(docs, "doc_id", "source")
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("rate", "n_copies", "copy")]
    docs = docs.select(*names)
    table = rates(docs.select("source"), weights, size)
    few = table.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    of, whole, cdf, ident, u, key = fresh(docs, "of", "whole", "cdf", "ident", "u", "key")
    side = table.select(F.col("source").alias(of), "rate", F.col("whole").alias(whole), F.col("cdf").alias(cdf))
    side = F.broadcast(side) if few else side
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in names else F.lit("")
    seeded = F.lit(str(seed))
    drawn = (
        docs.withColumn(ident, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), text)))
        .withColumn(u, hashed(seeded, F.col(ident)))
        .join(side, F.col("source").eqNullSafe(F.col(of)))
        .withColumn("n_copies", F.col(whole) + F.size(F.filter(cdf, lambda c: F.col(u) >= c)).cast("bigint"))
        .filter("n_copies > 0")
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    copies = copies.withColumn(key, F.md5(F.concat_ws(":", seeded, F.col(ident), F.col("copy").cast("string"), F.lit("order"))))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(n, key).sortWithinPartitions(key).select(*names, "rate", "n_copies", "copy")
