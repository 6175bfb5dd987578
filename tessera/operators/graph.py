"""Graph operators over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_path(spark, label: str) -> str:
    """A new path in the folder that the session's spark.checkpoint.dir names, else in its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: short lineage that survives lost executors."""
    return _written(df, label)[0]


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark, path: str) -> None:
    """Deletes a folder that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """n, m: the least v of each u. The key is an aggregate of its own, so that a join on it gets an exchange of its
    own, which adaptive execution can split for a hub with very many neighbours."""
    return edges.groupBy("u").agg(F.max("u").alias("n"), F.min("v").alias("m")).select("n", "m")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node with an edge to another one.

    Alternating star contraction: each round links every node's larger neighbours to its least one, then its smaller
    ones, until only stars are left; rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder, and the one before is deleted then. Rows with a null end and loops are ignored; repeated edges count
    once.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    stars, path = _written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    known = _fingerprint(stars)
    for _ in range(max_rounds):
        if not known[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("n", F.least("n", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least_neighbour(large)
        small = large.join(least, F.col("u") == F.col("n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, written = _written(small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = _fingerprint(after)
        discard(edges.sparkSession, path)
        stars, path, done, known = after, written, now == known, now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
