"""Models fitted by Spark's own library: forests with held-out groups, clusters of frames with a chosen number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(df)


def forest_cross_fit(df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int, trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Rows with predicted: a forest of regression trees fitted on all other folds. Rows without a feature go."""
    from pyspark.ml.regression import RandomForestRegressor

    rows, out = _vectors(df, features), None
    model = RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed)
    for k in range(folds):
        known = rows.filter((F.col(fold) != k) & F.col(target).isNotNull())
        one = model.fit(known).transform(rows.filter(F.col(fold) == k)).select(*df.columns, "predicted")
        out = one if out is None else out.unionByName(one)
    return out


def frame_clusters(df: DataFrame, key: str, features: Sequence[str], numbers: Sequence[int], seed: int = 7) -> tuple[DataFrame, dict[int, float]]:
    """key, cluster, is_centre (the row nearest its cluster's centre, ties to the least key) for the number of clusters of
    highest silhouette, and the silhouettes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(df, features)
    judge = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster")
    found = {}
    for k in numbers:
        model = KMeans(featuresCol="__x", predictionCol="cluster", k=k, seed=seed).fit(rows)
        found[k] = (judge.evaluate(model.transform(rows)), model)
    best = max(found, key=lambda k: (found[k][0], -k))
    model = found[best][1]
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(rows).withColumn("__c", centres[F.col("cluster")]).withColumn("__v", vector_to_array("__x"))
    far = F.aggregate(F.zip_with("__v", "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    placed = placed.select(key, "cluster", far.alias("__d"))
    nearest = placed.groupBy("cluster").agg(F.min(F.struct("__d", key)).alias("m")).select(F.col("cluster").alias("__k"), F.col(f"m.{key}").alias("__n"))
    out = placed.join(F.broadcast(nearest), F.col("cluster") == F.col("__k"))  # a row a cluster
    return out.select(key, "cluster", (F.col(key) == F.col("__n")).alias("is_centre")), {k: s for k, (s, _) in found.items()}
