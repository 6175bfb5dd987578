"""Registered queries of acquisition and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acquisition, journal, judgement, learning, lookup, network
from .registry import query
from .registry import table as _t


@query("""WITH r AS (SELECT p_partkey AS k, p_brand AS s, p_retailprice AS m, 10.0 * p_size AS w, p_retailprice + 15.0 * p_size AS u FROM part), x AS (SELECT DISTINCT p_brand AS q FROM part WHERE p_partkey % 40 = 0),
    v AS (SELECT s, k, w FROM r WHERE s NOT IN (SELECT q FROM x) QUALIFY row_number() OVER (PARTITION BY s ORDER BY w DESC, k) = 1 ORDER BY w DESC, k LIMIT 6), f AS (SELECT s, k FROM r QUALIFY row_number() OVER (PARTITION BY s ORDER BY u DESC, k) = 1),
    j AS (SELECT r.k, r.w, v.k IS NOT NULL AND v.k = r.k AS own, CASE WHEN v.k = r.k THEN u WHEN v.s IS NOT NULL OR f.k <> r.k THEN m - 25.0 ELSE u END AS score, CASE WHEN v.k = r.k THEN 'unseen_scaffold' WHEN v.s IS NOT NULL OR f.k <> r.k THEN 'diversity' ELSE 'potency' END AS reason FROM r LEFT JOIN v ON v.s = r.s LEFT JOIN f ON f.s = r.s)
    SELECT k AS p_partkey, CAST(row_number() OVER (ORDER BY own DESC, CASE WHEN own THEN -w ELSE -score END, k) AS INT) AS rank, CAST(score AS DOUBLE) AS score, reason FROM j QUALIFY rank <= 30""")
def acquire_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("width", 10.0 * F.col("p_size"))
    return acquisition.acquire(rows, rows.filter("p_partkey % 40 = 0"), "p_partkey", "p_brand", "p_retailprice", "width", 30, 1.5, 0.2, 25.0)


@query("""WITH a AS (SELECT p_partkey AS k, 1.0::DOUBLE AS f, p_size / 50.0::DOUBLE AS g, 1.0::DOUBLE + p_partkey % 3 AS c FROM part), o AS (SELECT k, f, g, g - 0.3::DOUBLE AS r FROM a WHERE k % 10 = 0),
    s AS (SELECT 1 + sum(f * f) * 4 AS p, sum(f * g) * 4 AS q, 1 + sum(g * g) * 4 AS t, sum(f * r) * 4 AS x, sum(g * r) * 4 AS y FROM o), i AS (SELECT t / (p * t - q * q) AS ii, -q / (p * t - q * q) AS ij, p / (p * t - q * q) AS jj, x, y FROM s),
    m AS (SELECT k, c, (ii * x + ij * y) * f + (ij * x + jj * y) * g AS mean, sqrt(ii * f * f + 2 * ij * f * g + jj * g * g) AS std FROM a, i WHERE k NOT IN (SELECT k FROM o))
    SELECT k AS p_partkey, round(mean, 6) AS mean, round(std, 6) AS std, round(greatest(0, mean + 2 * std) / c, 6) AS score FROM m""")
def variant_ranking(spark: SparkSession, d: str) -> DataFrame:
    arms = _t(spark, d, "part").select("p_partkey", F.lit(1.0).alias("one"), (F.col("p_size") / 50.0).alias("size"), (1.0 + F.col("p_partkey") % 3).alias("cost"))
    seen = arms.filter("p_partkey % 10 = 0").select("p_partkey", (F.col("size") - 0.3).alias("reward"))
    out = acquisition.rank_variants(arms, seen, "p_partkey", ["one", "size"], "reward", "cost", beta=2.0)
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("mean", "std", "score")])


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"), (F.col("l_extendedprice") / 1000).alias("w"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity > 49), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT a, b FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a),
    c AS (SELECT n, least(n, min(m)) AS g FROM r GROUP BY n) SELECT count(*) - count(DISTINCT g) AS edges FROM c""")
def spanning_size(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.spanning_forest(_links(spark, d), "a", "b", "w").agg(F.count(F.lit(1)).alias("edges"))


@query()
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.spanning_forest(_links(spark, d), "a", "b", "w")


@query("""SELECT n_nationkey, 0 AS depth, 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT n_nationkey, 1, 'n' || n_nationkey, 'x' || n_nationkey % 3 FROM nation WHERE n_nationkey % 2 = 0""")
def route_edges(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(', "children": [{"id": "x'), F.col("n_nationkey") % 3, F.lit('"}]'))).otherwise("")
    body = F.concat(F.lit('{"id": "r'), "n_regionkey", F.lit('", "children": [{"id": "n'), "n_nationkey", F.lit('"'), leaf, F.lit("}, 7]}"))
    return acquisition.tree_edges(_t(spark, d, "nation").select("n_nationkey", body.alias("body")), "n_nationkey", "body")


@query("""WITH r AS (SELECT o_custkey % 11 AS g, o_orderpriority AS c, o_orderstatus AS o FROM orders), w AS (SELECT g, c, o, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT c, o, sum(n) AS t FROM w GROUP BY ALL), m AS (SELECT g, c, sum(n) AS gn FROM w GROUP BY ALL), a AS (SELECT c, sum(n) AS an FROM w GROUP BY ALL)
    SELECT g, CAST(sum(n) AS BIGINT) AS n, -sum(n * ln((t - n + 1) / (an - gn + 3))) / sum(n) AS log_loss FROM w JOIN t USING (c, o) JOIN m USING (g, c) JOIN a USING (c) GROUP BY g""")
def group_log_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 11).alias("g"), F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("o"))
    return acquisition.group_log_loss(rows, "g", "c", "o", 3)


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'proposed' WHEN 'click' THEN 'validated' WHEN 'signup' THEN 'trial' WHEN 'purchase' THEN 'reported' ELSE 'retired' END AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM s),
    o AS (SELECT *, coalesce((s = 'proposed' AND b IS NULL) OR (s = 'validated' AND b = 'proposed') OR (s = 'trial' AND b = 'validated') OR (s = 'reported' AND b = 'trial') OR (s = 'retired' AND b IN ('proposed', 'validated', 'trial', 'reported', 'promoted')), false) AS ok FROM l)
    SELECT user_id, arg_max(s, i) FILTER (ok) AS status, count(*) FILTER (NOT ok) AS illegal FROM o GROUP BY user_id""")
def trial_states(spark: SparkSession, d: str) -> DataFrame:
    names = {"view": "proposed", "click": "validated", "signup": "trial", "purchase": "reported", "error": "retired"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    return acquisition.trial_states(_t(spark, d, "events").withColumn("status", status), "user_id", ["event_id"], "status")


@query("SELECT 'documents' AS source, count(*) AS n, count(*) FILTER (contains(lower(text), 'the')) AS found FROM documents UNION ALL SELECT 'benchmark', count(*), count(*) FILTER (contains(lower(text), 'the')) FROM benchmark UNION ALL SELECT 'none', 0, 0")
def evidence_query(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("text")
    return acquisition.evidence_query({"documents": docs, "benchmark": _t(spark, d, "benchmark").select("text"), "none": docs.limit(0)}, "text", "The")


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AND event_type = 'view' AND (user_id > 3 OR (user_id = 3 AND event_id > 100)) ORDER BY user_id, event_id LIMIT 20")
def find_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.facets(_t(spark, d, "events").filter("event_type = 'view'"), "props", {"k": [str(i) for i in range(1, 10)]})
    return journal.page(rows.select("event_id", "user_id"), ["user_id", "event_id"], {"user_id": 3, "event_id": 100}, 20)


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS a, 100 + n_nationkey AS b FROM nation UNION SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier), r(node, hops) AS (SELECT unnest([1000::BIGINT, 1001, 1002]), 0 UNION SELECT e.a, hops + 1 FROM r JOIN e ON e.b = node WHERE hops < 5) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def research_impact(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("b"), (100 + F.col("n_nationkey")).cast("bigint").alias("a"))
    b = _t(spark, d, "supplier").select((100 + F.col("s_nationkey")).cast("bigint").alias("b"), (1000 + F.col("s_suppkey")).alias("a"))
    return network.reachable(a.unionByName(b), spark.createDataFrame([(1000,), (1001,), (1002,)], "node bigint"), 5)


_STAGES = [acquisition.Stage("dock", 0.01, 0.35), acquisition.Stage("redock", 0.02, 0.36), acquisition.Stage("valid", 0.1, None, 0.5, 0.05), acquisition.Stage("endpoint", 2.0, 0.55), acquisition.Stage("fep", 40.0, 0.75)]


@query()
def funnel_plan(spark: SparkSession, d: str) -> DataFrame:
    pool = _t(spark, d, "part").count()
    return acquisition.plan_funnel(spark, pool, _STAGES, 4000.0, 0.01, 5, 0.05)[0]


@query()
def knob_advice(spark: SparkSession, d: str) -> DataFrame:
    knobs = [("ensemble", "dock", 0.15, None, 0.0), ("pose", "dock", None, 1.5, 0.01), ("tiny", "endpoint", 0.01, None, 0.0), ("odd", "missing", 0.2, None, 0.0)]
    return acquisition.advise(spark, _t(spark, d, "part").count(), _STAGES, 4000.0, 0.01, 5, 0.05, knobs)


@query()
def retention_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 25.0).alias("rho"))
    return rows.select("n_nationkey", acquisition.retained(F.col("rho"), F.lit(0.05), F.lit(0.01)).alias("retained"))


@query()
def surrogate_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 100).cast("double").alias("rest"), "p_retailprice", judgement.group_fold(F.col("p_brand"), 3, "f").alias("fold"))
    return learning.forest_cross_fit(rows, ["size", "rest"], "p_retailprice", "fold", 3).select("p_partkey", "predicted")


@query()
def frame_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").filter("embedding is not null").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)]).na.drop()
    return learning.frame_clusters(rows, "vec_id", [f"e{i}" for i in range(4)], [2, 4])[0]
