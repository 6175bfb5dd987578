"""Registered queries on the driver's tables, each beside the SQL that defines its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import contracts, evidence, gates, graph, journal, lookup, network, policy, scores, selection, series, similarity, stats
from ..sources import text
from ..streaming import windows
from . import cascade
from .registry import QUERIES, SQL, Query, query
from .registry import table as _t

PRICE = gates.Bounds(1000.0, 20000.0)
_BEST_SQL = "b AS (SELECT l_partkey, min(l_extendedprice) AS best, count(*) AS n FROM lineitem GROUP BY l_partkey)"
_GATED_SQL = f"""WITH {_BEST_SQL}, g AS (SELECT p_partkey, p_brand, best, CASE WHEN best IS NULL THEN 'PRICE_MISSING' WHEN best < 1000 THEN 'PRICE_BELOW_MINIMUM'
    WHEN best > 20000 THEN 'PRICE_ABOVE_MAXIMUM' ELSE 'PRICE_PASS' END AS reason_code FROM part LEFT JOIN b ON l_partkey = p_partkey)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    best = gates.best_of_group(_t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_extendedprice", "l_linenumber")
    return gates.numeric_gate(_t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), best, "p_partkey", "best", PRICE, "PRICE")


@query(f"{_GATED_SQL}, d AS (SELECT CASE WHEN reason_code = 'PRICE_PASS' THEN 'PASS' ELSE 'REJECT' END AS outcome, reason_code FROM g), t AS (SELECT outcome, count(*) AS total_n FROM d GROUP BY outcome) SELECT 'PARENT' AS entity_kind, d.outcome, reason_code, count(*) AS n, any_value(total_n) AS total_n FROM d JOIN t USING (outcome) GROUP BY ALL")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    out = gates.digest(gates.decisions(_gated(spark, d), "p_partkey", "price"))
    return out.select("entity_kind", "outcome", "reason_code", "n", "total_n")


_CLASS = "('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4))::INT % 3"


@query(f"""{_GATED_SQL}, d AS (SELECT CASE WHEN reason_code = 'PRICE_PASS' THEN 'PASS' ELSE 'REJECT' END AS outcome, reason_code, CAST(p_partkey AS VARCHAR) AS id, {_CLASS} AS c FROM g),
    q AS (SELECT outcome, reason_code, sum(n)::BIGINT AS n, list_sort(list(i)) AS sample_ids FROM (SELECT outcome, reason_code, c, count(*) AS n, min(id) AS i FROM d GROUP BY ALL) GROUP BY ALL),
    k AS (SELECT * FROM q ORDER BY n DESC, outcome, reason_code LIMIT 1), t AS (SELECT outcome, count(*) AS total_n FROM d GROUP BY outcome)
    SELECT 'PARENT' AS entity_kind, t.outcome, reason_code, coalesce(n, 0) AS n, array_to_string(sample_ids, ',') AS sample_ids, total_n, total_n - coalesce(n, 0) AS untracked_n FROM t LEFT JOIN k ON k.outcome = t.outcome""")
def decision_digest(spark: SparkSession, d: str) -> DataFrame:
    out = gates.digest(gates.decisions(_gated(spark, d), "p_partkey", "price"), max_buckets=1, sample=3)
    return out.withColumn("sample_ids", F.array_join("sample_ids", ","))

@query(f"{_GATED_SQL} SELECT p_partkey, best, reason_code, reason_code = 'PRICE_PASS' AS passed FROM g")
def numeric_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("p_partkey", "best", "reason_code", "passed")


@query("SELECT l_partkey, max(l_quantity) AS best, arg_max(l_linenumber, l_quantity * 1000 - l_linenumber) AS best_rank, count(*) AS n FROM lineitem GROUP BY l_partkey")
def best_of_group(spark: SparkSession, d: str) -> DataFrame:
    return gates.best_of_group(_t(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_linenumber", lower_is_stronger=False)


@query("""SELECT o_orderkey, reason_code, reason_code = 'DERIVED_METRIC_PASS' AS passed FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'DERIVED_METRIC_' || o_orderstatus
    WHEN o_totalprice < 50000 THEN 'DERIVED_METRIC_BELOW_MINIMUM' WHEN o_totalprice >= 300000 THEN 'DERIVED_METRIC_ABOVE_MAXIMUM' ELSE 'DERIVED_METRIC_PASS' END AS reason_code FROM orders)""")
def derived_metric_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "OK").otherwise(F.col("o_orderstatus")))
    return gates.status_gate(rows, "status", "o_totalprice", gates.Bounds(50000.0, 300000.0, True), False).select("o_orderkey", "reason_code", "passed")


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 OR p_size > 40 OR p_retailprice < 950 OR p_retailprice > 1800 THEN 'outside' WHEN p_size IS NULL OR p_retailprice IS NULL THEN 'unknown' ELSE 'within' END AS verdict FROM part) GROUP BY verdict")
def property_windows(spark: SparkSession, d: str) -> DataFrame:
    v = gates.window_verdict({"p_size": gates.Bounds(5, 40), "p_retailprice": gates.Bounds(950, 1800)})
    return _t(spark, d, "part").select(v.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _rules() -> dict:
    return {"small": F.col("p_size") <= 25, "cheap": F.col("p_retailprice") < 1400, "promo": F.col("p_type").contains("PROMO")}


_RULES_SQL = "SELECT p_partkey, CAST(p_size <= 25 AS INT) AS a, CAST(p_retailprice < 1400 AS INT) AS b, CAST(contains(p_type, 'PROMO') AS INT) AS c FROM part"


@query(f"SELECT p_partkey, a + b + c >= 1 AS any_rule, a + b + c >= 3 AS all_rules, a + b + c >= 2 AS two_rules, CAST(a * 10 + b * 30 + c * 100 AS INT) AS demerits FROM ({_RULES_SQL})")
def rule_gates(spark: SparkSession, d: str) -> DataFrame:
    r = _rules()
    cost = gates.demerits({"small": (r["small"], 10), "cheap": (r["cheap"], 30), "promo": (r["promo"], 100)})
    return _t(spark, d, "part").select("p_partkey", gates.rules_passed(r, "ANY").alias("any_rule"), gates.rules_passed(r).alias("all_rules"), gates.rules_passed(r, "AT_LEAST", 2).alias("two_rules"), cost.alias("demerits"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def orphan_evidence(spark: SparkSession, d: str) -> DataFrame:
    parents = _t(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return gates.orphans(parents, _t(spark, d, "lineitem"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_partkey, CAST(a + b + c AS BIGINT) AS passes, CAST(3 - a - b - c AS BIGINT) AS rejects, a + b + c >= 2 AS passed FROM ({_RULES_SQL})")
def decision_join(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part")
    branch = F.explode(F.array(*[F.struct(F.lit(n).alias("branch"), F.when(c, "PASS").otherwise("REJECT").alias("outcome")) for n, c in _rules().items()])).alias("x")
    votes = parts.select("p_partkey", branch).select("p_partkey", "x.branch", "x.outcome")
    return policy.decision_join(parts.select("p_partkey"), votes, "p_partkey", list(_rules()), "AT_LEAST", 2)


_FUNNEL_SQL = "SELECT 0 AS tier_no, 'size' AS tier, count(*) AS entering, count(*) FILTER (p_size <= 40) AS surviving FROM p UNION ALL SELECT 1, 'price', count(*) FILTER (p_size <= 40), count(*) FILTER (p_size <= 40 AND p_retailprice < 1500) FROM p UNION ALL SELECT 2, 'type', count(*) FILTER (p_size <= 40 AND p_retailprice < 1500), count(*) FILTER (p_size <= 40 AND p_retailprice < 1500 AND contains(p_type, 'STANDARD')) FROM p"


def _tiers() -> dict:
    return {"size": F.col("p_size") <= 40, "price": F.col("p_retailprice") < 1500, "type": F.col("p_type").contains("STANDARD")}


@query(f"WITH p AS (SELECT * FROM part) SELECT *, entering - surviving AS removed FROM ({_FUNNEL_SQL})")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    return policy.funnel(_t(spark, d, "part"), _tiers())


@query(f"WITH p AS (SELECT * FROM part WHERE p_size <= 7) SELECT *, entering - surviving AS removed, CASE WHEN entering > 0 THEN surviving / entering END AS retention FROM ({_FUNNEL_SQL})")
def recall_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return policy.recall_by_tier(_t(spark, d, "part"), F.col("p_size") <= 7, _tiers())


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'size' WHEN p_retailprice >= 1500 THEN 'price' ELSE 'type' END AS tier FROM part WHERE p_size <= 7 AND NOT (p_size <= 40 AND p_retailprice < 1500 AND contains(p_type, 'STANDARD'))")
def lost_actives(spark: SparkSession, d: str) -> DataFrame:
    return policy.lost(_t(spark, d, "part"), "p_partkey", F.col("p_size") <= 7, _tiers())


_REG_SQL = "WITH n AS (SELECT doc_id, md5(text) AS parent_id, md5(lower(text)) AS k FROM documents), p AS (SELECT parent_id, min(doc_id) AS primary_id, count(*) AS duplicate_count, min(k) AS k FROM n GROUP BY parent_id), s AS (SELECT k, count(*) AS n FROM p GROUP BY k)"


def _registered(spark: SparkSession, d: str):
    return policy.register(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", F.md5("text"), F.md5(F.lower("text")))


@query(f"{_REG_SQL} SELECT parent_id, primary_id, duplicate_count, p.k AS registration_key, s.n > 1 AS refined FROM p JOIN s ON p.k = s.k")
def registration_parents(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)[0]


@query(f"{_REG_SQL} SELECT doc_id, n.parent_id, CASE WHEN doc_id = primary_id THEN 'PRIMARY' ELSE 'DUPLICATE' END AS relation FROM n JOIN p ON n.parent_id = p.parent_id")
def registration_map(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)[1]


_TIE = "sha256('seed' || chr(0) || p_partkey)"


@query(f"WITH r AS (SELECT p_partkey, {_TIE} AS tie_break_key, row_number() OVER (ORDER BY {_TIE}, p_partkey) - 1 AS g FROM part) SELECT p_partkey, tie_break_key, CASE WHEN g < 100 THEN g END AS global_rank, g < 100 AS selected, CASE WHEN g < 100 THEN 'SELECTED' ELSE 'NOT_SELECTED_BUDGET' END AS reason_code FROM r")
def hash_budget(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_budget(_t(spark, d, "part").select("p_partkey"), "p_partkey", 100, "seed")


@query(f"""WITH r AS (SELECT p_partkey, p_brand, {_TIE} AS t, row_number() OVER (PARTITION BY p_brand ORDER BY {_TIE}, p_partkey) - 1 AS w FROM part),
    g AS (SELECT p_partkey, row_number() OVER (ORDER BY w, t, p_partkey) - 1 AS g FROM r WHERE w < 4)
    SELECT r.p_partkey, p_brand, t AS tie_break_key, w AS basket_rank, CASE WHEN g < 60 THEN g END AS global_rank, coalesce(g < 60, false) AS selected,
    CASE WHEN g < 60 THEN 'SELECTED' WHEN w >= 4 THEN 'NOT_SELECTED_SCAFFOLD_CAP' ELSE 'NOT_SELECTED_BUDGET' END AS reason_code FROM r LEFT JOIN g ON r.p_partkey = g.p_partkey""")
def scaffold_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return selection.round_robin(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 4, 60, "seed")


@query("WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer) SELECT c_custkey, c_nationkey, 'r1_batch_' || lpad(CAST(n // 8 AS VARCHAR), 4, '0') AS batch_id, n % 8 AS position FROM r WHERE n < total // 8 * 8")
def batch_carving(spark: SparkSession, d: str) -> DataFrame:
    return selection.carve_batches(_t(spark, d, "customer"), "c_custkey", "c_acctbal", "c_nationkey", 8, "r1_")


@query("SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return selection.top_per_group(_t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3)


_AUC_SQL = "WITH s AS (SELECT n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s), c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n, sum(r) FILTER (y) AS rs FROM r), a AS (SELECT p, n, (rs - p * (p + 1) / 2) / (p * n) AS a FROM c)"


@query(f"{_AUC_SQL} SELECT p AS positives, n AS negatives, a AS auc, sqrt(greatest(0, (a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n))) AS se FROM a")
def auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return stats.auc(rows, "n_chars", F.col("quality") == 1)


_Z = stats.Z95


@query(f"""WITH c AS (SELECT o_orderpriority AS g, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1)
    SELECT g AS priority, k AS hits, n AS trials, CASE WHEN k = 0 THEN 0.0 ELSE greatest(0, (k / n + {_Z * _Z / 2} / n - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z / 4} / n / n)) / (1 + {_Z * _Z} / n)) END AS low,
    CASE WHEN k = n THEN 1.0 ELSE least(1, (k / n + {_Z * _Z / 2} / n + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z / 4} / n / n)) / (1 + {_Z * _Z} / n)) END AS high FROM c""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count(F.lit(1)).alias("trials"))
    low, high = stats.wilson(F.col("hits"), F.col("trials"))
    return c.withColumn("low", low).withColumn("high", high)


@query("SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 0 AND quality = 1) AS fn FROM labels")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 1).select("tp", "fp", "tn", "fn")


@query("WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) / count(*) FILTER (quality = 1) AS se, count(*) FILTER (toxic = 0 AND quality = 0) / count(*) FILTER (quality = 0) AS sp FROM labels) SELECT se AS sensitivity, sp AS specificity, se + sp - 1 AS youden FROM c")
def youden(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 1).select("sensitivity", "specificity", "youden")


@query("""WITH n AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po FROM labels), e AS (SELECT sum((SELECT count(*) FROM labels WHERE quality = v) * (SELECT count(*) FROM labels WHERE toxic = v)) / power(max(n), 2) AS pe FROM (VALUES (0), (1)) t(v), n)
    SELECT n, po AS agreement, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS se FROM n, e""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return stats.cohen_kappa(_t(spark, d, "labels"), "quality", "toxic")


_VOTES_SQL = "SELECT p_partkey AS r, unnest([p_size % 3, CAST(p_partkey % 3 AS INT), CAST(floor(p_retailprice) % 3 AS INT)]) AS v FROM part"


@query(f"WITH v AS ({_VOTES_SQL}), c AS (SELECT r, v, count(*) AS c FROM v GROUP BY r, v), p AS (SELECT r, sum(c) AS m, sum(c * c) AS q FROM c GROUP BY r), a AS (SELECT count(*) AS records, avg((q - m) / (m * (m - 1))) AS p FROM p), e AS (SELECT sum(power(x / t, 2)) AS pe FROM (SELECT sum(c) AS x, (SELECT sum(c) FROM c) AS t FROM c GROUP BY v)) SELECT records, CAST(3 AS BIGINT) AS raters, (p - pe) / (1 - pe) AS kappa FROM a, e")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    seats = F.array(F.col("p_size") % 3, (F.col("p_partkey") % 3).cast("int"), (F.floor("p_retailprice") % 3).cast("int"))
    return stats.fleiss_kappa(_t(spark, d, "part").select("p_partkey", F.explode(seats).alias("vote")), "p_partkey", "vote")


@query("WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM (SELECT o_totalprice AS x, o_custkey AS y FROM orders)), s AS (SELECT count(*) AS n, corr(a, b) AS rho FROM r) SELECT n, rho, tanh(atanh(rho) - 1.96 / sqrt(n - 3)) AS low, tanh(atanh(rho) + 1.96 / sqrt(n - 3)) AS high FROM s")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_t(spark, d, "orders"), "o_totalprice", "o_custkey")


@query(f"""WITH r AS (SELECT quality = 0 AS a, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n, count(*) FILTER (a) AS act FROM r),
    f AS (SELECT fraction, n, act, greatest(1, CAST(round_even(n * fraction, 0) AS BIGINT)) AS k FROM n, (VALUES (0.01), (0.05), (0.1)) t(fraction)), h AS (SELECT fraction, n, k, act, (SELECT count(*) FROM r WHERE a AND r <= k) AS h FROM f)
    SELECT CAST(fraction AS DOUBLE) AS fraction, n, k, h AS hits, act / n AS base_rate, h / k / (act / n) AS factor,
    CASE WHEN h = 0 THEN 0.0 ELSE greatest(0, (h / k + {_Z * _Z / 2} / k - {_Z} * sqrt(h / k * (1 - h / k) / k + {_Z * _Z / 4} / k / k)) / (1 + {_Z * _Z} / k)) END AS low,
    CASE WHEN h = k THEN 1.0 ELSE least(1, (h / k + {_Z * _Z / 2} / k + {_Z} * sqrt(h / k * (1 - h / k) / k + {_Z * _Z / 4} / k / k)) / (1 + {_Z * _Z} / k)) END AS high FROM h""")
def enrichment_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return stats.enrichment(rows, "n_chars", "doc_id", F.col("quality") == 0, [0.01, 0.05, 0.1])


@query("SELECT list_sort(list(b))[greatest(1, CAST(ceil(0.1 * count(*)) AS BIGINT))] AS threshold FROM (SELECT min(l_extendedprice) AS b FROM lineitem GROUP BY l_partkey)")
def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = gates.best_of_group(_t(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "l_linenumber")
    return spark.createDataFrame([(stats.percentile_threshold(best, "best", 0.1, True),)], "threshold double")


@query("SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_acctbal <= s_acctbal) / (SELECT count(*) FROM customer) AS share FROM supplier")
def percentile_placement(spark: SparkSession, d: str) -> DataFrame:
    panel = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    return stats.percentile_of(panel, _t(spark, d, "customer").select(F.col("c_acctbal").alias("x")), "x").select("s_suppkey", "share")


@query("WITH b AS (SELECT o_custkey AS g, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS spent, sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) AS reserved FROM orders GROUP BY 1) SELECT g AS o_custkey, reserved, spent, 5000000.0 - spent - reserved AS remaining FROM b")
def balance(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "done").otherwise("reserved"))
    return journal.balance(rows, "o_custkey", "o_totalprice", "status", 5_000_000.0)


@query("SELECT o_orderkey, sum(o_totalprice) OVER w AS running_cost, sum(o_totalprice) OVER w <= 1000000 AS admitted FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def reservation_audit(spark: SparkSession, d: str) -> DataFrame:
    return journal.audit_reservations(_t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 1e6).select("o_orderkey", "running_cost", "admitted")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, arg_min(user_id, (ts, event_id)) AS user_id FROM events GROUP BY 1")
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("bigint"))
    return journal.first_claims(rows, "item", ["ts", "event_id"], "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id > 10 OR (user_id = 10 AND event_id > 500) ORDER BY user_id, event_id LIMIT 50")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_id", "user_id")
    return journal.page(rows, ["user_id", "event_id"], {"user_id": 10, "event_id": 500}, 50)


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f(u, n, live, held) AS (SELECT u, n, ['r' || n], [['r' || n]] FROM e WHERE n = 1 UNION ALL SELECT u, n, live, list_append(held, live) FROM (SELECT e.u, e.n, CASE WHEN e.n > 2 AND e.n % 5 = 0 THEN held[e.n - 3] ELSE list_append(live, 'r' || e.n) END AS live, held FROM f JOIN e ON e.u = f.u AND e.n = f.n + 1)),
    l AS (SELECT u, live FROM f QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1) SELECT u AS user_id, unnest(range(len(live))) AS position, unnest(live) AS round FROM l""")
def ledger_effective_set(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.when((F.col("n") > 2) & (F.col("n") % 5 == 0), "rewind").otherwise("round")
    rows = e.select("user_id", "n", kind.alias("kind"), F.concat(F.lit("r"), F.col("n")).alias("name"), F.when((F.col("n") > 2) & (F.col("n") % 5 == 0), F.concat(F.lit("r"), F.col("n") - 3)).alias("target"))
    return journal.effective_set(rows, "user_id", "n", "kind", "name", "target")


_EVENTS = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, CASE WHEN row_number() OVER ({_EVENTS}) >= 5 THEN avg(value) OVER ({_EVENTS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS moving_average FROM events")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return series.moving_average(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "moving_average")


@query(f"WITH r AS (SELECT user_id, value, row_number() OVER ({_EVENTS}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT *, i >= n - n // 3 AS tail FROM r) SELECT user_id, max(n) AS n, avg(value) FILTER (NOT tail) AS head_mean, avg(value) FILTER (tail) AS tail_mean, stddev_samp(value) FILTER (tail) AS fluctuation, avg(value) FILTER (tail) - avg(value) FILTER (NOT tail) AS drift FROM t GROUP BY user_id")
def final_third_drift(spark: SparkSession, d: str) -> DataFrame:
    return series.drift(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN value < 20 THEN 1 WHEN value > 60 THEN 0 END IGNORE NULLS) OVER ({_EVENTS} ROWS UNBOUNDED PRECEDING), 0) = 1 AS in_contact FROM events")
def contact_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return series.hysteresis(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 20.0, 60.0).select("event_id", "in_contact")


@query(f"WITH f AS (SELECT event_id, user_id, ts, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS BIGINT) AS f FROM events) SELECT event_id, CAST(sum(f) OVER ({_EVENTS} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unique_so_far FROM f")
def unique_so_far(spark: SparkSession, d: str) -> DataFrame:
    return series.unique_so_far(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "unique_so_far")


@query("""WITH h AS (SELECT event_type AS s, CAST(floor(value / 10) AS INT) AS b, count(*) AS n FROM events WHERE value >= 0 AND value < 100 GROUP BY 1, 2), p AS (SELECT s, b, n / sum(n) OVER (PARTITION BY s) AS p FROM h),
    a AS (SELECT s AS l, lead(s) OVER (ORDER BY s) AS r FROM (SELECT DISTINCT s FROM p)) SELECT l AS left_series, r AS right_series, sum(least(x.p, coalesce(y.p, 0))) AS overlap, sum(least(x.p, coalesce(y.p, 0))) < 0.1 AS flagged
    FROM a JOIN p x ON x.s = l LEFT JOIN p y ON y.s = r AND y.b = x.b WHERE r IS NOT NULL GROUP BY l, r""")
def histogram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return series.adjacent_overlap(series.histogram(_t(spark, d, "events"), "event_type", "value", 0.0, 10.0, 10), "event_type")


@query(f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, part, count(*) AS n, round(sum(value), 2) AS total FROM r, (SELECT CAST(unnest(range(1, 6)) AS INT) AS part) WHERE i * 5 <= part * n GROUP BY event_type, part")
def time_convergence(spark: SparkSession, d: str) -> DataFrame:
    out = series.prefix_means(_t(spark, d, "events"), "event_type", ["ts", "event_id"], "value", 5)
    return out.select("event_type", "part", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"))


@query("WITH p AS (SELECT l_linenumber AS r, avg(l_extendedprice) - avg(l_quantity) AS d, avg(l_tax) AS e FROM lineitem GROUP BY 1) SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS stderr, sqrt(sum(e * e) / count(*)) AS pooled_error FROM p")
def repeat_summary(spark: SparkSession, d: str) -> DataFrame:
    return series.repeats(_t(spark, d, "lineitem"), "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, -1 - s_nationkey AS b FROM supplier), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT a, b FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a)
    SELECT n AS node, least(n, min(m)) AS component FROM r GROUP BY n""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (-1 - F.col("s_nationkey")).cast("bigint").alias("b")))


@query("SELECT event_id, key AS field, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) e, LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def json_facets(spark: SparkSession, d: str) -> DataFrame:
    return text.json_cells(_t(spark, d, "events"), "event_id", "props")


@query("SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer")
def catalog_cells(spark: SparkSession, d: str) -> DataFrame:
    return text.cells(_t(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') AND p_size = 10")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return journal.search(_t(spark, d, "part"), F.concat_ws(" ", "p_name", "p_type"), "RING", {"p_size": 10}).select("p_partkey", "p_name")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@', '\\1'), '([?&](api_?key|token|secret|password|ref)=)[^&#]*', '\\1***', 'gi') AS url FROM pages")
def public_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", scalar.public_url(F.col("url")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN 9 - log10(p_retailprice) END AS pic50 FROM part")
def pic50(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.pic50(F.col("p_retailprice")).alias("pic50"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_extendedprice <= 0 THEN 'non_positive' WHEN l_returnflag = 'N' THEN 'unsupported' WHEN l_linestatus = 'O' THEN 'lower_bound' WHEN l_linestatus = 'F' AND l_quantity < 25 THEN 'quantitative' ELSE 'unresolved' END AS class FROM lineitem) GROUP BY class""")
def measurement_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem")
    relation = F.when(F.col("l_linestatus") == "O", ">").when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 25), "=")
    endpoint = F.when(F.col("l_returnflag") == "N", "Tm").otherwise("Ki")
    c = scalar.measurement_class(endpoint, relation, F.col("l_extendedprice"), F.lit("nM"), F.lit(None).cast("string"))
    return rows.select(c.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_NN_SQL = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b"


@query(f"{_NN_SQL} WHERE a.vec_id <> b.vec_id) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS INT) AS rank, neighbour, similarity FROM s QUALIFY rank <= 3")
def neighbours_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.nearest(v, v, "vec_id", "embedding", 3, exclude_self=True)


@query(f"{_NN_SQL} JOIN embeddings x ON x.vec_id = b.vec_id WHERE x.label = 0), m AS (SELECT vec_id, arg_max(neighbour, similarity) AS nearest_reference_id, max(similarity) AS nearest_similarity FROM s GROUP BY vec_id) SELECT *, nearest_similarity >= 0.4 AS analogue, nearest_similarity <= 0.4 AS novel FROM m")
def reference_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    best = similarity.nearest(v, v.filter("label = 0"), "vec_id", "embedding", 1)
    s = F.col("similarity")
    return best.select("vec_id", F.col("neighbour").alias("nearest_reference_id"), s.alias("nearest_similarity"), similarity.similarity_verdict(s, 0.4, "ANALOGUE").alias("analogue"), similarity.similarity_verdict(s, 0.4, "NOVELTY").alias("novel"))


@query("""WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings), r AS (SELECT * FROM b WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
    SELECT b.vec_id, r.vec_id AS reference, list_sum(list_transform(list_zip(b.s, r.s), lambda p: CAST(p[1] AND p[2] AS INT))) / list_sum(list_transform(list_zip(b.s, r.s), lambda p: CAST(p[1] OR p[2] AS INT))) AS tanimoto FROM b JOIN r ON b.label = r.label""")
def tanimoto_bits(spark: SparkSession, d: str) -> DataFrame:
    bits = _t(spark, d, "embeddings").select("vec_id", "label", similarity.sign_bits(F.col("embedding")).alias("bits"))
    first = bits.groupBy("label").agg(F.max("label").alias("l"), F.min(F.struct("vec_id", "bits")).alias("m")).select("l", F.col("m.vec_id").alias("reference"), F.col("m.bits").alias("r"))
    return bits.join(first, F.col("label") == F.col("l")).select("vec_id", "reference", similarity.tanimoto(F.col("bits"), F.col("r")).alias("tanimoto"))


_BITS_SQL = "b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE embedding IS NOT NULL), t AS (SELECT x.vec_id AS q, y.vec_id AS r, x.label AS ql, y.label AS rl, list_sum(list_transform(list_zip(x.s, y.s), lambda p: CAST(p[1] AND p[2] AS INT))) / list_sum(list_transform(list_zip(x.s, y.s), lambda p: CAST(p[1] OR p[2] AS INT))) AS s FROM b x, b y WHERE x.vec_id <> y.vec_id)"


@query(f"WITH {_BITS_SQL} SELECT q AS vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, r) AS INT) AS rank, r AS neighbour, s AS similarity FROM t WHERE s >= 0.5 QUALIFY rank <= 3")
def tanimoto_neighbours(spark: SparkSession, d: str) -> DataFrame:
    bits = _t(spark, d, "embeddings").filter("embedding is not null").select("vec_id", similarity.sign_bits(F.col("embedding")).alias("bits"))
    return similarity.tanimoto_neighbours(bits, bits, "vec_id", "bits", 0.5, 3)


@query(f"WITH {_BITS_SQL} SELECT q AS a, r AS b, s AS core FROM t WHERE q < r AND ql = rl AND s >= 0.45")
def pair_graph(spark: SparkSession, d: str) -> DataFrame:
    bits = _t(spark, d, "embeddings").filter("embedding is not null").select("vec_id", "label", similarity.sign_bits(F.col("embedding")).alias("bits"))
    return similarity.pair_graph(bits, "vec_id", "label", "bits", 0.45)


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.leader_clusters(_t(spark, d, "embeddings"), "vec_id", "embedding", 0.93, "label")


@query("SELECT p_partkey, 'cluster:sha256:' || sha256(p_brand) AS cluster_id, min(p_partkey) OVER (PARTITION BY p_brand) AS representative, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS is_representative FROM part")
def scaffold_group_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.group_clusters(_t(spark, d, "part"), "p_partkey", "p_brand")


@query("SELECT l_partkey, avg(l_extendedprice) FILTER (l_linenumber = 1) - avg(l_extendedprice) FILTER (l_linenumber > 1) AS delta_score, count(*) FILTER (l_linenumber > 1 AND l_extendedprice <= t) AS panel_win_count FROM (SELECT *, avg(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS t FROM lineitem) GROUP BY l_partkey HAVING count(*) FILTER (l_linenumber = 1) > 0 AND count(*) FILTER (l_linenumber > 1) > 0")
def specificity_panel(spark: SparkSession, d: str) -> DataFrame:
    return scores.specificity(_t(spark, d, "lineitem"), "l_partkey", F.col("l_linenumber") == 1, "l_extendedprice")


@query("SELECT p_partkey, -p_retailprice / p_size AS per_size, -p_retailprice / power(p_size, 0.3) AS per_power, 900 + 2 * p_size - p_retailprice AS residual FROM part WHERE p_size > 0")
def normalised_score(spark: SparkSession, d: str) -> DataFrame:
    m = scores.normalised(F.col("p_retailprice"), F.col("p_size"), 0.3, 900, 2)
    return _t(spark, d, "part").filter("p_size > 0").select("p_partkey", *[c.alias(n) for n, c in m.items()])


@query("""WITH m AS (SELECT p_partkey, unnest(['per_size', 'residual']) AS metric, unnest([CASE WHEN p_size > 10 THEN -p_retailprice / (p_size - 10) END, CASE WHEN p_size > 10 THEN 900 + 2 * (p_size - 10) - p_retailprice END]) AS value FROM part)
    SELECT p_partkey, metric, value, CASE WHEN value IS NULL THEN 'UNSCORABLE' ELSE 'OK' END AS status FROM m""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    m = scores.normalised(F.col("p_retailprice"), F.col("p_size") - 10, 0.3, 900, 2)
    return scores.metric_rows(_t(spark, d, "part"), "p_partkey", {n: m[n] for n in ("per_size", "residual")})


@query("SELECT event_type AS model, sum(d) / sum(r) AS delivery, sum(u) / sum(d) AS uniqueness, sum(u) * 3600.0 / sum(s) AS per_hour, sum(u) FILTER (i >= n - t) / sum(d) FILTER (i >= n - t) - sum(u) FILTER (i < t) / sum(d) FILTER (i < t) AS trend FROM (SELECT event_type, 100 AS r, 50 + user_id % 50 AS d, 1 + user_id % 50 AS u, 1.0 + event_id % 7 AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, greatest(1, count(*) OVER (PARTITION BY event_type) // 3) AS t FROM events) GROUP BY event_type")
def productivity(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.col("event_type").alias("model"), "event_id", F.lit(100).alias("requested"), (50 + F.col("user_id") % 50).alias("delivered"), (1 + F.col("user_id") % 50).alias("unique"), (1.0 + F.col("event_id") % 7).alias("seconds"))
    return journal.productivity(rows, "model", ["event_id"])


@query("SELECT e.event_id, o.o_orderkey AS o_orderkey_as_of FROM (SELECT event_id, ts, user_id FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"))
    right = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return series.as_of(left, right, "k", "at", "o_orderkey").select("event_id", "o_orderkey_as_of")


PART = contracts.Contract(
    "part_row/v1",
    T.StructType([
        T.StructField("p_partkey", T.LongType(), False), T.StructField("p_name", T.StringType(), False), T.StructField("p_brand", T.StringType(), False),
        T.StructField("p_type", T.StringType()), T.StructField("p_size", T.IntegerType(), False), T.StructField("p_retailprice", T.DoubleType()),
    ]),
    ("p_brand", "p_size"), {"p_brand": ("Brand#1", "Brand#2", "Brand#3")}, (("p_name", "p_type"),),
)


@query("""SELECT 'null:p_partkey' AS "check", count(*) FILTER (p_partkey IS NULL) AS n FROM part UNION ALL SELECT 'null:p_name', count(*) FILTER (p_name IS NULL) FROM part UNION ALL SELECT 'null:p_brand', count(*) FILTER (p_brand IS NULL) FROM part
    UNION ALL SELECT 'null:p_size', count(*) FILTER (p_size IS NULL) FROM part UNION ALL SELECT 'enum:p_brand', count(*) FILTER (p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')) FROM part
    UNION ALL SELECT 'nonempty:p_name|p_type', count(*) FILTER (coalesce(length(trim(p_name)), 0) = 0 AND coalesce(length(trim(p_type)), 0) = 0) FROM part
    UNION ALL SELECT 'key:p_brand|p_size', count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_size HAVING count(*) > 1)""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return PART.violations(_t(spark, d, "part"))


_SEATS_SQL = "SELECT p_partkey, list_transform([p_size % 3, CAST(p_partkey % 4 AS INT)], lambda x: CASE x WHEN 0 THEN 'refuse' WHEN 1 THEN 'clear' ELSE 'abstain' END) AS v FROM part"


@query(f"SELECT p_partkey, CASE WHEN list_contains(v, 'refuse') AND list_contains(v, 'clear') THEN 'SPLIT' WHEN list_contains(v, 'refuse') THEN 'REFUSED' WHEN list_contains(v, 'clear') THEN 'CLEARED_BUT_UNCERTIFIED' ELSE 'NO_VOTE' END AS outcome FROM ({_SEATS_SQL})")
def vote_outcomes(spark: SparkSession, d: str) -> DataFrame:
    word = lambda x: F.when(x == 0, "refuse").when(x == 1, "clear").otherwise("abstain")
    seats = F.array(word(F.col("p_size") % 3), word(F.col("p_partkey") % 4))
    return evidence.vote_outcomes(_t(spark, d, "part").select("p_partkey", F.explode(seats).alias("vote")), "p_partkey", "vote")


@query("""WITH b(fault, lower, upper) AS (VALUES ('low', 0.0, 3000.0), ('mid', 2000.0, 6000.0), ('any', 8500.0, NULL)), j AS (SELECT c_custkey, c_acctbal, fault FROM customer LEFT JOIN b ON abs(c_acctbal) >= lower AND (upper IS NULL OR abs(c_acctbal) <= upper))
    SELECT c_custkey, coalesce(string_agg(fault, ',' ORDER BY fault), '') AS candidates, CASE WHEN max(c_acctbal) IS NULL THEN 'NO_FAULT_OBSERVED' WHEN count(fault) = 0 THEN 'UNEXPLAINED' WHEN count(fault) = 1 THEN 'ATTRIBUTED' ELSE 'AMBIGUOUS' END AS verdict FROM j GROUP BY c_custkey""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("low", 0.0, 3000.0), ("mid", 2000.0, 6000.0), ("any", 8500.0, None)], "fault string, lower double, upper double")
    return evidence.attribute(_t(spark, d, "customer"), bands, "c_custkey", "c_acctbal")


@query("""WITH s AS (SELECT p_brand AS g, abs(p_retailprice - 1400) / (p_size + 1.0) AS s, p_size + 1.0 AS w FROM part), q AS (SELECT list_sort(list(s))[least(count(*), CAST(ceil((count(*) + 1) * 0.9) AS BIGINT))] AS q, count(*) AS n FROM s),
    g AS (SELECT g, count(*) AS c, avg(CAST(s <= q AS INT)) AS share, sum(CAST(s <= q AS INT)) AS k FROM s, q GROUP BY g) SELECT any_value(n) AS n, any_value(q) AS quantile, sum(k) / sum(c) AS marginal, coalesce(min(share) FILTER (c >= 50), 1.0) AS worst_group, (SELECT median(w * q) FROM s, q) AS median_half_width FROM g, q""")
def conformal_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_brand", F.lit(1400.0).alias("predicted"), "p_retailprice", F.col("p_size").cast("double").alias("spread"))
    return evidence.conformal(rows, "p_brand", "predicted", "p_retailprice", "spread", 0.1, 1.0, 50)


@query("WITH t AS (SELECT p_brand, p_retailprice AS v, count(*) OVER () AS tn, sum(p_retailprice) OVER () AS ts, count(*) OVER (PARTITION BY p_brand) AS gn, sum(p_retailprice) OVER (PARTITION BY p_brand) AS gs FROM part) SELECT p_brand, count(*) AS n, 1 - sum(power(v - (gs - v) / (gn - 1), 2)) / sum(power(v - (ts - v) / (tn - 1), 2)) AS skill FROM t WHERE gn > 1 GROUP BY p_brand")
def leave_one_out_skill(spark: SparkSession, d: str) -> DataFrame:
    return evidence.leave_one_out(_t(spark, d, "part"), "p_brand", "p_retailprice")


@query("SELECT o_orderpriority, (1 + count(*) FILTER (o_orderstatus = 'F')) / (2 + count(*)) AS rate FROM orders GROUP BY 1")
def admission_rates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.admission_rate(_t(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("""WITH p AS (SELECT text FROM benchmark), r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY n_chars, doc_id) AS n FROM documents)
    SELECT doc_id, CASE WHEN text IN (SELECT text FROM p) THEN 'KNOWN' WHEN n = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS status FROM r""")
def distinct_admit(spark: SparkSession, d: str) -> DataFrame:
    pool = _t(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.md5("text").alias("content"))
    rows = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("content"), "n_chars")
    return evidence.admit(rows, pool, "doc_id", "content", "n_chars").select("doc_id", "status")


@query("SELECT o_orderpriority, greatest(200000.0, list_sort(list(o_totalprice) FILTER (o_totalprice > 0))[CAST(ceil(count(*) FILTER (o_totalprice > 0) * 9 / 10) AS BIGINT)]) AS quote FROM orders GROUP BY 1")
def cost_quotes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.cost_quotes(_t(spark, d, "orders"), "o_orderpriority", "o_totalprice", 200_000.0)


@query("SELECT count(*) AS n FROM ((SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') INTERSECT (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT (SELECT p_partkey FROM part WHERE p_size < 10))")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    sets = [rows.filter(f"l_returnflag = '{f}'").select("l_partkey") for f in "RA"]
    return policy.survivors(sets, [_t(spark, d, "part").filter("p_size < 10").select("p_partkey")]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18, 6)) / 1000000000 AS molar FROM part")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.molar(F.col("p_retailprice"), F.lit("nM")).cast("double").alias("molar"))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS a, 100 + n_nationkey AS b FROM nation UNION SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier), r(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.b, hops + 1 FROM r JOIN e ON e.a = node WHERE hops < 3)
    SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("a"), (100 + F.col("n_nationkey")).cast("bigint").alias("b"))
    b = _t(spark, d, "supplier").select((100 + F.col("s_nationkey")).cast("bigint").alias("a"), (1000 + F.col("s_suppkey")).alias("b"))
    return network.reachable(a.unionByName(b), spark.createDataFrame([(0,)], "node bigint"), 3)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem WHERE l_quantity > 49) SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS nodes FROM e")
def graph_size(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"))
    return network.cycle_rank(e, graph.connected_components(e)).select("edges", "nodes")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity > 49), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT a, b FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a),
    c AS (SELECT n, least(n, min(m)) AS g FROM r GROUP BY n), k AS (SELECT (SELECT count(*) FROM e) AS edges, count(*) AS nodes, count(DISTINCT g) AS components FROM c) SELECT *, edges - nodes + components AS cycles FROM k""")
def graph_cycle_rank(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"))
    return network.cycle_rank(e, graph.connected_components(e))


@query("""WITH z AS (SELECT p_partkey, p_retailprice - 1500.0::DOUBLE AS d, p_size * 10.0::DOUBLE AS s FROM part), y AS (SELECT *, abs(d) / s AS z, least(abs(d) / s, 9.0::DOUBLE) AS u FROM z),
    t AS (SELECT *, 0.5 - list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((u * i / 2000) ** 2) / 2))) * u / 6000 / sqrt(2 * pi()) AS tail FROM y)
    SELECT p_partkey, round(greatest(d, 0) + s * (exp(-z * z / 2) / sqrt(2 * pi()) - z * tail), 5) AS improvement FROM t""")
def expected_improvement(spark: SparkSession, d: str) -> DataFrame:
    ei = selection.expected_improvement(F.col("p_retailprice"), F.col("p_size") * 10.0, 1500.0)
    return _t(spark, d, "part").select("p_partkey", F.round(ei, 5).alias("improvement"))


@query("SELECT window_start AS start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed(rows, "ts", "event_type", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text)) AS n_chars FROM conversations GROUP BY conv_id")
def ordered_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return journal.fold(rows, "conv_id", "turn", "role").join(rows.groupBy("conv_id").agg(F.sum("n").alias("n_chars")), "conv_id").select("conv_id", F.col("steps").alias("turns"), F.col("path").alias("roles"), "n_chars")


@query("SELECT l_partkey, count(*) FILTER (l_quantity < 10) / count(*) AS proportion, avg(l_quantity) FILTER (l_quantity < 10) AS mean_in_contact, min(l_quantity) AS low, max(l_quantity) AS high, median(l_quantity) AS mid FROM lineitem GROUP BY l_partkey")
def contact_proportions(spark: SparkSession, d: str) -> DataFrame:
    return scores.proportions(_t(spark, d, "lineitem"), "l_partkey", "l_quantity", 10)


@query("SELECT event_id, 100 - (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    top = selection.top_per_group(_t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5)
    return top.select("event_id", (100 - F.col("rank")).alias("score"))


def _cascade(spark: SparkSession, d: str) -> cascade.Run:
    judge = lambda column, low, high, name: lambda df: df.withColumn("reason_code", gates.verdict(F.col(column), gates.Bounds(low, high), name)).withColumn("passed", F.col("reason_code") == f"{name}_PASS")
    tiers = [
        cascade.Tier("cheap", {"size": judge("p_size", 5, 45, "SIZE"), "price": judge("p_retailprice", 950, None, "PRICE")}),
        cascade.Tier("vote", {"low": judge("p_retailprice", None, 1500, "LOW"), "small": judge("p_size", None, 25, "SMALL"), "large": judge("p_size", 35, None, "LARGE")}, "AT_LEAST", 2),
    ]
    return cascade.run_cascade(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", tiers)


_CASCADE_SQL = "a AS (SELECT * FROM part WHERE p_size BETWEEN 5 AND 45), b AS (SELECT * FROM a WHERE p_retailprice >= 950), c AS (SELECT * FROM b WHERE CAST(p_retailprice <= 1500 AS INT) + CAST(p_size <= 25 AS INT) + CAST(p_size >= 35 AS INT) >= 2)"


@query(f"WITH {_CASCADE_SQL} SELECT p_partkey, p_size, p_retailprice FROM c")
def cascade_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).survivors


@query(f"WITH {_CASCADE_SQL}, f AS (SELECT 0 AS tier_no, 'cheap' AS tier, (SELECT count(*) FROM part) AS entering, (SELECT count(*) FROM b) AS surviving UNION ALL SELECT 1, 'vote', (SELECT count(*) FROM b), (SELECT count(*) FROM c)) SELECT *, entering - surviving AS removed FROM f")
def cascade_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).funnel


@query(f"""WITH {_CASCADE_SQL} SELECT stage_id, outcome, count(*) AS n FROM (SELECT 'cheap.size' AS stage_id, CASE WHEN p_size BETWEEN 5 AND 45 THEN 'PASS' ELSE 'REJECT' END AS outcome FROM part
    UNION ALL SELECT 'cheap.price', CASE WHEN p_retailprice >= 950 THEN 'PASS' ELSE 'REJECT' END FROM a UNION ALL SELECT 'vote.low', CASE WHEN p_retailprice <= 1500 THEN 'PASS' ELSE 'REJECT' END FROM b
    UNION ALL SELECT 'vote.small', CASE WHEN p_size <= 25 THEN 'PASS' ELSE 'REJECT' END FROM b UNION ALL SELECT 'vote.large', CASE WHEN p_size >= 35 THEN 'PASS' ELSE 'REJECT' END FROM b) GROUP BY ALL""")
def cascade_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).decisions.groupBy("stage_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


class ScaleKernel:
    """A fixture behind the seam: price per size, two rows an entity."""

    schema = "p_partkey bigint, pose int, score double"
    config = {"name": "scale", "version": 1}

    def __call__(self, rows):
        out = rows.loc[rows.index.repeat(2)].reset_index(drop=True)
        out["pose"] = [0, 1] * len(rows)
        out["score"] = out["p_retailprice"] / out["p_size"] * (1 + out["pose"])
        return out[["p_partkey", "pose", "score"]].astype({"pose": "int32"})


@query("SELECT p_partkey, CAST(pose AS INT) AS pose, p_retailprice / p_size * (1 + pose) AS score FROM part, (VALUES (0), (1)) t(pose)")
def kernel_seam(spark: SparkSession, d: str) -> DataFrame:
    kernels = cascade.KernelRegistry()
    kernels.register("scale", ScaleKernel())
    return kernels.apply("scale", _t(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"])


@query("""WITH k AS (SELECT DISTINCT l_partkey AS k, l_partkey % 4 AS lane FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)), r AS (SELECT k, lane, (row_number() OVER (PARTITION BY lane ORDER BY k) - 1) // 50 AS batch FROM k)
    SELECT lane, batch, array_to_string(list_sort(list(CAST(k AS VARCHAR))), ',') AS keys, sha256('chembl' || chr(10) || array_to_string(list_sort(list(CAST(k AS VARCHAR))), chr(10))) AS request_id FROM r GROUP BY lane, batch""")
def lookup_batches(spark: SparkSession, d: str) -> DataFrame:
    keys = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    known = _t(spark, d, "part").filter("p_size > 30").select(F.col("p_partkey").alias("k"))
    return lookup.plan_lookups(keys, known, "k", F.col("k") % 4, 50, "chembl").withColumn("keys", F.array_join("keys", ","))


@query("SELECT p_partkey AS k, count(l_orderkey) AS n, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS n_documents, count(*) FILTER (l_returnflag = 'R') AS n_kind FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY p_partkey")
def dossier_inventory(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("doc"), "l_returnflag")
    docs = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"))
    return lookup.dossier(m, _t(spark, d, "part").select(F.col("p_partkey").alias("k")), docs, "k", "doc", F.col("l_returnflag") == "R")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '69', '42')")
def evidence_facets(spark: SparkSession, d: str) -> DataFrame:
    return lookup.facets(_t(spark, d, "events"), "props", {"k": ["1", "69", "42"]}).select("event_id")


@query("SELECT n_nationkey, position, position + n_regionkey AS mapped FROM (SELECT n_nationkey, n_regionkey, unnest(range(n_nationkey, n_nationkey + 4)) AS position FROM nation)")
def residue_map(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_nationkey").alias("low"), (F.col("n_nationkey") + 3).alias("high"))
    return lookup.ranges_to_rows(r, "low", "high", "n_regionkey").select("n_nationkey", "position", "mapped")


from . import acquisitions, judgements, plugins, records, sources, trajectories  # noqa: E402, F401  they register their queries

__all__ = ["QUERIES", "SQL", "Query", "query"]
