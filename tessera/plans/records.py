"""Registered queries of research records: quotas, windows, versions, lineage, panels, ingress, sourcing, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, graph, policy, records, selection
from .registry import query
from .registry import table as _t

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER w AS taken, sum(value) OVER w AS charged FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, taken, charged, coalesce(taken <= n, true) AND coalesce(charged <= c, true) AS admitted FROM r LEFT JOIN (VALUES ('view', 100, NULL), ('click', NULL, 4000.0), ('error', 50, 1500.0)) q(t, n, c) ON t = event_type""")
def trial_quotas(spark: SparkSession, d: str) -> DataFrame:
    caps = spark.createDataFrame([("view", 100, None), ("click", None, 4000.0), ("error", 50, 1500.0)], "event_type string, max_count int, max_cost double")
    return records.within_quota(_t(spark, d, "events"), caps, "event_type", ["ts", "event_id"], "value").select("event_id", "taken", "charged", "admitted")


@query("SELECT user_id, max(event_id) AS watermark, count(*) AS n, max(event_id) - min(event_id) + 1 = count(*) AND count(DISTINCT event_id) = count(*) AS complete FROM events GROUP BY user_id")
def watermarks(spark: SparkSession, d: str) -> DataFrame:
    return records.watermarks(_t(spark, d, "events"), "user_id", "event_id")


@query("SELECT user_id, event_id, before FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND event_id <> before + 1")
def sequence_faults(spark: SparkSession, d: str) -> DataFrame:
    return records.sequence_faults(_t(spark, d, "events"), "user_id", "event_id")


@query(f"SELECT event_id, {_K} // 10 >= max({_K} // 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS published FROM events")
def fenced_writes(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("epoch", F.floor(F.col("k") / 10))
    return records.fenced(rows, "user_id", "epoch", "ts", ["event_id"]).select("event_id", "published")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM events) SELECT user_id, count(*) AS n, round(max(g), 3) AS longest, coalesce(max(g) > 40000, false) AS stale FROM g GROUP BY user_id""")
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    return records.heartbeat_gaps(_t(spark, d, "events"), "user_id", "ts", ["event_id"], 40_000).withColumn("longest", F.round("longest", 3))


@query("""WITH c AS (SELECT o_custkey AS u, o_orderkey AS decision, o_orderkey // 2 AS cutoff FROM orders) SELECT u AS user_id, decision, (SELECT count(*) FROM events e WHERE e.user_id = u AND event_id <= cutoff) AS visible, (SELECT count(*) FROM events e WHERE e.user_id = u AND event_id > cutoff) AS hidden,
    (SELECT max(event_id) FROM events e WHERE e.user_id = u AND event_id <= cutoff) AS latest FROM c""")
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    cuts = _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("decision"), F.floor(F.col("o_orderkey") / 2).alias("cutoff"))
    return records.evidence_window(_t(spark, d, "events"), cuts, "user_id", "event_id", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, lag(event_id) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT user_id, min(i) AS bad FROM r WHERE i % 7 = 0 GROUP BY user_id)
    SELECT r.user_id, max(event_id) FILTER (bad IS NULL OR i < bad) AS head, count(*) FILTER (bad IS NULL OR i < bad) AS applied, count(*) FILTER (bad IS NOT NULL AND i >= bad) AS refused FROM r LEFT JOIN f ON f.user_id = r.user_id GROUP BY r.user_id""")
def version_heads(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = _t(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("p"), F.row_number().over(w).alias("i"))
    rows = rows.withColumn("expected", F.when(F.col("i") % 7 == 0, F.lit(-1)).otherwise(F.col("p")))
    return records.heads(rows, "user_id", "event_id", "expected", "event_id")


@query("""SELECT DISTINCT * FROM (SELECT o_orderkey AS source, 'customer' AS relation, 'c' || o_custkey AS target FROM orders UNION ALL SELECT o_orderkey, 'parts', unnest(l) FROM orders JOIN (SELECT l_orderkey, list(DISTINCT 'p' || l_partkey) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def relation_index(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("parts"))
    rows = _t(spark, d, "orders").join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return records.relations(rows, "o_orderkey", {"customer": F.array(F.concat(F.lit("c"), F.col("o_custkey"))), "parts": F.coalesce("parts", F.array().cast("array<string>"))})


@query("SELECT l_orderkey AS source, 'part' AS relation, l_partkey AS target FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 48)")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    lists = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return records.dangling(records.relations(lists, "l_orderkey", {"part": F.col("parts")}), _t(spark, d, "part").filter("p_size < 48"), "p_partkey")


@query("""WITH m AS (SELECT p_partkey AS artifact, 'make' || p_size % 4 AS producer FROM part WHERE p_size % 5 > 0), r AS (SELECT DISTINCT l_partkey AS artifact, 'use' || l_suppkey % 3 AS consumer FROM lineitem WHERE l_quantity > 45) SELECT producer, coalesce(m.artifact, r.artifact) AS artifact, consumer FROM m FULL JOIN r ON m.artifact = r.artifact""")
def execution_lineage(spark: SparkSession, d: str) -> DataFrame:
    made = _t(spark, d, "part").filter("p_size % 5 > 0").select(F.col("p_partkey").alias("artifact"), F.concat(F.lit("make"), F.col("p_size") % 4).alias("step"))
    read = _t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("artifact"), F.concat(F.lit("use"), F.col("l_suppkey") % 3).alias("step")).distinct()
    return records.lineage(made, read, "artifact", "step")


@query("""SELECT 0 AS stage_no, 'size' AS stage_id, CASE WHEN p_size BETWEEN 5 AND 45 THEN 'PASS' ELSE 'REJECT' END AS outcome, CASE WHEN p_size < 5 THEN 'SIZE_BELOW_MINIMUM' WHEN p_size > 45 THEN 'SIZE_ABOVE_MAXIMUM' ELSE 'SIZE_PASS' END AS reason_code, NOT p_size BETWEEN 5 AND 45 AS removed FROM part WHERE p_partkey = 7
    UNION ALL SELECT 1, 'price', CASE WHEN p_retailprice <= 905 THEN 'PASS' ELSE 'REJECT' END, CASE WHEN p_retailprice <= 905 THEN 'PRICE_PASS' ELSE 'PRICE_ABOVE_MAXIMUM' END, p_retailprice > 905 FROM part WHERE p_partkey = 7""")
def explain_entity(spark: SparkSession, d: str) -> DataFrame:
    parts, rows = _t(spark, d, "part"), None
    for name, column, bounds in (("price", "p_retailprice", gates.Bounds(None, 905)), ("size", "p_size", gates.Bounds(5, 45))):
        judged = parts.withColumn("reason_code", gates.verdict(F.col(column), bounds, name.upper())).withColumn("passed", F.col("reason_code") == f"{name.upper()}_PASS")
        one = gates.decisions(judged, "p_partkey", name)
        rows = one if rows is None else rows.unionByName(one)
    return records.explain(rows, ["size", "price"], "7")


_BYTES = "PARTITION BY user_id ORDER BY ts, event_id ROWS"


@query(f"SELECT event_id, CAST(floor(coalesce(sum(octet_length(encode(props))) OVER ({_BYTES} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 64) AS BIGINT) AS page FROM events")
def byte_pages(spark: SparkSession, d: str) -> DataFrame:
    return records.byte_pages(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("props"), 64).select("event_id", "page")


@query(f"SELECT event_id, sum(octet_length(encode(props))) OVER ({_BYTES} UNBOUNDED PRECEDING) <= 100 AS included FROM events")
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    return records.within_bytes(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("props"), 100).select("event_id", "included")


@query(f"SELECT user_id, count(DISTINCT {_K}) FILTER (event_type = 'view') AS view, count(DISTINCT {_K}) FILTER (event_type = 'click') AS click, count(DISTINCT {_K}) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def trace_projection(spark: SparkSession, d: str) -> DataFrame:
    return records.trace_projection(_events(spark, d), "user_id", "event_type", "k", ["view", "click", "purchase"])


@query("SELECT o_orderpriority, kind, sum(coalesce(amount, 0)) AS total, count(*) AS n FROM (SELECT o_orderpriority, unnest(['gpu', 'cpu']) AS kind, unnest([o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END]) AS amount FROM orders) GROUP BY ALL")
def workflow_accounting(spark: SparkSession, d: str) -> DataFrame:
    costs = F.create_map(F.lit("gpu"), F.col("o_totalprice"), F.lit("cpu"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("double")))
    return records.accounting(_t(spark, d, "orders"), "o_orderpriority", costs)


@query("""SELECT p, s, count(value) AS n, avg(value) AS mean FROM (VALUES ('view'), ('click'), ('never')) a(p), (VALUES (0), (1), (2)) b(s) LEFT JOIN events ON event_type = p AND user_id % 7 = s GROUP BY p, s""")
def policy_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.col("event_type").alias("p"), (F.col("user_id") % 7).cast("int").alias("s"), "value")
    return records.grid(rows, spark.createDataFrame([("view",), ("click",), ("never",)], "p string"), spark.createDataFrame([(0,), (1,), (2,)], "s int"), ["p", "s"], "value")


@query("""WITH c AS (SELECT event_type AS a, user_id AS b, avg(value) AS v FROM events GROUP BY 1, 2) SELECT x.a AS event_type, count(*) AS pairs, avg(x.v - y.v) AS mean_difference FROM c x JOIN c y ON x.b = y.b AND y.a = 'view' WHERE x.a <> 'view' GROUP BY x.a""")
def panel_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return records.contrasts(_t(spark, d, "events"), "event_type", "user_id", "value", "view")


_BANDS = "CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END"


@query(f"SELECT event_id, {_BANDS} AS outcome FROM events")
def outcome_bands(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", records.discretise(F.col("value"), [(20.0, "low"), (80.0, "mid")], "high").alias("outcome"))


@query(f"""WITH r AS (SELECT user_id AS g, event_type AS a, {_BANDS} AS b FROM events), s AS (SELECT g, count(*) AS n FROM r GROUP BY g) SELECT a, b, count(*) AS n, sum(1.0::DOUBLE / s.n / (SELECT count(*) FROM s)) AS probability FROM r JOIN s USING (g) GROUP BY a, b""")
def joint_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.col("user_id").alias("g"), F.col("event_type").alias("a"), records.discretise(F.col("value"), [(20.0, "low"), (80.0, "mid")], "high").alias("b"))
    return records.joint_outcomes(rows, ["a", "b"], "g")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    return records.split_leaks(_t(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return records.missing_cells(_t(spark, d, "documents"), ["text", "lang", "source"])


@query("WITH r AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber < 5 THEN l_tax END AS v FROM lineitem) SELECT g AS l_returnflag, count(v) AS known, count(*) - count(v) AS unknown, (coalesce(sum(v), 0) + (count(*) - count(v)) * 0.0) / count(*) AS least, (coalesce(sum(v), 0) + (count(*) - count(v)) * 0.1::DOUBLE) / count(*) AS greatest FROM r GROUP BY g")
def support_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") < 5, F.col("l_tax")).alias("v"))
    return records.support(rows, "l_returnflag", "v", 0.0, 0.1)


@query("""WITH r AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_filter(['A', 'N'], lambda x: NOT list_contains(c, x))), ',') AS missing, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(['A', 'N'], x))), ',') AS unexpected,
    len(c) = 2 AND NOT list_contains(c, 'R') AS complete FROM r""")
def result_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("checks"))
    return records.completeness(rows, "l_orderkey", F.col("checks"), ["A", "N"])


@query("""WITH r AS (SELECT p_brand AS g, p_partkey AS k, p_retailprice AS p, p_size < 20 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice - p_size END AS m FROM part) SELECT g AS p_brand, (SELECT k FROM r x WHERE x.g = r.g ORDER BY p DESC, k LIMIT 1) AS unrestricted, (SELECT k FROM r x WHERE x.g = r.g AND a ORDER BY p DESC, k LIMIT 1) AS attainable,
    (SELECT k FROM r x WHERE x.g = r.g AND m IS NOT NULL ORDER BY m DESC, k LIMIT 1) AS evidence FROM (SELECT DISTINCT g FROM r) r""")
def recommendation_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("measured", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") - F.col("p_size")))
    return records.recommendation(rows, "p_brand", "p_partkey", "p_retailprice", F.col("p_size") < 20, "measured")


@query("""SELECT n_nationkey, array_to_string(list_filter(['a=1', 'a=2', 'b=1'], lambda x, i: (m >> (i - 1)) % 2 = 1), ',') AS edits, CAST(bit_count(m) AS INT) AS n FROM nation, (SELECT unnest(range(8)) AS m) WHERE bit_count(m) <= 2 AND m NOT IN (3, 7)""")
def edit_sets(spark: SparkSession, d: str) -> DataFrame:
    return records.edit_sets(_t(spark, d, "nation"), "n_nationkey", [("a", "1"), ("a", "2"), ("b", "1")], 2)


@query("SELECT s_suppkey, 'IC50' AS endpoint, 'nM' AS unit, false AS reviewed FROM supplier")
def review_template(spark: SparkSession, d: str) -> DataFrame:
    return records.review_template(_t(spark, d, "supplier"), "s_suppkey", "IC50", "nM")


@query("""WITH r AS (SELECT sha256(l_orderkey || '-' || l_linenumber % 3) AS e, l_partkey AS k, l_quantity * CASE l_returnflag WHEN 'A' THEN 1e-9::DOUBLE WHEN 'N' THEN 1e-6::DOUBLE END AS v FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'N') AND l_tax > 0.01) SELECT e AS experiment_id, k AS l_partkey, v AS molar FROM r QUALIFY row_number() OVER (PARTITION BY e ORDER BY k, v) = 1""")
def import_assays(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("relation", F.when(F.col("l_linestatus") == "F", "=").otherwise(">"))
    experiment = F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber") % 3)
    return records.import_assays(rows, "l_partkey", experiment, "l_quantity", {"A": 1e-9, "N": 1e-6}, "l_returnflag", "relation", F.col("l_tax") > 0.01)


@query("""WITH r AS (SELECT p_partkey AS k, 'pool' AS o, true AS old FROM part WHERE p_size < 25 UNION ALL SELECT l_partkey, 'lib' || l_returnflag, false FROM lineitem WHERE l_quantity > 48) SELECT k, array_to_string(list_sort(list(DISTINCT o)), ',') AS origins, NOT bool_or(old) AS added FROM r GROUP BY k""")
def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    pool = _t(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("k"), F.lit("pool").alias("origin"))
    library = _t(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k"), F.concat(F.lit("lib"), "l_returnflag").alias("origin"))
    return records.import_candidates(pool, library, "k", "origin")


@query("""SELECT event_id, json_extract_string(b, '$.id.k') AS name, json_extract_string(b, '$.s') AS structure, CASE WHEN json_extract_string(b, '$.id.k') IS NULL THEN 'NO_IDENTITY' WHEN json_extract_string(b, '$.s') IS NULL THEN 'NO_STRUCTURE' ELSE 'REGISTERED' END AS status
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"id": ' || props || ', "s": "' || event_type || '"}' WHEN event_id % 3 = 1 THEN '{"id": ' || props || '}' ELSE '{"s": "x"}' END AS b FROM events)""")
def prepare_library(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 3
    body = F.when(i == 0, F.concat(F.lit('{"id": '), "props", F.lit(', "s": "'), "event_type", F.lit('"}'))).when(i == 1, F.concat(F.lit('{"id": '), "props", F.lit("}"))).otherwise('{"s": "x"}')
    return records.prepare_library(_t(spark, d, "events").withColumn("body", body), "event_id", "body", "id.k", "s")


@query("SELECT p.p_partkey, p.p_brand = h.b AND p.p_size = h.s AS attached, NOT (p.p_brand = h.b AND p.p_size = h.s) AS conflict FROM part p JOIN (SELECT p_partkey, p_brand AS b, p_size - CAST(p_partkey % 5 = 0 AS INT) AS s FROM part WHERE p_partkey % 2 = 0) h USING (p_partkey)")
def attach_handoffs(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    handoffs = rows.filter("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") - (F.col("p_partkey") % 5 == 0).cast("int"))
    return records.attach(rows, handoffs, "p_partkey", ["p_brand", "p_size"])


@query("SELECT o_orderkey, position, item FROM (SELECT o_orderkey, unnest(coalesce(l, [NULL])) AS item, unnest(CASE WHEN l IS NULL THEN [NULL] ELSE range(len(l)) END)::INT AS position FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS l FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey)")
def design_bundles(spark: SparkSession, d: str) -> DataFrame:
    lists = _t(spark, d, "lineitem").filter("l_quantity > 30").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("items"))
    rows = _t(spark, d, "orders").join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return records.unnest_bundle(rows, "o_orderkey", "items")


@query("""WITH o AS (SELECT p_name AS x, p_brand AS p FROM part WHERE p_size < 6), a AS (SELECT x, count(*) AS n FROM o GROUP BY x), b AS (SELECT p, count(*) AS n FROM o GROUP BY p) SELECT p_partkey, CASE WHEN a.n IS NOT NULL THEN 'EXACT' WHEN b.n IS NOT NULL THEN 'PARENT' ELSE 'NONE' END AS match, coalesce(a.n, b.n, 0) AS offers FROM part LEFT JOIN a ON x = p_name LEFT JOIN b ON p = p_brand""")
def sourcing_matches(spark: SparkSession, d: str) -> DataFrame:
    return records.sourcing(_t(spark, d, "part"), _t(spark, d, "part").filter("p_size < 6").select("p_name", "p_brand"), "p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, coalesce(p_partkey % 3 = 0 AND p_size > 10, false) AS authorised FROM part")
def spend_authorisation(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "p_partkey", "p_name"), 256)
    expires = F.when(F.col("p_size") > 10, F.to_date(F.lit("2030-01-01"))).otherwise(F.to_date(F.lit("2020-01-01")))
    tokens = _t(spark, d, "part").filter("p_partkey % 3 = 0").select(digest.alias("digest"), expires.alias("expires"))
    return records.authorised(_t(spark, d, "part"), tokens, digest, "2025-06-01").select("p_partkey", "authorised")


@query("""WITH c AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS recall, o_custkey % 2 = 0 AS sep, o_orderdate AS issued FROM orders), r AS (SELECT o_orderkey, CASE WHEN recall < 0.5 THEN 'RECALL' WHEN NOT sep THEN 'NO_SEPARATION' WHEN issued + INTERVAL 48 HOURS < TIMESTAMP '2000-06-01' THEN 'EXPIRED' END AS reason FROM c) SELECT o_orderkey, reason IS NULL AS granted, reason FROM r""")
def gate_authorisation(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 100.0).alias("recall"), (F.col("o_custkey") % 2 == 0).alias("sep"), "o_orderdate")
    return records.gate_authorisation(rows, "o_orderkey", 0.5, "sep", "o_orderdate", 48, "2000-06-01 00:00:00")


@query(f"SELECT user_id, event_type, arg_max({_K}, event_id) AS k FROM events WHERE value > 20 GROUP BY 1, 2")
def replay_parameters(spark: SparkSession, d: str) -> DataFrame:
    return records.replay(_events(spark, d), "user_id", "event_id", "event_type", "k", F.col("value") > 20)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) p WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE l_quantity > 20 AND m.l_orderkey = p.l_orderkey AND m.l_linenumber = p.l_linenumber AND m.l_returnflag = p.l_returnflag)")
def missing_shards(spark: SparkSession, d: str) -> DataFrame:
    plan = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return records.missing_shards(plan, _t(spark, d, "lineitem").filter("l_quantity > 20"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def key_set_filter(spark: SparkSession, d: str) -> DataFrame:
    keys = _t(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return records.with_keys(_t(spark, d, "lineitem"), keys, "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("WITH o AS (SELECT lower(trim(p_name)) AS k, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1) SELECT p_partkey, coalesce(n, 0) AS offers FROM part LEFT JOIN o ON k = lower(trim(p_name))")
def catalogue_matches(spark: SparkSession, d: str) -> DataFrame:
    return records.catalogue_matches(_t(spark, d, "part"), _t(spark, d, "part").filter("p_size > 45").select(F.upper("p_name").alias("offer")), "p_partkey", F.col("p_name"), F.concat(F.lit(" "), F.col("offer")))


@query("""SELECT l_partkey, count(*) AS asserted, count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS unresolved, count(DISTINCT l_returnflag) FILTER (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) > 1 AS conflicting FROM lineitem GROUP BY l_partkey""")
def review_evidence(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.integrate_review(_t(spark, d, "lineitem"), known, "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT l_suppkey, l_partkey, p_brand, s_name FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 47) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 10")
def screen_delivery(spark: SparkSession, d: str) -> DataFrame:
    survivors = _t(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    origins = _t(spark, d, "lineitem").filter("l_quantity > 47").select("l_partkey", "l_suppkey").distinct()
    return records.delivery(survivors, origins, _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_partkey", "l_suppkey")


@query("SELECT sha256(string_agg(octet_length(encode(CAST(n_nationkey AS VARCHAR))) || ':' || n_nationkey, '' ORDER BY CAST(n_nationkey AS VARCHAR))) AS digest, count(*) AS n FROM nation")
def order_hash(spark: SparkSession, d: str) -> DataFrame:
    return records.order_hash(_t(spark, d, "nation"), "n_nationkey")


@query("SELECT p_type, min(p_name) AS p_name, count(*) AS n FROM part GROUP BY p_type")
def reference_set(spark: SparkSession, d: str) -> DataFrame:
    return records.reference_set(_t(spark, d, "part"), "p_type", "p_name")


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 10 ELSE least(10, CAST(floor(1000000.0 / o_totalprice * (1 + 1e-12::DOUBLE)) AS BIGINT)) END AS n FROM orders")
def affordable_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", records.affordable_count(F.col("o_totalprice"), F.lit(1e6), F.lit(10)).alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS c FROM orders) WHERE c <= 500000")
def bounded_acquisition(spark: SparkSession, d: str) -> DataFrame:
    return records.bounded_prefix(_t(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice", 500_000.0).select("o_orderkey")


@query("SELECT p_partkey, round(p_retailprice, 6) AS greedy, round(p_retailprice + 1.5 * p_size, 6) AS ucb, -CAST(1 + p_partkey % 5 AS DOUBLE) AS cost_only FROM part")
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    s = records.policy_scores(F.col("p_retailprice"), size * 1.0, 1.0 + F.col("p_partkey") % 5, F.lit(3), F.lit(1), 1500.0, 1.5)
    return _t(spark, d, "part").select("p_partkey", *[F.round(s[n], 6).alias(n) for n in ("greedy", "ucb", "cost_only")])


@query("""WITH b AS (SELECT p_brand, p_type, p_partkey, p_retailprice + 1.5 * p_size AS s, 1.0 + p_partkey % 5 AS c FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY s DESC, p_partkey) = 1), r AS (SELECT *, row_number() OVER w AS rank, sum(c) OVER w AS t FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY s DESC, p_partkey ROWS UNBOUNDED PRECEDING))
    SELECT p_brand, p_partkey, CAST(rank AS INT) AS rank FROM r WHERE t <= 9""")
def policy_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("cost", 1.0 + F.col("p_partkey") % 5)
    return records.policy_choice(rows, "p_partkey", "p_brand", F.col("p_retailprice") + 1.5 * F.col("p_size"), "cost", 9.0, "p_type").select("p_brand", "p_partkey", "rank")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN CAST(ceil(p_retailprice / (p_size - 20)) AS BIGINT) END AS uses, coalesce(p_partkey >= CASE WHEN p_size > 20 THEN ceil(p_retailprice / (p_size - 20)) END, false) AS pays FROM part")
def break_even(spark: SparkSession, d: str) -> DataFrame:
    uses, pays = records.break_even(F.col("p_size").cast("double"), F.lit(20.0), F.col("p_retailprice"), F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", uses.alias("uses"), pays.alias("pays"))


@query("SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice, p_partkey) AS INT) AS rank FROM part WHERE p_retailprice < 1500 QUALIFY rank <= 2")
def pose_shortlist(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").filter("p_retailprice < 1500").select("p_type", "p_partkey", "p_size", "p_retailprice")
    return selection.top_per_group(rows, "p_type", [F.desc("p_size"), F.col("p_retailprice"), F.col("p_partkey")], 2).select("p_type", "p_partkey", "rank")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity > 49), n AS (SELECT p_partkey + 1000000 AS node, false AS poor FROM part) SELECT node, 'UNREACHABLE' AS fault FROM n WHERE node NOT IN (SELECT b FROM e)""")
def network_faults(spark: SparkSession, d: str) -> DataFrame:
    edges = _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"))
    nodes = _t(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("node"))
    return nodes.join(graph.connected_components(edges).select("node"), "node", "left_anti").withColumn("fault", F.lit("UNREACHABLE"))


@query("WITH p AS (SELECT * FROM part), t AS (SELECT 'size' AS tier, p_partkey FROM p WHERE p_size > 40 UNION ALL SELECT 'price', p_partkey FROM p WHERE p_size <= 40 AND p_retailprice >= 1500 UNION ALL SELECT 'type', p_partkey FROM p WHERE p_size <= 40 AND p_retailprice < 1500 AND NOT contains(p_type, 'STANDARD')) SELECT tier, count(*) AS n FROM t GROUP BY tier")
def removal_reasons(spark: SparkSession, d: str) -> DataFrame:
    tiers = {"size": F.col("p_size") <= 40, "price": F.col("p_retailprice") < 1500, "type": F.col("p_type").contains("STANDARD")}
    return policy.lost(_t(spark, d, "part"), "p_partkey", F.lit(True), tiers).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH j AS (SELECT event_type AS l, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM events WHERE event_id % 3 = 0 AND event_type <> 'view'), m AS (SELECT l, max(s) AS m FROM j GROUP BY l)
    SELECT event_id, coalesce(m, 0) + row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events LEFT JOIN m ON l = event_type WHERE event_id % 3 = 1""")
def append_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_type", "event_id")
    empty = e.limit(0).withColumn("seq", F.lit(0).cast("bigint"))
    journal = records.append_sequence(empty, e.filter("event_id % 3 = 0 and event_type <> 'view'"), "event_type", "seq", ["event_id"])
    return records.append_sequence(journal, e.filter("event_id % 3 = 1"), "event_type", "seq", ["event_id"]).select("event_id", "seq")


@query("""WITH RECURSIVE c AS (SELECT user_id AS u, event_id AS w, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r(u, i, w, held, until) AS (SELECT u, i, w, true, t + 20000.0::DOUBLE FROM c WHERE i = 1 UNION ALL SELECT c.u, c.i, c.w, c.t >= r.until, CASE WHEN c.t >= r.until THEN c.t + 20000.0::DOUBLE ELSE r.until END FROM r JOIN c ON c.u = r.u AND c.i = r.i + 1)
    SELECT u AS user_id, CAST(w AS VARCHAR) AS event_id, held FROM r""")
def lease_claims(spark: SparkSession, d: str) -> DataFrame:
    return records.leases(_t(spark, d, "events"), "user_id", "ts", ["event_id"], "event_id", 20_000.0)


@query("""WITH b AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS l FROM lineitem GROUP BY 1) SELECT k AS l_orderkey, CAST(len(l) AS INT) AS total, CAST(p + 1 AS INT) AS position, CAST(l[p + 2] AS VARCHAR) AS item FROM b, (VALUES (0), (1)) t(p) WHERE p + 2 <= len(l)""")
def json_page(spark: SparkSession, d: str) -> DataFrame:
    lists = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("items"))
    bodies = lists.select("l_orderkey", F.to_json(F.struct(F.struct("items").alias("a"))).alias("body"))
    return records.json_page(bodies, "l_orderkey", "body", "$.a.items", 1, 2)


@query("""WITH c AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS s, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS lo, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 THEN 3000.0::DOUBLE END AS hi FROM supplier), t AS (SELECT s FROM c GROUP BY s HAVING count(*) > 1)
    SELECT k AS s_suppkey, 'UNKNOWN_STAGE' AS problem FROM c WHERE s NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2) UNION ALL SELECT k, 'EMPTY_WINDOW' FROM c WHERE lo > hi UNION ALL SELECT k, 'NO_BOUND' FROM c WHERE lo IS NULL AND hi IS NULL UNION ALL SELECT k, 'STAGE_TWICE' FROM c WHERE s IN (SELECT s FROM t)""")
def plan_contradictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    config = _t(spark, d, "supplier").select(k, F.concat(F.lit("n"), "s_nationkey").alias("stage"), F.when(k % 5 > 0, F.col("s_acctbal")).alias("low"), F.when((k % 3 > 0) & (k % 5 > 0), F.lit(3000.0)).alias("high"))
    known = _t(spark, d, "nation").filter("n_regionkey <> 2").select(F.concat(F.lit("n"), "n_nationkey").alias("stage"))
    return records.contradictions(config, known, "s_suppkey", "stage", "low", "high")


@query("""WITH d AS (SELECT 0 AS n, 'size' AS s, CASE WHEN p_size < 5 THEN 1 WHEN p_size > 45 THEN 2 ELSE 0 END AS r FROM part UNION ALL SELECT 1, 'price', CASE WHEN p_retailprice < 950 THEN 1 WHEN p_retailprice > 1500 THEN 2 ELSE 0 END FROM part)
    SELECT n AS stage_no, s AS stage_id, count(*) AS entering, count(*) FILTER (r = 0) AS passed, count(*) FILTER (r > 0) AS rejected, CAST(0 AS BIGINT) AS warned, count(DISTINCT r) AS reasons FROM d GROUP BY n, s""")
def run_trace(spark: SparkSession, d: str) -> DataFrame:
    parts, rows = _t(spark, d, "part"), None
    for name, column, bounds in (("size", "p_size", gates.Bounds(5, 45)), ("price", "p_retailprice", gates.Bounds(950, 1500))):
        judged = parts.withColumn("reason_code", gates.verdict(F.col(column), bounds, name.upper())).withColumn("passed", F.col("reason_code") == f"{name.upper()}_PASS")
        one = gates.decisions(judged, "p_partkey", name)
        rows = one if rows is None else rows.unionByName(one)
    return records.run_trace(rows, ["size", "price"])
