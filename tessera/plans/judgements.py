"""Registered queries of judgements: panels, calibration, audits, councils, admission, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, judgement, stats
from .registry import query
from .registry import table as _t

_HEADING = "CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linenumber % 2 = 1) THEN 'LOWER_STRONGER' ELSE 'HIGHER_STRONGER' END"
_PANEL_SQL = f"""p AS (SELECT p_partkey AS k, p_size <= 25 AS a FROM part WHERE p_partkey % 10 = 0), s AS (SELECT l_returnflag AS e, l_partkey AS k, l_extendedprice AS v, {_HEADING} AS d FROM lineitem)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    heading = F.when((F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 1)), judgement.LOWER).otherwise(judgement.HIGHER)
    return _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_partkey").alias("parent"), F.col("l_extendedprice").alias("score"), heading.alias("direction"))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("parent"), (F.col("p_size") <= 25).alias("active"))


@query(f"""WITH {_PANEL_SQL}, j AS (SELECT e, k, a, min(CASE WHEN d = 'HIGHER_STRONGER' THEN -v ELSE v END) AS b FROM s JOIN p USING (k) GROUP BY e, k, a),
    h AS (SELECT e, CASE WHEN min(d) = max(d) THEN min(d) ELSE 'MIXED' END AS direction FROM s JOIN p USING (k) GROUP BY e),
    m AS (SELECT e, count(*) FILTER (a) AS actives, count(*) FILTER (NOT a) AS inactives, min(b) FILTER (a) AS ba, median(b) FILTER (a) AS ma, max(b) FILTER (a) AS wa, min(b) FILTER (NOT a) AS bi FROM j GROUP BY e),
    c AS (SELECT j.e, count(*) FILTER (NOT a AND b <= ba) AS above, count(*) FILTER (a AND b >= bi) AS below FROM j JOIN m USING (e) GROUP BY j.e), f AS (SELECT *, CASE direction WHEN 'HIGHER_STRONGER' THEN -1 WHEN 'LOWER_STRONGER' THEN 1 END AS g FROM m JOIN c USING (e) JOIN h USING (e))
    SELECT e AS engine, direction, actives, inactives, g * ba AS best_active, g * ma AS median_active, g * wa AS worst_active, g * bi AS best_inactive, CASE WHEN g IS NOT NULL THEN above END AS inactives_above_best_active, CASE WHEN g IS NOT NULL THEN below END AS actives_below_best_inactive FROM f""")
def panel_separation(spark: SparkSession, d: str) -> DataFrame:
    return judgement.panel_separation(_scores(spark, d), _panel(spark, d), "engine", "parent", "score", "direction", "active")


@query(f"""WITH {_PANEL_SQL}, b AS (SELECT e, k, min(CASE WHEN d = 'HIGHER_STRONGER' THEN -v ELSE v END) AS b FROM s WHERE e <> 'R' GROUP BY e, k)
    SELECT x.e AS engine, x.k AS parent, (SELECT count(*) FROM b y WHERE y.e = x.e AND y.b <= x.b) / (SELECT count(*) FROM b y WHERE y.e = x.e) AS percentile FROM b x JOIN p USING (k)""")
def panel_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return judgement.panel_enrichment(_scores(spark, d), _panel(spark, d), "engine", "parent", "score", "direction")


_REJECTS_SQL = "r AS (SELECT p_partkey AS k, 0 AS t FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_retailprice >= 1500 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_type = 'PROMO')"


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    tests = {"size": F.col("p_size") > 40, "price": F.col("p_retailprice") >= 1500, "type": F.col("p_type") == "PROMO"}
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("tier")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("parent"), each)


@query(f"""WITH {_PANEL_SQL}, {_REJECTS_SQL}, f AS (SELECT k, min(t) AS t FROM r GROUP BY k), l AS (SELECT t, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM f JOIN p USING (k) GROUP BY t)
    SELECT n AS tier_no, tier, coalesce(x, 0) AS lost_actives, coalesce(y, 0) AS lost_inactives, coalesce(x, 0) > 0 AS deletes_actives FROM (VALUES (0, 'size'), (1, 'price'), (2, 'type')) q(n, tier) LEFT JOIN l ON t = n""")
def tier_losses(spark: SparkSession, d: str) -> DataFrame:
    return judgement.tier_losses(_panel(spark, d), _rejects(spark, d), ["size", "price", "type"], "parent", "active")


@query(f"""WITH {_PANEL_SQL}, {_REJECTS_SQL}, c AS (SELECT count(*) AS members, count(*) FILTER (a) AS actives, count(*) FILTER (k NOT IN (SELECT p_partkey FROM part)) AS absent, count(*) FILTER (a AND k NOT IN (SELECT k FROM r)) / count(*) FILTER (a) AS recall FROM p)
    SELECT members, actives, absent, recall, recall >= 0.95 AS admissible, CASE WHEN recall < 0.95 THEN 'RECALL_BELOW_REQUIRED' END AS refusal FROM c""")
def gate_calibration(spark: SparkSession, d: str) -> DataFrame:
    screened = _t(spark, d, "part").select(F.col("p_partkey").alias("parent"))
    return judgement.gate_calibration(_panel(spark, d), _rejects(spark, d), screened, "parent", "active", 0.95)


_AUC2 = "(SELECT (rs - p * (p + 1) / 2) / (p * n) AS a, p, n FROM (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n, sum(r) FILTER (y) AS rs FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT {} AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)))))"
_SE = "sqrt(greatest(0, (a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)))"


@query(f"""WITH b AS (SELECT a, {_SE} AS s FROM {_AUC2.format('n_chars')}), c AS (SELECT a, {_SE} AS s FROM {_AUC2.format("length(text) - length(replace(text, '#', ''))")}), e AS (SELECT c.a - b.a AS delta, b.s + c.s AS bound FROM b, c)
    SELECT delta, bound, CASE WHEN delta < 0 AND delta <= -bound THEN 'WORSE' WHEN delta <= 0 OR delta < bound THEN 'WITHIN_NOISE' ELSE 'ACCEPTED' END AS verdict FROM e""")
def change_of_auc(spark: SparkSession, d: str) -> DataFrame:
    marks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("#"), F.lit("")))
    rows = _t(spark, d, "documents").select("doc_id", "n_chars", marks.alias("marks")).join(_t(spark, d, "labels"), "doc_id")
    return judgement.change_of_auc(stats.auc(rows, "n_chars", F.col("quality") == 1), stats.auc(rows, "marks", F.col("quality") == 1))


_FOLD = "CAST(('0x' || substr(md5('f:' || p_brand), 1, 8))::BIGINT % 4 AS INT)"


@query(f"SELECT p_brand, {_FOLD} AS fold, count(*) AS n FROM part GROUP BY p_brand")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy("p_brand", judgement.group_fold(F.col("p_brand"), 4, "f").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT p_partkey, {_FOLD} AS f, p_size AS x, p_retailprice AS y FROM part), g AS (SELECT f, regr_slope(b.y, b.x) AS s, regr_intercept(b.y, b.x) AS i FROM (SELECT DISTINCT f FROM r) a JOIN (SELECT f AS g, x, y FROM r) b ON a.f <> b.g GROUP BY f)
    SELECT p_partkey, round(i + s * x, 6) AS predicted FROM r JOIN g USING (f)""")
def cross_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("fold", judgement.group_fold(F.col("p_brand"), 4, "f"))
    return judgement.cross_fit(rows, "fold", "p_size", "p_retailprice").select("p_partkey", F.round("predicted", 6).alias("predicted"))


_WILSON = "CASE WHEN h = 0 THEN 0.0 ELSE greatest(0, (h / n + {z2} / 2 / n - {z} * sqrt(h / n * (1 - h / n) / n + {z2} / 4 / n / n)) / (1 + {z2} / n)) END AS lo, CASE WHEN h = n THEN 1.0 ELSE least(1, (h / n + {z2} / 2 / n + {z} * sqrt(h / n * (1 - h / n) / n + {z2} / 4 / n / n)) / (1 + {z2} / n)) END AS hi".format(z=stats.Z95, z2=stats.Z95**2)
_YIELD_SQL = f"y AS (SELECT m, s, h, n, h / n AS r, {_WILSON} FROM (SELECT event_type AS m, 0 AS s, count(*) FILTER (value >= 20) AS h, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, 1, count(*) FILTER (value >= 60 AND user_id % 5 <> length(event_type) % 5), count(*) FROM events GROUP BY 1))"


def _yields(spark: SparkSession, d: str) -> DataFrame:
    hits = F.explode(F.array(F.struct(F.lit("unique").alias("stage"), F.col("u").alias("hits")), F.struct(F.lit("gated").alias("stage"), F.col("g").alias("hits")))).alias("x")
    gated = (F.col("value") >= 60) & (F.col("user_id") % 5 != F.length("event_type") % 5)
    return _t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 20).alias("u"), F.count_if(gated).alias("g"), F.count(F.lit(1)).alias("trials")).select("event_type", "trials", hits).select("event_type", "x.stage", "x.hits", "trials")


@query(f"WITH {_YIELD_SQL} SELECT a.s AS stage_no, CASE a.s WHEN 0 THEN 'unique' ELSE 'gated' END AS stage, a.m AS left_model, b.m AS right_model, a.r AS left_rate, b.r AS right_rate, a.lo > b.hi OR b.lo > a.hi AS decidable FROM y a JOIN y b ON a.s = b.s AND a.m < b.m")
def generator_audit(spark: SparkSession, d: str) -> DataFrame:
    return judgement.generator_audit(_yields(spark, d), "event_type", ["unique", "gated"])


@query(f"WITH {_YIELD_SQL} SELECT CASE max(a.s) WHEN 0 THEN 'unique' WHEN 1 THEN 'gated' END AS stage FROM y a JOIN y b ON a.s = b.s AND a.m < b.m WHERE a.lo > b.hi OR b.lo > a.hi")
def deepest_decidable(spark: SparkSession, d: str) -> DataFrame:
    return judgement.deepest_decidable(judgement.generator_audit(_yields(spark, d), "event_type", ["unique", "gated"]))


_VOTE = "CASE WHEN x = 4 THEN 'abstain' WHEN x < 2 THEN 'refuse' ELSE 'clear' END"
_COUNCIL_SQL = f"""v AS (SELECT p_partkey AS r, p_size <= 20 AS t, s, {_VOTE} AS v FROM (SELECT p_partkey, p_size, unnest(['a', 'b', 'c']) AS s, unnest([CASE WHEN p_size <= 20 THEN p_partkey % 3 ELSE 1 + p_partkey % 3 END, CASE WHEN p_size <= 22 THEN p_partkey % 4 ELSE 1 + p_partkey % 4 END, p_partkey % 5]) AS x FROM part))"""
_SKILL_SQL = f"""k AS (SELECT s, answered, abstained, tp / (tp + fn) + tn / (tn + fp) - 1 AS youden, (SELECT lo FROM (SELECT {_WILSON} FROM (SELECT tp AS h, tp + fn AS n))) + (SELECT lo FROM (SELECT {_WILSON} FROM (SELECT tn AS h, tn + fp AS n))) - 1 AS low
    FROM (SELECT s, count(*) FILTER (v <> 'abstain') AS answered, count(*) FILTER (v = 'abstain') AS abstained, count(*) FILTER (v = 'refuse' AND t) AS tp, count(*) FILTER (v = 'refuse' AND NOT t) AS fp, count(*) FILTER (v = 'clear' AND NOT t) AS tn, count(*) FILTER (v = 'clear' AND t) AS fn FROM v GROUP BY s))"""
_KAPPA_SQL = """q AS (SELECT a.s AS l, b.s AS r, a.v AS x, b.v AS y FROM v a JOIN v b ON a.r = b.r AND a.s < b.s), w AS (SELECT l, r, count(*) AS n, avg(CAST(x = y AS INT)) AS po FROM q GROUP BY l, r),
    z AS (SELECT w.l, w.r, (po - pe) / (1 - pe) AS kappa FROM w JOIN (SELECT l, r, sum(cx * cy) / power(max(n), 2) AS pe FROM (SELECT l, r, c, count(*) FILTER (x = c) AS cx, count(*) FILTER (y = c) AS cy, count(*) AS n FROM q, (VALUES ('refuse'), ('clear'), ('abstain')) u(c) GROUP BY l, r, c) GROUP BY l, r) USING (l, r))"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    seats = {"a": F.when(size <= 20, k % 3).otherwise(1 + k % 3), "b": F.when(size <= 22, k % 4).otherwise(1 + k % 4), "c": k % 5}
    word = lambda x: F.when(x == 4, "abstain").when(x < 2, "refuse").otherwise("clear")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seat"), word(x).alias("vote")) for s, x in seats.items()])).alias("x")
    return _t(spark, d, "part").select("p_partkey", (size <= 20).alias("truth"), each).select("p_partkey", "truth", "x.seat", "x.vote")


@query(f"WITH {_COUNCIL_SQL}, {_SKILL_SQL} SELECT s AS seat, answered, abstained, youden, low AS youden_low FROM k")
def seat_skills(spark: SparkSession, d: str) -> DataFrame:
    return judgement.seat_skills(_votes(spark, d), "p_partkey", "seat", "vote", "truth")


@query(f"WITH {_COUNCIL_SQL}, {_KAPPA_SQL} SELECT l AS left_seat, r AS right_seat, kappa FROM z")
def pairwise_kappa(spark: SparkSession, d: str) -> DataFrame:
    return judgement.pairwise_kappa(_votes(spark, d), "p_partkey", "seat", "vote")


@query(f"""WITH {_COUNCIL_SQL}, {_SKILL_SQL}, {_KAPPA_SQL}, o AS (SELECT (SELECT count(DISTINCT r) FROM v) AS labels, count(*) AS seats, min(low) AS worst_low, (SELECT avg(kappa) FROM z) AS mean_kappa FROM k)
    SELECT labels, seats, worst_low, mean_kappa, CASE WHEN mean_kappa <= 0 THEN seats ELSE seats / (1 + (seats - 1) * mean_kappa) END AS effective_votes, labels >= 30 AND worst_low > 0 AS qualified,
    CASE WHEN labels < 30 THEN 'TOO_FEW_LABELS' WHEN worst_low <= 0 THEN 'SEAT_AT_CHANCE' END AS refusal FROM o""")
def council_ruling(spark: SparkSession, d: str) -> DataFrame:
    return judgement.council_ruling(_votes(spark, d), "p_partkey", "seat", "vote", "truth", 30)


@query("""WITH i AS (SELECT DISTINCT n_nationkey AS s, unnest([n_regionkey, n_nationkey % 3 + 10, n_nationkey // 7 + 20]) AS i FROM nation), c AS (SELECT s, count(*) AS n FROM i GROUP BY s), j AS (SELECT a.s AS l, b.s AS r, count(*) AS k FROM i a JOIN i b ON a.i = b.i AND a.s < b.s GROUP BY a.s, b.s)
    SELECT l AS left_seat, r AS right_seat, k AS shared, CASE WHEN k = x.n AND k = y.n THEN 'IDENTICAL' ELSE 'PARTIAL' END AS relation FROM j JOIN c x ON x.s = l JOIN c y ON y.s = r""")
def scope_overlaps(spark: SparkSession, d: str) -> DataFrame:
    scope = F.array(F.col("n_regionkey").cast("bigint"), (F.col("n_nationkey") % 3 + 10).cast("bigint"), F.floor(F.col("n_nationkey") / 7) + 20)
    return judgement.scope_overlaps(_t(spark, d, "nation").select("n_nationkey", scope.alias("scope")), "n_nationkey", "scope")


_TAXONOMY = [("F_A", "WRONG_SUBJECT"), ("F_B", "WRONG_SIZE"), ("F_C", "UNVERIFIABLE"), ("F_D", "WRONG_SUBJECT")]
_OBSERVED_SQL = """o AS (SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'F_A' WHEN 1 THEN 'F_B' WHEN 2 THEN 'F_C' ELSE 'F_D' END AS c, l_quantity > 40 AS f, l_returnflag <> 'N' AS e FROM lineitem),
    q AS (SELECT k, c, CASE WHEN NOT e THEN 'UNCHECKED' WHEN NOT f THEN 'CLEAR' WHEN c = 'F_C' THEN 'UNVERIFIABLE' WHEN c = 'F_B' THEN 'BOUNDED' WHEN c = 'F_D' THEN 'WAIVED' ELSE 'BLOCKING' END AS part FROM o)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    code = F.when(n == 0, "F_A").when(n == 1, "F_B").when(n == 2, "F_C").otherwise("F_D")
    rows = _t(spark, d, "lineitem").select("l_orderkey", code.alias("code"), (F.col("l_quantity") > 40).alias("fired"), (F.col("l_returnflag") != "N").alias("evaluable"))
    return judgement.partition_observations(rows, spark.createDataFrame(_TAXONOMY, "code string, consequence string"), ["F_D"])


@query(f"WITH {_OBSERVED_SQL} SELECT c AS code, part, count(*) AS n FROM q GROUP BY c, part")
def observation_parts(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).groupBy("code", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_OBSERVED_SQL}, g AS (SELECT k, list(c) FILTER (part = 'BLOCKING') AS b, count(*) FILTER (part = 'WAIVED') AS w, count(*) FILTER (part = 'UNCHECKED') AS u, count(*) FILTER (part = 'UNVERIFIABLE') AS v FROM q GROUP BY k),
    m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS x, CASE WHEN o_orderkey % 13 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS c FROM orders),
    t AS (SELECT o_orderkey, list_sort(coalesce(b, []) || CASE WHEN isnan(c) THEN ['NONFINITE_CHEAP_VALUE'] ELSE [] END || CASE WHEN x IS NULL THEN ['NO_EXPENSIVE_VALUE'] ELSE [] END) AS b, coalesce(w, 0) AS w, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM m LEFT JOIN g ON k = o_orderkey)
    SELECT o_orderkey, array_to_string(b, ',') AS blocking, w AS waived, u AS unchecked, CASE WHEN len(b) > 0 THEN 'WITHHELD' WHEN w > 0 THEN 'ADMITTED_UNDER_WAIVER' ELSE 'ADMITTED' END AS admission, v = 0 AS reproducible FROM t""")
def admissibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(k, F.when(k % 17 != 0, F.col("o_totalprice")).alias("expensive"), F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("cheap"))
    return judgement.admissibility(rows, _parts(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "expensive", "cheap")


def _handoffs(spark: SparkSession, d: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    return _t(spark, d, "part").select(
        "p_partkey", F.when(n % 7 != 0, "OK").alias("status"), F.when(size < 10, "TWO_D_DEPICTION").when(size < 40, "DOCKED_POSE").otherwise("CONFORMER").alias("coordinate_source"),
        F.when(n % 3 == 0, "EXPLICIT").when(n % 3 == 1, "IMPLICIT").alias("hydrogens"), F.when(n % 5 > 0, F.concat(F.lit("sha256:"), (n % 5).cast("string"))).alias("receptor_id"),
        F.when(n % 4 == 0, "UNDECIDED").otherwise("P1").alias("protonation"), F.when(n % 6 > 0, F.col("p_type")).alias("stereo"), F.when(size % 2 == 0, F.col("p_type")).otherwise("X").alias("parent"),
    )


@query("""WITH h AS (SELECT p_partkey AS k, p_partkey % 7 <> 0 AS ok, p_size < 10 AS flat, p_size BETWEEN 10 AND 39 AS pose, p_partkey % 3 = 0 AS hyd, p_partkey % 5 AS r, p_partkey % 4 = 0 AS und, p_partkey % 6 > 0 AS st, p_size % 2 = 0 OR p_type = 'X' AS same FROM part),
    c AS (SELECT k, unnest(['F_STRUCTURE_UNREADABLE', 'F_COORDINATES_ARE_A_DEPICTION', 'F_HYDROGENS_IMPLICIT', 'F_POSE_WITHOUT_RECEPTOR', 'F_RECEPTOR_NOT_THE_ONE_SCORED', 'F_PROTONATION_UNDECIDED', 'F_STEREO_CHOSEN_BY_EMBEDDING', 'F_RUN_NOT_REPRODUCIBLE', 'F_FEP_MAPPING_DEGENERATE']) AS code,
    unnest([NOT ok, flat, NOT hyd, pose AND r = 0, pose AND r NOT IN (0, 2), und, st AND NOT same, false, false]) AS fired, unnest([true, true, true, true, NOT pose OR r > 0, true, st, true, false]) AS evaluable FROM h) SELECT code, count(*) FILTER (fired) AS fired, count(*) FILTER (evaluable) AS evaluable, count(*) AS n FROM c GROUP BY code""")
def preflight_checks(spark: SparkSession, d: str) -> DataFrame:
    out = judgement.preflight(_handoffs(spark, d), "p_partkey", "2", True)
    return out.groupBy("code").agg(F.count_if("fired").alias("fired"), F.count_if("evaluable").alias("evaluable"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'F_HANDOFF_ABSENT' AS code, count(*) AS expected, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)) AS missing, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)) > 0 AS fired FROM part")
def missing_records(spark: SparkSession, d: str) -> DataFrame:
    records = _t(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return judgement.missing_records(_t(spark, d, "part"), records, "p_partkey")


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, 'F_LARGE' AS code, k > 80 AS fired, true AS evaluable FROM e UNION ALL SELECT event_id, 'F_SEED', false, false FROM e""")
def postflight_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = {"F_LARGE": ("$.k", F.col("value").cast("int") > 80), "F_SEED": ("$.seed", F.col("value") == "clock")}
    return judgement.postflight(_t(spark, d, "events"), "event_id", "props", checks)


_RULES = [("A", 2, "REJECT", 100), ("N", 4, "WARN", 20), ("R", 5, "REJECT", 40)]


@query("""WITH m AS (SELECT l_partkey AS k, l_returnflag AS rule, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2), r(rule, mx, act, dem) AS (VALUES ('A', 2, 'REJECT', 100), ('N', 4, 'WARN', 20), ('R', 5, 'REJECT', 40)),
    a AS (SELECT k, count(*) AS a, sum(dem) AS d, count(*) FILTER (act = 'REJECT') AS r FROM m JOIN r USING (rule) WHERE n > mx GROUP BY k) SELECT p_partkey, coalesce(a, 0) AS n_alerts, CAST(coalesce(d, 0) AS BIGINT) AS n_demerits, CASE WHEN coalesce(r, 0) > 0 THEN 'ALERT_REJECT' WHEN coalesce(a, 0) > 0 THEN 'ALERT_WARN' ELSE 'ALERT_PASS' END AS reason_code, coalesce(r, 0) = 0 AS passed FROM part LEFT JOIN a ON k = p_partkey""")
def alert_gate(spark: SparkSession, d: str) -> DataFrame:
    matches = _t(spark, d, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return judgement.alert_gate(_t(spark, d, "part"), matches, spark.createDataFrame(_RULES, "rule string, max_count int, action string, demerit int"), "p_partkey")


@query("SELECT p_partkey, coalesce(w, 0) AS worst, coalesce(w, 0) <= 5 AS passed FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS w FROM lineitem WHERE l_tax > 0.06 GROUP BY 1) ON l_partkey = p_partkey")
def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    findings = _t(spark, d, "lineitem").filter("l_tax > 0.06").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    return judgement.severity_gate(_t(spark, d, "part"), findings, "p_partkey", "l_linenumber", 5)


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'SMALL' END, CASE WHEN p_type = 'PROMO' THEN 'PROMO' END, CASE WHEN p_retailprice > 1800 THEN 'DEAR' END) AS reasons, NOT (p_size < 5 OR p_type = 'PROMO' OR p_retailprice > 1800) AS passed FROM part")
def handoff_refusals(spark: SparkSession, d: str) -> DataFrame:
    return judgement.refusals(_t(spark, d, "part"), "p_partkey", {"SMALL": F.col("p_size") < 5, "PROMO": F.col("p_type") == "PROMO", "DEAR": F.col("p_retailprice") > 1800})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def reconciliation_counts(spark: SparkSession, d: str) -> DataFrame:
    return judgement.status_counts(_t(spark, d, "orders"), "o_orderstatus")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'SYNTHESIS_BELOW_MINIMUM' WHEN p_size > 30 THEN 'SYNTHESIS_ABOVE_MAXIMUM' ELSE 'SYNTHESIS_PASS' END AS reason_code FROM part")
def synthesis_gate(spark: SparkSession, d: str) -> DataFrame:
    scores = judgement.one_direction(_t(spark, d, "part").select("p_partkey", F.col("p_size").alias("score"), F.lit("LOWER").alias("direction")), "direction")
    return gates.numeric_gate(_t(spark, d, "part").select("p_partkey"), scores, "p_partkey", "score", gates.Bounds(5, 30), "SYNTHESIS").select("p_partkey", "reason_code")


@query("""WITH b AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality = 1 AS g FROM documents JOIN labels USING (doc_id)), c AS (SELECT v, count(*) FILTER (g) AS g, count(*) FILTER (NOT g) AS b FROM b GROUP BY v),
    r AS (SELECT v, sum(g) OVER (ORDER BY v) + sum(b) OVER () - sum(b) OVER (ORDER BY v) AS c, sum(g + b) OVER () AS n FROM c) SELECT v AS threshold, CAST(c AS BIGINT) AS correct, CAST(n AS BIGINT) AS n FROM r ORDER BY c DESC, v LIMIT 1""")
def branch_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return judgement.branch_rule(rows, "n_chars", F.col("quality") == 1)


@query("SELECT avg(o_totalprice) AS mean_x, stddev_pop(o_totalprice) AS std_x, avg(o_custkey) AS mean_y, stddev_pop(o_custkey) AS std_y, count(*) AS pairs, corr(o_totalprice, o_custkey) * count(*) / (count(*) + 3) AS shrunk FROM orders")
def paired_moments(spark: SparkSession, d: str) -> DataFrame:
    return judgement.paired_moments(_t(spark, d, "orders"), "o_totalprice", "o_custkey")
