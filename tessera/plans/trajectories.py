"""Registered queries of trajectory analytics: order lines stand for atoms of frames, events for series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series, trajectory
from .registry import query
from .registry import table as _t

_ATOMS = "a AS (SELECT l_orderkey AS f, l_linenumber AS k, l_returnflag AS e, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"
_PAIRS = f"{_ATOMS}, p AS (SELECT l.f, l.k AS i, r.k AS j, l.e AS le, r.e AS re, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) AS d FROM a l JOIN a r ON l.f = r.f WHERE l.k <= 2 AND r.k > 2)"


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("atom"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    a = _atoms(spark, d)
    return trajectory.contacts(a.filter("atom <= 2"), a.filter("atom > 2"), "frame", "atom", 8.0)


@query(f"WITH {_PAIRS} SELECT f AS frame, i AS ligand_atom, j AS receptor_atom, round(d, 9) AS distance FROM p WHERE d < 8")
def contact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _contacts(spark, d).withColumn("distance", F.round("distance", 9))


@query(f"WITH {_PAIRS}, c AS (SELECT f, count(*) AS n, min(d) AS m FROM p WHERE d < 8 GROUP BY f) SELECT q.f AS frame, coalesce(n, 0) AS n, round(m, 9) AS closest FROM (SELECT DISTINCT f FROM a) q LEFT JOIN c ON c.f = q.f")
def contact_series(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.contact_series(_contacts(spark, d), "frame", _atoms(spark, d)).withColumn("closest", F.round("closest", 9))


@query(f"WITH {_PAIRS}, c AS (SELECT j, f, min(d) AS m FROM p WHERE d < 8 GROUP BY j, f) SELECT j AS receptor_atom, count(*) AS frames, count(*) / 1000 AS proportion, avg(m) AS mean_distance FROM c GROUP BY j")
def contact_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.contact_frequencies(_contacts(spark, d), "frame", "receptor_atom", 1000)


@query("""WITH p AS (SELECT event_id // 100 AS f, user_id % 20 AS i FROM events), s AS (SELECT DISTINCT i FROM p WHERE f = 0) SELECT f AS frame, count(DISTINCT i) FILTER (i IN (SELECT i FROM s)) / (SELECT count(*) FROM s) AS retained FROM p GROUP BY f""")
def initial_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("frame"), (F.col("user_id") % 20).alias("item"))
    return trajectory.initial_retention(rows, "frame", "item", 0, rows)


@query("SELECT l_partkey, count(DISTINCT l_orderkey) / 100 AS frequency, avg(l_quantity) AS mean_length, avg(l_discount * 1800) AS mean_angle FROM lineitem WHERE l_quantity < 20 AND l_discount * 1800 > 90 GROUP BY 1")
def hydrogen_bonds(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.hydrogen_bonds(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_quantity"), F.col("l_discount") * 1800, 20.0, 90.0, 100)


@query("SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity < 20 AND l_tax > 0.03) AS held, count(*) FILTER (l_quantity >= 20) AS distance_lost, count(*) FILTER (l_quantity < 20 AND l_tax <= 0.03) AS angle_lost, coalesce(min(l_orderkey) FILTER (l_quantity < 20 AND l_tax > 0.03) > 500, false) AS late_start FROM lineitem GROUP BY 1")
def contact_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.diagnose_direction(_t(spark, d, "lineitem"), "l_partkey", "l_orderkey", F.col("l_quantity"), F.col("l_tax"), 20.0, 0.03, 500)


_KINDS = "CASE i WHEN 1 THEN 'A' ELSE 'R' END AS le, CASE WHEN j % 2 = 1 THEN 'N' ELSE 'A' END AS re"


@query(f"WITH {_PAIRS}, k AS (SELECT f, i, j, d, {_KINDS} FROM p WHERE d < 9) SELECT f AS frame, i, j, CASE WHEN le = 'R' THEN 'IONIC' WHEN d <= 4 THEN 'HYDROGEN' ELSE 'HYDROPHOBIC' END AS type FROM k WHERE (le = 'A' AND re = 'N' AND d <= 8) OR (le = 'R' AND re = 'A' AND d <= 6)")
def interaction_types(spark: SparkSession, d: str) -> DataFrame:
    a = _atoms(spark, d)
    near = trajectory.contacts(a.filter("atom <= 2"), a.filter("atom > 2"), "frame", "atom", 9.0)
    kinds = near.select("frame", F.col("ligand_atom").alias("i"), F.col("receptor_atom").alias("j"), "distance", F.when(F.col("ligand_atom") == 1, "A").otherwise("R").alias("le"), F.when(F.col("receptor_atom") % 2 == 1, "N").otherwise("A").alias("re"))
    rules = spark.createDataFrame([("A", "N", 4.0, "HYDROGEN"), ("A", "N", 8.0, "HYDROPHOBIC"), ("R", "A", 6.0, "IONIC")], "left string, right string, longest double, type string")
    return trajectory.interaction_types(kinds, rules, "le", "re").select("frame", "i", "j", "type")


_DIHEDRAL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) >= 12), q AS (SELECT vec_id, e[4] - e[1] AS px, e[5] - e[2] AS py, e[6] - e[3] AS pz, e[7] - e[4] AS qx, e[8] - e[5] AS qy, e[9] - e[6] AS qz, e[10] - e[7] AS rx, e[11] - e[8] AS ry, e[12] - e[9] AS rz FROM v),
    c AS (SELECT *, py * qz - pz * qy AS nx, pz * qx - px * qz AS ny, px * qy - py * qx AS nz, qy * rz - qz * ry AS mx, qz * rx - qx * rz AS my, qx * ry - qy * rx AS mz FROM q),
    g AS (SELECT vec_id, degrees(atan2((px * mx + py * my + pz * mz) * sqrt(qx * qx + qy * qy + qz * qz), nx * mx + ny * my + nz * mz)) AS phi FROM c)"""


def _dihedrals(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    point = lambda i: [e[3 * i + j].cast("double") for j in range(3)]
    return _t(spark, d, "embeddings").filter(F.size("embedding") >= 12).select("vec_id", trajectory.dihedral(*map(point, range(4))).alias("phi"))


@query(f"{_DIHEDRAL} SELECT vec_id, round(phi, 6) AS phi FROM g")
def dihedrals(spark: SparkSession, d: str) -> DataFrame:
    return _dihedrals(spark, d).withColumn("phi", F.round("phi", 6))


@query(f"{_DIHEDRAL} SELECT CASE WHEN phi BETWEEN -160 AND -20 AND -phi / 2 BETWEEN -120 AND 50 THEN 'ALPHA_R' WHEN phi < -20 AND (-phi / 2 > 50 OR -phi / 2 < -120) THEN 'BETA' WHEN phi > 20 AND phi < 120 AND -phi / 2 BETWEEN -60 AND 90 THEN 'ALPHA_L' ELSE 'OTHER' END AS region, count(*) AS n FROM g GROUP BY 1")
def ramachandran_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = _dihedrals(spark, d).filter("phi is not null")
    return rows.groupBy(trajectory.ramachandran(F.col("phi"), -F.col("phi") / 2).alias("region")).agg(F.count(F.lit(1)).alias("n"))


_REFERENCE = "r AS (SELECT k, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY k)"


@query(f"WITH {_ATOMS}, {_REFERENCE} SELECT f AS frame, count(*) AS n, sqrt(avg((a.x - r.x) ** 2 + (a.y - r.y) ** 2 + (a.z - r.z) ** 2)) AS rmsd FROM a JOIN r USING (k) GROUP BY f")
def rmsd_series(spark: SparkSession, d: str) -> DataFrame:
    a = _atoms(spark, d)
    return trajectory.rmsd(a, a.groupBy("atom").agg(*[F.avg(c).alias(c) for c in trajectory.XYZ]), "frame", "atom")


@query(f"WITH {_ATOMS} SELECT k AS atom, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf FROM a GROUP BY k")
def rmsf(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.rmsf(_atoms(spark, d), "atom")


@query(f"WITH {_ATOMS}, c AS (SELECT f, sum(k * x) / sum(k) AS cx, sum(k * y) / sum(k) AS cy, sum(k * z) / sum(k) AS cz FROM a GROUP BY f) SELECT f AS frame, round(sqrt(sum(k * ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(k)), 4) AS radius FROM a JOIN c USING (f) GROUP BY f")
def gyration_radius(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.gyration(_atoms(spark, d), "frame", F.col("atom").cast("double")).withColumn("radius", F.round("radius", 4))


@query(f"WITH {_ATOMS}, u AS (SELECT DISTINCT * EXCLUDE (e) FROM a), m AS (SELECT f, min((k, x, y, z)) AS p, max((k, x, y, z)) AS q FROM u GROUP BY f) SELECT f AS frame, sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) AS length FROM m")
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.end_to_end(_atoms(spark, d), "frame", "atom")


@query("SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def distance_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.distance_statistics(_t(spark, d, "events"), "event_type", "value")


@query("""WITH s AS (SELECT count(*) FILTER (event_type = 'view') AS n, count(*) FILTER (event_type = 'click') AS m, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b, var_samp(value) FILTER (event_type = 'view') AS v, var_samp(value) FILTER (event_type = 'click') AS w FROM events)
    SELECT n AS n_left, m AS n_right, a - b AS difference, (a - b) / sqrt(v / n + w / m) AS t, power(v / n + w / m, 2) / (power(v / n, 2) / (n - 1) + power(w / m, 2) / (m - 1)) AS freedom FROM s""")
def two_sample(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.two_sample(_t(spark, d, "events"), "event_type", "value", "view", "click")


_PROFILE = "p AS (SELECT l_returnflag AS leg, (l_linenumber - 1) / 6.0::DOUBLE AS s, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1, 2)"


def _profile(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("leg"), ((F.col("l_linenumber") - 1) / 6.0).alias("step"), "l_quantity")
    return trajectory.lambda_profile(rows, "leg", "step", "l_quantity")


@query(f"WITH {_PROFILE} SELECT leg, s AS step, n, mean, se AS stderr FROM p")
def lambda_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


_TI = f"{_PROFILE}, w AS (SELECT *, (coalesce(s - lag(s) OVER o, 0) + coalesce(lead(s) OVER o - s, 0)) / 2 AS w FROM p WINDOW o AS (PARTITION BY leg ORDER BY s)), t AS (SELECT leg, sum(w * mean) AS delta, sqrt(sum(w * w * se * se)) AS error FROM w GROUP BY leg)"


@query(f"WITH {_TI} SELECT * FROM t")
def thermodynamic_integration(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.thermodynamic_integration(_profile(spark, d), "leg", "step")


@query(f"WITH {_TI} SELECT b.delta - u.delta AS difference, sqrt(b.error ** 2 + u.error ** 2) AS error FROM t b, t u WHERE b.leg = 'A' AND u.leg = 'N'")
def binding_difference(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.binding_difference(trajectory.thermodynamic_integration(_profile(spark, d), "leg", "step"), "leg", "A", "N")


@query("SELECT user_id, concat_ws(',', CASE WHEN stddev_samp(value) / sqrt(count(*)) > 5 THEN 'STDERR' END, CASE WHEN max(value) > 250 THEN 'ENDPOINT' END, CASE WHEN count(*) < 15 THEN 'SHORT' END) AS flags, NOT (coalesce(stddev_samp(value) / sqrt(count(*)) > 5, false) OR max(value) > 250 OR count(*) < 15) AS ok FROM events GROUP BY 1")
def fep_quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    rows = _t(spark, d, "events").groupBy("user_id").agg((F.stddev_samp("value") / F.sqrt(n)).alias("se"), F.max("value").alias("top"), n.alias("n"))
    return trajectory.quality_flags(rows, "user_id", {"STDERR": F.col("se") > 5, "ENDPOINT": F.col("top") > 250, "SHORT": F.col("n") < 15})


@query("SELECT user_id, avg(value) FILTER (event_type = 'view') AS view, avg(value) FILTER (event_type = 'click') AS click, greatest(avg(value) FILTER (event_type = 'view'), avg(value) FILTER (event_type = 'click')) - least(avg(value) FILTER (event_type = 'view'), avg(value) FILTER (event_type = 'click')) AS spread FROM events GROUP BY 1")
def estimator_comparison(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.compare_estimators(_t(spark, d, "events"), "user_id", "event_type", "value", ["view", "click"])


@query("""WITH r AS (SELECT event_type, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(sqrt(value)) OVER w AS root FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, CAST(ceil(i * 5 / n) AS INT) AS point FROM r)
    SELECT event_type, point, i AS n, round(root, 6) AS root FROM p WHERE i = floor(point * n / 5)""")
def prefix_decomposition(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("root", F.sqrt("value"))
    return trajectory.prefix_points(rows, "event_type", ["ts", "event_id"], ["root"], 5).withColumn("root", F.round("root", 6))


@query("SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS work FROM (SELECT event_id, user_id, coalesce((value + lag(value) OVER w) / 2 * (event_id - lag(event_id) OVER w), 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def pulling_work(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.work(_t(spark, d, "events"), "user_id", ["event_id"], "value", "event_id").select("event_id", F.round("work", 6).alias("work"))


@query("SELECT user_id, count(*) AS n, coalesce(sum(t), 0) AS integral FROM (SELECT user_id, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def trapezoids(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.trapezoid(_t(spark, d, "events"), "user_id", "event_id", "value")


@query("""SELECT l_orderkey % 50 AS pose, l_returnflag, l_linestatus, CASE WHEN l_quantity < 3 THEN 0 WHEN l_quantity < 4 THEN 1 WHEN l_quantity < 5 THEN 2 WHEN l_quantity < 6 THEN 3 WHEN l_quantity < 8 THEN 4 ELSE 5 END AS shell, count(*) AS n FROM lineitem WHERE l_quantity >= 2 AND l_quantity < 12 GROUP BY ALL""")
def shell_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("pose"), "l_returnflag", "l_linestatus", F.col("l_quantity").alias("distance"))
    return trajectory.shell_counts(rows, "pose", "l_returnflag", "l_linestatus", [2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0])


@query("SELECT p_partkey, CAST(m AS INT) AS mask, CASE WHEN m % 2 = 1 THEN p_retailprice ELSE 0 END + CASE WHEN m // 2 % 2 = 1 THEN p_size ELSE 1 END AS total FROM part, (SELECT unnest(range(4)) AS m)")
def factorial_masks(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.factorial_masks(_t(spark, d, "part"), "p_partkey", {"price": (F.col("p_retailprice"), F.lit(0.0)), "size": (F.col("p_size").cast("double"), F.lit(1.0))})


@query("SELECT l_partkey, ['A', 'N', 'R'][max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)] AS l_returnflag FROM lineitem GROUP BY 1")
def worst_status(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.worst_status(_t(spark, d, "lineitem"), "l_partkey", "l_returnflag", ["A", "N", "R"])


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT *, i >= n - n // 3 AS tail FROM r), s AS (SELECT user_id, max(value) AS m, avg(value) FILTER (tail) - avg(value) FILTER (NOT tail) AS d, stddev_samp(value) FILTER (tail) AS f FROM t GROUP BY 1)
    SELECT user_id, m > 200 AS left_site, coalesce(abs(d) > 0.5 * f, false) AS unsettled FROM s""")
def trajectory_stability(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    moved = series.drift(e, "user_id", ["ts", "event_id"], "value").join(e.groupBy("user_id").agg(F.max("value").alias("largest")), "user_id")
    return trajectory.site_verdict(moved, "user_id", 200.0, 0.5)


@query("SELECT l_partkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) - coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 6) AS buried FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def buried_area(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.exposed(_t(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_quantity", "A", "N").withColumn("buried", F.round("buried", 6))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_nationkey * 1.0::DOUBLE AS x, s_acctbal / 500 AS y FROM supplier), n AS (SELECT a.k, b.k AS m FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2.25), c AS (SELECT k FROM n GROUP BY k HAVING count(*) >= 4),
    l AS (SELECT k, m FROM n WHERE k IN (SELECT k FROM c) AND m IN (SELECT k FROM c)), r(k, m) AS (SELECT k, m FROM l UNION SELECT r.k, l.m FROM r JOIN l ON r.m = l.k), o AS (SELECT k, min(m) AS g FROM r GROUP BY k)
    SELECT p.k AS s_suppkey, coalesce(o.g, (SELECT min(o2.g) FROM n JOIN o o2 ON o2.k = n.m WHERE n.k = p.k)) AS cluster, o.g IS NOT NULL AS core FROM p LEFT JOIN o ON o.k = p.k""")
def dense_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 500).alias("y"))
    return trajectory.dense_clusters(rows, "s_suppkey", ["x", "y"], 1.5, 4)
