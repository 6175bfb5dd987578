"""Registered queries of sources and sinks: tables go out to the shared folder in a format and come back through its reader."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evidence, gates, graph, series
from ..sources import artifacts, formats, text
from .registry import query
from .registry import table as _t


def _lines(df: DataFrame, line, label: str) -> str:
    """Writes one line a row, and gives the folder."""
    path = graph.shared_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS kind FROM part")
def delimited_source(spark: SparkSession, d: str) -> DataFrame:
    path = _lines(_t(spark, d, "part"), F.concat_ws(",", "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')), "p_type"), "csv")
    return text.delimited(spark, path, ["id", "name", "kind"])[0].select("id", "name", "kind")


@query("SELECT count(*) AS n, 'MALFORMED_RECORD' AS reason_code FROM part WHERE p_partkey % 7 = 0")
def malformed_records(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("p_partkey") % 7 == 0, F.lit(",more,and more")).otherwise("")
    path = _lines(_t(spark, d, "part"), F.concat(F.concat_ws(",", "p_partkey", "p_type"), extra), "csv")
    return text.delimited(spark, path, ["id", "kind"])[1].groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def framed_source(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.col("p_partkey").cast("string"), F.lit("\n> <size>\n"), F.col("p_size").cast("string"), F.lit("\n\n$$$$"))
    rows = text.framed(spark, _lines(_t(spark, d, "part"), body, "sdf"))
    return rows.select(F.split("record", "\n")[0].alias("name"), F.col("tags")["size"].alias("size"))


@query("SELECT s_suppkey * 1.0::DOUBLE AS x, s_acctbal AS y FROM supplier")
def plotted_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "supplier")
    path = _lines(rows, F.concat(F.lit("# made\n@ title\n"), F.col("s_suppkey").cast("string"), F.lit("  "), F.col("s_acctbal").cast("string")), "xvg")
    return text.numeric_series(spark, path).select(F.col("fields")[0].alias("x"), F.col("fields")[1].alias("y"))


@query("SELECT event_id, user_id, event_type FROM events")
def ledger_source(spark: SparkSession, d: str) -> DataFrame:
    path = graph.shared_path(spark, "ledger")
    _t(spark, d, "events").select("event_id", "user_id", "event_type").write.json(path)
    return text.ledger(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS size FROM part GROUP BY p_brand")
def table_sink(spark: SparkSession, d: str) -> DataFrame:
    path = graph.shared_path(spark, "table")
    text.write_table(_t(spark, d, "part"), path, partition_by=["p_brand"])
    return text.read_table(spark, path, ["p_brand", "p_size"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_size = 7")
def shortlist_sink(spark: SparkSession, d: str) -> DataFrame:
    path = graph.shared_path(spark, "shortlist")
    text.write_shortlist(_t(spark, d, "part").filter("p_size = 7"), path, ["p_partkey", "p_name"])
    return text.delimited(spark, path, ["p_partkey", "p_name"], sep="\t")[0].select("p_partkey", "p_name")


@query("SELECT 'parts' AS port, count(*) AS n, true AS verified, true AS same FROM part")
def artifact_port(spark: SparkSession, d: str) -> DataFrame:
    root = graph.shared_path(spark, "artifacts")
    made = artifacts.commit(spark, root, "table", {"name": "part"}, [], {"parts": _t(spark, d, "part")})
    again = artifacts.commit(spark, root, "table", {"name": "part"}, [], {"parts": _t(spark, d, "part")})
    rows = artifacts.read_port(spark, artifacts.resolve(spark, root, made.id), "parts", verify=True)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parts").alias("port"), "n", F.lit(True).alias("verified"), F.lit(made.id == again.id).alias("same"))


@query("SELECT 'm' || p_partkey AS name, p_size AS n_atoms, p_size - 1 AS n_bonds FROM part")
def mol2_source(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("@<TRIPOS>MOLECULE\nm"), F.col("p_partkey").cast("string"), F.lit("\n "), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") - 1).cast("string"), F.lit("\nSMALL\n@<TRIPOS>ATOM\n1 C"))
    good, _ = formats.mol2(spark, _lines(_t(spark, d, "part"), body, "mol2"))
    return good.select("name", "n_atoms", "n_bonds")


@query("SELECT event_id AS step, value AS delta, user_id * 1.0::DOUBLE AS temperature FROM events")
def energy_source(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    line = F.concat_ws(" ", F.lit("FepEnergy:"), e.event_id.cast("string"), F.lit("1 2 3 4"), e.value.cast("string"), F.lit("0.5"), e.user_id.cast("string"), F.lit("0"))
    return formats.namd_energies(spark, _lines(e, F.concat(F.lit("# window\n"), line), "fepout")).select("step", "delta", "temperature")


@query("SELECT o_orderstatus AS code, count(*) AS n FROM orders WHERE DATE '2000-06-01' <= CAST(o_orderdate AS DATE) GROUP BY 1")
def active_waivers(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("code"), F.to_date("o_orderdate").alias("expires"))
    return evidence.active_waivers(rows, F.lit(date(2000, 6, 1)), "expires").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'F' AS engine, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def only_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").filter("o_orderstatus = 'F'")
    engine = gates.only_identity(rows, rows.select("o_orderkey"), "o_orderkey", "o_orderstatus")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(engine).alias("engine"), "n")


@query("SELECT p_partkey, sha256(octet_length(encode(p_name)) || ':' || p_name || octet_length(encode(CAST(p_size AS VARCHAR))) || ':' || p_size) AS id FROM part")
def row_identities(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.row_hash(F.col("p_name"), F.col("p_size")).alias("id"))


_SG = "PARTITION BY user_id ORDER BY event_id"


@query(f"SELECT event_id, round((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35, 6) AS smoothed FROM events WINDOW w AS ({_SG})")
def polynomial_smoothing(spark: SparkSession, d: str) -> DataFrame:
    out = series.weighted_window(_t(spark, d, "events"), "user_id", ["event_id"], "value", [x / 35 for x in (-3, 12, 17, 12, -3)])
    return out.select("event_id", F.round("smoothed", 6).alias("smoothed"))


_CUTS = "list_transform(range(0, 12), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-1) / gamma(j + 1))))"


@query(f"""WITH c AS (SELECT {_CUTS} AS c), r AS (SELECT r, o_totalprice AS v, ('0x' || substr(md5('b:' || r || ':' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders, (SELECT unnest(range(1, 21)) AS r)),
    m AS (SELECT r, sum(n * v) / sum(n) AS m FROM (SELECT r, v, len(list_filter(c, lambda x: u >= x)) AS n FROM r, c) GROUP BY r) SELECT avg(m) AS mean, stddev_samp(m) AS spread FROM m""")
def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return series.poisson_bootstrap(_t(spark, d, "orders"), "o_orderkey", "o_totalprice", 20, "b")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    path, e = graph.shared_path(spark, "ledger"), _t(spark, d, "events").select("event_id", "event_type")
    e.filter("event_id % 2 = 0").write.json(path)
    e.filter("event_id % 2 <> 0 and event_id % 3 = 0").write.mode("append").json(path)
    return text.ledger(spark, path, "event_id bigint, event_type string").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT 'CHANGED' AS fault, CAST(0 AS BIGINT) AS n, true AS sealed")
def sealed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = graph.shared_path(spark, "snapshot")
    text.write_table(_t(spark, d, "part").repartition(3), path)
    first = graph.materialise(artifacts.seal(spark, path), "seal")
    faults = artifacts.changed(first, artifacts.seal(spark, path))
    return faults.agg(F.count(F.lit(1)).alias("n")).select(F.lit("CHANGED").alias("fault"), "n", F.lit(first.count() >= 3).alias("sealed"))
