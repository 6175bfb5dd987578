"""Operators on edge frames: nothing, one row, nulls, NaN, infinities, bounds, ties, repeats, missing coverage."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalar
from tessera.operators import acquisition, contracts, evidence, gates, graph, journal, judgement, learning, lookup, network, planning, policy, ranks, records, selection, series, similarity, sizes, stats, trajectory
from tessera.plans import cascade, plugins
from tessera.sources import artifacts, formats, text
from tessera.streaming import windows


def test_contract(spark):
    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("kind", T.StringType()), T.StructField("note", T.StringType())])
    c = contracts.Contract("thing/v1", schema, ("id",), {"kind": ("A", "B")}, (("kind", "note"),))
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    good = spark.createDataFrame([("1", "A", None), ("2", None, "x")], loose)
    assert c.require(good) is good and c.require(good.limit(0)) is not None
    bad = spark.createDataFrame([("1", "C", None), ("1", None, " "), (None, "A", "y")], loose)
    assert {r["check"]: r["n"] for r in c.violations(bad).collect()} == {"null:id": 1, "enum:kind": 1, "nonempty:kind|note": 1, "key:id": 1}
    with pytest.raises(contracts.ContractError):
        c.require(bad)
    with pytest.raises(contracts.ContractError, match="unexpected column"):
        c.require(good.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="name/vN"):
        contracts.Contract("thing", schema, ("id",))
    registry = contracts.Registry([c])
    assert registry["thing/v1"] is c and list(registry) == ["thing/v1"]
    with pytest.raises(ValueError, match="already"):
        registry.add(c)


def test_numeric_gate(spark):
    parents = spark.createDataFrame([(i,) for i in range(8)], "k int")
    values = [(0, 1.0), (1, 2.0), (2, 0.99), (3, 2.01), (4, float("nan")), (5, float("inf")), (6, None)]
    ev = spark.createDataFrame(values, "k int, v double")
    out = {r["k"]: r["reason_code"] for r in gates.numeric_gate(parents, ev, "k", "v", gates.Bounds(1.0, 2.0), "V").collect()}
    assert out == {0: "V_PASS", 1: "V_PASS", 2: "V_BELOW_MINIMUM", 3: "V_ABOVE_MAXIMUM", 4: "V_MISSING", 5: "V_MISSING", 6: "V_MISSING", 7: "V_MISSING"}
    sharp = gates.numeric_gate(parents, ev, "k", "v", gates.Bounds(None, 2.0, True), "V").filter("k = 1").first()
    assert sharp["reason_code"] == "V_ABOVE_MAXIMUM" and not sharp["passed"]
    for wrong in ({}, {"minimum": 2.0, "maximum": 1.0}, {"minimum": math.nan}):
        with pytest.raises(ValueError):
            gates.Bounds(**wrong)


def test_best_of_group_ties_and_missing(spark):
    rows = spark.createDataFrame([("a", -5.0, 2), ("a", -5.0, 1), ("a", float("nan"), 0), ("b", None, 1), ("c", 1.0, 7)], "k string, s double, r int")
    out = {r["k"]: tuple(r)[1:] for r in gates.best_of_group(rows, "k", "s", "r").collect()}
    assert out == {"a": (-5.0, 1, 3), "b": (None, None, 1), "c": (1.0, 7, 1)}
    assert {r["k"]: r["best_rank"] for r in gates.best_of_group(rows, "k", "s", "r", False).collect()}["a"] == 1


def test_status_gate_and_decisions(spark):
    rows = spark.createDataFrame([(1, "OK", 5.0), (2, "OK", 9.0), (3, "FAILED", 5.0), (4, None, 5.0)], "k int, s string, v double")
    out = [(r["reason_code"], r["passed"]) for r in gates.status_gate(rows, "s", "v", gates.Bounds(1, 6), False).orderBy("k").collect()]
    assert out == [("DERIVED_METRIC_PASS", True), ("DERIVED_METRIC_ABOVE_MAXIMUM", False), ("DERIVED_METRIC_FAILED", False), ("DERIVED_METRIC_MISSING", False)]
    lax = gates.status_gate(rows, "s", "v", gates.Bounds(1, 6), True)
    assert [r["passed"] for r in lax.orderBy("k").collect()] == [True, False, True, True]
    d = gates.decisions(lax, "k", "m", warns=["DERIVED_METRIC_UNSCORABLE_ACCEPTED"])
    assert d.count() == 6 and d.filter("outcome = 'WARN'").count() == 2 and d.filter("outcome = 'REJECT'").count() == 1
    assert {r["outcome"]: (r["n"], r["total_n"], r["untracked_n"]) for r in gates.digest(d, max_buckets=1).collect()} == {"PASS": (2, 3, 1), "WARN": (0, 2, 2), "REJECT": (0, 1, 1)}
    whole = gates.digest(d, sample=2).collect()
    assert all(0 < len(r["sample_ids"]) <= 2 and r["untracked_n"] == 0 for r in whole) and sum(r["n"] for r in whole) == 6


def test_decision_join_fails_closed(spark):
    parents = spark.createDataFrame([("p",), ("q",)], "k string")
    good = [("x", "p", "PASS"), ("x", "q", "REJECT"), ("y", "p", "PASS"), ("y", "p", "WARN"), ("y", "q", "PASS")]
    frame = lambda rows: spark.createDataFrame(rows, "branch string, k string, outcome string")
    passed = lambda mode, n=0: {r["k"] for r in policy.decision_join(parents, frame(good), "k", ["x", "y"], mode, n).filter("passed").collect()}
    assert passed("ALL") == {"p"} and passed("ANY") == {"p", "q"} and passed("AT_LEAST", 2) == {"p"}
    for wrong in (good[:-1], [*good, ("y", "z", "PASS")], [*good, ("x", "p", "REJECT")], good[:2], [*good, ("w", "p", "PASS")]):
        with pytest.raises(policy.CoverageError):
            policy.decision_join(parents, frame(wrong), "k", ["x", "y"])
    assert policy.decision_join(parents.limit(0), frame(good).limit(0), "k", ["x", "y"]).count() == 0
    with pytest.raises(policy.CoverageError):
        policy.decision_join(parents.limit(0), frame(good), "k", ["x", "y"])


def test_only_identity(spark):
    parents = spark.createDataFrame([(1,)], "k int")
    ev = spark.createDataFrame([(1, "m"), (2, "n")], "k int, model string")
    assert gates.only_identity(ev, parents, "k", "model") == "m" and gates.orphans(parents, ev, "k").count() == 1
    with pytest.raises(ValueError):
        gates.only_identity(ev.withColumn("k", F.lit(1)), parents, "k", "model")


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 12) / 3, rng.random() < 0.4) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = stats.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()
    assert math.isclose(got["auc"], want) and 0 < got["se"] < 0.1
    one = stats.auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", F.col("y")).first()
    assert one["auc"] is None and one["se"] is None


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 2, 3]] + [(None,), (float("nan"),)], "v double")
    assert [stats.order_statistic(df, "v", i) for i in range(6)] == [1, 2, 3, 4, 4, 5]
    assert stats.percentile_threshold(df, "v", 0.5, True) == 3 and stats.percentile_threshold(df, "v", 0.5, False) == 4
    assert stats.percentile_threshold(df.limit(0), "v", 0.5, True) is None
    assert stats.conformal_rank(9, 0.1) == 9 and stats.conformal_rank(100, 0.1) == 91 and stats.cost_quote([1, 0, 2], 0.5) == 2
    assert stats.effective_votes(0.0, 3) == 3 and stats.effective_votes(1.0, 3) == 1


def test_single_class_and_short_samples(spark):
    df = spark.createDataFrame([(True, True)] * 3, "c boolean, t boolean")
    r = stats.confusion(df, F.col("c"), F.col("t")).first()
    assert r["sensitivity"] == 1 and r["specificity"] is None and r["youden"] is None
    k = stats.cohen_kappa(df, "c", "t").first()
    assert (k["kappa"], k["se"]) == (0.0, 0.0)
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double"), "x", "y").first()["rho"] is None
    uneven = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "r int, v string")
    assert stats.fleiss_kappa(uneven, "r", "v").first()["kappa"] is None


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_networks(spark):
    edges = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("d", "e", 0.2)]
    assert network.spanning_network(edges, 0.5, 1) == ([("a", "b"), ("b", "c"), ("a", "c")], 1)
    offers = [("1", "s", 1.0, 0.5), ("2", "s", 0.9, 0.1), ("3", "t", 0.2, 2.0), ("4", "u", 0.5, 0.1)]
    assert network.greedy_batch(offers, 2, 0.0, 1.0, 0.5) == ["3", "1"]
    assert network.greedy_batch(offers, 3, 0.0, 1.0, 0.0) == ["1", "4", "3"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "a bigint, b bigint")
    start = spark.createDataFrame([(0,)], "node bigint")
    assert {r["node"]: r["hops"] for r in network.reachable(chain, start, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_ledger():
    rounds = [(1, "round", "a", None), (2, "round", "b", None), (3, "rewind", "", "a"), (4, "round", "c", None), (5, "rewind", "", "b"), (6, "round", "d", None)]
    assert journal.live_rounds(rounds) == ["a", "b", "d"]
    for wrong in ([*rounds, (7, "round", "a", None)], [*rounds, (7, "rewind", "", "zz")]):
        with pytest.raises(journal.LedgerError):
            journal.live_rounds(wrong)


def test_selection(spark):
    df = spark.createDataFrame([(i, "g" if i < 90 else "h") for i in range(100)], "k int, g string")
    out = selection.round_robin(df, "k", "g", 5, 8, "s")
    assert out.filter("selected").groupBy("g").count().count() == 2 and out.filter("selected").count() == 8
    assert out.filter("reason_code = 'NOT_SELECTED_SCAFFOLD_CAP'").count() == 90 and out.count() == 100
    assert selection.hash_budget(df, "k", 0, "s").filter("selected").count() == 0
    assert selection.hash_budget(df.limit(0), "k", 5, "s").count() == 0
    lanes = selection.carve_batches(df, "k", "k", "g", 8)
    assert lanes.count() == 88 + 8 and selection.carve_batches(df, "k", "k", "g", 8, flush=True).count() == 100
    assert selection.affordable(0.1, 0.3, 9) == 3 and selection.affordable(0.0, 1.0, 9) == 9
    assert math.isclose(selection.knowledge_gradient([0.0, 0.0], [0.0, 1.0]), 1 / math.sqrt(2 * math.pi))
    assert selection.knowledge_gradient([1.0, 0.0], [1.0, 1.0]) == 0


def test_knowledge_gradient_by_integration():
    rng = random.Random(4)
    for _ in range(20):
        a, b = [rng.gauss(0, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(5)]
        grid = [-8 + 16 * i / 20000 for i in range(20001)]
        mean = sum(max(x + y * z for x, y in zip(a, b, strict=True)) * math.exp(-z * z / 2) for z in grid) * (16 / 20000) / math.sqrt(2 * math.pi)
        assert math.isclose(selection.knowledge_gradient(a, b), mean - max(a), abs_tol=1e-4)


def test_series(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 5.0, 3.0, 9.0, 5.0, 1.0])], "s string, i int, v double")
    assert [r["in_contact"] for r in series.hysteresis(df, "s", ["i"], "v", 2.0, 8.0).orderBy("i").collect()] == [True, True, True, False, False, True]
    assert [r["moving_average"] for r in series.moving_average(df, "s", ["i"], "v", 5).orderBy("i").collect()][:5] == [None] * 4 + [4.6]
    assert [r["unique_so_far"] for r in series.unique_so_far(df, "s", ["i"], "v").orderBy("i").collect()] == [1, 2, 3, 4, 4, 4]
    d = series.drift(df, "s", ["i"], "v").first()
    assert (d["head_mean"], d["tail_mean"]) == (4.5, 3.0)


def test_similarity(spark):
    rows = [(i, [float(i == j) for j in range(4)], 0) for i in range(4)] + [(9, [0.0] * 4, 0), (10, [1.0, 0.0, 0.0, 0.0], 0), (11, None, 0)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>, g int")
    near = {(r["k"], r["rank"]): (r["neighbour"], r["similarity"]) for r in similarity.nearest(df, df, "k", "v", 2, exclude_self=True).collect()}
    assert near[0, 1] == (10, 1.0) and near[9, 1] == (0, 0.0) and near[1, 1] == (0, 0.0) and (11, 1) not in near
    lead = {r["k"]: r["leader"] for r in similarity.leader_clusters(df, "k", "v", 0.9, "g").collect()}
    assert lead == {0: 0, 1: 1, 2: 2, 3: 3, 9: 9, 10: 0}
    bits = df.filter("v is not null").select("k", similarity.sign_bits(F.col("v")).alias("b"))
    pair = bits.alias("x").join(bits.alias("y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("c"), similarity.tanimoto(F.col("x.b"), F.col("y.b")).alias("t"))
    t = {(r["a"], r["c"]): r["t"] for r in pair.collect()}
    assert t[0, 10] == 1.0 and t[0, 1] == 0.0 and t[9, 9] == 0.0
    assert similarity.nearest(df, df.limit(0), "k", "v", 2).count() == 0


def test_evidence(spark):
    votes = spark.createDataFrame([(1, "refuse"), (1, "clear"), (2, "clear"), (2, "abstain"), (3, "abstain"), (4, "refuse")], "r int, v string")
    assert {r["r"]: r["outcome"] for r in evidence.vote_outcomes(votes, "r", "v").collect()} == {1: "SPLIT", 2: "CLEARED_BUT_UNCERTIFIED", 3: "NO_VOTE", 4: "REFUSED"}
    pool = spark.createDataFrame([("k1", "c1")], "k string, c string")
    new = spark.createDataFrame([("k1", "c9", 1), ("k2", "c1", 2), ("k3", "c3", 3), ("k4", "c3", 4)], "k string, c string, o int")
    assert {r["k"]: r["status"] for r in evidence.admit(new, pool, "k", "c", "o").collect()} == {"k1": "KNOWN", "k2": "KNOWN", "k3": "ACCEPTED", "k4": "DUPLICATE"}
    empty = spark.createDataFrame([], "g string, p double, o double, s double")
    assert evidence.conformal(empty, "g", "p", "o", "s", 0.1, 1.0, 5).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.molar(F.lit(3.0), F.lit("uM")).cast("double").alias("m"), scalar.molar(F.lit(3.0), F.lit("g")).alias("none"), scalar.pic50(F.lit(10.0)).alias("p"),
        scalar.measurement_class(F.lit("Ki"), F.lit(">"), F.lit("7"), F.lit("nM"), F.lit("Not Active")).alias("a"), scalar.measurement_class(F.lit("Ki"), F.lit(">="), F.lit(7.0), F.lit("nM"), F.lit(None)).alias("b"),
        scalar.measurement_class(F.lit("Tm"), F.lit("="), F.lit(7.0), F.lit("nM"), F.lit(None)).alias("c"), scalar.public_url(F.lit("https://me:pw@x.org/a?token=1&b=2")).alias("u"),
        scalar.row_hash(F.lit("ab"), F.lit("c")).alias("h1"), scalar.row_hash(F.lit("a"), F.lit("bc")).alias("h2"),
    ).first()
    assert math.isclose(row["m"], 3e-6) and row["none"] is None and row["p"] == 8
    assert (row["a"], row["b"], row["c"]) == ("reported_inactive", "lower_bound", "unsupported")
    assert row["u"] == "https://x.org/a?token=***&b=2" and row["h1"] != row["h2"]
    assert scalar.canonical_json({"b": 1, "a": [1.5, None]}) == b'{"a":[1.5,null],"b":1}'


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,smiles\n1,C\n2,"C,O"\n3,N,extra\n')
    good, bad = text.delimited(spark, str(tmp_path / "a.csv"), ["id", "smiles"])
    assert [(r["id"], r["smiles"]) for r in good.orderBy("id").collect()] == [("1", "C"), ("2", "C,O")]
    assert bad.select("outcome", "reason_code").collect() == [("REJECT", "MALFORMED_RECORD")]
    (tmp_path / "b.sdf").write_text("m1\n> <A>\nx\n\n> <B>\ny\n\n$$$$\nm2\n$$$$\n")
    tags = [r["tags"] for r in text.framed(spark, str(tmp_path / "b.sdf")).collect()]
    assert {"A": "x", "B": "y"} in tags and {} in tags
    (tmp_path / "c.xvg").write_text("# note\n@ title\n0.0 1.5\n1.0 nan\n")
    assert [r["fields"][0] for r in text.numeric_series(spark, str(tmp_path / "c.xvg")).collect()] == [0.0, 1.0]
    out = str(tmp_path / "t")
    text.write_table(good, out)
    assert text.read_table(spark, out, ["id"], F.col("id") == "2").collect() == [("2",)]
    with pytest.raises(Exception, match="already exists"):
        text.write_table(good, out)
    cells = text.cells(good, "record_id", ["id", "smiles"])
    assert cells.count() == 4
    text.write_shortlist(good, str(tmp_path / "s"), ["id", "smiles"])


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    stream = lambda: windows.read_stream(spark, path, events.schema)
    batch = {tuple(r) for r in windows.windowed(events, "ts", "event_type", "value").select("start", "event_type", "n").collect()}
    live = windows.drain(windows.windowed(stream(), "ts", "event_type", "value"), "live", "complete", str(tmp_path / "c1"))
    assert {tuple(r) for r in live.select("start", "event_type", "n").collect()} == batch
    spent = windows.drain(windows.running_balance(stream(), "user_id", "value", 1000.0), "spent", "update", str(tmp_path / "c2"))
    last = {r["user_id"]: r["s"] for r in spent.groupBy("user_id").agg(F.max("spent").alias("s")).collect()}
    total = {r["user_id"]: r["s"] for r in events.groupBy("user_id").agg(F.sum("value").alias("s")).collect()}
    assert last.keys() == total.keys() and all(math.isclose(last[k], total[k], rel_tol=1e-9) for k in total)


def test_planning():
    assert planning.retention(0.0, 0.1, 0.01) == 0.1 and planning.retention(1.0, 0.1, 0.2) == 0.5
    values = [planning.retention(r, 0.1, 0.01) for r in (0.05, 0.3, 0.6, 0.9, 0.99)]
    assert values == sorted(values) and 0.1 < values[0] and values[-1] <= 1
    rho = planning.rho_for_multiplier(0.3, 1.5, 0.1, 0.01)
    assert math.isclose(planning.retention(rho, 0.1, 0.01), 1.5 * planning.retention(0.3, 0.1, 0.01), rel_tol=1e-6)
    assert math.isclose(planning.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    parabola = [x * x / 7.0 for x in range(20)]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(planning.savitzky_golay(parabola, 7, 2), parabola, strict=True))
    assert planning.merge_json({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    assert planning.at_pointer({"a/b": [1, {"~": 2}]}, "/a~1b/1/~0") == 2


def test_gaussian_process():
    import numpy as np

    pool = np.linspace(0, 1, 40)[:, None] ** np.array([[1, 2]])
    mean, spread = planning.gaussian_process(pool, [0, 20, 39], [0.0, 1.0, 0.0], 1e-6)
    assert abs(mean[20] - 1) < 1e-2 and spread[20] < 1e-2 < spread[10]
    mean, spread = planning.gaussian_process(pool, [], [], 0.1)
    assert (mean == 0).all() and (spread == 1).all()


def test_cascade_modes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, v double")
    gate = lambda lo: lambda x: x.withColumn("reason_code", F.when(F.col("v") >= lo, "P").otherwise("R")).withColumn("passed", F.col("v") >= lo)
    ids = lambda mode, n=0: {r["k"] for r in cascade.run_cascade(df, "k", [cascade.Tier("t", {"a": gate(3), "b": gate(6)}, mode, n)]).survivors.collect()}
    assert ids("SERIAL") == ids("ALL") == ids("AT_LEAST", 2) == set(range(6, 10)) and ids("ANY") == set(range(3, 10))
    run = cascade.run_cascade(df, "k", [cascade.Tier("t", {"a": gate(3), "b": gate(6)})])
    assert run.decisions.count() == 17 and run.funnel.first()["removed"] == 6
    with pytest.raises(policy.CoverageError):
        cascade.run_cascade(df, "k", [cascade.Tier("t", {"a": lambda x: gate(3)(x).filter("k > 0"), "b": gate(6)}, "ALL")])
    for wrong in ({"gates": {}}, {"gates": {"a": gate(1)}, "mode": "SOME"}, {"gates": {"a": gate(1)}, "mode": "AT_LEAST", "at_least": 2}):
        with pytest.raises(ValueError):
            cascade.Tier("t", **wrong)
    assert cascade.plan_id("k", [cascade.Tier("t", {"a": gate(1)})], {"a": 1}) != cascade.plan_id("k", [cascade.Tier("t", {"a": gate(1)})], {"a": 2})


def test_artifacts(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    one = artifacts.commit(spark, root, "table", {"name": "x"}, [], {"primary": df})
    again = artifacts.commit(spark, root, "table", {"name": "x"}, [], {"primary": df.orderBy(F.desc("k")).repartition(3)})
    other = artifacts.commit(spark, root, "table", {"name": "y"}, [one.id], {"primary": df})
    assert one.id == again.id != other.id and artifacts.resolve(spark, root, one.id).manifest["ports"]["primary"]["rows"] == 2
    assert artifacts.read_port(spark, one, "primary", verify=True).count() == 2
    df.filter("k = 1").write.mode("overwrite").parquet(f"{one.path}/primary")
    with pytest.raises(artifacts.ArtifactError, match="manifest says"):
        artifacts.read_port(spark, one, "primary", verify=True)
    for bad in (lambda: artifacts.resolve(spark, root, "0" * 64), lambda: artifacts.read_port(spark, one, "none")):
        with pytest.raises(artifacts.ArtifactError):
            bad()


def test_facets_and_ranges(spark):
    df = spark.createDataFrame([(1, '{"task":"a","role":["x","y"]}'), (2, '{"task":"b","role":"x"}'), (3, "not json"), (4, None)], "k int, body string")
    assert [r["k"] for r in lookup.facets(df, "body", {"role": ["x"], "task": ["a", "b"]}).orderBy("k").collect()] == [1, 2]
    assert lookup.facets(df, "body", {"role": ["y"]}).count() == 1
    with pytest.raises(Exception, match="range too long"):
        lookup.ranges_to_rows(spark.createDataFrame([(1, 9, 0)], "a int, b int, s int"), "a", "b", "s", limit=5).collect()


def test_normal_distribution_to_double_precision(spark):
    xs = [i / 17 for i in range(-150, 151)] + [0.0, 1e-9, 0.46875, 4.0, -4.0, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", selection.erfc(F.col("x")).alias("e"), selection.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-12) and math.isclose(r["p"], 0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel_tol=1e-12) for r in got)


def test_ranges_rank_as_one_sort_does(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    sizes = ranks.RANGE_ROWS
    for size in (sizes, 70):
        monkeypatch.setattr(ranks, "RANGE_ROWS", size)
        got = {r["i"]: r["n"] for r in ranks.ranked(df, ["g"], ["v", "i"], "n").collect()}
        for g in ("a", "b", None):
            for n, (_, i) in enumerate(sorted((v, i) for h, v, i in rows if h == g), 1):
                assert got[i] == n
        counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
        for r in ranks.cumulative(counts, "v", ["c"], ["g"]).collect():
            assert r["before_c"] == sum(h == r["g"] and v < r["v"] for h, v, _ in rows)
        assert stats.median(df, F.col("v")) == sorted(v for _, v, _ in rows)[449] / 2 + sorted(v for _, v, _ in rows)[450] / 2
        top = stats.enrichment(df, "v", "i", F.col("i") % 3 == 0, [0.01, 0.1, 1.0]).orderBy("fraction").collect()
        order = sorted(rows, key=lambda r: (-r[1], r[2]))
        assert [r["hits"] for r in top] == [sum(i % 3 == 0 for _, _, i in order[: r["k"]]) for r in top]


def test_rigid_fit_and_contacts(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    points = rng.standard_normal((12, 3)) * 5
    turn, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    moved = points @ turn + [1.0, -2.0, 3.0]
    rotation, shift = trajectory.rigid_fit(moved, points)
    assert np.allclose(moved @ rotation + shift, points) and math.isclose(np.linalg.det(rotation), 1.0)
    rows = [(f, a, *map(float, (moved if f else points)[a])) for f in (0, 1) for a in range(12)] + [(2, 0, 0.0, 0.0, 0.0)]
    frames = spark.createDataFrame(rows, "frame bigint, atom bigint, x double, y double, z double")
    reference = pd.DataFrame({"atom": range(12), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})
    got = {r["frame"]: (r["n"], r["rmsd"]) for r in trajectory.fitted_rmsd(frames, reference, "frame", "atom").collect()}
    assert got[0][1] < 1e-9 and got[1][1] < 1e-9 and got[2] == (1, None)
    a, b = frames.filter("atom < 5"), frames.filter("atom >= 5")
    near = {(r["frame"], r["ligand_atom"], r["receptor_atom"]) for r in trajectory.contacts(a, b, "frame", "atom", 6.0).collect()}
    xyz = {(f, i): np.array(p) for f, i, *p in rows}
    assert near == {(f, i, j) for f, i in xyz for g, j in xyz if f == g and i < 5 <= j and np.linalg.norm(xyz[f, i] - xyz[g, j]) < 6}
    angles = spark.range(1).select(
        trajectory.angle(*[[F.lit(float(x)) for x in p] for p in ((1, 0, 0), (0, 0, 0), (0, 2, 0))]).alias("a"),
        trajectory.dihedral(*[[F.lit(float(x)) for x in p] for p in ((1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1))]).alias("d"),
        trajectory.angle(*[[F.lit(0.0)] * 3] * 3).alias("none"),
    ).first()
    assert math.isclose(angles["a"], 90) and math.isclose(abs(angles["d"]), 90) and angles["none"] is None


def test_judgements_fail_closed(spark):
    taxonomy = spark.createDataFrame([("F_A", "WRONG_SUBJECT")], "code string, consequence string")
    odd = spark.createDataFrame([("F_X", True, True)], "code string, fired boolean, evaluable boolean")
    with pytest.raises(Exception, match="unknown fault"):
        judgement.partition_observations(odd, taxonomy, []).collect()
    panel = spark.createDataFrame([("p", True), ("q", False)], "k string, a boolean")
    none = spark.createDataFrame([], "k string, tier string")
    absent = judgement.gate_calibration(panel, none, panel.filter("k = 'q'"), "k", "a", 0.9).first()
    assert absent["recall"] is None and absent["refusal"] == "PANEL_NOT_SCREENED" and not absent["admissible"]
    assert judgement.gate_calibration(panel, none, panel, "k", "a", 0.9).first()["admissible"]
    with pytest.raises(ValueError):
        judgement.gate_calibration(panel, none, panel, "k", "a", 0.0)
    gaps = spark.createDataFrame([("m", "one", 1, 2), ("m", "two", 1, 2), ("n", "one", 1, 2)], "m string, stage string, hits int, trials int")
    with pytest.raises(Exception, match="lacks counts"):
        judgement.generator_audit(gaps, "m", ["one", "two"]).collect()
    with pytest.raises(Exception, match="directions disagree"):
        judgement.one_direction(spark.createDataFrame([("UP",), ("DOWN",)], "d string"), "d").collect()
    few = spark.createDataFrame([(1, "a", "refuse", True), (2, "a", "clear", False)], "r int, seat string, vote string, truth boolean")
    ruling = judgement.council_ruling(few, "r", "seat", "vote", "truth", 10).first()
    assert ruling["refusal"] == "TOO_FEW_LABELS" and ruling["effective_votes"] == 1 and not ruling["qualified"]
    with pytest.raises(Exception, match="unknown status"):
        trajectory.worst_status(spark.createDataFrame([(1, "odd")], "k int, s string"), "k", "s", ["ok", "bad"]).collect()


def test_small_sides_are_looked_at(spark):
    df = spark.range(10)
    plan = lambda side: spark.range(5).join(side, "id")._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(sizes.small(df, 10)) or "UnresolvedHint" in plan(sizes.small(df, 10)) or "broadcast" in plan(sizes.small(df, 10)).lower()
    assert "broadcast" not in plan(sizes.small(df, 9)).lower() and "Hint" not in plan(sizes.small(df, 9))


def test_versions_and_edits(spark):
    rows = [("a", 1, None, "v1"), ("a", 2, "v1", "v2"), ("a", 3, "v1", "v3"), ("a", 4, "v2", "v4"), ("b", 1, "x", "y")]
    got = {r["k"]: tuple(r)[1:] for r in records.heads(spark.createDataFrame(rows, "k string, s int, e string, r string"), "k", "s", "e", "r").collect()}
    assert got == {"a": ("v4", 3, 1), "b": (None, 0, 1)}
    sets = records.edit_sets(spark.range(1), "id", [("a", "1"), ("a", "2"), ("b", "1")], 3).collect()
    assert sorted(r["edits"] for r in sets) == ["", "a=1", "a=1,b=1", "a=2", "a=2,b=1", "b=1"]
    with pytest.raises(ValueError):
        records.edit_sets(spark.range(1), "id", [("f", str(i)) for i in range(17)], 2)


def workbook(rows, sheet="Data"):
    """A small workbook with shared strings, numbers, inline strings and gaps."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            at = f'{chr(65 + j)}{i}'
            if isinstance(v, str) and j % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


def test_further_formats(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", "smiles", "mw"], ["m1", "CCO", 46.07], ["m2", None, 18], [None, "C"]]))
    got = sorted((r["row"], r["id"], r["mw"], r["smiles"]) for r in formats.spreadsheet(spark, str(tmp_path / "a.xlsx"), ["id", "mw", "smiles"]).collect())
    assert got == [(1, "m1", "46.07", "CCO"), (2, "m2", "18", None), (3, None, None, "C")]
    with pytest.raises(Exception, match="no columns"):
        formats.spreadsheet(spark, str(tmp_path / "a.xlsx"), ["nope"]).collect()
    with pytest.raises(ValueError, match="no sheet"):
        formats.sheet_rows(workbook([["a"]]), "Other")
    (tmp_path / "b.mol2").write_text("# made by hand\n@<TRIPOS>MOLECULE\nbenzene\n 6 6 0\nSMALL\n@<TRIPOS>ATOM\n1 C\n@<TRIPOS>MOLECULE\nodd\nno counts\n@<TRIPOS>MOLECULE\nwater\n3 2\nSMALL\n")
    good, bad = formats.mol2(spark, str(tmp_path / "b.mol2"))
    assert sorted((r["name"], r["n_atoms"], r["n_bonds"], r["kind"]) for r in good.collect()) == [("benzene", 6, 6, "SMALL"), ("water", 3, 2, "SMALL")] and bad.count() == 1
    (tmp_path / "c.fepout").write_text("#NEW FEP WINDOW\nFepEnergy: 10 1.5 2.5 3 4 0.5 0.25 300.1 -0.1\nother\nFepEnergy: 20 1 x 3 4 0.5 0.25 300 0\n")
    rows = formats.namd_energies(spark, str(tmp_path / "c.fepout")).orderBy("step").collect()
    assert [(r["step"], r["elec_new"], r["net"]) for r in rows] == [(10, 2.5, -0.1), (20, None, 0.0)]
    assert formats.format_of("x.CSV.gz") == "delimited" and formats.format_of("a.b.sdf") == "sdf"
    with pytest.raises(ValueError):
        formats.format_of("noext")
    assert formats.provider_catalogue(spark, [{"provider": "p", "kinds": {"b", "a"}}]).first()["kinds"] == ["a", "b"]
    parents = spark.createDataFrame([("p", "C"), ("q", "N"), ("q", "O")], "k string, s string")
    with pytest.raises(Exception, match="not one parent"):
        formats.registered_parents(parents, "k", "s").collect()
    assert formats.registered_parents(parents.filter("k = 'p'"), "k", "s").count() == 1


def test_batch_is_the_step_by_step_greedy_one(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.randrange(20) / 4, rng.randrange(1, 9) / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, s string, m double, w double")
    seen = spark.createDataFrame([("a",), ("b",)], "s string")
    kappa, penalty, budget, explore = 1.0, 2.0, 20, 0.15
    got = [(r["k"], r["reason"]) for r in acquisition.acquire(df, seen, "k", "s", "m", "w", budget, kappa, explore, penalty).orderBy("rank").collect()]
    best = {}
    for k, s, _, w in sorted(rows, key=lambda r: (-r[3], r[0])):
        if s and s not in ("a", "b"):
            best.setdefault(s, (k, w))
    want = [(k, "unseen_scaffold") for k, _ in list(best.values())[: int(budget * explore)]]
    by = {r[0]: r for r in rows}
    taken = {by[k][1] for k, _ in want}
    left = [r for r in rows if r[0] not in {k for k, _ in want}]
    while left and len(want) < budget:
        score = lambda r: r[2] + kappa * r[3] - (kappa * r[3] + penalty if r[1] in taken and r[1] else 0)
        pick = min(left, key=lambda r: (-score(r), r[0]))
        want.append((pick[0], "diversity" if pick[1] and pick[1] in taken else "potency"))
        taken.add(pick[1])
        left.remove(pick)
    assert got == want
    with pytest.raises(ValueError):
        acquisition.acquire(df, seen, "k", "s", "m", "w", 0, 1.0, 0.1, 1.0)


def test_spanning_forest_is_kruskals(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.randrange(12) / 10) for _ in range(70)] + [("z1", "z2", 0.1)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    heaviest = {}
    for a, b, w in edges:
        if a != b:
            heaviest[min(a, b), max(a, b)] = max(w, heaviest.get((min(a, b), max(a, b)), w))
    forest, _ = network.spanning_network([(a, b, w) for (a, b), w in heaviest.items()], 0.0, 0)
    got = acquisition.spanning_forest(df, "a", "b", "w").collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(forest)
    assert acquisition.spanning_forest(df.limit(0), "a", "b", "w").count() == 0


def test_funnels_and_knobs(spark):
    stages = [acquisition.Stage("dock", 0.01, 0.35), acquisition.Stage("same", 0.02, 0.36), acquisition.Stage("end", 1.0, 0.6)]
    tiers, refused, ok = acquisition.plan_funnel(spark, 1000, stages, 400.0, 0.02, 10, 0.05)
    rows = tiers.orderBy("tier").collect()
    assert ok and refused == {"same": "NOT_RESOLVABLY_BETTER"} and [r["stage"] for r in rows] == ["dock", "end"]
    assert math.isclose(rows[-1]["molecules_out"], 10, rel_tol=1e-6) and sum(r["hours"] for r in rows) <= 400
    even = acquisition._walk([stages[0], stages[2]], [0.1, 0.1], 1000, 0.02)[0][-1][4]
    assert rows[-1]["retained"] >= even - 1e-9  # moving shares between tiers does not lose
    assert not acquisition.plan_funnel(spark, 1000, stages, 5.0, 0.02, 10, 0.05)[2]
    advice = {r["knob"]: (r["gain"], r["reason"]) for r in acquisition.advise(spark, 1000, stages, 400.0, 0.02, 10, 0.05, [("up", "end", 0.2, None, 0.0), ("tiny", "end", 0.01, None, 0.0), ("lost", "none", 0.2, None, 0.0)]).collect()}
    assert advice["up"][0] > 0 and advice["tiny"] == (None, "BELOW_RESOLUTION") and advice["lost"] == (None, "STAGE_NOT_IN_FUNNEL")
    with pytest.raises(ValueError):
        acquisition.plan_funnel(spark, 5, stages, 1.0, 0.1, 10)


def test_stages_keep_to_their_descriptors(spark):
    registry = plugins.Registry()
    gate = plugins.size_gate()
    registry.register(gate)
    with pytest.raises(ValueError, match="already"):
        registry.register(gate)
    rows = spark.createDataFrame([(1, 10), (2, 50), (3, None)], "p_partkey bigint, p_size int")
    out = registry.run("size_gate", 1, {"parents": rows})
    assert [r["p_partkey"] for r in out["primary"].collect()] == [1] and out["decisions"].filter("outcome = 'REJECT'").count() == 2
    for wrong in ({}, {"parents": rows.drop("p_size")}, {"parents": rows, "more": rows}):
        with pytest.raises(plugins.StageError):
            registry.run("size_gate", 1, wrong)
    with pytest.raises(plugins.StageError, match="became"):
        registry.run("size_gate", 1, {"parents": rows.unionByName(rows)})
    with pytest.raises(ValueError):
        plugins.Descriptor("x", 1, "ODD", (), ())
    bundle = plugins.ModelBundle(("a", "b"), (1.0, 2.0), 0.5)
    assert plugins.ModelBundle.load(bundle.dump()) == bundle
    with pytest.raises(plugins.StageError):
        plugins.ModelBundle.load(bundle.dump().replace("2.0", "3.0"))
    got = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double").select(bundle.predict()().alias("p")).collect()
    assert got[0]["p"] == 5.5 and (got[1]["p"] is None or math.isnan(got[1]["p"]))


def test_fitted_models(spark):
    rng = random.Random(4)
    rows = [(i, float(i % 10), rng.random(), 3.0 * (i % 10), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double, fold int")
    out = learning.forest_cross_fit(df, ["a", "b"], "y", "fold", 3, trees=10)
    error, plain = out.agg(F.avg(F.abs(F.col("predicted") - F.col("y"))), F.avg(F.abs(F.col("y") - 13.5))).first()
    assert out.count() == 120 and error < plain / 3  # far better than the mean
    points = spark.createDataFrame([(i, float(i % 2) * 10 + rng.random(), rng.random()) for i in range(60)], "k int, x double, y double")
    placed, scores = learning.frame_clusters(points, "k", ["x", "y"], [2, 3])
    got = placed.collect()
    assert max(scores, key=scores.get) == 2 and sum(r["is_centre"] for r in got) == 2
    assert len({(r["k"] % 2, r["cluster"]) for r in got}) == 2
