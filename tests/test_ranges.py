"""Queries whose tables are dealt into ranges equal their SQL, too; what is compared block by block or looked up by value."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck, rows  # noqa: F401

from tessera.operators import judgement, ranks, similarity
from tessera.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", ["final_third_drift", "time_convergence", "trajectory_stability", "append_sequence"])
def test_ranged_query_equals_sql(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(ranks, "RANGE_ROWS", 70)
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("size", [ranks.RANGE_ROWS, 40])
def test_panel_members_are_looked_up(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    rng = random.Random(5)
    poses = [(e, m, float(rng.randrange(-30, 30)), judgement.HIGHER if e == "h" or (e == "x" and m % 2) else judgement.LOWER) for e in "hlx" for m in range(150) for _ in range(2)]
    poses += [("l", 3, math.nan, judgement.LOWER), ("l", 500, None, judgement.LOWER), ("l", 501, -math.inf, judgement.LOWER), ("l", 160, -0.0, judgement.LOWER), ("l", 161, 0.0, judgement.LOWER)]
    scores = spark.createDataFrame(poses, "engine string, parent int, score double, direction string")
    panel = spark.createDataFrame([(m,) for m in (*range(0, 170, 5), 161, 500, 501, 5, None)], "parent int")
    out = judgement.panel_enrichment(scores, panel, "engine", "parent", "score", "direction")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Join" in x and "<=" in x]  # by equal keys, not by each value below
    best = {}
    for e, m, v, d in poses:
        if v is not None and math.isfinite(v):
            best[e, m] = min(best.get((e, m), math.inf), -v if d == judgement.HIGHER else v)
    of = lambda e: [v for (g, _), v in best.items() if g == e]
    members = {r["parent"] for r in panel.collect()}
    want = {(e, m): sum(x <= v for x in of(e)) / len(of(e)) for (e, m), v in best.items() if m in members and e != "x"}
    assert {(r["engine"], r["parent"]): r["percentile"] for r in out.collect()} == want and out.count() == len(want)


def packed(rng, n, width):
    """Some sets of the same counts, copies, empty ones and shorter ones."""
    rows = [[rng.choice([0, 1, 3, 7, 255, rng.randrange(256)]) for _ in range(rng.choice([width, width, 1]))] for _ in range(n)]
    return rows + [list(rows[0])] * 5 + [[0] * width, [0], None]


def share(a, b):
    a, b = (int.from_bytes(bytes(x or []), "little") for x in (a, b))
    return (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0


@pytest.mark.parametrize("block, strip", [(similarity.BLOCK, 256), (16, 5)])
def test_bit_neighbours_block_by_block(spark, monkeypatch, block, strip):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "STRIP", strip, raising=False)
    sets = packed(random.Random(8), 70, 3)
    df = spark.createDataFrame([(1000 - 7 * i, v) for i, v in enumerate(sets)], "k bigint, b array<int>")
    out = similarity.tanimoto_neighbours(df, df, "k", "b", 0.5, 3)
    got = {(r["k"], r["rank"]): (r["neighbour"], r["similarity"]) for r in out.collect()}
    rows, want = list(enumerate(sets)), {}
    for i, v in rows:
        near = sorted((-share(v, w), 1000 - 7 * j) for j, w in rows if i != j and share(v, w) >= 0.5)[:3]
        want |= {(1000 - 7 * i, r): (j, -s) for r, (s, j) in enumerate(near, 1)}
    assert got == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" not in plan and "Join" not in plan  # no expression for each pair
    assert similarity.tanimoto_neighbours(df.limit(0), df.limit(0), "k", "b", 0.5, 3).count() == 0
    named = df.withColumn("k", F.col("k").cast("string"))
    assert similarity.tanimoto_neighbours(named.filter("k = '1000'"), named, "k", "b", 0.5, 2).count() == 2


@pytest.mark.parametrize("block, strip", [(similarity.BLOCK, 256), (16, 5)])
def test_pair_graph_block_by_block(spark, monkeypatch, block, strip):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "STRIP", strip, raising=False)
    rng = random.Random(9)
    sets = packed(rng, 150, 2)
    series = [rng.choice("aaaaab") if i % 40 else None for i in range(len(sets))] + ["lone"]
    df = spark.createDataFrame([(1000 - 7 * i, g, v) for i, (g, v) in enumerate(zip(series, [*sets, [3, 1]], strict=True))], "k bigint, g string, b array<int>")
    out = similarity.pair_graph(df, "k", "g", "b", 0.45)
    rows = [(r["k"], r["g"], r["b"]) for r in df.collect()]
    want = sorted((i, j, share(v, w)) for i, g, v in rows for j, h, w in rows if i < j and g == h and g and share(v, w) >= 0.45)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 1000
    assert "bit_count" not in out._jdf.queryExecution().executedPlan().toString()  # no expression for each pair
    assert similarity.pair_graph(df.limit(0), "k", "g", "b", 0.45).count() == 0
