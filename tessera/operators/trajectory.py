"""Trajectory analytics over tables of (frame, atom, x, y, z) and of distances, angles and energies by frame."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small

XYZ = ("x", "y", "z")


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def angle(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Degrees at b between a and c; null where two of the points coincide."""
    u, v = [p - q for p, q in zip(a, b, strict=True)], [p - q for p, q in zip(c, b, strict=True)]
    dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
    size = F.sqrt(sum((p * p for p in u), F.lit(0.0))) * F.sqrt(sum((p * p for p in v), F.lit(0.0)))
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))))


def _cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dihedral(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column], d: Sequence[Column]) -> Column:
    """Degrees in (-180, 180] between the planes a b c and b c d."""
    p, q, r = ([y - x for x, y in zip(s, t, strict=True)] for s, t in ((a, b), (b, c), (c, d)))
    n, m = _cross(p, q), _cross(q, r)
    dot = lambda u, v: sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    return F.degrees(F.atan2(dot(p, m) * F.sqrt(dot(q, q)), dot(n, m)))


def ramachandran(phi: Column, psi: Column) -> Column:
    """Coarse region of a backbone's angles."""
    return F.when(phi.isNull() | psi.isNull(), F.lit(None).cast("string")).when((phi < 0) & phi.between(-160, -20) & psi.between(-120, 50), "ALPHA_R").when((phi < -20) & ((psi > 50) | (psi < -120)), "BETA").when((phi > 20) & (phi < 120) & psi.between(-60, 90), "ALPHA_L").otherwise("OTHER")


def contacts(ligand: DataFrame, receptor: DataFrame, frame: str, atom: str, cutoff: float) -> DataFrame:
    """frame, ligand_atom, receptor_atom, distance of pairs closer than the cutoff.

    Space is cut into cubes as wide as the cutoff; a ligand atom meets the receptor atoms of its own and the 26 cubes
    around it, not all of the frame.
    """
    cube = lambda c, d=0: F.floor(F.col(c) / cutoff) + d
    shifts = F.explode(F.array(*[F.struct(*[F.lit(s).alias(n) for n, s in zip(("i", "j", "k"), (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("s")
    a = ligand.select(F.col(frame).alias("f"), F.col(atom).alias("ligand_atom"), *[F.col(c).alias(f"l{c}") for c in XYZ], shifts)
    for c, n in zip(XYZ, ("i", "j", "k"), strict=True):
        a = a.withColumn(f"c{c}", F.floor(F.col(f"l{c}") / cutoff) + F.col(f"s.{n}"))
    b = receptor.select(F.col(frame).alias("g"), F.col(atom).alias("receptor_atom"), *[F.col(c).alias(f"r{c}") for c in XYZ], *[cube(c).alias(f"d{c}") for c in XYZ])
    near = a.join(b, (F.col("f") == F.col("g")) & (F.col("cx") == F.col("dx")) & (F.col("cy") == F.col("dy")) & (F.col("cz") == F.col("dz")))
    d = distance([F.col(f"l{c}") for c in XYZ], [F.col(f"r{c}") for c in XYZ])
    return near.withColumn("distance", d).filter(F.col("distance") < cutoff).select(F.col("f").alias(frame), "ligand_atom", "receptor_atom", "distance")


def contact_series(pairs: DataFrame, frame: str, frames: DataFrame) -> DataFrame:
    """frame, n, closest for every frame, those without a contact as well."""
    n = pairs.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("closest"))
    return frames.select(frame).distinct().join(n, frame, "left").select(frame, F.coalesce("n", F.lit(0)).alias("n"), "closest")


def contact_frequencies(pairs: DataFrame, frame: str, item: str, n_frames: int) -> DataFrame:
    """item, frames, proportion, mean_distance (of the closest pair of each frame)."""
    per = pairs.groupBy(item, frame).agg(F.min("distance").alias("d"))
    return per.groupBy(item).agg(F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / n_frames).alias("proportion"), F.avg("d").alias("mean_distance"))


def initial_retention(pairs: DataFrame, frame: str, item: str, first: int, frames: DataFrame) -> DataFrame:
    """frame, retained: the share of the first frame's items that each frame still has."""
    start = pairs.filter(F.col(frame) == first).select(F.col(item).alias("__i")).distinct()
    total = start.agg(F.count(F.lit(1)).alias("__n"))
    kept = pairs.select(frame, item).distinct().join(start, F.col(item) == F.col("__i"), "left_semi").groupBy(frame).agg(F.count(F.lit(1)).alias("__k"))
    rows = frames.select(frame).distinct().join(kept, frame, "left").crossJoin(F.broadcast(total))  # one row
    return rows.select(frame, F.when(F.col("__n") > 0, F.coalesce("__k", F.lit(0)) / F.col("__n")).alias("retained"))


def hydrogen_bonds(triples: DataFrame, frame: str, key: str, length: Column, degrees: Column, longest: float, least: float, n_frames: int) -> DataFrame:
    """key, frequency, mean_length, mean_angle of donor-hydrogen-acceptor triples that are short and straight enough."""
    held = triples.withColumn("__l", length).withColumn("__a", degrees).filter((F.col("__l") < longest) & (F.col("__a") > least))
    return held.groupBy(key).agg((F.countDistinct(frame) / n_frames).alias("frequency"), F.avg("__l").alias("mean_length"), F.avg("__a").alias("mean_angle"))


def diagnose_direction(rows: DataFrame, key: str, at: str, length: Column, degrees: Column, longest: float, least: float, late: float) -> DataFrame:
    """key, n, held, distance_lost, angle_lost, late_start: why a directional contact is not there.

    A frame has lost the distance, or holds it and has lost the angle; late: the first frame that holds comes after ``late``.
    """
    near, straight = length < longest, degrees > least
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(near & straight).alias("held"), F.count_if(~near).alias("distance_lost"), F.count_if(near & ~straight).alias("angle_lost"), F.min(F.when(near & straight, F.col(at))).alias("__f"))
    return out.select(key, "n", "held", "distance_lost", "angle_lost", F.coalesce(F.col("__f") > late, F.lit(False)).alias("late_start"))


def interaction_types(pairs: DataFrame, rules: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with type: of the rules (left, right, longest, type) that a pair keeps, the one of least distance.

    Rules are a closed table: those of a pair of kinds are one list, so a pair meets one row.
    """
    lists = rules.groupBy(F.col("left").alias("__l"), F.col("right").alias("__r")).agg(F.sort_array(F.collect_list(F.struct("longest", "type"))).alias("__rules"))
    rows = pairs.join(small(lists), (F.col(left) == F.col("__l")) & (F.col(right) == F.col("__r")))
    first = F.get(F.filter("__rules", lambda r: F.col("distance") <= r["longest"]), 0)
    return rows.withColumn("type", first["type"]).filter("type is not null").select(*pairs.columns, "type")


def rmsd(frames: DataFrame, reference: DataFrame, frame: str, atom: str) -> DataFrame:
    """frame, n, rmsd of the atoms that a frame shares with the reference, as they lie (no fit)."""
    ref = reference.select(F.col(atom).alias("__a"), *[F.col(c).alias(f"__{c}") for c in XYZ])
    rows = frames.join(small(ref), F.col(atom) == F.col("__a"))
    d = distance([F.col(c) for c in XYZ], [F.col(f"__{c}") for c in XYZ])
    return rows.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmsd"))


def rigid_fit(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that bring ``source`` closest to ``target`` in the least squares: rows @ rotation + shift."""
    a, b = source - source.mean(0), target - target.mean(0)
    u, _, v = np.linalg.svd(a.T @ b)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
    rotation = u @ flip @ v
    return rotation, target.mean(0) - source.mean(0) @ rotation


def fitted_rmsd(frames: DataFrame, reference: pd.DataFrame, frame: str, atom: str) -> DataFrame:
    """frame, n, rmsd after a rigid fit to the reference (its atoms, bounded); a frame is one group. Fewer than three
    shared atoms: null."""
    points = {a: (x, y, z) for a, x, y, z in reference[[atom, *XYZ]].itertuples(index=False)}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows[atom].isin(points.keys())]
        target = np.array([points[a] for a in known[atom]], dtype=float).reshape(-1, 3)
        source = known[list(XYZ)].to_numpy(float)
        value = None
        if len(source) >= 3:
            rotation, shift = rigid_fit(source, target)
            value = math.sqrt((((source @ rotation + shift) - target) ** 2).sum(1).mean())
        return pd.DataFrame({frame: [rows[frame].iloc[0]], "n": [len(source)], "rmsd": [value]}).astype({"rmsd": "float64"})

    return frames.select(F.col(frame).cast("bigint"), F.col(atom).cast("bigint"), *XYZ).groupBy(frame).applyInPandas(fit, f"{frame} bigint, n bigint, rmsd double")


def rmsf(frames: DataFrame, atom: str) -> DataFrame:
    """atom, n, rmsf: the root mean square distance of an atom from its mean place."""
    spread = sum((F.var_pop(c) for c in XYZ), F.lit(0.0))
    return frames.groupBy(atom).agg(F.count(F.lit(1)).alias("n"), F.sqrt(spread).alias("rmsf"))


def gyration(frames: DataFrame, frame: str, mass: Column) -> DataFrame:
    """frame, radius of gyration about the centre of mass, from sums alone."""
    m = F.sum(mass)
    square = sum(((F.sum(mass * F.col(c) * F.col(c)) / m - (F.sum(mass * F.col(c)) / m) * (F.sum(mass * F.col(c)) / m)) for c in XYZ), F.lit(0.0))
    return frames.groupBy(frame).agg(F.sqrt(F.greatest(F.lit(0.0), square)).alias("radius"))


def end_to_end(frames: DataFrame, frame: str, atom: str) -> DataFrame:
    """frame, length: the distance of a frame's first and last atom."""
    ends = frames.groupBy(frame).agg(F.min(F.struct(atom, *XYZ)).alias("a"), F.max(F.struct(atom, *XYZ)).alias("b"))
    return ends.select(frame, distance([F.col(f"a.{c}") for c in XYZ], [F.col(f"b.{c}") for c in XYZ]).alias("length"))


def distance_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def two_sample(df: DataFrame, group: str, value: str, left: str, right: str) -> DataFrame:
    """n_left, n_right, difference of means, and Welch's t and its degrees of freedom, from one aggregate."""
    out = df.filter(F.col(group).isin(left, right)).agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{i}") for i, g in ((0, left), (1, right)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    freedom = (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))
    return out.select(F.col("n0").alias("n_left"), F.col("n1").alias("n_right"), (F.col("m0") - F.col("m1")).alias("difference"), ((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), freedom.alias("freedom"))


def trapezoid(df: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """series, n, integral of value over at, by trapezoids between rows that follow each other."""
    w = Window.partitionBy(series).orderBy(at)
    rows = df.withColumn("__t", (F.col(at) - F.lag(at).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2)
    return rows.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__t"), F.lit(0.0)).alias("integral"))


def lambda_profile(samples: DataFrame, leg: str, step: str, value: str) -> DataFrame:
    """leg, step, n, mean, stderr of the derivative's samples at each step of a coupling."""
    n = F.count(value)
    return samples.groupBy(leg, step).agg(n.alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("stderr"))


def thermodynamic_integration(profile: DataFrame, leg: str, step: str) -> DataFrame:
    """leg, delta, error: the profile's trapezoid over its steps, and the error that the steps' errors add up to."""
    w = Window.partitionBy(leg).orderBy(step)
    before, after = F.col(step) - F.lag(step).over(w), F.lead(step).over(w) - F.col(step)
    weight = (F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))) / 2
    rows = profile.withColumn("__w", weight)
    return rows.groupBy(leg).agg(F.sum(F.col("__w") * F.col("mean")).alias("delta"), F.sqrt(F.sum(F.col("__w") * F.col("__w") * F.col("stderr") * F.col("stderr"))).alias("error"))


def binding_difference(deltas: DataFrame, leg: str, bound: str, unbound: str) -> DataFrame:
    """difference (bound less unbound leg) and its error, from one row a leg."""
    pick = lambda g, c: F.max(F.when(F.col(leg) == g, F.col(c)))
    out = deltas.agg(pick(bound, "delta").alias("b"), pick(unbound, "delta").alias("u"), pick(bound, "error").alias("e"), pick(unbound, "error").alias("f"))
    return out.select((F.col("b") - F.col("u")).alias("difference"), F.sqrt(F.col("e") * F.col("e") + F.col("f") * F.col("f")).alias("error"))


def quality_flags(results: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, flags (comma-joined, in the rules' order), ok."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return results.select(key, F.array_join(held, ",").alias("flags"), (F.size(held) == 0).alias("ok"))


def compare_estimators(results: DataFrame, key: str, estimator: str, value: str, names: Sequence[str]) -> DataFrame:
    """key, a column an estimator, and spread: the largest less the least of those that are there."""
    out = results.groupBy(key).agg(*[F.avg(F.when(F.col(estimator) == n, F.col(value))).alias(n) for n in names])
    return out.withColumn("spread", F.greatest(*names) - F.least(*names) if len(names) > 1 else F.lit(0.0))


def prefix_points(df: DataFrame, series: str, order: Sequence[str], values: Sequence[str], points: int) -> DataFrame:
    """series, point, n and the mean of each value over the rows up to the point: points of a running decomposition."""
    w = Window.partitionBy(series).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(series)))
    for v in values:
        rows = rows.withColumn(f"__{v}", F.avg(v).over(run))
    point = F.ceil(F.col("__i") * points / F.col("__n")).cast("int")
    rows = rows.withColumn("point", point).filter(F.col("__i") == F.floor(F.col("point") * F.col("__n") / points))
    return rows.select(series, "point", F.col("__i").cast("bigint").alias("n"), *[F.col(f"__{v}").alias(v) for v in values])


def work(df: DataFrame, series: str, order: Sequence[str], force: str, place: str) -> DataFrame:
    """Rows with work: force times displacement, added up along the pulling by trapezoids."""
    w = Window.partitionBy(series).orderBy(*order)
    step = (F.col(force) + F.lag(force).over(w)) / 2 * (F.col(place) - F.lag(place).over(w))
    rows = df.withColumn("__s", F.coalesce(step, F.lit(0.0)))
    return rows.withColumn("work", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def shell_counts(pairs: DataFrame, pose: str, left: str, right: str, edges: Sequence[float]) -> DataFrame:
    """pose, left, right, shell, n: pairs by half-open shells of distance [edge, next edge); closer or farther ones go."""
    shell = sum((F.when(F.col("distance") >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    rows = pairs.withColumn("shell", shell.cast("int")).filter((F.col("shell") >= 0) & (F.col("shell") < len(edges) - 1))
    return rows.groupBy(pose, left, right, "shell").agg(F.count(F.lit(1)).alias("n"))


def factorial_masks(rows: DataFrame, key: str, factors: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """key, mask, total: every combination of factors set (bit on) or reset, and the sum of the values that it takes.

    Factors are few: 2 ** k rows a key.
    """
    if not 1 <= len(factors) <= 12:
        raise ValueError("between 1 and 12 factors")
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(factors)) - 1))).alias("mask"))
    total = sum((F.when(F.col("mask").bitwiseAND(1 << i) != 0, on).otherwise(off) for i, (on, off) in enumerate(factors.values())), F.lit(0.0))
    return out.select(key, "mask", total.alias("total"))


def worst_status(rows: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """key, status: the worst of a key's checks, by a closed order from best to worst; an unknown one is an error."""
    rank = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    known = F.coalesce(rank[F.col(status)], F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(F.col(status), F.lit("null")))).cast("int"))
    out = rows.groupBy(key).agg(F.max(known).alias("__w"))
    return out.select(key, F.element_at(F.array(*[F.lit(s) for s in order]), F.col("__w") + 1).alias(status))


def site_verdict(series: DataFrame, key: str, cutoff: float, ratio: float) -> DataFrame:
    """key, left_site, unsettled: whether a series ever passed the cutoff, and whether its drift over the final third is
    larger than ``ratio`` times its fluctuation there. ``series`` is as from series.drift, with largest."""
    return series.select(key, (F.col("largest") > cutoff).alias("left_site"), F.coalesce(F.abs("drift") > ratio * F.col("fluctuation"), F.lit(False)).alias("unsettled"))


def exposed(areas: DataFrame, system: str, residue: str, area: str, whole: str, part: str) -> DataFrame:
    """residue, buried: how much less of a residue the whole system leaves open than the part alone; absent counts zero."""
    pick = lambda s: F.coalesce(F.sum(F.when(F.col(system) == s, F.col(area))), F.lit(0.0))
    return areas.filter(F.col(system).isin(whole, part)).groupBy(residue).agg((pick(part) - pick(whole)).alias("buried"))


def dense_clusters(points: DataFrame, key: str, columns: Sequence[str], radius: float, least: int) -> DataFrame:
    """key, cluster (its least core; null: noise), core: points with at least ``least`` neighbours (themselves included)
    within the radius are cores; cores in reach are one cluster, and border points join their least core.

    Neighbours come from a grid as wide as the radius, so only cubes around a point are looked at.
    """
    import itertools

    from .graph import connected_components, materialise

    cubes = F.array(*[F.floor(F.col(c) / radius).alias(c) for c in columns])
    rows = points.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], cubes.alias("cube"))
    around = F.explode(F.array(*[F.array(*[F.col("cube")[i] + s for i, s in enumerate(shift)]) for shift in itertools.product((-1, 0, 1), repeat=len(columns))])).alias("cube2")
    a = rows.select("k", *[f"v{i}" for i in range(len(columns))], around)
    b = rows.select(F.col("k").alias("m"), *[F.col(f"v{i}").alias(f"w{i}") for i in range(len(columns))], F.col("cube").alias("cube3"))
    d = sum(((F.col(f"v{i}") - F.col(f"w{i}")) * (F.col(f"v{i}") - F.col(f"w{i}")) for i in range(len(columns))), F.lit(0.0))
    near = materialise(a.join(b, (F.col("cube2") == F.col("cube3")) & (d <= radius * radius)).select("k", "m"), "near")
    cores = materialise(near.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("k"), "cores")
    links = near.join(cores, "k", "left_semi").join(cores.select(F.col("k").alias("c")), F.col("m") == F.col("c"))
    comps = connected_components(links.filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b")))
    own = cores.join(comps, F.col("k") == F.col("node"), "left").select(F.col("k").alias("c"), F.coalesce("component", "k").alias("cluster"))
    border = near.join(own, F.col("m") == F.col("c")).groupBy("k").agg(F.min("cluster").alias("b"))
    out = rows.select("k").join(own, F.col("k") == F.col("c"), "left").join(border, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("cluster", "b").alias("cluster"), F.col("cluster").isNotNull().alias("core"))
