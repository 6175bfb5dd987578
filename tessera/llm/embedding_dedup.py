"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one vector kept a group.

A vector is at home in the cell of its nearest centroid. So that no link across a border is lost, it also visits every
cell in which a vector within the threshold's angle of it may be at home: those whose bisecting plane is no farther
than the sine of that angle. Cells that are too large are cut again, by centroids of their own, as long as that saves
comparisons. Home rows of a cell are compared with all rows of the cell, in blocks of BLOCK by BLOCK.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import hash_share, require, stored

THRESHOLD = 0.93
BLOCK = 1024
#: Rows of the largest label a cell; cells of the first cut; rows that centroids are fitted on.
CELL_ROWS = 4096
MAX_CELLS = 1024
FIT_ROWS = 20_000
ROUNDS = 12
#: Home rows above which a cell is cut again, and into how many cells at a time; rows that a task assigns; cuts after
#: each other; the share of comparisons that a cut may leave.
SPLIT_ROWS = 32_768
SPLIT_CELLS = 64
CHUNK = 8_192
CUTS = 8
WORTH = 0.7


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def homes_and_visits(unit: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and which cells it has to be compared in (its home included)."""
    p = unit @ centroids.T
    home = p.argmax(1)
    gap = p[np.arange(len(p)), home][:, None] - p
    apart = np.linalg.norm(centroids[home][:, None, :] - centroids[None, :, :], axis=2) if len(centroids) <= 64 else np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)[home]))
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    return home, gap <= reach * apart


def usable(values: pa.Array) -> np.ndarray:
    """Rows of an array column that are vectors: not null, no null or non-finite component, not all zero."""
    flat, starts, size = _flat(values)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(size))
    return (bad == 0) & (np.bincount(row, weights=flat != 0, minlength=len(size)) > 0)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as doubles (null: not a number), and where each row's begin and how many they are (null: none)."""
    flat = values.flatten().cast(pa.float64())
    size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.to_numpy(zero_copy_only=False), np.cumsum(size) - size, size


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and vec (double components as bytes, null if the row links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("embedding")
            ok = usable(col) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            flat, starts, size = _flat(col)
            data = flat.astype("<f8").tobytes()
            rows = [data[8 * a : 8 * (a + n)] if good else None for a, n, good in zip(starts.tolist(), size.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32(), mask=~ok), pa.array(rows, pa.binary())], ["vec_id", "label", "dim", "vec"]
            )

    return vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, label bigint, dim int, vec binary")


def _matrix(rows: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float):
    """One block of home rows against one block of a cell's rows: counts of links, and a spanning star per local group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        linked = _matrix(left["vec"]) @ _matrix(right["vec"]).T >= threshold
        lid, rid = left["rep"].to_numpy(), right["rep"].to_numpy()
        linked &= lid[:, None] != rid[None, :]
        links = linked @ right["n"].to_numpy()
        lroot, rroot = lid.copy(), rid.copy()
        on_left, on_right = linked.any(1), linked.any(0)
        if on_left.any():
            sub = linked[np.ix_(on_left, on_right)]
            a, b, none = lroot[on_left], rroot[on_right], np.iinfo(np.int64).max
            while True:
                a2 = np.minimum(a, np.where(sub, b[None, :], none).min(1))
                b2 = np.minimum(b, np.where(sub, a2[:, None], none).min(0))
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
            lroot[on_left], rroot[on_right] = a, b
        return pd.DataFrame({
            "rep": np.concatenate([lid[on_left], rid[on_right]]),
            "links": np.concatenate([links[on_left], np.zeros(int(on_right.sum()), dtype=np.int64)]),
            "root": np.concatenate([lroot[on_left], rroot[on_right]]),
        })

    return run


_CELL = ["label", "dim", "cell"]
_PLACED = "rep bigint, n bigint, label bigint, dim int, vec binary, cell bigint, at_home boolean"


def _sizes(placed: DataFrame) -> DataFrame:
    """k_label, k_dim, k_cell, n_home, n_all of every cell with home rows; keys as aggregates, so that joins can split hot cells."""
    sizes = placed.groupBy(*_CELL).agg(*[F.max(c).alias(f"k_{c}") for c in _CELL], F.sum(F.col("at_home").cast("bigint")).alias("n_home"), F.count(F.lit(1)).alias("n_all"))
    return sizes.drop(*_CELL).filter("n_home > 0")


def _of(sizes: DataFrame):
    return [F.col(c) == F.col(f"k_{c}") for c in _CELL]


def cut_large_cells(placed: DataFrame, threshold: float) -> DataFrame:
    """The placed rows, with cells of more than SPLIT_ROWS home rows cut again and again where that saves comparisons.

    Centroids of a cell come from about FIT_ROWS of its home rows; all its rows are assigned in chunks, each beside the
    centroids. A row stays at home in one cell, and visits every new cell that its reach touches. Cells without clusters
    are left as they are: every row would visit every part.
    """
    done = None
    for _ in range(CUTS):
        sizes = stored(_sizes(placed), "sizes")
        large = sizes.filter(F.col("n_home") > SPLIT_ROWS)
        if large.isEmpty():
            break
        rows = placed.join(large, _of(large))
        few = rows.filter(F.col("at_home") & (F.xxhash64("rep", F.lit(7)) / F.lit(float(1 << 64)) + 0.5 <= FIT_ROWS / F.col("n_home")))

        def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            k = min(SPLIT_CELLS, math.ceil(int(part["n_home"].iloc[0]) / CELL_ROWS), len(part))
            return pd.DataFrame({"c_label": [key[0]], "c_dim": [key[1]], "c_cell": [key[2]], "centroids": [spherical_kmeans(_matrix(part.sort_values("rep")["vec"]), max(2, k)).astype("<f8").tobytes()]})

        centroids = stored(few.select(*_CELL, "rep", "vec", "n_home").groupBy(*_CELL).applyInPandas(fit, "c_label bigint, c_dim int, c_cell bigint, centroids binary"), "centroids")
        chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n_all") / CHUNK))
        dealt = rows.select(*_CELL, "rep", "n", "vec", "at_home", chunk.alias("chunk"))
        beside = centroids.join(large, (F.col("c_label") == F.col("k_label")) & (F.col("c_dim") == F.col("k_dim")) & (F.col("c_cell") == F.col("k_cell")))
        beside = beside.select(F.col("c_label").alias("label"), F.col("c_dim").alias("dim"), F.col("c_cell").alias("cell"), "centroids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_all") / CHUNK) - 1)).alias("chunk"))

        def assign(key: tuple, part: pd.DataFrame, with_: pd.DataFrame) -> pd.DataFrame:
            if part.empty or with_.empty:
                return pd.DataFrame({c: [] for c in ("rep", "n", "label", "dim", "vec", "cell", "at_home", "part")})
            c = np.frombuffer(with_["centroids"].iloc[0], "<f8").reshape(-1, int(key[1]))
            home, visits = homes_and_visits(_matrix(part["vec"]), c, threshold)
            at, cell = np.nonzero(visits)
            out = part.iloc[at][["rep", "n", "label", "dim", "vec", "cell"]].reset_index(drop=True)
            out["at_home"] = part["at_home"].to_numpy()[at] & (home[at] == cell)
            out["part"] = cell
            return out

        keys = [*_CELL, "chunk"]
        parts = dealt.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInPandas(assign, _PLACED + ", part int")
        parts = stored(parts.withColumn("new", F.xxhash64("cell", "part")), "parts")
        work = parts.groupBy(*_CELL, "new").agg((F.sum(F.col("at_home").cast("double")) * F.count(F.lit(1))).alias("w")).groupBy(*_CELL).agg(*[F.max(c).alias(f"w_{c}") for c in _CELL], F.sum("w").alias("after")).drop(*_CELL)
        better = large.join(work, [F.col(f"k_{c}") == F.col(f"w_{c}") for c in _CELL]).filter(F.col("after") <= WORTH * F.col("n_home") * F.col("n_all"))
        better = stored(better.select(*[F.col(f"k_{c}").alias(f"b_{c}") for c in _CELL]), "better")
        same = [F.col(c) == F.col(f"b_{c}") for c in _CELL]
        left = placed.join(better, same, "left_anti")
        if better.isEmpty():
            break
        gone = large.select(*[F.col(f"k_{c}").alias(f"b_{c}") for c in _CELL]).join(better.withColumnsRenamed({f"b_{c}": f"g_{c}" for c in _CELL}), [F.col(f"b_{c}") == F.col(f"g_{c}") for c in _CELL], "left_anti")
        stuck = left.join(gone, same, "left_semi")  # large, but not worth a cut: settled as they are
        settled = stored(stuck.select(*placed.columns), "settled")
        done = settled if done is None else done.unionByName(settled)
        cut = parts.join(better, same, "left_semi").select("rep", "n", "label", "dim", "vec", F.col("new").alias("cell"), "at_home")
        placed = stored(left.join(gone, same, "left_anti").select(*placed.columns).unionByName(cut), "cells")
    return placed if done is None else placed.unionByName(done)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors are compared only where label and length are equal. Null labels, null or zero vectors and those with null
    or non-finite components link with nothing; neither do rows with a null id (their component is null, and they are
    kept). Equal vectors of a label are compared once, as a class, and counted as often as they occur. An empty table
    gives an empty result; further columns are ignored.

    Centroids are fitted on about FIT_ROWS classes; every class is assigned, and large cells are cut again. Blocks bound
    a task at 2 * BLOCK vectors; links go out as counts and spanning stars, never as pairs.
    """
    require(vectors, "vec_id", "embedding", "label")
    spark = vectors.sparkSession
    rows = stored(_prepared(vectors).withColumn("digest", F.md5(F.concat_ws(":", "label", "dim", F.md5("vec")))), "vectors")
    valid = rows.filter("vec is not null and vec_id is not null")
    classes = stored(
        valid.groupBy("digest").agg(
            F.max("digest").alias("class"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
            F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        ).drop("digest"),
        "classes",
    )
    shape = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    most = classes.filter(F.col("dim") == (shape["dim"] if shape else 0)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    k = min(MAX_CELLS, max(1, math.ceil(most / CELL_ROWS)))
    centroids = None
    if k > 1:
        u = hash_share("rep")
        sample = classes.filter((F.col("dim") == shape["dim"]) & (u <= FIT_ROWS / shape["n"])).select(u.alias("u"), "vec").toPandas().sort_values("u")
        centroids = spherical_kmeans(_matrix(sample["vec"]), k)
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_CELLS rows

    @F.pandas_udf("struct<home:int,cells:array<int>>")
    def cells_of(vecs: pd.Series) -> pd.DataFrame:
        c, home, cells = shared.value, [0] * len(vecs), [[0]] * len(vecs)
        at = np.flatnonzero([c is not None and len(v) == 8 * c.shape[1] for v in vecs])
        if at.size:
            h, visits = homes_and_visits(_matrix(vecs.iloc[at]), c, threshold)
            for i, x, row in zip(at.tolist(), h.tolist(), visits, strict=True):
                home[i], cells[i] = x, np.flatnonzero(row).tolist()
        return pd.DataFrame({"home": home, "cells": cells})

    placed = classes.withColumn("c", cells_of("vec")).select("rep", "n", "label", "dim", "vec", "c.home", F.explode("c.cells").alias("cell"))
    placed = placed.select("rep", "n", "label", "dim", "vec", F.col("cell").cast("bigint").alias("cell"), (F.col("home") == F.col("cell")).alias("at_home"))
    placed = cut_large_cells(stored(placed, "cells"), threshold)
    sizes = _sizes(placed).select("k_label", "k_dim", "k_cell", F.ceil(F.col("n_home") / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("rights"))
    sized = placed.join(sizes, (F.col("label") == F.col("k_label")) & (F.col("dim") == F.col("k_dim")) & (F.col("cell") == F.col("k_cell")))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    columns = ["label", "dim", "cell", "i", "j", "side", "rep", "n", "vec"]
    left = sized.filter("at_home").withColumn("i", part("lefts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    right = sized.withColumn("j", part("rights")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    both = left.select(columns).unionByName(right.select(columns))
    both = both.withColumn("block", F.xxhash64("label", "dim", "cell", "i", "j"))  # one key, so that a hot cell's blocks go to different tasks
    found = stored(both.groupBy("block").applyInPandas(_compare(threshold), "rep bigint, links bigint, root bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = classes.select("class", "rep", "n").join(links.withColumnRenamed("rep", "l_rep"), F.col("rep") == F.col("l_rep"), "left")
    about = about.join(comps, F.col("rep") == F.col("node"), "left")
    about = about.groupBy("class").agg(  # one row each; its own key, so that a hot class can be split in the next join
        F.max("class").alias("k"), F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component")
    ).drop("class")
    out = rows.select("vec_id", F.when(F.col("vec").isNotNull() & F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(about, F.col("digest") == F.col("k"), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
