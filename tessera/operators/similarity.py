"""Similarity of packed bit sets and vectors: nearest references, verdicts, leader and group clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reference set up to so many rows is broadcast; a larger one is compared block by block.
REFERENCE_ROWS = 50_000
BLOCK = 4096
#: Rows of a block that are compared at a time, and tasks that pairs of blocks are dealt over.
STRIP = 256
CELL_TASKS = 2000


def sign_bits(vector: Column) -> Column:
    """Bits of the positive components, packed eight a byte from the low end, as an array of small integers."""
    groups = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 8).cast("int"))
    bit = lambda g: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)), F.lit(0),
        lambda acc, i: acc + F.when(F.coalesce(F.get(vector, g * 8 + i), F.lit(0.0)) > 0, F.pow(F.lit(2.0), i).cast("int")).otherwise(0),
    )
    return F.transform(groups, bit)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all set bits of two packed sets; two empty sets have 0."""
    zipped = F.arrays_zip(a.alias("x"), b.alias("y"))
    both = F.aggregate(zipped, F.lit(0), lambda acc, p: acc + F.bit_count(p["x"].bitwiseAND(p["y"])))
    any_ = F.aggregate(zipped, F.lit(0), lambda acc, p: acc + F.bit_count(p["x"].bitwiseOR(p["y"])))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int, references_key: str | None = None, exclude_self: bool = False) -> DataFrame:
    """key, rank (from 1), neighbour, similarity: the k references of highest cosine, ties to the least id.

    Exact. The reference set is dealt into blocks; each query block meets each reference block once, keeps its k best,
    and the best of all blocks are taken last. So neither side has to fit in one task.
    """
    rk = references_key or key
    n = references.count()
    if not n:
        return queries.select(key).limit(0).selectExpr(key, "0 as rank", f"{key} as neighbour", "0.0D as similarity")
    blocks = max(1, -(-n // BLOCK))
    dealt = references.filter(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(rk), F.lit(blocks)).cast("int").alias("__b"), F.lit(1).alias("__side"), F.col(rk).cast("bigint").alias("__id"), F.col(vector).alias("__v"))
    slices = max(1, -(-queries.count() // BLOCK))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"), F.lit(0).alias("__side"), F.col(key).cast("bigint").alias("__id"), F.col(vector).alias("__v"))
    asked = asked.withColumn("__q", F.pmod(F.xxhash64("__id"), F.lit(slices)).cast("int"))
    dealt = dealt.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def best(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, r = rows[rows["__side"] == 0], rows[rows["__side"] == 1].sort_values("__id")
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []}).astype({"id": "int64", "neighbour": "int64", "similarity": "float64"})
        sims, me, ids = _unit(q["__v"]) @ _unit(r["__v"]).T, q["__id"].to_numpy(), r["__id"].to_numpy()
        if exclude_self:
            sims[me[:, None] == ids[None, :]] = -np.inf
        # all that reach a row's k-th best, ties included; then the k best of them, ties to the least id
        least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(me), -np.inf)
        i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
        order = np.lexsort((ids[j], -sims[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pd.DataFrame({"id": me[i], "neighbour": ids[j], "similarity": sims[i, j]})

    found = asked.unionByName(dealt).groupBy("__q", "__b").applyInPandas(best, "id bigint, neighbour bigint, similarity double")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k)
    top = found.groupBy("id").agg(ordered.alias("l")).select("id", F.posexplode("l").alias("p", "x"))
    return top.select(F.col("id").alias(key), (F.col("p") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("similarity"))


def similarity_verdict(similarity: Column, threshold: float, mode: str) -> Column:
    """ANNOTATE passes all, ANALOGUE those at or above the threshold, NOVELTY those at or below."""
    return {"ANNOTATE": F.lit(True), "ANALOGUE": similarity >= threshold, "NOVELTY": similarity <= threshold}[mode]


def leader_clusters(df: DataFrame, key: str, vector: str, threshold: float, group: str) -> DataFrame:
    """key, cluster_id, leader, similarity, assignment_rank: sequential leader clustering inside each group.

    Arrival order is the key's. A row joins the leader of strictly highest similarity if that reaches the threshold,
    else it leads a new cluster with similarity 1. The algorithm is sequential by nature, so a group is one task;
    its leaders, not its rows, are compared.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x, ids = _unit(rows[vector]), rows[key].to_numpy()
        leaders, counts, out = np.empty((64, x.shape[1])), [], []  # grows by doubling
        who: list[int] = []
        for i, me in enumerate(ids.tolist()):
            s = leaders[: len(who)] @ x[i]
            j = int(s.argmax()) if len(s) else -1
            if j >= 0 and s[j] >= threshold:
                counts[j] += 1
                out.append((me, who[j], float(s[j]), counts[j]))
            else:
                if len(who) == len(leaders):
                    leaders = np.concatenate([leaders, np.empty_like(leaders)])
                leaders[len(who)] = x[i]
                who.append(me)
                counts.append(0)
                out.append((me, me, 1.0, 0))
        got = pd.DataFrame(out, columns=[key, "leader", "similarity", "assignment_rank"])
        got["cluster_id"] = [f"cluster:sha256:{hashlib.sha256(str(w).encode()).hexdigest()}" for w in got["leader"]]
        return got[[key, "cluster_id", "leader", "similarity", "assignment_rank"]]

    schema = f"{key} bigint, cluster_id string, leader bigint, similarity double, assignment_rank bigint"
    return df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector, group).groupBy(group).applyInPandas(assign, schema)


def group_clusters(df: DataFrame, key: str, group: str) -> DataFrame:
    """key, cluster_id, representative and its flag: a cluster is a group, represented by its least id."""
    least = df.groupBy(group).agg(F.max(group).alias("__g"), F.min(key).alias("representative")).drop(group)
    out = df.join(least, F.col(group) == F.col("__g"))
    name = F.concat(F.lit("cluster:sha256:"), F.sha2(F.col(group).cast("string").cast("binary"), 256))
    return out.select(key, name.alias("cluster_id"), "representative", (F.col(key) == F.col("representative")).alias("is_representative"))


def bits_set(packed: Column) -> Column:
    return F.aggregate(packed, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def _bits_in_blocks(df: DataFrame, key: str, bits: str, width: int, blocks: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, __b, ids, bits: rows dealt into blocks by a hash of the key, one row a block, in order of key; packed bits one
    after another, filled up with empty bytes to the same width. Rows without bits are left out."""
    filled = F.concat(F.col(bits), F.array_repeat(F.lit(0), F.lit(width) - F.size(bits)))
    rows = df.filter(F.col(bits).isNotNull() & F.col(key).isNotNull()).select(*by, F.pmod(F.xxhash64(key), blocks).cast("int").alias("__b"), F.struct(F.col(key).alias("k"), F.transform(filled, lambda x: F.coalesce(x, F.lit(0)).cast("smallint")).alias("v")).alias("r"))
    dealt = rows.groupBy(*by, "__b").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return dealt.select(*by, "__b", F.col("r.k").alias("ids"), F.flatten("r.v").alias("bits"))


def _in_cells(sides: Sequence[DataFrame], by: Sequence[str], cells: int) -> DataFrame:
    """ids0, bits0, ids1, bits1: two blocks that meet, in one row. ``sides`` are the blocks, with __x and __y, the cell's
    place. Cells are dealt over tasks of their own: they are small to send and long to compare."""
    each = [s.select(*by, "__x", "__y", F.struct("ids", "bits").alias("s0" if i == 0 else "s1")) for i, s in enumerate(sides)]
    both = each[0].withColumn("s1", F.lit(None).cast(each[0].schema["s0"].dataType)).unionByName(each[1].withColumn("s0", F.lit(None).cast(each[1].schema["s1"].dataType)))
    met = both.repartition(max(1, min(cells, CELL_TASKS)), *by, "__x", "__y").groupBy(*by, "__x", "__y").agg(F.first("s0.ids", True).alias("ids0"), F.first("s0.bits", True).alias("bits0"), F.first("s1.ids", True).alias("ids1"), F.first("s1.bits", True).alias("bits1"))
    return met.filter("bits0 is not null and bits1 is not null").select("ids0", "bits0", "ids1", "bits1")


def _shares(width: int, row) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """A cell's shares of common bits in double precision, strip by strip: the strip's rows, ids of both sides, shares.
    Products of 0s and 1s are whole numbers, exact in single precision up to 2**24."""
    x, y = (np.unpackbits(np.asarray(b, dtype=np.uint8).reshape(-1, width), axis=1).astype(np.float32) for b in (row.bits0, row.bits1))
    ids0, ids1, nx, ny, t = np.asarray(row.ids0), np.asarray(row.ids1), x.sum(1), y.sum(1), np.ascontiguousarray(y.T)
    for at in range(0, len(x), STRIP):
        part = slice(at, at + STRIP)
        both = x[part] @ t
        any_ = nx[part, None] + ny[None, :]
        any_ -= both
        np.maximum(any_, 1, out=any_)  # two empty sets have 0
        yield part, ids0, ids1, np.divide(both, any_, dtype=np.float64)


def _extent(df: DataFrame, bits: str) -> tuple[int, int]:
    """The widest packed bits, and the number of blocks."""
    width, n = df.agg(F.max(F.size(bits)), F.count(F.lit(1))).first()
    return width or 0, max(1, -(-n // BLOCK))


def tanimoto_neighbours(queries: DataFrame, references: DataFrame, key: str, bits: str, threshold: float, k: int) -> DataFrame:
    """key, rank, neighbour, similarity: up to k references that reach the threshold, ties to the least id. Exact.

    Every query meets every reference, block by block, by matrix products of the bits; a query keeps its k best of each
    block, and the best of all blocks are taken last. Empty sets resemble nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    mine = _extent(queries, bits)
    other = mine if references is queries else _extent(references, bits)
    width, m, n = max(mine[0], other[0]), mine[1], other[1]
    kind = queries.schema[key].dataType.simpleString()
    if width < 1:
        return queries.limit(0).select(key, F.lit(0).alias("rank"), F.col(key).alias("neighbour"), F.lit(0.0).alias("similarity"))
    q = _bits_in_blocks(queries, key, bits, width, F.lit(m)).select("*", F.col("__b").alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__y"))
    r = _bits_in_blocks(references, key, bits, width, F.lit(n)).select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("__x"), F.col("__b").alias("__y"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (x for b in batches for x in b.itertuples(index=False)):
            for part, ids0, ids1, s in _shares(width, row):
                s[ids0[part, None] == ids1[None, :]] = -1
                asked, left = ids0[part], np.arange(len(s))
                for _ in range(min(k, s.shape[1])):  # the first of the largest has the least id
                    j = s[left].argmax(1) if len(left) < len(s) else s.argmax(1)
                    v = s[left, j]
                    left, j, v = left[v >= threshold], j[v >= threshold], v[v >= threshold]
                    if not len(left):
                        break
                    yield pd.DataFrame({"q": asked[left], "neighbour": ids1[j], "similarity": v})
                    s[left, j] = -1

    found = _in_cells([q, r], [], m * n).mapInPandas(best, f"q {kind}, neighbour {kind}, similarity double")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k)
    top = found.groupBy("q").agg(ordered.alias("l")).select("q", F.posexplode("l").alias("p", "x"))
    return top.select(F.col("q").alias(key), (F.col("p") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("similarity"))


def pair_graph(df: DataFrame, key: str, series: str, bits: str, least: float) -> DataFrame:
    """a, b, core: unordered pairs inside a series whose shared share of bits is enough for an edge.

    A series of any size is dealt into blocks, and every two of them meet in a task of their own, by matrix products of the
    bits; pairs below the share leave no row.
    """
    width = _extent(df, bits)[0]
    kind = df.schema[key].dataType.simpleString()
    if width < 1:
        return df.limit(0).select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("core"))
    sizes = df.filter(F.col(series).isNotNull()).groupBy(series).agg(F.max(series).alias("__s"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__n")).drop(series)
    cells = sizes.agg(F.sum(F.col("__n").cast("bigint") * (F.col("__n") + 1) / 2)).first()[0] or 1
    blocks = _bits_in_blocks(df.join(sizes, F.col(series) == F.col("__s")), key, bits, width, F.col("__n"), ["__s", "__n"])
    x = blocks.select("*", F.col("__b").alias("__x"), F.explode(F.sequence(F.col("__b"), F.col("__n") - 1)).alias("__y"))
    y = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("__b"))).alias("__x"), F.col("__b").alias("__y"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (x for b in batches for x in b.itertuples(index=False)):
            itself = row.ids0[0] == row.ids1[0]  # then it has each pair twice; two blocks have no key in common
            for part, ids0, ids1, s in _shares(width, row):
                i, j = np.nonzero(s >= least)
                a, b, v = ids0[part][i], ids1[j], s[i, j]
                up = a < b
                if itself:
                    a, b, v = a[up], b[up], v[up]
                else:
                    a, b = np.where(up, a, b), np.where(up, b, a)
                yield pd.DataFrame({"a": a, "b": b, "core": v})

    return _in_cells([x, y], ["__s"], int(cells)).mapInPandas(linked, f"a {kind}, b {kind}, core double")
