"""MinHash near-dedup with bottom-k sketches of a single hash function.

Every text becomes the set of its word shingles' 64-bit hashes; its sketch is the K smallest. Texts with equal sets
form a class and go on as one. Two sets that reach the threshold share at least t retained values (see ``agreed``), so
they share one of the m - t + 1 rarest of their m retained values: inverted lists of just those generate candidates.
Lists of up to COLD members yield their pairs. Members of a longer list meet its pivot, and those that the pivot doesn't
resemble meet all others of about their size, sketch against sketch in blocks. Whatever meets has to pass the estimate
from the union's sketch. The connected groups of what passes are the candidate families: within them, and only there,
full sets are compared, in blocks, and links go out as spanning stars, never as pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import byte_texts, fresh, map_arrow, require, stored

WORDS = 5
PERCENT = 80
#: Retained values a sketch; a list's members up to which all its pairs are candidates; full sets, and sketches, a block.
K = 64
COLD = 64
BLOCK = 256
SKETCH_BLOCK = 1024
#: The chance that the estimate, or the number of shared values, of a pair just at the threshold falls below its bound.
MISS = 1e-6
_COLUMNS = 8192

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending, as signed 64-bit integers.

    A-Z are lower-cased; words are runs of other than ASCII white space. Fewer words than a shingle has count as one
    shingle; a null text, or one without words, has none.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(tokens))
    m = len(tokens) - width + 1
    acc = np.full(m, width, dtype=np.uint64)
    for j in range(width):
        acc = _mixed(acc * _C1 + h[j : j + m])
    return np.unique(acc.view(np.int64))


@cache
def least_shared(n: int, percent: int = PERCENT) -> int:
    """The largest number that fewer of n samples reach with a chance of MISS at most, if each is shared with the
    threshold's chance. (Samples are drawn without replacement, which only narrows this.)"""
    share, below, at = percent / 100, 0.0, 0
    while at <= n:
        below += math.comb(n, at) * share**at * (1 - share) ** (n - at)
        if below > MISS:
            break
        at += 1
    return at


def agreed(n: int, k: int = K, percent: int = PERCENT) -> int:
    """How many retained values a set of n surely shares with any set that reaches the threshold.

    Where the partner's sketch holds its whole set (n at most the threshold's share of k) this is exact; else retained
    values are a sample, and the number is its least_shared.
    """
    if n * 100 <= k * percent:
        return max(1, -(-n * percent // 100))
    return max(1, least_shared(min(n, k), percent))


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if members.size else None


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the full set; null if empty), sketch (the K smallest, ascending) and mark (of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in byte_texts(batch)]
            low = [s[:K] for s in sets]
            offsets = np.zeros(len(low) + 1, dtype=np.int32)
            np.cumsum([len(s) for s in low], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(low)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), lists, batch.column("mark")],
                ["doc_id", "n_shingles", "digest", "sketch", "mark"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", mark_of("text").alias("mark"))
    return map_arrow(rows, run, "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>, mark string")


def mark_of(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """digest and members (as bytes) of the full set of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in byte_texts(batch) if (s := shingle_set(t, words)).size]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "members"])

    return map_arrow(docs.select("text"), run, "digest binary, members binary")


def _prefix_length(n: Column, k: int, percent: int) -> Column:
    """m - t + 1 of ``agreed``, from a literal table."""
    table = F.array(*[F.lit(min(i, k) - agreed(i, k, percent) + 1) for i in range(1, k + 2)])
    return F.element_at(table, F.least(n, F.lit(k + 1)).cast("int"))


def rare_entries(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """value, df, node: of each sketch the rarest values that a similar sketch must share one of, if others hold them.

    Values that a single sketch holds are the rarest; they need no row, only their number counts.
    """
    values = classes.select("node", F.explode("sketch").alias("value"))
    df = values.groupBy("value").agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("df")).filter("df > 1").select("v", "df")
    held = values.join(df, F.col("value") == F.col("v")).groupBy("node").agg(F.collect_list(F.struct("df", "value")).alias("held"))
    sized = held.join(classes.select(F.col("node").alias("of"), "n"), F.col("node") == F.col("of"))
    alone = F.least("n", F.lit(K)) - F.size("held")
    rest = F.greatest(_prefix_length(F.col("n"), K, percent) - alone, F.lit(0)).cast("int")
    return sized.select("node", F.explode(F.slice(F.array_sort("held"), F.lit(1), rest)).alias("e")).select("e.value", "e.df", "node")


def _reach(n: Column, sketch: Column) -> Column:
    """Up to which value a sketch knows its set; null: all of it."""
    return F.when(n > K, F.element_at(sketch, -1))


def similar_estimate(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate from the union's sketch, and whose sizes, leave the threshold possible.

    The union's sketch is all that both sketches know: values up to where the shorter-reaching one ends.
    """
    side = lambda x: classes.select(F.col("node").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"), _reach(F.col("n"), F.col("sketch")).alias(f"{x}_r"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    both = both.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    both = both.withColumn("reach", F.least("a_r", "b_r")).withColumn("shared", F.size(F.array_intersect("a_s", "b_s")))
    known = lambda x: F.when(F.col("reach").isNull(), F.size(f"{x}_s")).otherwise(F.size(F.filter(f"{x}_s", lambda v: v <= F.col("reach"))))
    union = (known("a") + known("b") - F.col("shared")).cast("int")
    least = F.array(*[F.lit(least_shared(i, percent)) for i in range(1, 2 * K + 1)])
    return both.filter(F.col("shared") >= F.element_at(least, union)).select("a", "b")


def _estimate_block(percent: int):
    """Spanning stars of the pairs of a block's left (0) and right (1) rows that pass the estimate of similar_estimate."""
    least = np.array([0, *[least_shared(i, percent) for i in range(1, 2 * K + 1)]])
    far = np.iinfo(np.int64).max

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0].drop_duplicates("node"), rows[rows["side"] == 1].drop_duplicates("node")
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ls, rs = [np.asarray(x) for x in left["sketch"]], [np.asarray(x) for x in right["sketch"]]
        ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
        reach = lambda sets, n: np.array([s[-1] if m > K else far for s, m in zip(sets, n, strict=True)])
        lr, rr = reach(ls, ln), reach(rs, rn)
        shared = common_counts(ls, rs)
        # of each set, how much of it is known up to where the other one's knowledge ends
        of_left = np.array([np.searchsorted(s, np.minimum(rr, r), "right") for s, r in zip(ls, lr, strict=True)])
        of_right = np.array([np.searchsorted(s, np.minimum(lr, r), "right") for s, r in zip(rs, rr, strict=True)]).T
        union = of_left + of_right - shared
        near = np.minimum.outer(ln, rn) * 100 >= np.maximum.outer(ln, rn) * percent
        lid, rid = left["node"].to_numpy(), right["node"].to_numpy()
        return local_stars(near & (shared >= least[np.minimum(union, 2 * K)]) & (lid[:, None] != rid[None, :]), lid, rid)

    return run


def dealt(lefts: DataFrame, rights: DataFrame, group: list[str], size: int, columns: list[str]) -> DataFrame:
    """All blocks of ``size`` left by ``size`` right rows of each group: side (0 and 1), ``columns`` and block, their key.

    The key is one number, so that the blocks of a hot group go to different tasks.
    """
    both = lefts.select(*group, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(rights.select(*group, F.lit(0).alias("l"), F.lit(1).alias("r")))
    blocks = lambda c: F.ceil(F.sum(c) / size).cast("int")
    # the keys as aggregates: the join's sides get exchanges of their own, in which a hot group is split
    counts = both.groupBy(*group).agg(*[F.max(g).alias(f"of_{g}") for g in group], blocks("l").alias("lefts"), blocks("r").alias("rights")).drop(*group)
    counts = counts.filter((F.col("lefts") > 0) & (F.col("rights") > 0))
    same = lambda df: df.join(counts, [F.col(g) == F.col(f"of_{g}") for g in group])
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = same(lefts).withColumn("i", part("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0))
    right = same(rights).withColumn("j", part("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1))
    out = left.select(*group, "i", "j", "side", *columns).unionByName(right.select(*group, "i", "j", "side", *columns))
    return out.select(F.xxhash64(*group, "i", "j").alias("block"), "side", *columns)


def candidate_edges(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs that pass the estimate, or spanning stars of such pairs."""
    entries = stored(rare_entries(classes, percent), "entries")
    cold = entries.filter(F.col("df") <= COLD).groupBy("value").agg(F.array_sort(F.collect_list("node")).alias("l")).filter(F.size("l") > 1)
    pairs = F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> named_struct('a', x, 'b', y))))")
    pairs = cold.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a != b")
    hot = entries.filter(F.col("df") > COLD)
    pivots = hot.groupBy("value").agg(F.max("value").alias("v"), F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))).alias("p")).select("v", F.col("p.node").alias("b"))
    ties = stored(hot.join(pivots, F.col("value") == F.col("v")).select(F.col("node").alias("a"), "b").filter("a != b").distinct(), "ties")
    tied = stored(similar_estimate(ties, classes, percent), "tied")
    return similar_estimate(pairs.distinct(), classes, percent).unionByName(tied).unionByName(_left_by_pivots(ties, tied, classes, percent))


def _left_by_pivots(ties: DataFrame, tied: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: what passes the estimate between those that didn't with a pivot and all that share a value with it.

    Only sets of about one size meet: sizes fall into classes as wide as the threshold allows, and a class meets its
    neighbours.
    """
    width = math.log(100 / percent) if percent < 100 else 1.0
    left = ties.join(tied.select(F.col("a").alias("ta"), F.col("b").alias("tb")), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    about = classes.select(F.col("node").alias("of"), "n", "sketch", F.floor(F.log("n") / width).cast("int").alias("own"))
    known = lambda df: df.join(about, F.col("a") == F.col("of")).select(F.col("b").alias("pivot"), F.col("a").alias("node"), "n", "sketch", "own")
    lefts = stored(known(left).withColumnRenamed("own", "kind"), "left")
    open_ = lefts.groupBy("pivot").agg(F.max("pivot").alias("p")).select("p")
    rights = known(ties.join(open_, F.col("b") == F.col("p"), "left_semi")).withColumn("kind", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    blocks = dealt(lefts, rights, ["pivot", "kind"], SKETCH_BLOCK, ["node", "n", "sketch"])
    return blocks.groupBy("block").applyInPandas(_estimate_block(percent), "a bigint, b bigint")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the values that both sides hold, some columns at a time."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    lrow, rrow = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])

    def placed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        ok = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    (lc, lr), (rc, rr) = placed(lv, lrow), placed(rv, rrow)
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(shared), _COLUMNS):
        width = min(_COLUMNS, len(shared) - lo)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = np.searchsorted(lc, [lo, lo + width])
        a[lr[i:j], lc[i:j] - lo] = 1
        i, j = np.searchsorted(rc, [lo, lo + width])
        b[rr[i:j], rc[i:j] - lo] = 1
        out += a @ b.T
    return out.astype(np.int64)


def local_stars(linked: np.ndarray, lid: np.ndarray, rid: np.ndarray) -> pd.DataFrame:
    """a, b: of each group that the links of a block connect, every member with the least one."""
    none = np.iinfo(np.int64).max
    on_left, on_right = linked.any(1), linked.any(0)
    sub, a, b = linked[np.ix_(on_left, on_right)], lid[on_left], rid[on_right]
    while a.size:
        a2 = np.minimum(a, np.where(sub, b[None, :], none).min(1))
        b2 = np.minimum(b, np.where(sub, a2[:, None], none).min(0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    out = pd.DataFrame({"a": np.concatenate([lid[on_left], rid[on_right]]), "b": np.concatenate([a, b])})
    return out[out["a"] != out["b"]].astype("int64")


def _verify(percent: int):
    """Links between the left (0) and right (1) rows of a block; side 2 is on both."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ls, rs = [np.frombuffer(x, "<i8") for x in left["members"]], [np.frombuffer(x, "<i8") for x in right["members"]]
        both = common_counts(ls, rs)
        size = np.array([len(s) for s in ls])[:, None] + np.array([len(s) for s in rs])[None, :] - both
        lid, rid = left["node"].to_numpy(), right["node"].to_numpy()
        return local_stars((100 * both >= percent * size) & (lid[:, None] != rid[None, :]), lid, rid)

    return run


def verified_links(families: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: spanning links among the nodes of each family, by comparing their full sets.

    ``families`` has node, component and the set's digest, ``sets`` digest and members. A family of up to BLOCK nodes is one block. Of a
    larger one, all are first compared with its pivot, block by block; those that it doesn't link to are compared with
    the whole family in blocks of BLOCK by BLOCK.
    """
    sizes = families.groupBy("component").agg(F.max("component").alias("family"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("p"))).alias("least"))
    sizes = sizes.select("family", "size", F.col("least.p").alias("pivot"))
    member = families.join(sizes, F.col("component") == F.col("family")).select("node", F.col("digest").alias("of"), "family", "size", "pivot")
    full = stored(sets.join(member, F.col("digest") == F.col("of")).select("node", "members", "family", "size", "pivot"), "sets")
    schema, columns = "a bigint, b bigint", ["node", "members"]
    small = full.filter(F.col("size") <= BLOCK).select(F.xxhash64("family", F.lit(0), F.lit(-1)).alias("block"), F.lit(2).alias("side"), *columns)
    large = full.filter(F.col("size") > BLOCK)
    rows = small.unionByName(dealt(large.filter("node != pivot"), large.filter("node = pivot"), ["family"], BLOCK, columns))
    links = stored(rows.groupBy("block").applyInPandas(_verify(percent), schema), "links")
    # of a star around a pivot every member has the least one as its b; who is tied to the pivot's group is settled
    ends = links.select(F.col("a").alias("t")).unionByName(links.select(F.col("b").alias("t"))).distinct()
    left_over = large.join(ends, F.col("node") == F.col("t"), "left_anti").filter("node != pivot")
    rest = dealt(left_over, large, ["family"], BLOCK, columns).groupBy("block").applyInPandas(_verify(percent), schema)
    return links.unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null texts and those without words have an empty set and link with nothing. Rows with a null id keep their counts
    and link with nothing (their component is null, and they are kept). Rows that repeat an id count as one document
    wherever their texts are equal; where they differ, each row follows its own text. Equal sets are one class however
    often they occur. An empty table gives an empty result; further columns are ignored.
    """
    return judged(docs, words, percent).drop("mark")


def judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates and the mark of the row's text."""
    require(docs, "doc_id", "text")
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be in 1..100 and words positive")
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs, words), "sketches")
    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.max("digest").alias("class"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    # a class is a node; its number is written once, so it stays what it is
    classes = stored(classes.drop("digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    families = stored(connected_components(candidate_edges(classes, percent)), "families")
    about = classes.select(F.col("node").alias("of"), "rep", F.col("class").alias("digest"))
    wanted = stored(families.join(about, F.col("node") == F.col("of")).select("node", "component", "rep", "digest"), "wanted")
    texts = docs.join(wanted.select(F.col("rep").alias("w")).distinct(), F.col("doc_id").cast("bigint") == F.col("w"), "left_semi")
    sets = full_sets(texts, words).groupBy("digest").agg(F.first("members").alias("members"))  # repeated rows once
    comps = connected_components(verified_links(wanted, sets, percent))
    least = comps.join(classes.select(F.col("node").alias("of"), "rep"), F.col("node") == F.col("of")).groupBy("component").agg(F.max("component").alias("c"), F.min("rep").alias("least")).drop("component")
    linked = comps.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("of"), "least")
    about = classes.select("class", "rep", "node").join(linked, F.col("node") == F.col("of"), "left")
    about = about.groupBy("class").agg(F.max("class").alias("k"), F.min(F.coalesce("least", "rep")).alias("component")).drop("class")
    out = rows.select("doc_id", "n_shingles", "mark", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(about, F.col("digest") == F.col("k"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "mark")


def keep_representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that near_duplicates keeps: one of each group.

    Of rows that repeat both id and text one stays. Rows with a null id link with nothing, and stay. Texts are shuffled
    once, to meet the ids that go, usually far fewer than those that stay. Columns of any name pass unchanged.
    """
    verdict = judged(docs, words, percent).filter("doc_id is not null").groupBy("doc_id", "mark").agg(F.count_if("kept").alias("n"))
    key, mark, n = fresh(docs, "key", "mark", "n")
    settled = stored(verdict.filter("n <> 1").select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("n").alias(n)), "not-once")
    same = (F.col("doc_id").cast("bigint") == F.col(key)) & (mark_of("text") == F.col(mark))
    # what goes grows with the input: texts and it meet by a shuffle at every size
    kept = docs.join(settled.hint("merge"), same, "left_anti")
    more = settled.filter(F.col(n) > 1)
    if more.isEmpty():
        return kept
    again = docs.join(more.hint("merge"), same, "left_semi").withColumn(mark, mark_of("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.unionByName(again)
