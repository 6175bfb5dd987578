"""Quality rules: rule statistics of a text, and an isolation forest over them.

Random splits isolate documents whose statistics lie where few clean ones do: their path from the root is short. The
forest is grown from a bounded sample of labelled clean rows inside the exact box of all rows, so empty regions have
short paths. The threshold on the score is calibrated on all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, flag_texts, hash_share, map_arrow, require, stored

_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\x0b\x0c\r"
_NOT_CHARS = _BLANKS + _CONTINUATION
#: Fixed value: the symbols that rules count.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"!?~^="
#: Words of ASCII punctuation alone.
_BARE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
WINDOW = 8
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) | 1 for j in range(1, WINDOW + 1)], dtype=np.uint64)

#: Features of the forest. None depends on a text's length as such, so long and short clean texts look alike.
FEATURES = ("word_len", "symbols", "upper", "bare", "marks", "dup_lines", "repeats", "echoes")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text holds twice or more (all of them count).

    Windows are matched by a 64-bit hash, and those that it matches are compared word for word.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    m = n - WINDOW + 1
    key = np.zeros(m, dtype=np.uint64)
    for j in range(WINDOW):
        key += (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29))) * _WEIGHTS[j]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    if not same.any():
        return 0
    twin = np.zeros(m, dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at = np.flatnonzero(twin).tolist()
    seen: dict[tuple[bytes, ...], int] = {}
    tuples = [tuple(words[i : i + WINDOW]) for i in at]
    for t in tuples:
        seen[t] = seen.get(t, 0) + 1
    cover = np.zeros(n + 1, dtype=np.int64)
    for i, t in zip(at, tuples, strict=True):
        if seen[t] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1 if i + WINDOW <= n else 0
    return int((np.cumsum(cover)[:n] > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then counts that only the forest uses."""
    if not text:
        return (0,) * 11
    words = text.split()
    word_chars = len(text.translate(None, _NOT_CHARS))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    return (
        len(words), word_chars, count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), count(_UPPER), len(_BARE.findall(text)), count(_MARKS), echoes, len(set(words)),
    )


STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bare", "n_marks", "n_echoes", "n_distinct")


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of STAT_COLUMNS for every row: a narrow map over whole texts."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t) for t in byte_texts(batch)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T)], ["doc_id", *STAT_COLUMNS])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STAT_COLUMNS))


def features(s: pd.DataFrame) -> np.ndarray:
    words, chars = np.maximum(s["n_words"].to_numpy(float), 1), np.maximum(s["word_chars"].to_numpy(float), 1)
    share = lambda name, of: np.minimum(s[name].to_numpy(float) / of, 1.0)
    return np.column_stack([
        np.minimum(chars / words, 40.0), share("n_symbols", chars), share("n_upper", chars), share("n_bare", words), share("n_marks", chars),
        share("n_dup_lines", np.maximum(s["n_lines"].to_numpy(float), 1)), share("n_repeat_words", words), share("n_echoes", words),
    ])


def _unsuccessful(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (or -1), split, left child (right is left + 1), and path length of a leaf."""

    trees: int = 100
    rows: int = 256
    depth: int = 10
    seed: int = 7

    def fit(self, clean: np.ndarray, box: np.ndarray) -> IsolationForest:
        """``clean``: rows to grow from. ``box``: rows whose range the splits are drawn from; the two ends will do."""
        rng = np.random.default_rng(self.seed)
        low, high = np.minimum(box.min(0), clean.min(0)), np.maximum(box.max(0), clean.max(0))
        self.forest = []
        for _ in range(self.trees):
            pick = clean[rng.choice(len(clean), min(self.rows, len(clean)), replace=False)]
            feature, split, left, path = [-1], [0.0], [0], [0.0]
            todo = [(0, pick, low.copy(), high.copy(), 0)]
            while todo:
                at, x, lo, hi, d = todo.pop()
                path[at] = d + float(_unsuccessful(len(x)))
                wide = np.flatnonzero(hi > lo)
                if d >= self.depth or len(x) <= 1 or not len(wide):
                    continue
                f = int(rng.choice(wide))
                # half of the splits inside the rows' own range, half anywhere in the region
                a, b = (lo[f], hi[f]) if rng.random() < 0.5 or x[:, f].min() == x[:, f].max() else (x[:, f].min(), x[:, f].max())
                q = float(rng.uniform(a, b))
                child = len(feature)
                feature[at], split[at], left[at] = f, q, child
                feature += [-1, -1]
                split += [0.0, 0.0]
                left += [0, 0]
                path += [0.0, 0.0]
                below = x[:, f] < q
                hi_l, lo_r = hi.copy(), lo.copy()
                hi_l[f], lo_r[f] = q, q
                todo += [(child, x[below], lo, hi_l, d + 1), (child + 1, x[~below], lo_r, hi, d + 1)]
            self.forest.append((np.array(feature), np.array(split), np.array(left), np.array(path)))
        self.scale = float(_unsuccessful(min(self.rows, len(clean)))) or 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, left, path in self.forest:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return np.power(2.0, -total / len(self.forest) / self.scale)


@dataclass(frozen=True)
class QualityModel:
    """``threshold``: scores above it are anomalous; infinite without labels of both kinds."""

    forest: IsolationForest | None
    threshold: float


#: Bounds of the fit: labelled clean rows to grow trees from. Bins of the calibration.
FIT_ROWS = 20_000
BINS = 2_000
#: The share of labelled clean rows that the threshold may reject.
CLEAN_LOSS = 0.002
MIN_WORDS = 20
REPEAT_PERCENT = 30


def with_base(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    model = stats.sparkSession.sparkContext.broadcast(forest)  # trees x rows nodes, a bounded size

    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(model.value.score(features(s)))

    return stats.withColumn("score", score(F.struct(*STAT_COLUMNS)))


def _sample(rows: DataFrame) -> pd.DataFrame:
    """About FIT_ROWS rows by their hash, in its order; of equal rows one."""
    u = hash_share("doc_id", *STAT_COLUMNS)
    n = max(1, rows.count())
    some = rows.select(u.alias("u"), *STAT_COLUMNS).filter(F.col("u") <= FIT_ROWS / n).dropDuplicates(["u"])
    return some.toPandas().sort_values(["u", *STAT_COLUMNS]).drop(columns="u")


def _box(stats: DataFrame) -> np.ndarray:
    """The least and the largest value of each feature over all rows: a row a batch, then one in all."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in batches:
            if len(s):
                x = features(s)
                yield pd.DataFrame([[*x.min(0), *x.max(0)]], columns=[*lows, *highs])

    lows, highs = [f"low_{f}" for f in FEATURES], [f"high_{f}" for f in FEATURES]
    found = stats.select(*STAT_COLUMNS).mapInPandas(ends, ", ".join(f"{c} double" for c in [*lows, *highs]))
    row = found.agg(*(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs)).first()
    return np.array(row, dtype=float).reshape(2, len(FEATURES))


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Forest from about FIT_ROWS distinct clean rows (those with the smallest hashes) in the box of all rows that have
    MIN_WORDS words; threshold from all labelled ones.

    Rows with quality 1 are clean, with 0 not; an id that is labelled both ways counts as not clean. The threshold
    is the score with the best balance of kept clean and rejected other rows among those that lose at most CLEAN_LOSS
    of the clean rows; it is read off a histogram of BINS bins, whatever the number of labels.
    """
    # its key is an aggregate, so that the join gets exchanges of its own, in which an id of very many rows is split
    kind = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("doc_id").alias("of"), F.min("quality").alias("quality")).drop("doc_id")
    known = with_base(stats).join(kind, F.col("doc_id") == F.col("of")).drop("of").filter(~F.col("base_failed"))
    known = stored(known, "known")  # counts only
    clean = _sample(known.filter("quality = 1"))
    if len(clean) < 2:
        return QualityModel(None, math.inf)
    forest = IsolationForest().fit(features(clean), _box(stats.filter(f"n_words >= {MIN_WORDS}")))
    scored = _scored(known, forest).withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"))
    hist = scored.groupBy("bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")).toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    good[hist["bin"]], bad[hist["bin"]] = hist["good"], hist["bad"]
    if not bad.sum():
        return QualityModel(forest, math.inf)
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    merit = np.where(lost <= CLEAN_LOSS, caught - lost, -1.0)
    best = int(np.flatnonzero(merit == merit.max())[-1])
    return QualityModel(forest, (best + 1) / BINS)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of every row.

    Texts are read once; their statistics are written to the shared folder and used from there. Null and empty texts
    have no words and fail the base rule. Repeated rows and null ids are judged by their own text; ties in the sample
    are broken by id. Without labels of both kinds the base rule decides alone. An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    return judge(stored(rule_stats(docs), "quality"), labels)


def judge(stats: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_quality(stats, labels)
    out = with_base(stats)
    out = out.withColumn("score", F.lit(0.0)) if model.forest is None else _scored(out, model.forest)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(model.threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_rules keeps; no row is shuffled.

    The model is fitted on the statistics of all rows; a second narrow pass judges every text by it.
    """
    model = fit_quality(stored(rule_stats(docs), "quality"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[bytes | None]) -> list[bool]:
        m = shared.value
        rows = pd.DataFrame([text_stats(t) for t in texts], columns=list(STAT_COLUMNS))
        ok = ((rows["n_words"] >= MIN_WORDS) & (100 * rows["n_repeat_words"] <= REPEAT_PERCENT * rows["n_words"])).to_numpy()
        if m.forest is not None and len(rows):
            ok &= m.forest.score(features(rows)) <= m.threshold
        return ok.tolist()

    return docs.filter(flag_texts(good, binary=True)("text"))
