"""Language identification by a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3) that both hold, over the geometric mean of how
many each holds. Letters are lower-cased, whatever their script, and a run of all else is one character; n-grams are
hashed into a fixed number of codes for each n. Landmarks are a bounded, hashed choice of learning texts; a document's
kernel row against them is one matrix product of presence vectors, normalised, and mapped through the inverse root of
the landmarks' own kernel (Nystroem). One kernel ridge regression per language, one-versus-rest, gives the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flag_texts, fold_of, hash_share, map_arrow, require

#: Codes of 1-, 2- and 3-grams, as powers of two.
BITS = (12, 14, 17)
SIZE = sum(1 << b for b in BITS)
#: Bounds of the fit: languages (the most frequent ones), landmarks and learning rows in all, and of each language at most.
LANGUAGES = 2_000
MARKS = 512
SAMPLE = 8_000
LANDMARKS = 24
FIT_ROWS = 400
RIDGE = 1e-2
#: Entries of a block's presence matrix.
BLOCK = 1 << 24
UNKNOWN = "und"


class Letters:
    """Text to numbers: 0 for a run of non-letters, else the lower-cased letter's code point. LOW of them by a table."""

    LOW = 0x600

    def __init__(self) -> None:
        self.low = np.array([self._letter(i) for i in range(self.LOW)], dtype=np.uint32)
        self.high: dict[int, int] = {}

    @staticmethod
    def _letter(point: int) -> int:
        c = chr(point)
        return ord(c.lower()[0]) if c.isalpha() else 0

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.low[np.minimum(points, self.LOW - 1)]
        far = np.flatnonzero(points >= self.LOW)
        if far.size:
            found, at = np.unique(points[far], return_inverse=True)
            for p in found.tolist():
                if p not in self.high:
                    self.high[p] = self._letter(p)
            out[far] = np.array([self.high[p] for p in found.tolist()], dtype=np.uint32)[at]
        gap = out == 0
        again = np.flatnonzero(gap[1:] & gap[:-1])
        return np.delete(out, again + 1) if again.size else out


_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def ngrams(letters: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Codes of the distinct 1-, 2- and 3-grams, ascending. ``seen`` is an all-false work array of SIZE."""
    if not letters.size:
        return np.empty(0, np.int64)
    key, base = letters.astype(np.uint64), 0
    for n, bits in enumerate(BITS):
        if n:
            key = (key[:-1] << np.uint64(21)) | letters[n:]  # a code point has 21 bits, so three of them fit
        seen[(key * _ODD[n] >> np.uint64(64 - bits)) + np.uint64(base)] = True
        base += 1 << bits
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class LanguageModel:
    """``column``: n-gram code to column of the landmarks' presence matrix, or -1."""

    labels: list[str]
    column: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def rows(self) -> int:
        """Texts of a block."""
        return max(16, BLOCK // max(1, self.presence.shape[1]))

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel rows against all landmarks: one matrix product a block."""
        parts = []
        for lo in range(0, len(grams), self.rows()):
            some = grams[lo : lo + self.rows()]
            rows = np.zeros((len(some), self.presence.shape[1]), dtype=np.float32)
            for i, g in enumerate(some):
                c = self.column[g]
                rows[i, c[c >= 0]] = 1.0
            n = np.array([max(1, len(g)) for g in some], dtype=np.float64)
            parts.append((rows @ self.presence.T) / np.sqrt(n[:, None] * self.sizes[None, :]))
        return np.concatenate(parts)

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Pseudo-probabilities of the languages: the regressions' values, sharpened (more so among many) and normalised."""
        k = self.kernel(grams)
        value = np.hstack([k, np.ones((len(k), 1))]) @ self.weights
        value = np.exp((value - value.max(1, keepdims=True)) * (4.0 + math.log(max(4, len(self.labels)) / 4)))
        return value / value.sum(1, keepdims=True)


def fit_language(grams: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on rows' n-grams in the given order: the first ``landmarks`` of each language are landmarks (fewer if there
    are MARKS of them in all), all are regressed on."""
    labels = sorted(set(langs))
    order: dict[str, list[int]] = {lang: [] for lang in labels}
    for i, x in enumerate(langs):
        order[x].append(i)
    each = max(1, min(landmarks, MARKS // len(labels)))
    often = sorted(labels, key=lambda x: (-len(order[x]), x))[:MARKS]
    marks = [i for lang in sorted(often) for i in order[lang][:each]]
    used = np.unique(np.concatenate([grams[i] for i in marks]))
    column = np.full(SIZE, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    presence = np.zeros((len(marks), len(used)), dtype=np.float32)
    for row, i in enumerate(marks):
        presence[row, column[grams[i]]] = 1.0
    sizes = np.array([max(1, len(grams[i])) for i in marks], dtype=np.float64)
    model = LanguageModel(labels, column, presence, sizes, np.zeros((len(marks) + 1, len(labels))))
    among = model.kernel([grams[i] for i in marks])
    value, vector = np.linalg.eigh((among + among.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # Nystroem: features are kernel rows times this
    feats = model.kernel(grams) @ root
    number = {x: i for i, x in enumerate(labels)}
    at = np.array([number[x] for x in langs])
    target = np.full((len(langs), len(labels)), -1.0)
    target[np.arange(len(langs)), at] = 1.0
    share = (1.0 / np.bincount(at))[at][:, None] * len(langs) / len(labels)
    mean, goal = (feats * share).sum(0) / share.sum(), (target * share).sum(0) / share.sum()
    centred = feats - mean
    beta = np.linalg.solve((centred * share).T @ centred + ridge * len(langs) * np.eye(centred.shape[1]), (centred * share).T @ (target - goal))
    model.weights = np.vstack([root @ beta, (goal - mean @ beta)[None, :]])
    return model


def learn(docs: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """Learns from rows with text and lang whose crc32(doc_id) mod 3 is not 1; None if there are none.

    A bounded sample is enough: of every language the distinct rows with the smallest hashes, FIT_ROWS at most, and
    fewer where there are so many languages that SAMPLE rows would not do. Of more than LANGUAGES languages the most
    frequent ones are learnt. Only n-gram codes come to the driver, at most SIZE of a row, however long its text.
    """
    known = docs.filter("doc_id is not null and text is not null and lang is not null").filter(F.coalesce(fold_of(F.col("doc_id"), 3) != 1, F.lit(True)))
    known = known.select("lang", "text", hash_share("doc_id", "text").alias("u"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("u").alias("d")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    each = max(4, min(fit_rows, SAMPLE // len(counts)))
    # rows are even in u, so twice the expected share surely holds enough of them; the rest is cut on the driver
    cuts = [(r["lang"], min(1.0, (2 * each + 200) / max(1, r["d"]))) for r in counts]
    below = lambda cuts: known.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "l string, cut double")), F.col("lang") == F.col("l")).filter("u <= cut")
    chosen: dict[str, list[float]] = {}
    for r in below(cuts).select("lang", "u").distinct().collect():
        chosen.setdefault(r["lang"], []).append(r["u"])
    cuts = [(lang, sorted(us)[:each][-1]) for lang, us in sorted(chosen.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = Letters(), np.zeros(SIZE, dtype=bool)
        for batch in batches:
            of = [letters.of(t) for t in batch.column("text").to_pylist()]
            grams = pa.array([ngrams(x, seen).astype(np.int32) if x.any() else None for x in of], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("u"), grams], ["lang", "u", "grams"])

    rows = map_arrow(below(cuts).select("lang", "u", "text").dropDuplicates(["lang", "u"]), run, "lang string, u double, grams array<int>")
    rows = rows.filter("grams is not null").toPandas().sort_values(["lang", "u"])
    return fit_language([np.asarray(g) for g in rows["grams"]], rows["lang"].tolist(), landmarks) if len(rows) else None


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, from its text alone: a narrow map, blocks of matrix products.

    Null texts, and texts without a letter, are ``und`` with score 0; so is every text where nothing could be learnt.
    Whole texts count, however long. Repeated rows and null ids stay.
    """
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x their n-grams: bounded by the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, a block of texts a matrix product."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    seen, letters, block = np.zeros(SIZE, dtype=bool), _letters(), model.rows()
    for lo in range(0, len(texts), block):
        at, grams = [], []
        for i in range(lo, min(lo + block, len(texts))):
            if texts[i]:
                c = letters.of(texts[i])
                if c.any():
                    at.append(i)
                    grams.append(ngrams(c, seen))
        if at:
            s = model.scores(grams)
            for i, best, row in zip(at, s.argmax(1).tolist(), s, strict=True):
                langs[i], scores[i] = model.labels[best], float(row[best])
    return langs, scores


@cache
def _letters() -> Letters:
    return Letters()


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is identified with at least that score.

    Learns from ``docs`` itself; where nothing can be learnt every row would be ``und``, and all go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def known(texts: list[str | None]) -> list[bool]:
        langs, scores = predict(shared.value, texts)
        return [lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)]

    return docs.filter(flag_texts(known)("text"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from ``docs`` and predicts every row; adds held_out (crc32 of the id as text mod 3 is 1).

    An empty table gives an empty result. lang, source and doc_id are not inputs of a prediction.
    """
    require(docs, "doc_id", "text", "lang")
    return identify(docs, learn(docs)).withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)))
