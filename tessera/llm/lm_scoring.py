"""LM scoring: a gated recurrent language model with a class-factored softmax.

Counts of all learning tokens come from the whole corpus. The most frequent words are words of the model; any other
word is one of BUCKETS buckets (by its last bytes), and inside its bucket it has its share of the corpus counts plus
one, the rest being left to unseen words. So the model gives a proper probability to every text. The network learns by
truncated backpropagation through time; its output biases start from the corpus counts. It starts on a bounded, hashed
sample of learning documents, then learns from every token of all of them in ROUNDS rounds: each task trains a copy on its
part of the round's documents, and the copies are averaged by their tokens in the shared folder. So the weights depend a
little on how the table is cut into files. Documents are scored whole: lanes run through them in windows, and the state is
carried from window to window until the document ends. They are learned from whole, too, in segments that run side by
side, each led in by some tokens of the one before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hash_share, map_arrow, require, stored

#: The token after a text's last word; no word is empty.
END = b""
#: Words the workers know with their counts (a table of bounded size); the rest are looked up by a join.
KNOWN = 200_000
#: Words of the model (END among them) at least, and buckets for all other words; words_for has the growth.
WORDS = 4_096
BUCKETS = 256
TAIL = 3
HIDDEN = 16
CLASSES = 48
#: The start of learning: tokens of the sample, learning rate.
FIT_TOKENS = 600_000
RATE = 0.02
#: Learning from all rows: rounds, the first one's rate, tokens of a copy at most (of more than a few copies a core), and
#: copies that a task adds up.
ROUNDS = 3
ROUND_RATE = 0.01
COPY_TOKENS = 200_000_000
FAN = 4
#: Learning: lanes and steps of a window, tokens of a lane's segment, and of what leads into it; the tables' rate.
ROUND_LANES = 512
ROUND_STEPS = 16
SEGMENT = 512
WARM = 32
TABLE_RATE = 16.0
#: Scoring: documents at a time, and steps of a window when there are as many.
LANES = 768
STEPS = 32
#: Bytes of text that are counted at a time.
COUNT_BYTES = 16 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts (A-Z lower-cased, null: none) as bytes, and where each text's begin (and the last end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    starts = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    starts -= starts[0]
    empty = pc.equal(pc.binary_length(words), 0)  # white space at a text's ends
    if pc.any(empty).as_py():
        starts -= np.concatenate([[0], np.cumsum(empty.to_numpy(zero_copy_only=False))])[starts]
        words = words.filter(pc.invert(empty))
    return words.cast(pa.binary()), starts


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-TAIL:]) % BUCKETS


#: The crc of a single byte, without its first and last inversions: the table of the bytewise algorithm.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for i in range(256)], dtype=np.uint32)


def buckets_of(words: pa.Array) -> np.ndarray:
    """bucket_of every word of a binary array."""
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(1, np.uint8)
    size = np.minimum(np.diff(ends), TAIL)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in range(TAIL, 0, -1):
        on = size >= back
        at = ends[1:][on] - back
        crc[on] = _CRC[(crc[on] ^ data[at]) & np.uint32(0xFF)] ^ (crc[on] >> np.uint32(8))
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(fold_of(F.col("doc_id"), 7) != 2, F.lit(True)))


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes, lower-cased; END as empty) and c over all whole texts; summed slice by slice before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = split_words(batch.column("text"))[0].value_counts()
            words, c = pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field("values"), words]), pa.concat_arrays([counts.field("counts"), c])], ["word", "c"])

    return map_arrow(docs.select("text"), run, "word binary, c bigint", limit=COUNT_BYTES).groupBy("word").agg(F.sum("c").alias("c"))


class Network:
    """GRU over word vectors, then softmax over classes and over the words of the class.

    Words are kept in order of frequency, so that a class is a range of them; ``place`` is a word's place in it.
    """

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        n = len(counts)
        # words in order of frequency, cut so that classes hold equal sums of root counts
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order] + 1.0))
        _, cls = np.unique(np.minimum((mass - mass[0]) / mass[-1] * classes, classes - 1).astype(int), return_inverse=True)
        self.n_classes = int(cls.max()) + 1
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.class_of = cls.astype(np.uint16)
        self.edges = np.searchsorted(cls, np.arange(self.n_classes + 1)).tolist()
        p = ((counts + 1.0) / (counts + 1.0).sum())[order]
        by_class = np.bincount(cls, weights=p, minlength=self.n_classes)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.par = {
            "e": small(n, hidden) * 3, "w": small(hidden, 3 * hidden) * 3, "u": small(hidden, 3 * hidden) * 2, "b": np.zeros(3 * hidden, np.float32),
            "wc": small(hidden, self.n_classes) * 0.1, "bc": np.log(by_class).astype(np.float32),
            "wo": small(n, hidden) * 0.1, "bo": np.log(p / by_class[cls]).astype(np.float32),
        }
        self.hidden = hidden

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of a window (steps x lanes), and the last one.

        A step has an update and a reset gate, (1 + tanh) / 2 each, and a candidate. ``keep`` gets, for the way back,
        the word vectors and the steps' gates, inner parts and candidates.
        """
        par, k = self.par, self.hidden
        steps, lanes = inputs.shape
        words = par["e"].take(inputs.ravel(), axis=0)
        kind = words.dtype
        words = words.reshape(steps, lanes, -1)
        u, w, b, inner_b = par["u"], par["w"], par["b"][: 2 * k], par["b"][2 * k :]
        out = np.empty((steps, lanes, k), kind)
        n = steps if keep is not None else 1
        gates, inner, cand = np.empty((n, lanes, 2 * k), kind), np.empty((n, lanes, k), kind), np.empty((n, lanes, k), kind)
        if keep is not None:
            keep += [words, gates, inner, cand]
        a, x = np.empty((lanes, 3 * k), kind), np.empty((lanes, 3 * k), kind)
        h = h.astype(kind, copy=False)
        for t in range(steps):
            i = t if keep is not None else 0
            np.matmul(h, u, out=a)
            np.matmul(words[t], w, out=x)
            g, y, c, new = gates[i], inner[i], cand[i], out[t]
            np.add(x[:, : 2 * k], a[:, : 2 * k], out=g)
            g += b
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.add(a[:, 2 * k :], inner_b, out=y)
            np.multiply(g[:, k:], y, out=c)
            c += x[:, 2 * k :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            new *= g[:, :k]
            new += c
            h = new
        return out, h

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(word | class) of each target, for rows of states."""
        return self._output(states, targets, None)[0]

    def bounded(self) -> bool:
        """Whether no output can overflow an exponential, as no state is beyond 1: their largest needn't be taken off."""
        par = self.par
        return bool(np.abs(par["wc"]).sum(0).max() + np.abs(par["bc"]).max() < 80 and np.abs(par["wo"]).sum(1).max() + np.abs(par["bo"]).max() < 80)

    def _output(self, states: np.ndarray, targets: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, dict, np.ndarray | None]:
        """Log probabilities; with ``weight`` also the gradients of -(weight * them).sum(), and those by the states."""
        par, safe = self.par, self.bounded()
        place = self.place[targets]
        cls = self.class_of[place]
        order = np.argsort(cls, kind="stable")
        cls, place, rows = cls[order], place[order], states.take(order, axis=0)
        edge = np.searchsorted(cls, np.arange(self.n_classes + 1)).tolist()
        every, ones = np.arange(len(order)), np.ones(max(len(order), len(self.place)), rows.dtype)
        grad: dict = {}
        if weight is not None:
            weight = weight[order].astype(rows.dtype)
            grad["wo"], grad["bo"] = np.zeros_like(par["wo"]), np.zeros_like(par["bo"])

        def one(some: np.ndarray, matrix: np.ndarray, bias: np.ndarray, pick: np.ndarray, w: np.ndarray | None) -> tuple:
            """Logs of the picked columns' softmax, and the gradients by matrix, bias and rows."""
            x = some @ matrix.T
            x += bias
            if not safe:
                x -= x.max(1, keepdims=True)
            flat, width = x.ravel(), x.shape[1]
            at = every[: len(some)] * width + pick
            logs = flat[at]
            np.exp(x, out=x)
            total = x @ ones[:width]
            logs -= np.log(total)
            if w is None:
                return (logs,)
            x *= (w / total)[:, None]
            flat[at] -= w
            return logs, x.T @ some, ones[: len(some)] @ x, x @ matrix

        found, *back = one(rows, par["wc"].T, par["bc"], cls, weight)
        if weight is not None:
            grad["wc"], grad["bc"] = back[0].T, back[1]
        for c in range(self.n_classes):
            (i, j), (lo, hi) = edge[c : c + 2], self.edges[c : c + 2]
            if i == j or hi - lo < 2:
                continue
            logs, *more = one(rows[i:j], par["wo"][lo:hi], par["bo"][lo:hi], place[i:j] - lo, None if weight is None else weight[i:j])
            found[i:j] += logs
            if weight is not None:
                grad["wo"][lo:hi], grad["bo"][lo:hi] = more[0], more[1]
                back[2][i:j] += more[2]
        out = np.empty_like(found)
        out[order] = found
        if weight is None:
            return out, grad, None
        unsorted = np.empty_like(rows)
        unsorted[order] = back[2]
        return out, grad, unsorted

    def backward(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h0: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean negative log-likelihood over a window, the state after it, and the loss."""
        par, k = self.par, self.hidden
        kept: list = []
        states, last = self.states(inputs, h0, kept)
        words, gates, inner, cand = kept
        w = mask.ravel() / max(1.0, float(mask.sum()))
        found, grad, dh = self._output(states.reshape(-1, k), targets.ravel(), w)
        loss = -float((found * w).sum())
        dh = dh.reshape(states.shape)
        before = np.concatenate([h0[None].astype(states.dtype, copy=False), states[:-1]])
        z, r = gates[:, :, :k], gates[:, :, k:]
        # what a step's gradient is multiplied by on its way to the gates' and the candidate's arguments
        to_z, to_c = 2 * (before - cand) * z * (1 - z), (1 - z) * (1 - cand * cand)
        to_r = 2 * inner * r * (1 - r)
        dx = np.empty((*inputs.shape, 3 * k), states.dtype)
        g = np.empty((inputs.shape[1], 3 * k), states.dtype)
        ut, carry, du = par["u"].T.copy(), np.zeros_like(before[0]), np.zeros_like(par["u"])
        db = np.zeros_like(par["b"])
        for t in range(len(inputs) - 1, -1, -1):
            d = dh[t]
            d += carry
            row = dx[t]
            np.multiply(d, to_z[t], out=row[:, :k])
            dc = row[:, 2 * k :]
            np.multiply(d, to_c[t], out=dc)
            np.multiply(dc, to_r[t], out=row[:, k : 2 * k])
            g[:, : 2 * k] = row[:, : 2 * k]
            np.multiply(dc, r[t], out=g[:, 2 * k :])
            du += before[t].T @ g
            carry = g @ ut
            d *= z[t]
            carry += d
        to_r = dx[:, :, 2 * k :] * r
        dx = dx.reshape(-1, 3 * k)
        ones = np.ones(len(dx), dx.dtype)
        db[: 2 * k], db[2 * k :] = (ones @ dx)[: 2 * k], ones @ to_r.reshape(-1, k)
        grad |= {"u": du, "b": db, "w": words.reshape(len(dx), -1).T @ dx}
        de = dx @ par["w"].T
        at = inputs.ravel().astype(np.uint16 if len(par["e"]) < 1 << 16 else np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        grad["e"] = np.zeros_like(par["e"])
        grad["e"][at[first]] = np.add.reduceat(de.take(order, axis=0), first, axis=0)
        return grad, last, loss


#: Parameters with a row per word.
TABLES = ("e", "wo", "bo")


class Steps:
    """Steps of bounded norm: Adam's, and Adagrad's for the tables; the rate rises over the first 20.

    Squares are of gradients times LARGE: numbers near the least that a float can hold are slow.
    """

    LARGE = 1e4

    def __init__(self, net: Network) -> None:
        self.net, self.count = net, 0
        self.m = {n: np.zeros_like(v) for n, v in net.par.items() if n not in TABLES}
        self.s = {n: np.full_like(v, 1e-8 * self.LARGE**2 if n in TABLES else 0.0) for n, v in net.par.items()}

    def update(self, grad: dict, rate: float) -> None:
        self.count += 1
        scale = self.LARGE * min(1.0, 1.0 / (math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) + 1e-9))
        lr = rate * min(1.0, self.count / 20)
        for n, g in grad.items():
            g *= scale
            s = self.s[n]
            if n in TABLES:
                s += g * g
                g /= np.sqrt(s)
                g *= TABLE_RATE * lr
            else:
                m = self.m[n]
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                g[...] = m / (np.sqrt(s / (1 - 0.99**self.count)) + 1e-6 * self.LARGE)
                g *= lr / (1 - 0.9**self.count)
            self.net.par[n] -= g


def segments(docs: Iterable[np.ndarray], start: int) -> Iterator[tuple[np.ndarray, int]]:
    """Texts in parts of at most SEGMENT tokens: the part after the token before it, and how many to learn from.

    A part that is not a text's first is led in by WARM tokens more, from which nothing is learnt: they make its state.
    """
    for text in docs:
        for lo in range(0, len(text), SEGMENT):
            lead = min(lo, WARM)
            part = text[max(0, lo - lead - 1) : lo + SEGMENT]
            yield (part if lo > lead else np.concatenate([[start], part])), min(SEGMENT, len(text) - lo)


def train_lanes(net: Network, start: int, docs: Iterable[np.ndarray], rate: float, lanes: int = ROUND_LANES, steps: int = ROUND_STEPS) -> int:
    """Truncated backpropagation through every token of a stream of documents; their number.

    Each lane runs through a segment in windows, with the state carried from window to window, and then takes the next
    one, with a state of zeros. A window that is not full makes a step that is shorter in proportion.
    """
    source, steps_of, n = segments(docs, start), Steps(net), 0
    parts: list[np.ndarray] = []
    learnt = np.empty(0, np.int64)
    at = np.empty(0, np.int64)
    h = np.empty((0, net.hidden), np.float32)
    while True:
        fresh = list(islice(source, lanes - len(parts)))
        if fresh:
            parts += [p for p, _ in fresh]
            learnt = np.concatenate([learnt, [len(p) - m for p, m in fresh]])  # the place of the first token to learn
            at = np.concatenate([at, np.zeros(len(fresh), np.int64)])
            h = np.concatenate([h, np.zeros((len(fresh), net.hidden), h.dtype)])
        if not parts:
            return n
        length = np.minimum([len(p) - 1 for p in parts] - at, steps)
        width, longest = len(parts), int(length.max())
        both = np.full((width, longest + 1), start, np.int64)
        for row, p, a, k in zip(both, parts, at.tolist(), length.tolist(), strict=True):
            row[: k + 1] = p[a : a + k + 1]
        place = np.arange(longest)
        mask = ((place < length[:, None]) & (at[:, None] + place + 1 >= learnt[:, None])).T
        both = both.T
        grad, h, _ = net.backward(np.ascontiguousarray(both[:-1]), np.ascontiguousarray(both[1:]), mask, h)
        tokens = int(mask.sum())
        if tokens:
            steps_of.update(grad, rate * min(1.0, tokens / (lanes * steps)))
        n += tokens
        at = at + length
        left = np.flatnonzero(at < np.array([len(p) - 1 for p in parts]))
        if len(left) < width:
            parts, learnt, at, h = [parts[i] for i in left.tolist()], learnt[left], at[left], h[left]


@dataclass
class Model:
    """``known``: words; ``ids``: their model words or buckets (after the words); ``c``: their counts; ``end``: END's row.

    ``inside``: log10 of the denominator of a bucket's words. ``n`` and ``v``: learning tokens, distinct ones.
    """

    known: pa.Array
    end: int
    ids: np.ndarray
    c: np.ndarray
    inside: np.ndarray
    n_words: int
    n: int
    v: int
    net: Network


def frequent(vocab: DataFrame) -> DataFrame:
    """Words of the highest counts, at most KNOWN of them: those above a count read off a histogram of eighths of octaves."""
    octave = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted((r["o"], r["n"]) for r in vocab.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, held = (sizes[-1][0] + 1 if sizes else 0), 0
    for o, n in reversed(sizes):
        if held + n > KNOWN:
            break
        least, held = o, held + n
    return vocab.filter(octave >= least)


def words_for(n: int) -> int:
    """Words of the model for n learning tokens: they grow with the root of n, much as a corpus' words do."""
    return min(KNOWN, max(WORDS, math.isqrt(n) // 2))


def learn(docs: DataFrame, vocab: DataFrame) -> Model:
    """Fits on learning rows. ``vocab`` is their count_words."""
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = sorted(frequent(vocab).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    words, counts = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], dtype=np.int64)
    size = words_for(int(n))
    model_words = words[: size - 1] if END in words[: size - 1] else [END, *words[: size - 2]]
    chosen = {w: i for i, w in enumerate(model_words)}
    tail = F.pmod(F.crc32(F.expr(f"substring(word, -{TAIL}, {TAIL})")), F.lit(BUCKETS)).cast("int")
    sums = {r["b"]: (r["n"], r["v"]) for r in vocab.groupBy(tail.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    bn, bv = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, (x, y) in sums.items():
        bn[b], bv[b] = x, y
    count_of = dict(zip(words, counts.tolist(), strict=True))
    for w in model_words:
        if w in count_of:
            bn[bucket_of(w)] -= count_of[w]
            bv[bucket_of(w)] -= 1
    ids = np.array([chosen.get(w, len(model_words) + bucket_of(w)) for w in words], dtype=np.int32)
    net = Network(np.concatenate([[count_of.get(w, 0) for w in model_words], bn]).astype(float), classes=int(CLASSES * max(1.0, size / WORDS) ** 0.5))
    if END not in count_of:
        words, ids, counts = [*words, END], np.append(ids, np.int32(chosen[END])), np.append(counts, 0)
    model = Model(pa.array(words, pa.binary()), words.index(END), ids, counts, np.log10(bn + bv + 1), len(model_words), int(n), int(v), net)
    train_lanes(net, chosen[END], sample(docs, model), RATE)
    for k in range(ROUNDS):
        train_round(docs, model, k)
    return model


_COPY = "tokens bigint, weights binary"


def train_round(docs: DataFrame, model: Model, k: int) -> int:
    """Learns from all tokens of the rows whose hash falls to round k, and sets the weights' mean; the number of tokens.

    The copies, a few a core, go to the shared folder and are added up FAN at a time until the driver gets FAN at most.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    names = list(model.net.par)
    rate, lanes = ROUND_RATE * (1 - k / ROUNDS), ROUND_LANES

    def packed(tokens: int, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net = copy_of(m.net)
        texts = (text for batch in batches for text in encode(m, batch.column("text")).texts())
        if n := train_lanes(net, int(m.ids[m.end]), texts, rate, lanes):
            yield packed(n, np.concatenate([net.par[x].ravel() for x in names]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for tokens, weights in zip(batch.column("tokens").to_pylist(), batch.column("weights"), strict=True):
                n, total = n + tokens, total + tokens * np.frombuffer(weights.as_buffer(), np.float32).astype(float)
        if n:
            yield packed(n, total / n)

    mine = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k).select("text").coalesce(max(2 * context.defaultParallelism, model.n // ROUNDS // COPY_TOKENS))
    copies = stored(map_arrow(mine, run, _COPY), "weights")
    while (count := copies.count()) > FAN:
        copies = stored(copies.coalesce(-(-count // FAN)).mapInArrow(add, _COPY), "weights")
    n, total = 0, 0.0
    for r in copies.toLocalIterator():
        n, total = n + r["tokens"], total + r["tokens"] * np.frombuffer(bytes(r["weights"]), np.float32).astype(float)
    if n:
        at = 0
        for x in names:
            old = model.net.par[x]
            model.net.par[x] = (total[at : at + old.size] / n).astype(np.float32).reshape(old.shape)
            at += old.size
    shared.unpersist()
    return n


def copy_of(net: Network) -> Network:
    """The network with weights of its own, as workers share the broadcast one."""
    out = copy(net)
    out.par = {n: v.copy() for n, v in net.par.items()}
    return out


def sample(docs: DataFrame, model: Model) -> list[np.ndarray]:
    """Whole documents with the smallest hashes, until they hold FIT_TOKENS tokens; of equal rows one."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("double")).alias("chars")).first()
    if not size["n"]:
        return []
    mean = max(1.0, (size["chars"] or 0.0) / size["n"] / 7)
    u = hash_share("doc_id", "text")
    rows = docs.filter(u <= (FIT_TOKENS / mean + 1) / size["n"]).select(u.alias("u"), "text").dropDuplicates(["u"]).toLocalIterator()
    texts = [text for _, text in sorted((r["u"], r["text"] or "") for r in rows)]
    out = encode(model, pa.array(texts, pa.string())).texts()
    return out[: int(np.searchsorted(np.cumsum([len(t) for t in out]), FIT_TOKENS)) + 1]


@dataclass
class Encoded:
    """Words of a column of texts: distinct ones, which one each token is (no END), and where each text begins.

    ``rows``: a distinct word's row in the table of known words (-1: looked up later); ``ids``: its model id.
    """

    words: pa.Array
    tokens: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    end: int

    def texts(self) -> list[np.ndarray]:
        """Model ids of each text, its END included."""
        flat = np.insert(self.ids[self.tokens], self.starts[1:], self.end)
        cuts = (self.starts + np.arange(len(self.starts))).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(model: Model, texts: pa.Array) -> Encoded:
    words, starts = split_words(texts)
    coded = words.dictionary_encode()
    rows = pc.fill_null(pc.index_in(coded.dictionary, value_set=model.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = model.ids[rows].astype(np.int64)
    lost = np.flatnonzero(rows < 0)
    ids[lost] = model.n_words + buckets_of(coded.dictionary.take(pa.array(lost)))
    return Encoded(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), starts, rows, ids, int(model.ids[model.end]))


def run_lanes(net: Network, start: int, docs: Iterable[tuple[object, np.ndarray]], lanes: int = LANES, steps: int = STEPS) -> Iterator[tuple[object, float]]:
    """(key, natural log probability) of every document, in the order in which they end.

    Each lane holds one document and its state. After a window the state is carried on; a lane whose document has
    ended takes the next one, with a state of zeros. Lanes without a document are dropped, and the windows of the
    others get longer: a window holds lanes * steps tokens at most.
    """
    source = iter(docs)
    keys: list[object] = []
    texts: list[np.ndarray] = []
    at, size = np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.empty(0)
    h = np.empty((0, net.hidden), np.float32)
    while True:
        fresh = list(islice(source, lanes - len(keys)))
        if fresh:
            keys, texts = keys + [k for k, _ in fresh], texts + [t for _, t in fresh]
            at, total = np.concatenate([at, np.zeros(len(fresh), np.int64)]), np.concatenate([total, np.zeros(len(fresh))])
            size = np.concatenate([size, [len(t) for _, t in fresh]])
            h = np.concatenate([h, np.zeros((len(fresh), net.hidden), h.dtype)])
        if not keys:
            return
        width = len(keys)
        length = np.minimum(size - at, lanes * steps // width)
        longest = int(length.max())
        both = np.full((width, longest + 1), start, np.int64)
        for row, text, p, k in zip(both, texts, at.tolist(), length.tolist(), strict=True):
            if p:
                row[: k + 1] = text[p - 1 : p + k]
            else:
                row[1 : k + 1] = text[:k]
        both = both.T
        states, h = net.states(np.ascontiguousarray(both[:-1]), h)
        on = (np.arange(longest)[:, None] < length).ravel()
        probs = np.zeros(longest * width)
        probs[on] = net.log_probs(states.reshape(-1, net.hidden)[on], both[1:].ravel()[on])
        total += probs.reshape(longest, width).sum(0)
        at = at + length
        if (at >= size).any():
            for i in np.flatnonzero(at >= size).tolist():
                yield keys[i], float(total[i])
            left = np.flatnonzero(at < size)
            keys, texts = [keys[i] for i in left.tolist()], [texts[i] for i in left.tolist()]
            at, size, total, h = at[left], size[left], total[left], h[left]


_OUT = "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:binary,n:bigint>>"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 (null ids learn, too); scores all whole texts. A
    null or empty text is its end alone. Repeated rows are scored one by one; words of equal count are taken in the
    order of their bytes; an empty table gives an empty result. Other columns are ignored.

    Counts of KNOWN words, of bounded size, are broadcast; all other words of a document are joined with the counts by
    word (each is rare, so no key is hot) and summed up again by row.
    """
    require(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    train_rows = learning_rows(docs)
    vocab = stored(count_words(train_rows), "vocab")
    model = learn(train_rows, vocab)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base_of = np.log10((m.c + 1) / (m.n + m.v + 1))
        inner = np.where(m.ids >= m.n_words, np.log10(m.c + 1) - m.inside[np.maximum(m.ids - m.n_words, 0)], 0.0)
        first = TaskContext.get().partitionId() << 40
        waiting: dict[int, tuple] = {}

        def feed() -> Iterator[tuple[int, np.ndarray]]:
            uid = first
            for batch in batches:
                e = encode(m, batch.column("text"))
                size, lost = np.diff(e.starts), e.rows < 0
                # by distinct word: counted in training, base score, share inside its bucket
                seen = (m.c[e.rows] > 0) & ~lost
                base = np.where(lost, -math.log10(m.n + m.v + 1), base_of[e.rows])
                inside = np.where(lost, -m.inside[np.maximum(e.ids - m.n_words, 0)], inner[e.rows])
                doc = np.repeat(np.arange(len(size)), size)
                total = lambda of: np.bincount(doc, weights=of[e.tokens], minlength=len(size))
                known, base, inside = total(seen.astype(float)), total(base), total(inside)
                away = np.flatnonzero(lost[e.tokens])
                pair, times = np.unique(doc[away] * len(e.words) + e.tokens[away], return_counts=True)
                edge = np.searchsorted(pair, np.arange(len(size) + 1) * len(e.words)).tolist()
                pair %= max(1, len(e.words))
                for i, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), e.texts(), strict=True)):
                    rare = pair[edge[i] : edge[i + 1]]
                    words = e.words.take(pa.array(rare)) if len(rare) else None
                    row = (int(known[i]) + int(m.c[m.end] > 0), base[i] + base_of[m.end], inside[i] + inner[m.end])
                    waiting[uid] = (doc_id, len(ids), *row, words, times[edge[i] : edge[i + 1]])
                    yield uid, ids
                    uid += 1

        ready: list[tuple] = []

        def out() -> pa.RecordBatch:
            uid, doc_id, n, known, base, score, words, times = zip(*ready, strict=True)
            none = pa.array([], pa.binary())
            size = np.array([len(x) for x in times])
            pairs = pa.StructArray.from_arrays([pa.concat_arrays([none if w is None else w for w in words]), pa.array(np.concatenate(times).astype(np.int64))], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pairs)
            return pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), lists],
                ["uid", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
            )

        for uid, natural in run_lanes(m.net, int(m.ids[m.end]), feed()):
            doc_id, n, known, base, inside, words, times = waiting.pop(uid)
            ready.append((uid, doc_id, n, known, base, natural / math.log(10) + inside, words, times))
            if len(ready) >= 500:
                yield out()
                ready = []
        if ready:
            yield out()

    scored = stored(map_arrow(docs, run, _OUT), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("w"), F.col("r.n").alias("k"))
    more = rare.join(vocab, F.col("w") == F.col("word")).groupBy("uid").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("found")
    ).withColumnRenamed("uid", "r_uid")
    out = scored.drop("rare").join(more, F.col("uid") == F.col("r_uid"), "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
