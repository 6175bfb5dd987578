"""Licence scans by a positional rare-token index.

Templates are licence texts, notices and phrases, as word sequences. The index holds postings (template, position) of each
template's words of highest inverse document frequency, counted over the whole corpus. A file looks up its own rare licence
words: an occurrence at word p that a posting places at q proposes that the template starts at p - q. Where enough
different rare words propose starts within a window (words may be missing or put in), the region is intersected with the
template in order, and counts if enough of it is there and its mandatory phrases stand word for word.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import byte_texts, map_arrow, require

#: Bytes that separate words (all ASCII but digits and letters) become spaces, A-Z become a-z.
_WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(_WORD_TABLE).split() if text else []


@dataclass(frozen=True)
class Template:
    """A licence text, or a phrase (then the phrase itself is the mandatory part)."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    phrase: bool = False


PHRASES = tuple(Template(label, text, phrase=True) for label, text in license_texts.PHRASES)
NOTICES = tuple(Template(label, text, mandatory) for label, text, mandatory in license_texts.TEXTS)
#: Rare words of a template that are looked up; different ones that must agree on a start; how far the starts may lie
#: apart, in words and as a share of the template; the share of a template that must be there.
RARE_WORDS = 12
AGREE = 4
SLACK_WORDS, SLACK_SHARE = 6, 0.15
LEAST = 0.7


@dataclass
class RareIndex:
    """Postings of the rare words of templates; small and bounded by the templates. ``idf``: of their words, in the corpus."""

    templates: Sequence[Template]
    idf: Mapping[bytes, float] = field(default_factory=dict)
    postings: dict[bytes, list[tuple[int, int]]] = field(init=False)

    def __post_init__(self) -> None:
        self.seqs = [words_of(t.text.encode()) for t in self.templates]
        self.key = [[words_of(m.encode()) for m in t.mandatory] for t in self.templates]
        self.places: list[dict[bytes, list[int]]] = []
        self.need: list[int] = []
        self.postings = defaultdict(list)
        for t, seq in enumerate(self.seqs):
            places: dict[bytes, list[int]] = defaultdict(list)
            for q, w in enumerate(seq):
                places[w].append(q)
            self.places.append(dict(places))
            ranked = sorted(places, key=lambda w: (-self.idf.get(w, 0.0), -len(w), places[w][0]))
            rare = ranked[: 1 if self.templates[t].phrase else RARE_WORDS]  # of a phrase all is verified
            self.need.append(min(AGREE, len(rare)))
            for w in rare:
                self.postings[w] += [(t, q) for q in places[w]]
        self.postings = dict(self.postings)
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, is a phrase, start, words, share of template words in place), in order of start."""
        if not self.rare.intersection(words):
            return []
        found: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.rare:
                for t, q in self.postings[w]:
                    found[t].append((p - q, p, w))
        out = []
        for t, proposals in found.items():
            tpl, seq = self.templates[t], self.seqs[t]
            if tpl.phrase:
                out += [(tpl.label, True, d, len(seq), 1.0) for d in sorted({d for d, _, _ in proposals}) if d >= 0 and words[d : d + len(seq)] == seq]
            elif len({w for _, _, w in proposals}) >= self.need[t]:
                out += self._aligned(t, sorted(proposals), words)
        return sorted(out, key=lambda x: (x[2], x[0], x[1]))

    def _aligned(self, t: int, proposals: list[tuple[int, int, bytes]], words: list[bytes]) -> Iterator[tuple[str, bool, int, int, float]]:
        """Places of a template where proposals agree; of those that overlap the fullest one."""
        seq, slack = self.seqs[t], SLACK_WORDS + int(SLACK_SHARE * len(self.seqs[t]))
        regions: list[tuple[int, int]] = []
        inside: Counter[bytes] = Counter()
        lo = 0
        for hi, (d, _, w) in enumerate(proposals):
            inside[w] += 1
            while proposals[lo][0] < d - slack:
                inside[proposals[lo][2]] -= 1
                inside += Counter()  # drops zeros
                lo += 1
            if len(inside) >= self.need[t]:
                region = max(0, proposals[lo][0] - slack), min(len(words), d + len(seq) + slack)
                if not regions or region[0] > regions[-1][0] + slack:
                    regions.append(region)
                else:
                    regions[-1] = regions[-1][0], region[1]
        hits = []
        for begin, end in regions:
            if all(_stands(k, words, begin, end) for k in self.key[t]) and (at := self._in_order(t, words, begin, end)):
                share = len(at) / len(seq)
                if share >= LEAST:
                    hits.append((share, at[0], at[-1] + 1))
        taken: list[tuple[int, int]] = []
        for share, begin, end in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(end <= a or begin >= b for a, b in taken):
                taken.append((begin, end))
                yield self.templates[t].label, False, begin, end - begin, share

    def _in_order(self, t: int, words: list[bytes], begin: int, end: int) -> list[int]:
        """Places of the longest sequence of the template's words that the region holds in their order."""
        places, tails, at, back, last = self.places[t], [], [], {}, []
        for p in range(begin, end):
            for q in reversed(places.get(words[p], ())):
                i = bisect_left(tails, q)
                back[p, q] = last[i - 1] if i else None
                if i == len(tails):
                    tails.append(q)
                    last.append((p, q))
                else:
                    tails[i], last[i] = q, (p, q)
        step = last[-1] if last else None
        while step:
            at.append(step[0])
            step = back[step]
        return at[::-1]


def _stands(phrase: list[bytes], words: list[bytes], lo: int, hi: int) -> bool:
    k = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + k] == phrase for i in range(lo, hi - k + 1))


def word_idf(docs: DataFrame, words: Sequence[bytes]) -> dict[bytes, float]:
    """Inverse document frequency, over all whole texts, of the given words: log of (texts + 1) / (texts with it + 1).

    One narrow pass with counts summed in tasks; a row a word comes to the driver.
    """
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            n[b""] += batch.num_rows
            for text in byte_texts(batch):
                n.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = map_arrow(docs.select("text"), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    return {w: math.log((n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) for w in wanted}


SCHEMA = "doc_id bigint, n_words bigint, hits array<struct<label:string,base:boolean,start:bigint,n_words:bigint,share:double>>"
_HIT = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])


def scan_licenses(docs: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words and every hit (label, base phrase or not, start word, words, share).

    Two narrow passes over whole texts: frequencies of the templates' words (a row a word is summed), then the scan; the
    index is bounded by the templates. Null and empty texts have no
    words and no hits. Repeated rows, null ids and ties are kept as they are; an empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    require(docs, "doc_id", "text")
    idf = word_idf(docs, [w for t in (*phrases, *notices) for w in words_of(t.text.encode())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, more = RareIndex(phrases, idf), RareIndex(notices, idf)
        for batch in batches:
            counts, hits = [], []
            for text in byte_texts(batch):
                words = words_of(text)
                counts.append(len(words))
                found = [(label, True, *rest) for label, _, *rest in base.scan(words)]
                found += [(label, False, *rest) for label, _, *rest in more.scan(words)]
                hits.append([dict(zip(("label", "base", "start", "n_words", "share"), h, strict=True)) for h in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["doc_id", "n_words", "hits"]
            )

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
