"""The pipeline against its stages' plain meaning, on small tables with nulls, repeats, extra columns, and none at all."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import language_id, minhash_dedup, mixing, quality
from tessera.llm.bpe import parse_ranks
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_representatives(texts):
    """Ids that stay: the least of each group that five-word shingles of a similarity of 0.8 link."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return {i for i, g in group.items() if i == g}


def plain_copies(rows):
    """Copies of each id: the Poisson distribution's inverse at the hashed number, source by source."""
    n = Counter(s for _, s in rows)
    weight = {s: c**mixing.POWER for s, c in n.items()}
    out = {}
    for i, s in rows:
        rate = len(rows) * weight[s] / sum(weight.values()) / n[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[: mixing.HEX_DIGITS], 16) / 16**mixing.HEX_DIGITS
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return out


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})


def test_run_against_plain_stages(spark, encoder):
    """Forest and kernel decide by their own operators, which have tests of their own; all else is worked out plainly."""
    docs = table(spark, SF, "documents")
    good = [r[0] for r in quality.quality_rules(docs, table(spark, SF, "labels")).filter("kept").select("doc_id").collect()]
    one = corpus_pipeline.quality_stage(spark, docs, SF)
    assert one.columns == docs.columns and sorted(r[0] for r in one.select("doc_id").collect()) == sorted(good)
    known = language_id.identify(one, language_id.learn(one)).filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.MIN_LANGUAGE_SCORE}")
    ids = {r[0] for r in known.select("doc_id").collect()}
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in ids}
    stay = plain_representatives({i: t for i, (t, _) in rows.items()})
    copies = plain_copies([(i, rows[i][1]) for i in sorted(stay)])
    want = Counter()
    for i in stay:
        tokens = tuple(encoder.encode_ordinary(rows[i][0]))
        want[i, len(tokens), tokens, True] += copies[i]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "same_text"]
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["same_text"]) for r in out.collect()) == +want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "encoding"]
    assert minhash_dedup.WORDS == 5 and minhash_dedup.PERCENT == 80


def folder(spark, base, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, mark string, cdf int, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(r[0], i % 5 > 0) for i, r in enumerate(rows) if r[0] is not None], "doc_id bigint, q boolean").select("doc_id", F.col("q").cast("int").alias("quality")).write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_run_on_edges(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, text(), "en" if i % 2 else "fr", f"s{i % 3}", 1, 1, "m", 2, 0.5) for i in range(40)]
    rows += [(100, None, None, None, None, 1, "m", 2, 0.5), (101, "", "en", "s0", 0, 1, "m", 2, 0.5), (None, text(), "en", None, 1, 1, None, None, None), rows[3], rows[3], (3, text(), "en", "s1", 1, 1, "m", 2, 0.5), (102, text() + " x" * 9000, "en", "s1", 1, 1, "m", 2, 0.5)]
    at = folder(spark, tmp_path, rows)
    docs = table(spark, at, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert {r["k"] for r in out.select("k").collect()} == {1}
        docs = corpus_pipeline.stored(out, name)
    out = corpus_pipeline.run(spark, at).collect()
    seen = Counter(r["doc_id"] for r in out)
    assert 100 not in seen and 101 not in seen and len(seen) > 20 and all(r["same_text"] for r in out)


def test_run_on_an_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, []))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids", "same_text"]
