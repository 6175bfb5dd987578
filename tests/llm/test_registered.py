"""The registered queries, called as the driver calls them, against plain versions on a folder of small tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tessera.llm import lm_scoring, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    out = [None, "", " \n\t", "one", "Two  words here", "a\x0bb", "é漢字 🙂", "long " * 4000, "mark <|endoftext|> end", "Under the MIT License, under the mit-license", "CC BY-NC\nApache License, Version 2", "1 2 3 !?", "# * $ %\nsame line\nsame line\n"]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 90))) + rng.choice([".", "\nThe END", " Apache License Version 2.0"]) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = rng.choice(vocab)
        out.append(" ".join(copy))
    out += [" ".join("abcdefgh"[rng.randrange(8)] for _ in range(8)) * 9, *out[13:16]]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4 if i % 9 else 0}", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, len(rows), 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = [(i, [x + rng.gauss(0, 0.12) for x in rng.choice(vectors)], i % 3) for i in range(90)] + [(90, None, 1), (91, [0.0] * 8, 1), (92, [None] + [1.0] * 7, 2), (93, vectors[0], None), (94, [float("nan")] * 8, 0)]
    spark.createDataFrame(near, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "https://example.net", "ftp://a.org/fr/b#c", "http://example.com/de/", "http://a.io/casino", "http://a.io/win-bonus", "a://b://c.net/", "HTTP://B.IO?XXX"] * 2
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{base}/pages.parquet")
    return base


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    shape = lambda cols, rows: sorted(str([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert shape(df.columns, [tuple(r) for r in df.collect()]) == shape(names, cur.fetchall())


def tokens(t):
    return [*WORD.findall(lower(t or "")), ""]


def test_op1_scores_and_base(spark, folder, monkeypatch):
    """Base columns from plain counts; the score from a step-by-step walk with full softmaxes over the same model."""
    kept, learn = [], lm_scoring.learn
    monkeypatch.setattr(lm_scoring, "KNOWN", 60)  # other words come by the join
    monkeypatch.setattr(lm_scoring, "WORDS", 30)
    monkeypatch.setattr(lm_scoring, "learn", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, folder).collect()}
    model, rows = kept[0], dict(enumerate(texts()))
    train = [tokens(t) for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count: dict[str, int] = {}
    for ts in train:
        for w in ts:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    known = [w.decode() for w in model.known.to_pylist()]
    model_words = {w: int(i) for w, i in zip(known, model.ids, strict=True) if i < model.n_words}
    bucket = lambda w: lm_scoring.bucket_of(w.encode())
    inside = {}
    for w, c in count.items():
        if w not in model_words:
            inside.setdefault(bucket(w), []).append(c)
    net, par = model.net, model.net.par
    sigma = lambda x: 0.5 + 0.5 * np.tanh(x)

    def log_softmax(x, at):
        return float(x[at] - x.max() - np.log(np.exp(x - x.max()).sum()))

    for i in [0, 1, 3, 4, 6, 9, 14, 20, 33]:
        h, before, total, k = np.zeros(net.hidden), model_words[""], 0.0, net.hidden
        for w in tokens(rows[i]):
            a, x = h @ par["u"], par["e"][before] @ par["w"]
            g = sigma(x[: 2 * k] + a[: 2 * k] + par["b"][: 2 * k])
            c = np.tanh(x[2 * k :] + g[k:] * (a[2 * k :] + par["b"][2 * k :]))
            h = c + g[:k] * (h - c)
            target = model_words.get(w, model.n_words + bucket(w))
            place = net.place[target]
            cls = int(net.class_of[place])
            lo, hi = net.edges[cls : cls + 2]
            total += log_softmax(h @ par["wc"] + par["bc"], cls) / math.log(10)
            total += log_softmax(par["wo"][lo:hi] @ h + par["bo"][lo:hi], place - lo) / math.log(10)
            if w not in model_words:
                cs = inside.get(bucket(w), [])
                total += math.log10((count.get(w, 0) + 1) / (sum(cs) + len(cs) + 1))
            before = target
        assert math.isclose(got[i]["score"], total, rel_tol=1e-4), i
    for i, t in rows.items():
        ws = tokens(t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(w in count for w in ws), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def plain_repeats(ws):
    seen: dict[tuple, list[int]] = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    return len({i + j for places in seen.values() if len(places) > 1 for i in places for j in range(8)})


def test_op2_counts(spark, folder):
    rows = texts()
    for r in queries.op2_quality_rules(spark, folder).collect():
        t = rows[r["doc_id"]] or ""
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        repeats = plain_repeats(ws)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), repeats)
        assert r["base_failed"] == (len(ws) < 20 or 100 * repeats > 30 * len(ws)) and not (r["kept"] and r["base_failed"])


def test_op3_rows(spark, folder):
    rows = texts()
    for r in queries.op3_language_id(spark, folder).collect():
        t = rows[r["doc_id"]]
        letters = any(c.isalpha() for c in t or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] in ("en", "fr")) if letters else r["lang_pred"] == "und"


def test_op7_digests(spark, folder):
    import tiktoken

    from tessera.llm.bpe import parse_ranks

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    want = []
    for i, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op7_byte_bpe(spark, folder).collect()) == want


def test_op9_places(spark, folder):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    rows = texts()
    for r in queries.op9_license_scan(spark, folder).collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(rows[r["doc_id"]] or ""))
        places = sorted((i, label) for label, p in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        labels = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 and (r["score"] == 1 if places else True)


def test_op10_files(spark, folder):
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in enumerate(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op10_token_files(spark, folder).collect()) == want
