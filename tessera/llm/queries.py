"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, language_id, license_scan, lm_scoring, minhash_dedup, mixing, quality, token_files
from .common import table
from .url_filter import RULES, SOFT_LIMIT, SOFT_TERMS, STRICT_TERMS, filter_urls


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the recurrent model and by the base counts; null texts are their end alone."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts and verdict; null and empty texts have no words and fail the base rule."""
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; texts that are null or have no letter are ``und``."""
    out = language_id.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; null urls are allowed unless a rule fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict")


def _op4_sql() -> str:
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)"
    soft = " + ".join(map(hit, SOFT_TERMS))
    strict = " + ".join(f"len(regexp_extract_all(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in STRICT_TERMS)
    whens = lambda what: " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{what(r)}'"
        for r in sorted(RULES, key=lambda r: (-len(r.pattern), r.pattern))
    )
    return f"""
    WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS tail,
                      translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
    h AS (SELECT page_id, u, coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM t),
    c AS (SELECT page_id, host, path, CASE {whens(lambda r: r.pattern)} END AS rule, CASE {whens(lambda r: r.verdict)} END AS by_rule,
                 CAST({strict} AS INTEGER) AS n_strict, CAST({soft} AS INTEGER) AS n_soft FROM h)
    SELECT page_id, host, path, rule, n_strict, n_soft,
           coalesce(by_rule, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM c"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, group and whether it is kept; unusable vectors stand alone."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
          AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
           vec_id <= coalesce(c.m, vec_id) AS kept
    FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, group and whether it is kept, by two-word shingles; texts without words stand alone."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP6_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                 ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id,
           documents.doc_id <= coalesce(m, documents.doc_id) AS kept
    FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.a = documents.doc_id"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of the ids and of the bytes decoded from them; null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of all documents after mixing the sources to their target weights; null is a source."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_chars", F.round("rate", 9).alias("rate"), "n_copies", "copy", F.md5("text").alias("text_md5"))


def _op8_sql() -> str:
    k = mixing.HEX_DIGITS
    return f"""
    WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    r AS (SELECT source, least({mixing.MAX_RATE}, (SELECT sum(n) FROM c) * power(n, {mixing.POWER}) / (SELECT sum(power(n, {mixing.POWER})) FROM c) / n) AS rate FROM c),
    cdf(source, rate, k, p, c) AS (
        SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
    u AS (SELECT doc_id, source, n_chars, md5(text) AS text_md5,
                 ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, {k}))::BIGINT / {float(16**k)!r} AS u FROM documents),
    n AS (SELECT u.doc_id, u.source, any_value(n_chars) AS n_chars, any_value(text_md5) AS text_md5, any_value(rate) AS rate, count(*) AS n_copies
          FROM u JOIN cdf ON u.source = cdf.source AND u.u >= cdf.c GROUP BY u.doc_id, u.source)
    SELECT doc_id, source, n_chars, round(rate, 9) AS rate, n_copies, unnest(range(1, n_copies + 1)) AS copy, text_md5 FROM n"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and labels; null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan_licenses(docs)
    base = F.filter("hits", lambda h: h["base"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files; null texts are the end id alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_files.token_path(spark)
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_crc32(token_files.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": _op4_sql(), "op8_mix_sources": _op8_sql(), "op5_embedding_dedup": OP5_SQL, "op6_minhash_dedup": OP6_SQL}
