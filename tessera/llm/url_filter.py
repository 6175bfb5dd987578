"""URL filters: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, require


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path, e.g. ``example.net/en/``; it holds for the host and its subdomains."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: One boundary-checked hit of these rejects.
STRICT_TERMS = (
    "casino", "porn", "xxx", "viagra", "warez", "torrent", "phishing", "malware", "escorts", "payday-loan", "pornography", "hentai", "camgirls", "sportsbook", "keygen", "ransomware", "botnet",
    "cialis", "xanax", "spyware", "rootkit", "cardsharing", "cvv-shop",
)
#: Several distinct ones of these reject.
SOFT_TERMS = ("bet", "betting", "poker", "adult", "nude", "loan", "loans", "pills", "cheap", "free-download", "crack", "serial", "dating", "win", "bonus", "spam", "click", "ads",
              "gambling", "jackpot", "slots", "lottery", "roulette", "nsfw", "erotic", "hookup", "forex", "miracle", "replica", "cheats", "popup", "sweepstakes", "giveaway", "clickbait", "torrents", "betting-tips", "weight-loss")
SOFT_LIMIT = 2


def split_url(url):
    """Host (after the first ``://`` up to / ? # or the end, A-Z lowered) and path (then up to ? # or the end)."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(ascii_lower(F.regexp_extract(tail, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, False))
    for term in strict:
        a.add_word(term, (term, True))
    a.make_automaton()
    return a


#: Rules up to which they are compiled into expressions; more are looked up by host suffix beside the terms.
COMPILED_RULES = 200


def longest_rule(by_host: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """Pattern and verdict of the longest rule (ties: the first pattern) of the host or a domain above it whose path the
    url's begins with. ``by_host`` has (path, pattern, verdict) of each host."""
    best, at = None, 0
    while at >= 0:
        for start, pattern, verdict in by_host.get(host[at:], ()):
            if path.startswith(start) and (best is None or (-len(pattern), pattern) < (-len(best[0]), best[0])):
                best = pattern, verdict
        at = host.find(".", at) + 1 or -1
    return best or (None, None)


def term_hits(a, text: str) -> tuple[int, int]:
    """Strict hits, and distinct soft terms, that neither follow nor precede an ASCII letter or digit."""
    strict, soft = 0, set()
    word = lambda c: c.isascii() and c.isalnum()
    for end, (term, hard) in a.iter(text):
        start = end - len(term) + 1
        if (start and word(text[start - 1])) or (end + 1 < len(text) and word(text[end + 1])):
            continue
        if hard:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Adds host, path, rule, n_strict, n_soft and verdict to every row.

    Narrow: rules are a parameter, compiled into expressions while they are few, else looked up by host suffix; the
    automaton is built once a task.
    A null url, or one without ``://``, has empty host and path; no rule fits it and no term hits a null, so it is
    allowed unless its characters hold listed terms. Repeated rows are judged alike; an empty table gives an empty
    result; columns of the input that have one of the added names are replaced, all others pass unchanged.
    """
    require(pages, url)
    spark_cols = [c for c in pages.columns if c not in ("host", "path", "rule", "n_strict", "n_soft", "verdict")]
    text, by, terms = fresh(pages, "text", "by", "terms")
    base = pages.select(F.col(url).alias(text), *spark_cols)
    host, path = split_url(F.col(text))
    base = base.withColumn("host", host).withColumn("path", path)
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    few = len(ordered) <= COMPILED_RULES
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for r in ordered:
        by_host.setdefault(r.host, []).append((r.path, r.pattern, r.verdict))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered if few else ()):
        rule = F.when(fits(r), F.lit(r.pattern)).otherwise(rule)
        by_rule = F.when(fits(r), F.lit(r.verdict)).otherwise(by_rule)
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict int, n_soft int, rule string, verdict string")
    def hits(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)
        for urls, hosts, paths in batches:
            found = [term_hits(a, u) if u else (0, 0) for u in urls]
            ruled = [(None, None)] * len(found) if few else [longest_rule(by_host, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame([(*f, *r) for f, r in zip(found, ruled, strict=True)], columns=["n_strict", "n_soft", "rule", "verdict"])

    base = base.withColumn(terms, hits(ascii_lower(F.col(text)), F.col("host"), F.col("path")))
    base = base.withColumn("rule", rule if few else F.col(terms)["rule"]).withColumn(by, by_rule if few else F.col(terms)["verdict"])
    n_strict, n_soft = F.col(terms)["n_strict"], F.col(terms)["n_soft"]
    own = F.when((n_strict >= 1) | (n_soft >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return base.select(*spark_cols, "host", "path", "rule", n_strict.alias("n_strict"), n_soft.alias("n_soft"), F.coalesce(F.col(by), own).alias("verdict"))
