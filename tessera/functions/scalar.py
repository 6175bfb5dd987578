"""Scalar functions: units, potencies, censoring, hashes, text."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of ten of molar units.
MOLAR = {"M": 0, "mM": -3, "uM": -6, "nM": -9, "pM": -12}
ENDPOINTS = ("Kd", "Ki", "IC50", "EC50")


def molar(value: Column, unit: Column) -> Column:
    """The value in mol/l as an exact decimal; null for unknown units."""
    out = F.lit(None).cast("decimal(38,18)")
    for name, power in MOLAR.items():
        out = F.when(unit == name, (value.cast("decimal(20,6)") * F.lit(f"1e{power}").cast("decimal(18,12)")).cast("decimal(38,18)")).otherwise(out)
    return out


def pic50(nanomolar: Column) -> Column:
    return F.when(nanomolar > 0, 9 - F.log10(nanomolar))


def measurement_class(endpoint: Column, relation: Column, value: Column, unit: Column, text: Column) -> Column:
    """Evidence class of a reported measurement; the tests are asked in this order."""
    v = value.cast("double")
    return (
        F.when(F.lower(F.coalesce(text, F.lit(""))).rlike("not active|inactive"), "reported_inactive")
        .when(v.isNull(), "non_numeric")
        .when((v <= 0) | F.isnan(v) | (v == float("inf")), "non_positive")
        .when(~endpoint.isin(*ENDPOINTS) | ~unit.isin(*MOLAR) | endpoint.isNull() | unit.isNull(), "unsupported")
        .when(relation.isin(">", ">="), "lower_bound")
        .when(relation.isin("=", "<", "<="), "quantitative")
        .otherwise("unresolved")
    )


def canonical_json(value: object) -> bytes:
    """Sorted keys, no blanks, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def content_id(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def row_hash(*parts: Column) -> Column:
    """sha256 over length-prefixed parts, so that no two different rows run together."""
    prefixed = [F.concat(F.octet_length(s).cast("string"), F.lit(":"), s) for s in (F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.sha2(F.concat(*prefixed).cast("binary"), 256)


def public_url(url: Column) -> Column:
    """The URL without user information and without values of query fields that look like credentials."""
    no_user = F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(no_user, r"(?i)([?&](?:api_?key|token|secret|password|ref)=)[^&#]*", "$1***")


def normal_text(text: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
