"""Sources of further formats: spreadsheets, MOL2 molecules, NAMD energies, provider catalogues, registered parents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Formats by the ending of a file's name; a .gz ending before is left out.
FORMATS = {"csv": "delimited", "tsv": "delimited", "smi": "smiles", "smiles": "smiles", "sdf": "sdf", "mol2": "mol2", "xlsx": "spreadsheet", "parquet": "parquet", "xvg": "series", "fepout": "fepout", "json": "json", "jsonl": "ledger"}


def format_of(name: str) -> str:
    """The format that a file's name tells; an error for one that is not known."""
    parts = name.lower().removesuffix(".gz").rsplit(".", 1)
    if len(parts) < 2 or parts[1] not in FORMATS:
        raise ValueError(f"no known format: {name}")
    return FORMATS[parts[1]]


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a workbook's sheet (the first one by default) as texts, row by row; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_REL)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {sorted(sheets)}")
        path = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        root = ElementTree.fromstring(book.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
    out = []
    for row in root.iter(f"{_SHEET}row"):
        cells: list[str | None] = []
        for cell in row.iter(f"{_SHEET}c"):
            column = 0
            for letter in re.match(r"[A-Z]*", cell.get("r") or "").group():
                column = column * 26 + ord(letter) - 64
            cells += [None] * max(0, column - 1 - len(cells))
            value = cell.find(f"{_SHEET}v")
            if cell.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in cell.iter(f"{_SHEET}t")))
            elif value is None:
                cells.append(None)
            else:
                cells.append(strings[int(value.text)] if cell.get("t") == "s" else value.text)
        out.append(cells)
    return out


def spreadsheet(spark: SparkSession, path: str, columns: Sequence[str], sheet: str | None = None, max_bytes: int = 256 << 20) -> DataFrame:
    """source_uri, row and the named columns (as strings) of workbooks whose first row names the columns.

    A workbook is one record: files above ``max_bytes`` are an error, as are workbooks without a wanted column.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.raise_error(F.lit("workbook too large")).cast("binary")).alias("content"))
    schema = "source_uri string, row bigint, " + ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for uri, content in zip(files["path"], files["content"], strict=True):
                rows = sheet_rows(bytes(content), sheet)
                head = rows[0] if rows else []
                if missing := [c for c in columns if c not in head]:
                    raise ValueError(f"{uri}: no columns {missing}")
                at = [head.index(c) for c in columns]
                body = [[r[i] if i < len(r) else None for i in at] for r in rows[1:]]
                out = pd.DataFrame(body, columns=list(columns), dtype=object)
                out.insert(0, "row", range(1, len(body) + 1))
                out.insert(0, "source_uri", uri)
                yield out

    return files.mapInPandas(run, schema)


def mol2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """source_uri, name, n_atoms, n_bonds, kind and record of MOL2 molecules, and decisions for records without a count line."""
    text = spark.read.option("lineSep", "@<TRIPOS>MOLECULE").text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("record"))
    rows = text.filter(F.trim("record") != "").filter(~F.col("record").rlike(r"^\s*#[^\n]*\s*$"))
    lines = F.split(F.regexp_replace("record", r"^[^\n]*\n", ""), "\n")
    counts = F.split(F.trim(F.get(lines, F.lit(1))), r"\s+")
    rows = rows.select("source_uri", F.trim(F.get(lines, F.lit(0))).alias("name"), F.get(counts, F.lit(0)).try_cast("int").alias("n_atoms"), F.get(counts, F.lit(1)).try_cast("int").alias("n_bonds"), F.trim(F.get(lines, F.lit(2))).alias("kind"), "record")
    bad = rows.filter("n_atoms is null").select(F.sha2(F.concat_ws("\x1f", "source_uri", "record").cast("binary"), 256).alias("entity_id"), F.lit("REJECT").alias("outcome"), F.lit("MALFORMED_RECORD").alias("reason_code"))
    return rows.filter("n_atoms is not null"), bad


def namd_energies(spark: SparkSession, path: str) -> DataFrame:
    """source_uri, step, elec, elec_new, vdw, vdw_new, delta, delta_mean, temperature, net of FepEnergy lines; others are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.split(F.trim("value"), r"\s+").alias("f")).filter(F.col("f")[0] == "FepEnergy:")
    names = ["elec", "elec_new", "vdw", "vdw_new", "delta", "delta_mean", "temperature", "net"]
    return lines.select("source_uri", F.get("f", F.lit(1)).try_cast("bigint").alias("step"), *[F.get("f", F.lit(i + 2)).try_cast("double").alias(n) for i, n in enumerate(names)])


def provider_catalogue(spark: SparkSession, providers: Sequence[Mapping[str, object]]) -> DataFrame:
    """provider, url, license, access, kinds: a declared list of data providers as a table; names are unique."""
    names = [p["provider"] for p in providers]
    if len(set(names)) != len(names):
        raise ValueError("a provider is declared twice")
    rows = [(p["provider"], p.get("url"), p.get("license"), p.get("access", "open"), sorted(p.get("kinds", ()))) for p in providers]
    return spark.createDataFrame(rows, "provider string, url string, license string, access string, kinds array<string>")


def registered_parents(parents: DataFrame, key: str, structure: str) -> DataFrame:
    """Parents that are registered already, as a population; a repeated key or a missing structure is an error."""
    n = parents.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(structure).alias(structure))
    ok = F.when((F.col("n") == 1) & F.col(structure).isNotNull(), F.col(structure)).otherwise(F.raise_error(F.concat(F.lit("not one parent: "), F.col(key).cast("string"))))
    return n.select(key, ok.cast("string").alias(structure))
