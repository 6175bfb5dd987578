"""Sources: delimited and framed text, catalogues, journals; malformed records become decisions, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Parquet with projection and predicate; both reach the scan."""
    df = spark.read.parquet(path)
    df = df if predicate is None else df.filter(predicate)
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", quote: str = '"', header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records with all their columns, and decisions (entity_id, outcome, reason_code) for the malformed ones.

    A record is a line; with ``header`` each file's column line is dropped. Columns are strings. What doesn't parse
    into just the columns is malformed: it becomes a decision, not an error.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _malformed string"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("line")).filter(F.trim("line") != "")
    if header:
        lines = lines.filter(F.translate("line", quote, "") != sep.join(columns))
    options = {"sep": sep, "quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    raw = lines.withColumn("r", F.from_csv("line", schema, options)).withColumn("record_id", F.sha2(F.concat_ws("\x1f", "source_uri", "line").cast("binary"), 256))
    bad = raw.filter("r._malformed is not null").select(F.col("record_id").alias("entity_id"), F.lit("REJECT").alias("outcome"), F.lit("MALFORMED_RECORD").alias("reason_code"))
    return raw.filter("r._malformed is null").select("record_id", *[F.col(f"r.`{c}`").alias(c) for c in columns]), bad


def framed(spark: SparkSession, path: str, separator: str = "$$$$\n") -> DataFrame:
    """source_uri, record, tags of a text in records that end with a line of the separator; tags are ``> <name>`` blocks."""
    text = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("record")).filter(F.trim("record") != "")
    return text.withColumn("tags", framed_tags(F.col("record")))


def framed_tags(record: Column) -> Column:
    names = F.regexp_extract_all(record, F.lit(r"(?m)^>[^<\n]*<([^>\n]+)>[^\n]*\n([^\n]*)"), F.lit(1))
    values = F.regexp_extract_all(record, F.lit(r"(?m)^>[^<\n]*<([^>\n]+)>[^\n]*\n([^\n]*)"), F.lit(2))
    return F.map_from_entries(F.arrays_zip(names.alias("k"), values.alias("v")))


def cells(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, value: the long form of a catalogue, for exact-match look-ups by field; nulls have no cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return records.select(key, pairs).select(key, "x.field", "x.value").filter("value is not null")


def json_cells(records: DataFrame, key: str, column: str) -> DataFrame:
    """key, field, value of the top-level members of a JSON object column; malformed text has none."""
    return records.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))


def numeric_series(spark: SparkSession, path: str) -> DataFrame:
    """source_uri, fields (array<double>) of a plotted-data text; lines that begin with # or @ are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.trim("value").alias("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[#@]"))
    return kept.select("source_uri", F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double")).alias("fields"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines journal with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet, zstd; published by the committer, never over a committed table unless asked."""
    writer = df.write.mode("overwrite" if overwrite else "error").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_shortlist(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """A delimited export in the order of its first column."""
    df.select(*columns).orderBy(columns[0]).write.mode("error").option("sep", sep).option("header", True).csv(path)
