"""Content-addressed artifacts: datasets under an id that follows from what they hold and how they were made."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, content_id


class ArtifactError(ValueError):
    """An artifact that is missing or doesn't hold what its manifest says."""


@dataclass(frozen=True)
class Artifact:
    id: str
    path: str
    manifest: dict


def schema_checksum(df: DataFrame) -> str:
    return hashlib.sha256(canonical_json(json.loads(df.schema.json()))).hexdigest()


def rows_checksum(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and the sum of their hashes: independent of order and partitions; one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], str(r["h"] or 0)


def _about(df: DataFrame) -> dict:
    n, h = rows_checksum(df)
    return {"schema": schema_checksum(df), "rows": n, "hash": h}


def commit(spark: SparkSession, root: str, kind: str, producer: dict, inputs: list[str], ports: dict[str, DataFrame]) -> Artifact:
    """Writes the ports' datasets and a manifest below ``root``/id. The same content has the same id and is written once.

    The manifest is written last: an artifact without one was never committed.
    """
    manifest = {"kind": kind, "producer": producer, "inputs": sorted(inputs), "ports": {name: _about(df) for name, df in sorted(ports.items())}}
    artifact = Artifact(content_id(manifest), f"{root.rstrip('/')}/{content_id(manifest)}", manifest)
    try:
        return resolve(spark, root, artifact.id)
    except ArtifactError:
        for name, df in ports.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{artifact.path}/{name}")
        spark.createDataFrame([(canonical_json(manifest).decode(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{artifact.path}/manifest")
        return artifact


def resolve(spark: SparkSession, root: str, artifact_id: str) -> Artifact:
    """The committed artifact of an id; its manifest must hash to the id."""
    path = f"{root.rstrip('/')}/{artifact_id}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise ArtifactError(f"no artifact {artifact_id}")
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest").first()[0])
    if content_id(manifest) != artifact_id:
        raise ArtifactError(f"the manifest of {artifact_id} was changed")
    return Artifact(artifact_id, path, manifest)


def read_port(spark: SparkSession, artifact: Artifact, port: str, verify: bool = False) -> DataFrame:
    """A port's dataset; with ``verify``, only if its schema, rows and hashes are those of the manifest."""
    if port not in artifact.manifest["ports"]:
        raise ArtifactError(f"{artifact.id} has no port {port}")
    df = spark.read.parquet(f"{artifact.path}/{port}")
    if verify and _about(df) != artifact.manifest["ports"][port]:
        raise ArtifactError(f"{port} of {artifact.id} doesn't hold what its manifest says")
    return df


def seal(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below the folder), bytes, sha256 of every file of a snapshot."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace("path", "^.*" + re.escape(root.split("/")[-1]) + "/", "")
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """file, fault: files of a seal that are CHANGED or MISSING, and files that were ADDED."""
    a, b = sealed.select("file", F.col("sha256").alias("before")), now.select("file", F.col("sha256").alias("after"))
    fault = F.when(F.col("after").isNull(), "MISSING").when(F.col("before").isNull(), "ADDED").when(F.col("before") != F.col("after"), "CHANGED")
    return a.join(b, "file", "full").select("file", fault.alias("fault")).filter("fault is not null")
