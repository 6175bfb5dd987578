"""Helpers shared by the training-data operators: reading, byte words, Arrow batches, held-out splits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import materialise as stored
from ..operators.graph import shared_path as shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
__all__ = ["ascii_lower", "byte_texts", "flag_texts", "fold_of", "fresh", "hash_share", "held", "lean", "map_arrow", "require", "shared_dir", "slices", "stored", "table", "trim"]
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library; memory is then given back when the worker ends
    _libc = None
#: Bytes of Python lists built at a time from an Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


#: What a worker process keeps from task to task, by name: (key, value). One operator's at a time.
HELD: dict[str, tuple[object, object]] = {}


def held(name: str, key: object, make: Callable[[], object]):
    """A value that tasks of a worker share (a codec with its caches), made when first needed."""
    got = HELD.get(name)
    if got is None or got[0] != key:
        HELD.clear()
        got = HELD[name] = (key, make())
    return got[1]


def trim() -> None:
    """Gives freed memory back to the system; a worker lives longer than a task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(keep: str | None = None) -> None:
    """Drops what other operators' tasks left in this worker."""
    if any(name != keep for name in HELD):
        HELD.clear()
        gc.enable()
        gc.collect()
        trim()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of ``column`` (a single longer value stays whole)."""
    n, limit = batch.num_rows, limit or SLICE_BYTES
    if not n:
        return
    size = max(1, batch.column(column).nbytes)
    step = max(1, int(n * limit / size)) if size > limit else n
    for i in range(0, n, step):
        yield batch.slice(i, step)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: str | None = None, limit: int | None = None
) -> DataFrame:
    """mapInArrow whose function sees bounded slices of the ``text`` column. ``keep``: the name of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, limit=limit):
                    yield part
                    trim()

        lean(keep)
        return fn(parts())

    return df.mapInArrow(run, schema)


def flag_texts(test: Callable[[list], list[bool]], binary: bool = False):
    """A boolean function of a text column, tested slice by slice."""

    @F.arrow_udf("boolean")
    def flags(texts: pa.Array) -> pa.Array:
        lean()
        out: list[bool] = []
        for part in slices(pa.RecordBatch.from_arrays([texts.cast(pa.binary()) if binary else texts], ["text"])):
            out += test(part.column("text").to_pylist())
        trim()
        return pa.array(out, pa.bool_())

    return flags


def hash_share(*columns: str) -> Column:
    """Even in [0, 1], the same for equal values: rows below n / count are a sample of about n, without a sort."""
    return F.xxhash64(*columns) / F.lit(float(1 << 64)) + 0.5


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
