"""Token-ID output: Parquet list columns in document order, with chosen encodings, row groups and page indexes.

Each file holds one range of ascending doc_id: doc_id, n_tokens, local_start (ids before the document in its file),
file_no and ids. Token ids are dictionary-encoded (bit-packed below 17 bits for a vocabulary of 50k), the counters
delta-encoded (writer version 2); column and offset indexes let a reader fetch a few documents' pages, or the metadata
columns without any ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Splitter, list_array
from .common import held, map_arrow, require, shared_dir, trim

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, local_start bigint, file_no int, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """``dictionary``: ids as a dictionary, else delta-packed. Sizes in bytes; ``page_rows`` bounds documents a page."""

    dictionary: bool = True
    row_group: int = 32 << 20
    page: int = 256 << 10
    page_rows: int = 1_000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": str(self.dictionary).lower(),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
        }


#: Cuts that the library encodes at a time; its working memory is many times their text.
CUTS = 20_000
#: Bytes of text encoded at a time, and cuts that a worker remembers.
SLICE_BYTES = 8 << 20
CUT_ROWS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def worker_splitter(model: str) -> Splitter:
    """Parts of texts encoded by the tokenizers library, shared by this worker's tasks.

    Texts that hold an added token's string (such as an end mark) go to the library whole, which makes it that token.
    """

    def make() -> Splitter:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model)
        byte = byte_alphabet()
        token_bytes = [b""] * tok.get_vocab_size()
        for token, i in tok.get_vocab(with_added_tokens=False).items():
            token_bytes[i] = bytes(byte.get(c, 0) for c in token)
        size = np.array([max(1, len(b)) for b in token_bytes], dtype=np.int64)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]

        def joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            return np.array([i for p in parts for i in p], dtype=np.uint32), np.array([len(p) for p in parts], dtype=np.int64)

        def others(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return joined([tok.encode(t, add_special_tokens=False).ids for t in texts])

        def cuts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            some_ = [some(parts[i : i + CUTS]) for i in range(0, len(parts), CUTS)]
            return np.concatenate([i for i, _ in some_]), np.concatenate([n for _, n in some_])

        def some(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # a text made of the cuts splits at their borders, and a token's bytes tell where they are
            ids = np.array(tok.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.cumsum([len(p.encode()) + 1 for p in parts])
            place = np.cumsum(size[ids])
            border = np.searchsorted(place, ends)
            if border[-1] >= len(place) or (place[border] != ends).any():
                return others([" " + p for p in parts])
            return ids, np.diff(border + 1, prepend=0)

        return Splitter(token_bytes, cuts, others, "|".join(map(re.escape, added)) or None, CUT_ROWS)

    return held("token_files", zlib.crc32(model.encode()), make)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, files: int | None = None, layout: Layout = Layout()
) -> None:
    """Encodes every whole text and writes the files. The tokenizer's pattern must start a match at every blank that a
    non-blank follows, as byte-level ones do.

    One range exchange by (doc_id, text hash) puts documents in order; each task then encodes its range. A null text
    is empty and yields the end id alone. Null ids come first; rows that share an id follow each other in the order of
    their texts' hash. Very long texts stay whole. An empty table writes files without rows.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = worker_splitter(model.value)
        no, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, starts = splitter.encode_many(batch.column("text"))
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(starts[:-1] + before), pa.array(np.full(len(n), no, np.int32)), list_array(ids, starts)],
                ["doc_id", "n_tokens", "local_start", "file_no", "ids"],
            )
            before += len(ids)
            trim()

    map_arrow(ordered, run, FILE_SCHEMA, keep="token_files", limit=SLICE_BYTES).write.options(**layout.options()).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of the files; a plan that doesn't use ``ids`` doesn't read them.

    ``start`` adds the tokens of all earlier files to local_start. Files are summed from the counters alone; the
    running sum has one row a file.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("file_no", before.alias("before")))  # one row a file
    return rows.join(offsets, "file_no").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Adds the crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(ids: pa.Array) -> pa.Array:
        flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64())

    return tokens.withColumn("ids_crc32", crc("ids"))


def token_path(spark: SparkSession) -> str:
    return shared_dir(spark, "tokens")
