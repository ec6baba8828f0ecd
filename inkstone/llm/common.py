"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources.store import shared_folder, stored as checkpointed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that Spark hands to Python, so that a worker's memory doesn't follow the length of texts.
BATCH_BYTES = "8m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _worker(batches: Iterator[pa.RecordBatch], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``fn`` in a worker, which lives on between tasks: memory that a task has used goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield from fn(batches)
    finally:
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES, unless the session has a bound of its own."""
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(partial(_worker, fn=fn), schema)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: remainder 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array, nulls as empty, offsets from 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; for integers many times as fast as hashing them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that are in a word: ASCII letters and digits, and all of a non-ASCII character.
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def word_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each text: runs of WORD_BYTES, never across texts."""
    if not len(data):
        return np.zeros(len(off) - 1, np.int64)
    word = WORD_BYTES[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = word[first]
    total = np.concatenate([[0], np.cumsum(start, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


#: Bytes of text that a training sample brings to the driver at most.
SAMPLE_BYTES = 64 << 20


def collected(rows: DataFrame, most_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (doc_id, text, ...), in order of the CRC-32 of doc_id, as long as their texts fit in ``most_bytes``.

    A text that doesn't fit is left out as a whole, and the next ones are tried.
    """
    rows = checkpointed(rows)
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).collect()
    left, wanted = most_bytes, []
    for doc_id, n in sorted(sizes, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
        if n <= left:
            left -= n
            wanted.append(doc_id)
    if len(wanted) < len(sizes):
        ids = rows.sparkSession.createDataFrame([(i,) for i in wanted], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    return sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows of the folds that may be learnt from, in whole texts of ``most_bytes`` at most.

    The rows are those first in the order of a hash of doc_id, so the sample has a fixed bound at any size of the
    tables and is the same in each run. An id is one row before anything is collected: of several texts it has the
    smallest, of several labels the largest; a label other than 0 and 1 or null is none. Null texts count as empty.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod("doc_id", folds) != left_out))
        .groupBy("doc_id").agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    got = collected(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y")), most_bytes)
    return [(r.text, int(r["_y"])) for r in got]


def without_copies(sample: list[tuple[str, int]], words: int = 5, size: int = 6, same: int = 4) -> list[tuple[str, int]]:
    """The sample without texts whose sketch shares ``same`` of its ``size`` smallest shingle hashes with one kept.

    Copies of one text would else count as so many witnesses for each of its words.
    """
    holders: dict[int, list[int]] = {}
    out = []
    for text, y in sample:
        w = text.lower().split()
        sketch = sorted({zlib.crc32(" ".join(w[i : i + words]).encode()) for i in range(max(1, len(w) - words + 1))})[:size]
        shared: dict[int, int] = {}
        for h in sketch:
            for k in holders.get(h, ()):
                shared[k] = shared.get(k, 0) + 1
        if max(shared.values(), default=0) < min(same, len(sketch)):
            for h in sketch:
                holders.setdefault(h, []).append(len(out))
            out.append((text, y))
    return out
