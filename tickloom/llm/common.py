"""Helpers shared by the corpus operators: stored steps, Arrow maps over texts, hashing of byte windows."""
from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F

from tickloom.session import drop_path, prepare, work_path

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library plus bounded Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends there and it is computed once.

    The step's shuffle files are deleted when it is written, so a job of many steps needs the disk of its largest.
    """
    spark = df.sparkSession
    path = work_path(spark, f"llm-{name}")
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def free(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


def drop_stored(*steps: DataFrame) -> None:
    """Delete stored steps whose last reader has been stored itself."""
    for step in steps:
        drop_path(step.sparkSession, step._llm_path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what they hold adds up over the steps of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; batches without rows are skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                out = fn(batch) if batch.num_rows else None
                del batch
                if out is not None:
                    yield out
                    del out
        finally:
            give_back()
    return df.mapInArrow(run, schema)


def map_groups(grouped: GroupedData, fn: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``applyInArrow`` with a function of one group."""
    def run(group: pa.Table) -> pa.Table:
        try:
            return fn(group)
        finally:
            give_back()
    return grouped.applyInArrow(run, schema)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch and more columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, and the offset at which each starts (one more at the end).

    Nulls are empty. No text is copied unless the column holds nulls.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_random = np.random.default_rng(20240607)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64; the tables grow by doubling."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.ones(size, np.uint64)
            filled, step = 1, base
            while filled < size:  # out[filled:2*filled] = out[:filled] * base**filled
                out[filled:2 * filled] = out[:filled] * np.uint64(step)
                filled, step = filled * 2, step * step % (1 << 64)
            _powers[name] = out
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``window_hash`` takes the hash of any stretch from them."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end); stretches of other lengths differ by their length too."""
    _, down = powers(len(prefix))
    out = (prefix[end] - prefix[start]) * down[start]
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end).

    Words are runs of bytes other than the six ASCII spaces; in UTF-8 these are the same as runs of code points.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_is_space[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data))]
    starts[inner] = word[inner]  # a text never continues the word before it
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


#: A text is split into words in pieces of this many bytes.
PIECE = 1 << 20
_space = re.compile(b"[" + re.escape(SPACES) + b"]")


def word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists; a long text is split piece by piece, at white space."""
    a = 0
    while a < len(raw):
        stop = _space.search(raw, a + PIECE)
        b = stop.start() if stop else len(raw)
        yield raw[a:b].split()
        a = b


class ByteValues:
    """The hash values of bytes, taken when a slice is asked for."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __getitem__(self, part: slice) -> np.ndarray:
        return BYTE_VALUE[self.data[part]]


HASH_STEP, LONG_WORD = 1 << 16, 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, taken over ``HASH_STEP`` bytes of text at a time; longer words are hashed one by one.

    Polynomial hashes modulo 2^64 confuse certain long words (Thue-Morse words), so they name short ones only.
    """
    out, i = np.empty(len(start), np.uint64), 0
    long = end - start > LONG_WORD
    for k in np.flatnonzero(long):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k]:end[k]].tobytes())
    short = np.flatnonzero(~long)
    start, end = start[short], end[short]
    while i < len(short):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_STEP, "right")))
        base = start[i]
        if end[j - 1] - base > 2 * HASH_STEP:  # a long word in between
            j = i + 1
        out[short[i:j]] = window_hash(prefix_hash(data[base:end[j - 1]]), start[i:j] - base, end[i:j] - base)
        i = j
    return out


def word_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the index of its first word (one more at the end)."""
    data, offsets = bytes_of(texts)
    start, end, first = word_spans(data, offsets)
    return word_hashes(data, start, end), first


def string_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())
