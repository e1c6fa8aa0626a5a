"""Helpers shared by the operators: text chunks as bytes, word expressions, lineage cuts."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: Java/Python pattern of a word: everything but the ASCII white space 20 and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """How many white-space separated words a text has."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an error where a cluster has none."""
    return shared.folder(spark)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffles and checkpoints that nothing refers to, which it learns from the garbage collectors."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Gives back what the driver's JVM and Python have freed outside the heap; each of the JVM's many threads may keep a pool of its own. JVMs without the command keep it: False."""
    tidy()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = new(jvm.java.lang.Class, 4)
        for i, k in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(k)
        given = new(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        return False
    return True


class Kept:
    """What operators keep beside their results: persisted frames and stored folders, until release()."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []
        self.paths: list[str] = []

    def release(self, spark: SparkSession) -> None:
        for df in self.frames:
            df.unpersist()
        for path in self.paths:
            shared.drop(spark, path)
        self.frames, self.paths = [], []
        sweep(spark)


_collecting: list[Kept] = []


@contextmanager
def keeping(kept: Kept) -> Iterator[None]:
    """All that is persisted or stored meanwhile is noted, so that it can be released once the results are written."""
    _collecting.append(kept)
    try:
        yield
    finally:
        _collecting.pop()


#: Rows of a partition of what cut() writes, where it knows how many there are: many small files cost more than they hold.
ROWS = 200_000


def cut(df: DataFrame, rows: int | None = None, each: int = ROWS) -> DataFrame:
    """df computed once and read again from the shared folder, its lineage cut; a lost executor costs no more than a task.

    rows: about how many there are, if that is known; `each` of them make a partition.
    """
    shared_folder(df.sparkSession)
    trim(df.sparkSession)
    with cleaning(df.sparkSession):
        return (df.select("*") if rows is None else df.coalesce(max(1, -(-rows // each)))).checkpoint(eager=True)


def reused(df: DataFrame) -> DataFrame:
    """df kept by the executors, in memory or on their disks; what a lost one held is computed again from the input."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _collecting:
        _collecting[-1].frames.append(df)
    return df


#: Whether Spark removes a query's shuffles at its end. Versions without the setting leave them to sweep().
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries made meanwhile lose the shuffles that they have made once they end; sweep() may learn of them much later."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def stored(df: DataFrame, name: str, by: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """As cut(), but as compressed Parquet, for wide or large rows; in a folder for each value of a column, if one is given. The path is added to `paths`."""
    spark = df.sparkSession
    path = shared.place(spark, name)
    if _collecting:
        _collecting[-1].paths.append(path)
    if paths is not None:
        paths.append(path)
    with cleaning(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, without a copy."""
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` text bytes (a longer text has a slice of its own); null texts become empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        array = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, pa.field(column, array.type), array)
        if not len(array):
            continue
        size = pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum(np.cumsum(size) - 1, 0) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(array)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    tidy()


def tidy() -> None:
    """Gives freed memory back, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def row_and_text(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a struct `row` of these columns and more, with the text beside it where it is one of them."""
    for b in batches:
        if "text" in columns and b.schema.get_field_index("text") < 0:
            b = b.add_column(1, "text", b.column(0).flatten()[columns.index("text")])
        yield b


def row_struct(docs: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """docs as the struct `row` of the columns, the text if it isn't one of them, and more; each is sent to Python once."""
    own = [] if "text" in columns else [F.col("text").alias("text")]
    return docs.select(F.struct(*columns).alias("row"), *own, *more)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows one by one; binary values (also within lists) as buffers of the batch, without a copy."""

    def value(x: pa.Scalar):
        if not x.is_valid:
            return None
        if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type):
            return x.as_buffer()
        return [value(y) for y in x] if pa.types.is_list(x.type) else x.as_py()

    for i in range(batch.num_rows):
        yield tuple(value(c[i]) for c in batch.columns)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return x.astype(next(f"u{k}" for k in (1, 2, 4, 8) if x.max(initial=0) < 1 << (8 * k)))


def pack(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as they need, which the first byte tells."""
    x = narrow(x)
    return bytes([x.itemsize]) + x.tobytes()


def unpack(data) -> np.ndarray:
    return np.frombuffer(data, f"u{memoryview(data)[0]}", offset=1).astype(np.int64)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as their steps, byte by byte, as the upper bytes of steps are mostly zero and compress."""
    return planes(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(data) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data, kind) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def fold(array: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _FOLD[array]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and the document of each; words never cross documents."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]
    last = np.empty_like(word)
    last[-1] = word[-1]
    last[:-1] = word[:-1] & (~word[1:] | first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SEGMENT = 1 << 19


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in order, the same wherever a span stands; worked through in short segments."""
    out = np.empty(len(starts), np.uint64)
    part = starts // _SEGMENT
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(starts) else ()
    for a, z in zip(edges, edges[1:]):
        lo = starts[a]
        out[a:z] = _span_hashes(raw[lo : ends[z - 1]], starts[a:z] - lo, ends[a:z] - lo)
    return out


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(raw)
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, _BACK)):
            p = np.full(max(n + 1, 2 * _SEGMENT), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * _powers[0][:n], out=s[1:])
    return mixed((s[ends] - s[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no given column has, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def read_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of the documents and no others, whatever else the table has."""
    return docs.select(*columns)
