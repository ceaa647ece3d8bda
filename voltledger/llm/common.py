"""What the corpus operators share: tables written in the shared folder, row numbers, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, a fresh temporary folder."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-")
    return _own_dir


class Scratch:
    """Tables that live for one operator call. put() writes one and reads it back, which cuts the lineage and gives
    the optimiser true sizes; drop() deletes tables that nothing later reads, clear() those that the result doesn't read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str, **options: str | int) -> DataFrame:
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes those of tables that put() returned; what was made from them has to be written before."""
        jvm = self.spark.sparkContext._jvm
        gone = [x for x in self.tables if any(x[0] is t for t in tables)]
        for _, path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = [x for x in self.tables if not any(x is g for g in gone)]

    def put_bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """As put(), in as many buckets of key as a shuffle has partitions: a join by key finds this side in place."""
        path, table = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}", f"t{uuid.uuid4().hex}"
        n = parts(self.spark)
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay, and what is read from them has found them
        return out

    def clear(self, keep: tuple[str, ...] = ()) -> None:
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.top)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(top):
            for s in fs.listStatus(top):
                if not s.getPath().getName().startswith(tuple(f"{k}-" for k in keep)):
                    fs.delete(s.getPath(), True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str) -> Column:
    """Stands for a row by its content; identical rows share it."""
    return F.xxhash64(*cols)


def numbered(df: DataFrame, key: str, order: list[str], chunks: int, out: str = "slot") -> DataFrame:
    """Adds out: 0, 1, 2, ... within each value of key. A key's rows are split into chunks by a hash of order, numbered
    there and moved up by the rows of earlier chunks, so no task holds a key as a whole."""
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_chunk").orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(own) - 1)
    return ranked.join(counts.hint("merge"), [key, "_chunk"]).withColumn(out, F.col("_before") + F.col("_at")).drop("_chunk", "_before", "_at")


def blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about chars bytes of column, or one longer text, and at most rows rows."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array([0 if s is None else s for s in pc.binary_length(b.column(column)).to_pylist()], dtype=np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // chars) | np.diff(np.arange(len(sizes)) // rows)) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in one array, and where each text starts (one more at the end); null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes that words() works on at once.
WORD_BYTES = 1 << 22
#: Odd, for polynomials modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = (mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1))[_FOLD]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts joined as by joined_bytes, cut at ASCII white space, A-Z in lower case: a 64-bit hash of each,
    the text it is in, and its bytes' start and end."""
    found, lo = [], 0
    while lo < len(data):  # the arrays take some 50 bytes a byte while they are made, so long stretches are cut at white space
        hi = min(lo + WORD_BYTES, len(data))
        while hi < len(data) and not len(blank := np.flatnonzero(_SPACE[data[max(lo, hi - WORD_BYTES) : hi]])):
            hi = min(hi + WORD_BYTES, len(data))
        if hi < len(data):
            hi = max(lo, hi - WORD_BYTES) + int(blank[-1]) + 1
        inner = starts[(starts > lo) & (starts < hi)] - lo
        h, at, ends = _words(data[lo:hi], inner)
        found.append((h, at + lo, ends + lo))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    h, at, ends = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
    return h, np.searchsorted(starts, at, side="right") - 1, at, ends


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of data, in which a text begins at each of edges."""
    gap = _SPACE[data]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    ends = np.flatnonzero(np.append(inside[:-1] & (gap[1:] | first[1:]), inside[-1])) + 1
    sizes = ends - at
    where = np.flatnonzero(inside)
    place = np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = _BYTE[data[where]] * powers(BASE, int(sizes.max()))[place]
    h = mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, at, ends


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def squeezed(x: np.ndarray, in_order: bool = False) -> bytes:
    """A compressed array of whole numbers: differences if in order, then byte by byte of all numbers."""
    import zstandard

    if in_order and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(x.view("u1").reshape(len(x), x.dtype.itemsize).T).tobytes(), 1)


def unsqueezed(data: bytes, kind: str, in_order: bool = False) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if in_order else x


def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves, the
    other bytes follow from 256 on in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}
