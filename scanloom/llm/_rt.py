"""Helpers shared by the operators: row keys, worker state, vectorised words."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step looks at together (single longer texts are taken alone).
SLICE_BYTES = 1 << 20


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(text: Column) -> Column:
    """Tells apart rows that share a doc_id (or have none): together they are a row's key."""
    return F.xxhash64(text)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine's own only where there is no cluster and none is set."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


#: While an intermediate table is written: its shuffles go once it is there, and batches for Python are small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


class Scratch:
    """Intermediate tables of one result, in the shared folder; the rest of them goes with the session's JVM."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back, which cuts lineage.  The session's settings are as before afterwards."""
        import uuid

        spark = self.spark
        path = f"{scratch_dir(spark)}/scanloom-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
        try:
            for k, v in _WHILE_WRITING.items():
                spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        self._fs(path)[0].deleteOnExit(self._fs(path)[1])
        out = spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that write() returned and that nothing reads any more."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            fs, at = self._fs(path)
            fs.delete(at, True)

    def release(self) -> None:
        """Deletes all that is left: for callers who have stored the result."""
        self.drop(*[table for table, _ in self._paths.values()])


def ranked(table: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """The rows with their number, 1, 2, 3 ..., in a global order, stored.

    A range partition, each part sorted by itself; the driver adds up the parts' sizes, a row a part.  Rows that are equal
    in the order may change places."""
    parts = 4 * shuffle_partitions(table.sparkSession)
    (at,) = fresh(table.columns, "at")
    placed = scratch.write(table.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(at), 33)
    before, rows = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        rows.append((p, before))
        before += n
    p, b = fresh((*table.columns, at), "part", "before")
    sizes = table.sparkSession.createDataFrame(rows, f"{p} bigint, {b} bigint")
    out = placed.withColumn(p, part).join(F.broadcast(sizes), p)
    return out.select(*table.columns, (F.col(b) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def fresh(taken, *names: str) -> tuple[str, ...]:
    """The names, each with underscores before it until no column is called that, whatever the case of its letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def _home():
    return sys.modules.setdefault("_scanloom_worker_state", types.ModuleType("_scanloom_worker_state"))


def worker_state(name: str, build):
    """What a Python worker keeps between tasks."""
    home = _home()
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)


def large_state(name: str, build):
    """As worker_state, for what takes over 50 MB: a worker holds one such thing, and other operators drop it."""
    home = _home()
    held = getattr(home, "large", None)
    if held is None or held[0] != name:
        drop_large()
        home.large = (name, build())
    return home.large[1]


def drop_large() -> None:
    """Gives back what a large state and earlier operators took, to the system too where its C library can do that."""
    import ctypes
    import gc

    home = _home()
    if getattr(home, "large", None) is not None:
        home.large = None
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- hashing
_U = np.uint64
#: Odd 64-bit bases of the two polynomial hashes.
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    k = 1
    while k < n:
        step = _U(pow(base, k, 1 << 64))
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        k += m
    return out


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept between calls."""
    tables = worker_state("powers", dict)
    have = tables.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(BASE[which], -1, 1 << 64) if inverse else BASE[which]
        have = _powers(base, 1 << max(16, (n - 1).bit_length()))
        if n <= 2 * SLICE_BYTES:
            tables[(which, inverse)] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of values[starts:ends] for each span: equal spans have equal hashes wherever they lie."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((values.astype(_U) + _U(1)) * powers(which, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(which, n + 1, inverse=True)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def separators(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: White space of ASCII: space and U+0009 to U+000D.
ASCII_SPACE = (0x20, *range(0x09, 0x0E))


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of each text, and the text each belongs to."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~sep[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = solid[inner]  # a text's first byte begins a word, whatever lies before it
    end[inner - 1] = solid[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, side="right") - 1


def word_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts, where ASCII white space stands between words."""
    n = len(data)
    space = (data == 0x20) | (data - np.uint8(0x09) < 5)
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = ~space[inner]  # a text's first byte begins a word, whatever lies before it
    end[inner - 1] = ~space[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (null: empty), without a copy where it has no nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column = column.cast(pa.large_string())
        kind = np.int64
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], kind)[at : at + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch, text_col: str, most: int = SLICE_BYTES):
    """Parts of a record batch with about `most` bytes of text each."""
    _, offsets = text_buffers(batch.column(text_col))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(sorted_values)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.concatenate((starts, [n])))


# ---------------------------------------------------------------- bitmaps
#: A bitmap of 2 ** BITMAP_BITS places (4 MB): what is sent to all workers has this size for any input.
BITMAP_BITS = 25


def bitmap(df: DataFrame, hash_col: str) -> np.ndarray:
    """Marks the hashes (longs) of a column.  What is not marked is surely absent; the fuller it gets, the more is let through."""
    h = F.shiftrightunsigned(F.col(hash_col), 64 - BITMAP_BITS)
    words = df.select(F.shiftright(h, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes >> _U(64 - BITMAP_BITS)
    return (bits[(h >> _U(6)).astype(np.int64)] >> (h & _U(63))) & _U(1) == 1
