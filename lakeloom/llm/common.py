"""What the operators share: stored intermediate tables, exact distributed ranks, and word hashing on Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 250, 1 << 24

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for local sessions that name none."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def made() -> int:
    """How many tables of this process are stored."""
    return len(_made)


def clear(since: int | None = None) -> None:
    """Deletes all stored tables of this process; DataFrames that read them are void then. At exit it happens by itself. With since, a
    number from made(): all but the newest one that were stored since."""
    gone = _made[since:-1] if since is not None else list(_made)
    for entry in gone:
        spark, path = entry
        _made.remove(entry)
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(clear)


def stored(df: DataFrame, release: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs only a reread. With release,
    Spark is made to drop the shuffle files that only led here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def batched(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small enough for very long texts."""
    conf = df.sparkSession.conf
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if conf.get(key, None) != str(value):
            conf.set(key, str(value))
    return df


def release() -> None:
    """Gives memory that this process no longer uses back to the system: Python workers live on from stage to stage, and what
    their allocators keep would add up."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM: its unused heap, and what its native allocator keeps of freed buffers, where the JVM can tell it to."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:  # by the interface's method, as the server's own class is closed to py4j
        made, kind = spark.sparkContext._gateway.new_array, jvm.java.lang.Class.forName
        server, text = kind("javax.management.MBeanServer"), kind("java.lang.String")
        types, values = made(jvm.java.lang.Class, 4), made(jvm.java.lang.Object, 4)
        types[0], types[1] = kind("javax.management.ObjectName"), text
        types[2], types[3] = made(jvm.java.lang.Object, 0).getClass(), made(jvm.java.lang.String, 0).getClass()
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server.getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # noqa: BLE001  not every JVM has the command
        return


def release_executors(spark: SparkSession) -> None:
    """The same for the executors' heaps, which garbage alone lets grow to their limit. It is more than unused memory: a process that an
    executor starts (where Hadoop has no native library, one for the mode of each file it writes) counts as large as its heap for a moment."""
    n = spark.sparkContext.defaultParallelism  # as many tasks as cores: at once, so that every executor gets some; it collects once for them
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def trimmed(run):
    """run, a function over Arrow batches, with a release at the end of its task."""

    @functools.wraps(run)
    def ended(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return ended


def starts(counts: DataFrame, key: str, part: str = "pid", n: str = "n") -> DataFrame:
    """Of counts by (part, key): for each the rows of the same key in lesser parts, as `before`."""
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, sorted. By sorting: np.unique() alone goes by a hash table, which takes many times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class LocalRanks:
    """Within one task: the rank of each row among the task's rows of its key. With the counts by (task, key), starts() makes
    these ranks exact over all tasks, and no key's rows ever meet in one task."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(k)])
        base = np.fromiter((self.seen.get(int(k[f]), 0) for f in first), np.int64, len(first))
        for f, b, s in zip(first, base, size, strict=True):
            self.seen[int(k[f])] = int(b + s)
        out = np.empty(len(k), np.int64)
        out[order] = np.arange(len(k)) - np.repeat(first, size) + np.repeat(base, size)
        return out


# ---------------------------------------------------------------- words

_RNG = np.random.default_rng(20240117)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_A = np.uint64(0x9E3779B97F4A7C15 | 1)
_A_INV = np.uint64(pow(int(_A), -1, 2**64))
#: Words of more bytes are hashed one by one.
LONG = 128
#: Bytes 0x09-0x0D and 0x20 part words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A**i and A**-i modulo 2**64 for i below n."""
    if len(_POW[0]) < n:
        for k, a in enumerate((_A, _A_INV)):
            p = np.full(n + 1, a, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's bounds in them, without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 19):
    """(first row, bytes, bounds) of runs of rows with about `most` bytes; a longer row comes alone."""
    raw, off = buffers(column)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row (runs of bytes that are not white space): first byte, end, row and 64-bit hash. Rows part words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    out = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = ~out
    begin[1:] &= out[:-1] | edge[1:n]
    stop = ~out
    stop[:-1] &= out[1:] | edge[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(off, s, "right") - 1
    p, q = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[raw] * p, out=total[1:])
    hashed = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
    for i in np.flatnonzero(e - s > LONG):  # sums modulo 2**64 have equal values for some pairs of words of 1024 bytes
        word = raw[s[i] : e[i]].tobytes()
        hashed[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return s, e, row, hashed
