"""Helpers that the operators share: words of UTF-8 buffers in numpy, Arrow slices, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.ship import ship

#: Bytes of text that one vectorised step handles; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20
#: Bytes of batches after which a Python worker returns its freed memory.
GIVE_BACK_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64, kept between calls unless a text is very long."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls: empty) and the n + 1 offsets into them."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind, column = np.int32, column.cast(pa.string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about `limit` bytes of `column` (a longer text is a slice of its own)."""
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: By operator: forgets what its tasks keep in a worker for the tasks that follow.
_FORGET: dict[str, Callable[[], None]] = {}
_LIBC: list[ctypes.CDLL | None] = []


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Tasks of `owner` keep something in this worker; tasks of other operators call forget()."""
    _FORGET[owner] = forget


def give_back() -> None:
    """Return freed memory to the system. numpy's and Arrow's allocators would hold it for as long as the worker lives."""
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL(None))
        except OSError:
            _LIBC.append(None)
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC[0], "malloc_trim", None)  # only in glibc
    if trim:
        trim(0)


def steady(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches of a task. What other operators left in this worker goes first, and after every GIVE_BACK_BYTES what they took.

    Spark uses a worker again and again, also while it is idle beside an executor whose heap grows.
    """
    for name in [x for x in _FORGET if x != owner]:
        _FORGET.pop(name)()
    give_back()
    read = 0
    for batch in batches:
        read += batch.nbytes
        yield batch
        del batch
        if read >= GIVE_BACK_BYTES:
            give_back()
            read = 0


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a buffer of texts: starts, ends (byte positions) and bounds (first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = np.unique(offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """An unsigned 64-bit hash of each word's bytes: a polynomial over random byte values, mixed with the length."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_STEP, n), out=sums[1:])
            raw = (sums[self.ends] - sums[self.starts]) * powers(_BACK, n + 1)[self.starts]
            return _mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values: a polynomial of the values, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(_STEP) + hashes[k : k + n]
    return _mix(out)


def with_checkpoints(spark: SparkSession) -> None:
    """Set a checkpoint folder where the session names none (tests); a cluster names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df as files in the shared checkpoint folder: lineage ends here and a lost executor costs nothing."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    with_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the JVM drop shuffle files of DataFrames that are out of reach, ahead of its periodic collection."""
    import gc

    for _ in range(3):  # what one collection frees holds what the next one can
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)  # the cleaner works in a thread of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Most ranges of range_bounds; more rows than these hold make the ranges longer.
MOST_RANGES = 1 << 13


def range_bounds(df: DataFrame, key: str, rows: int) -> list[int]:
    """Ascending values of a long column that start ranges of about `rows` rows each; nulls count as the least long."""
    value = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    count, low = df.agg(F.count("*"), F.min(value)).first()
    n = max(1, min(MOST_RANGES, -(-count // rows)))
    if n == 1:
        return [low if low is not None else 0]
    found = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted({low, *found})


def range_number(key: str, bounds: list[int]) -> F.Column:
    """The number of the range of a long column by binary search; values below the first bound are in range 0."""
    size = len(bounds)
    steps = [1 << k for k in range((size - 1).bit_length() - 1, -1, -1)] if size > 1 else []
    value = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    if not steps:
        return F.lit(0)
    marks = F.lit(bounds) if size < 2 else F.array(*(F.lit(b) for b in bounds))
    found = lambda lo, step: F.when((lo + step < size) & (F.element_at(marks, F.least(lo + step, F.lit(size - 1)) + 1) <= value), lo + step).otherwise(lo)
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), found)
