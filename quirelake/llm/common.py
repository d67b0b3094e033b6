"""Helpers shared by the training-data operators: shared folders, lineage cuts, ASCII folding, byte buffers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: whole texts are long, and both sides of a Python worker hold a batch.
ARROW_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ARROW_ROWS rows for what runs within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    with small_batches(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Bytes of a written table (compressed) up to which it may be broadcast; beyond, Spark shuffles.
BROADCAST_BYTES = 4 << 20


def cut_small(df: DataFrame, what: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Like cut, for one side of a join: with a hint to broadcast it if what was written is no larger than `most` bytes."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    with small_batches(spark):
        df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    out = spark.read.schema(df.schema).parquet(at)
    return F.broadcast(out) if size <= most else out


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole(c: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(c, F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id and text as one value that is never null and sorts by id, rows without one last."""
    return F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, evaluated once a row: inside the lambdas of body, an expression would be evaluated each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def release() -> None:
    """Gives what a reused Python worker has freed since back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---------------------------------------------------------------- byte buffers (numpy)

_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes by prefix sums.
_Q = 0x9E3779B97F4A7C15
_QI = pow(_Q, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
TABLE_FOLDED = _TABLE[_FOLD]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S)
    h *= _M
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


_powers: dict[int, np.ndarray] = {}


def powers(n: int, q: int) -> np.ndarray:
    """q ** 0 .. q ** (n - 1); what a worker has made serves again."""
    if q not in _powers or len(_powers[q]) < n:
        out = np.full(max(n, 1 << 21), np.uint64(q), np.uint64)
        out[0] = 1
        _powers[q] = np.multiply.accumulate(out)
    return _powers[q][:n]


class Rolling:
    """Hashes of any range of a buffer in O(1) each, equal for equal ranges wherever they lie. table: a value for each byte; None if data are 64-bit hashes."""

    def __init__(self, data: np.ndarray, table: np.ndarray | None = _TABLE) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        part = data.copy() if table is None else table[data]
        part *= powers(n, _Q)
        np.cumsum(part, out=self.sums[1:])
        self.inverse = powers(n + 1, _QI)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: n + 1 - k]) * self.inverse[: n + 1 - k])


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values (64-bit, unsigned) in a row, by blocks of `width`: the end of one block and the start of the next."""
    pad = -len(values) % width
    rows = np.append(values, np.full(pad, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = max(0, len(values) - width + 1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def buffers(column, most: int = 2 << 20):
    """Of an Arrow string or binary array: (first row, last row, bytes as numpy, offsets into them), about `most` bytes at a time.
    Nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        yield from buffers(column, most)
        return
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


SPACED = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
#: Digits, letters and whatever lies beyond ASCII.
ALNUM = _ALNUM


def words_in(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row of a buffer, by default [^\\x20\\x09-\\x0D]+: starts, ends, and the words before each row (rows + 1 values)."""
    word = kind[data]
    n = len(data)
    edge = np.empty(n, bool)
    if n:
        edge[0] = True
        np.not_equal(word[1:], word[:-1], out=edge[1:])
        inner = offsets[:-1]
        edge[inner[inner < n]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    keep = word[at] if n else np.zeros(0, bool)
    starts, ends = at[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)
