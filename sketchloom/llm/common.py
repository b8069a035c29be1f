"""Helpers shared by the training-data operators: work tables, ranged order, word hashing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
#: Odd multipliers of the polynomial hashes, and their inverses modulo 2**64.
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
SLICE_BYTES = 1 << 21


# ------------------------------------------------------------------ work tables
def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work-tables"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sketchloom/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def renamed(df: DataFrame, table_: DataFrame) -> DataFrame:
    """``df``, which reads the work table ``table_`` and stands for it in ``drop``."""
    df._work_path = table_._work_path
    return df


def drop(*frames: DataFrame) -> None:
    """Delete the files of work tables that nothing needs any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._work_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ memory of Python workers
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold about 4 MB, not 64: both sides of a worker's pipe keep less
    outside the heap. Results are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_kept: dict[str, Callable[[], None]] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """From now on this process holds caches of ``owner``, which ``forget`` empties."""
    if owner not in _kept:
        release(owner)
        _kept[owner] = forget


def release(but: str | None = None) -> None:
    """Spark uses a Python worker again for the next stages: caches that kernels of other owners
    left in it go, and freed memory goes back to the system."""
    for owner in [x for x in _kept if x != but]:
        _kept.pop(owner)()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


# ------------------------------------------------------------------ global order
def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending cut points of a long column, from one narrow scan.

    The driver receives ``n`` numbers, however many rows there are."""
    if n < 2:
        return []
    q = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, q, 20 * n).alias("q")).first()["q"] or []
    return sorted(set(got))


def range_bucket(key: str, bounds: list[int]) -> F.Column:
    """0-based range of ``key``; nulls come first. A binary search on a literal array."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col(key)))).cast("int")


def in_ranges(df: DataFrame, bucket: str, n: int, *order: F.Column | str) -> DataFrame:
    """Range ``i`` goes whole to partition ``i``, sorted by ``order`` there."""
    return df.repartitionById(n, F.col(bucket)).sortWithinPartitions(bucket, *order)


# ------------------------------------------------------------------ words
_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_CODE[IS_SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base), U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, each followed by a line feed, and where each starts."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    raw.append(b"")
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    return buf, np.concatenate([[0], np.cumsum(lengths)])


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 9 to 13."""
    edge = np.diff(np.concatenate([[True], IS_SPACE[buf], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_words(texts: list[str | None], lower: bool = False):
    """64-bit hashes of all words of the texts, and the offsets of each text in them.

    Also the byte buffer with the words' starts and ends, to cut words out again."""
    buf, at = text_buffer(texts)
    if lower:
        buf = LOWER[buf]
    starts, ends = word_bounds(buf)
    lens = ends - starts
    out = np.zeros(len(starts), U64)
    longest = int(lens.max(initial=0))
    pw = powers(BASES[0], longest + 1)
    first = 0
    while first < len(starts):  # slices bound the memory, whatever the text's length
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE_BYTES)))
        a, b = starts[first], ends[last - 1]
        code = BYTE_CODE[buf[a:b]]
        place = np.arange(a, b) - np.repeat(starts[first:last], np.diff(np.append(starts[first:last], b)))
        np.minimum(place, longest, out=place)
        out[first:last] = np.add.reduceat(code * pw[place], starts[first:last] - a)
        first = last
    out = mix(out + lens.astype(U64) * GOLD)
    return out, np.searchsorted(starts, at), buf, starts, ends


class Spans:
    """Hashes of arbitrary word ranges of one array, by prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int):
        pw = powers(base, len(words) + 1)
        self.inverse = powers(pow(base, -1, 2**64), len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * pw[:-1], dtype=U64)])

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * GOLD)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of an Arrow batch with at most about ``most`` bytes of text each."""
    col = batch.column(column)
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64) if len(col) else np.zeros(0, np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct ``row``, whatever their names."""
    return F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in df.columns]).alias("row")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
