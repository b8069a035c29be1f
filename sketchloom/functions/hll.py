"""HyperLogLog: Spark's own sketches, and a portable register form that SQL can reproduce."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BITS = 21  # of Spark's own sketches; the sparse form goes further
REGISTERS = 4096


def native(elements: DataFrame, bits: int = 12, key: str = "ub_id") -> DataFrame:
    """(key, sketch): mergeable, with a map-side combine. Spark has 4 to 21 index bits."""
    if not 4 <= bits <= MOST_BITS:
        raise ValueError(f"sketch_bits must lie in [4, {MOST_BITS}] here")
    return elements.groupBy(key).agg(F.hll_sketch_agg("h", bits).alias("sketch"))


def union(sketches: DataFrame, key: str) -> DataFrame:
    return sketches.groupBy(key).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(F.col(sketch))


def union_estimate(a: str, b: str) -> Column:
    return F.hll_sketch_estimate(F.hll_union(F.col(a), F.col(b)))


def registers(elements: DataFrame, key: str = "ub_id") -> DataFrame:
    """(key, reg, rank): 4096 registers by the first three hex digits of md5, rank by the next 13."""
    digest = F.md5(F.col("h").cast("string").cast("binary"))
    tail = F.conv(F.substring(digest, 4, 13), 16, 10).cast("long")
    rank = F.when(tail == 0, 53).otherwise(53 - F.length(F.bin(tail)))
    return elements.select(key, F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("reg"), rank.cast("int").alias("rank")).groupBy(key, "reg").agg(F.max("rank").alias("rank"))


def merge(regs: DataFrame, key: str) -> DataFrame:
    return regs.groupBy(key, "reg").agg(F.max("rank").alias("rank"))


def sparse(elements: DataFrame, bits: int, key: str = "ub_id") -> DataFrame:
    """(key, reg, rank) with 4 to 32 index bits: only registers in use have a row, so a sketch is
    no larger than its set, and parts merge by the greatest rank. The index is the head of the
    first eight hex digits of md5, the rank comes from the next 13."""
    if not 4 <= bits <= 32:
        raise ValueError("sketch_bits must lie in [4, 32]")
    digest = F.md5(F.col("h").cast("string").cast("binary"))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    tail = F.conv(F.substring(digest, 9, 13), 16, 10).cast("long")
    rank = F.when(tail == 0, 53).otherwise(53 - F.length(F.bin(tail)))
    rows = elements.select(key, F.shiftright(head, 32 - bits).alias("reg"), rank.cast("int").alias("rank"))
    return rows.groupBy(key, "reg").agg(F.max("rank").alias("rank"))


def pack(regs: DataFrame, *key: str) -> DataFrame:
    """(key, regs): the 4096 registers of each key as one byte string."""
    pairs = regs.groupBy(*key).agg(F.collect_list(F.struct("reg", "rank")).alias("pairs"))

    def run(batches):
        for batch in batches:
            out = []
            for one in batch.column("pairs"):
                row = np.zeros(REGISTERS, np.uint8)
                row[one.values.field("reg").to_numpy()] = one.values.field("rank").to_numpy()
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(out, pa.binary())], [*key, "regs"])

    return pairs.mapInArrow(run, T.StructType([pairs.schema[k] for k in key] + [T.StructField("regs", T.BinaryType())]))


def estimates(regs: DataFrame, key: str = "ub_id", bits: int = 12) -> DataFrame:
    """(key, estimate): harmonic mean, linear counting for small sets."""
    m = float(1 << bits)
    alpha = 0.7213 / (1 + 1.079 / m)
    got = regs.groupBy(key).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("used")))
    return got.select(key, F.when((raw <= 2.5 * m) & (F.col("used") < m), m * F.log(m / (m - F.col("used")))).otherwise(raw).alias("estimate"))
