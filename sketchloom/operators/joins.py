"""Joins that Spark has no operator for: as-of, and points in intervals.

Both become equi-joins and windows over bounded pieces, so a hot key is dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64


def cuts(rows: DataFrame, key: str, pieces: int = PIECES) -> list[float]:
    """At most ``pieces`` - 1 ascending places that split the keys evenly; numbers only reach the driver."""
    if pieces < 2:
        return []
    got = rows.agg(F.percentile_approx(key, [i / pieces for i in range(1, pieces)], 20 * pieces).alias("q")).first()["q"]
    return sorted(set(got or []))


def piece_of(key: str, at: list[float]) -> Column:
    """0-based piece of a key: how many places lie at or before it."""
    if not at:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x <= F.col(key)))


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keep: list[str], by: list[str] = (), forward: bool = False, pieces: int = PIECES) -> DataFrame:
    """Rows of ``left`` with ``keep`` of the last row of ``right`` at or before (``forward``: the first
    at or after) their key, among rows that agree in ``by``; nulls where there is none.

    Keys are numbers. Of rows of ``right`` with one key the greatest in ``keep`` counts. Both
    sides are put in one order, and the last value is carried on. The order is cut into pieces:
    each is a window of its own, and begins with what the pieces before it end with, which is one
    row a piece. Null keys and null ``by`` match nothing."""
    by = list(by)
    sign = -1 if forward else 1
    own = left.select(*by, (F.col(left_on) * sign).alias("k"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    theirs = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [right_on, *by])).select(*by, (F.col(right_on) * sign).alias("k"), F.lit(0).alias("side"), F.struct(*keep).alias("value"))
    at = cuts(own.where("k IS NOT NULL").select("k"), "k", pieces)
    both = own.withColumn("value", F.lit(None).cast(theirs.schema["value"].dataType)).unionByName(theirs, allowMissingColumns=True).withColumn("piece", piece_of("k", at))
    ends = both.where("side = 0").groupBy(*by, "piece").agg(F.max_by("value", F.struct("k", "value")).alias("end"))
    # What a piece begins with: the end of the nearest piece before it that has one.
    following = F.lead("piece", 1, len(at)).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("piece"))
    span = ends.withColumn("next", following).where("next > piece")
    carried = span.select(*by, F.col("end").alias("before"), F.explode(F.sequence(F.col("piece") + 1, F.col("next"))).alias("piece"))
    order = Window.partitionBy(*by, "piece").orderBy("k", "side", "value").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("last", F.last("value", ignorenulls=True).over(order)).where("side = 1").join(carried, [*by, "piece"], "left")
    found = F.when(F.col("k").isNotNull(), F.coalesce("last", "before"))
    return met.select("row.*", found.alias("value")).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"value.{c}").alias(c) for c in keep])


def in_intervals(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, by: list[str] = ()) -> DataFrame:
    """Points with every interval ``low < point <= high`` they lie in (and agree in ``by``).

    Intervals are dealt to the buckets of ``width`` that they touch; points have one bucket. So
    it is an equi-join, and a bucket holds what lies in it only."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    dealt = intervals.withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = points.withColumn("bucket", bucket(point)).join(dealt, [*by, "bucket"])
    return met.where((F.col(low) < F.col(point)) & (F.col(point) <= F.col(high))).drop("bucket")
