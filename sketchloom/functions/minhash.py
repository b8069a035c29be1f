"""Bottom-k sketches: the k least hashes of a set. Two of them merge, and estimate similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 40


def hashed(h: str = "h") -> Column:
    """60 bits of md5."""
    return F.conv(F.substring(F.md5(F.col(h).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _least(hashes: DataFrame, k: int, key: str) -> DataFrame:
    # A limit on row_number is applied before the shuffle too, so k rows a key and task travel.
    rank = F.row_number().over(Window.partitionBy(key).orderBy("m"))
    least = hashes.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("minhashes"))


def bottom(elements: DataFrame, k: int = K, key: str = "ub_id") -> DataFrame:
    """(key, minhashes): the k least hashes of each set, ascending."""
    return _least(elements.select(key, hashed().alias("m")), k, key)


def merge(sketches: DataFrame, key: str, k: int = K) -> DataFrame:
    """Sketches of the unions of the sets with one key."""
    return _least(sketches.select(key, F.explode("minhashes").alias("m")), k, key)


def similarity(a: str, b: str, k: int = K) -> Column:
    """Jaccard similarity estimate: of the k least hashes of both, the share that is in each."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(both, F.col(a)), F.col(b))) / F.size(both)
