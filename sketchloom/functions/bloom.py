"""Bloom filter sizes, false positive corrections and query cost, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Measured query cost relative to 64 bins, by false positive rate, for 2^6 .. 2^16 bins.
COST = {
    0.0001: (1.0000, 1.0602, 1.3492, 1.3524, 1.5645, 1.9595, 3.4143, 5.4849, 6.8115, 10.9489, 19.8932),
    0.0005: (1.0000, 1.0534, 1.1068, 1.2821, 1.5151, 1.7112, 3.6442, 4.7700, 6.9978, 12.2086, 22.5374),
    0.0025: (1.0000, 1.0015, 1.0031, 1.0876, 1.4027, 1.6920, 3.3014, 4.8019, 7.6273, 13.5664, 24.1108),
    0.0125: (1.0000, 1.0071, 1.1713, 1.3430, 1.8335, 2.6955, 5.3925, 8.6168, 15.0510, 28.3340, 54.4134),
    0.0500: (1.0000, 1.2241, 1.3336, 1.6827, 2.4608, 3.7554, 7.3573, 12.4689, 23.2699, 45.0874, 86.5339),
    0.0625: (1.0000, 1.1011, 1.2670, 1.5964, 2.4030, 3.6996, 7.1772, 12.4852, 23.3882, 44.7427, 87.8259),
    0.3125: (1.0000, 1.2818, 1.5493, 2.2546, 3.7804, 6.5428, 12.9410, 24.4539, 47.6262, 93.4733, 185.1019),
}
MAX_BINS = 65536


def _fill(fpr: float, hashes: int) -> float:
    """ln(1 - fpr^(1/h)): the log of the share of bits that stay unset."""
    return math.log(1 - math.exp(math.log(fpr) / hashes))


def bits(n: Column, fpr: float, hashes: int) -> Column:
    """Bits of a Bloom filter for ``n`` elements."""
    return F.ceil(-(n * hashes) / F.lit(_fill(fpr, hashes))).cast("long")


def bits_of(n: int, fpr: float, hashes: int) -> int:
    return math.ceil(-(n * hashes) / _fill(fpr, hashes))


def split_factor(s: int, fpr: float, hashes: int) -> float:
    """Growth of each of ``s`` bins that share one user bin, to keep the joint rate."""
    return 1.0 if s == 1 else _fill(fpr, hashes) / _fill(1 - math.exp(math.log(1 - fpr) / s), hashes)


def split_correction(s: Column, fpr: float, hashes: int) -> Column:
    each = 1 - F.exp(F.lit(math.log(1 - fpr)) / s)
    return F.when(s == 1, 1.0).otherwise(F.lit(_fill(fpr, hashes)) / F.log(1 - F.exp(F.log(each) / hashes)))


def merged_factor(fpr: float, relaxed: float, hashes: int) -> float:
    """Shrinking of merged bins, which may have the relaxed rate."""
    return _fill(fpr, hashes) / _fill(relaxed, hashes)


def ceil_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    top = a + b - 1
    return ((top - F.pmod(top, b)) / b).cast("long")


def multiple_of_64(v: Column) -> Column:
    return ceil_div(v.cast("long"), F.lit(64).cast("long")) * 64


def jaccard_distance(a: Column, b: Column, union: Column) -> Column:
    """From two sizes and the size of the union, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) - (a + b) / union))


# ------------------------------------------------------------------ query cost
def nearest_fpr(fpr: float) -> float:
    """The tabulated rate at or next above ``fpr``; above the table, its last."""
    return next((x for x in sorted(COST) if x >= fpr), max(COST))


def cost_exact(bins: int, fpr: float) -> float:
    if bins & (bins - 1) or not 64 <= bins <= MAX_BINS:
        raise ValueError(f"{bins} is no power of two between 64 and {MAX_BINS}")
    return COST[nearest_fpr(fpr)][bins.bit_length() - 7]


def cost_of(bins: int, fpr: float) -> float:
    """Cost at any number of bins up to 65536: linear between powers of two."""
    if bins > MAX_BINS:
        raise ValueError(f"at most {MAX_BINS} bins")
    if bins <= 64:
        return COST[nearest_fpr(fpr)][0]
    hi = 1 << (bins - 1).bit_length()
    if hi == bins:
        return cost_exact(bins, fpr)
    lo = hi // 2
    a, b = cost_exact(lo, fpr), cost_exact(hi, fpr)
    return a + (b - a) * (bins - lo) / (hi - lo)


def cost_table(spark: SparkSession) -> DataFrame:
    """The 77 rows (fpr, bins, cost)."""
    return spark.createDataFrame([(f, 1 << (6 + i), c) for f, row in COST.items() for i, c in enumerate(row)], "fpr double, bins long, cost double")


def query_cost(bins: Column, fpr: Column) -> Column:
    """``cost_of`` as an expression: the as-of rate, then the interval of the bins."""
    rates = sorted(COST)
    per_rate = F.array(*[F.array(*[F.lit(c) for c in COST[r]]) for r in rates])
    at = F.lit(len(rates) - 1)
    for i in reversed(range(len(rates) - 1)):
        at = F.when(fpr <= rates[i], i).otherwise(at)
    row = F.get(per_rate, at)
    step = F.lit(10)
    for i in reversed(range(11)):
        step = F.when(bins <= (1 << (6 + i)), i).otherwise(step)
    hi = F.get(row, step)
    lo = F.get(row, step - 1)
    top = F.element_at(F.array(*[F.lit(1 << (6 + i)) for i in range(11)]), step + 1)
    within = lo + (hi - lo) * (bins - top / 2) / (top / 2)
    bad = F.raise_error(F.concat(F.lit("at most 65536 bins, not "), bins.cast("string"))).cast("double")
    return F.when(bins > MAX_BINS, bad).when(bins <= 64, F.get(row, 0)).when(bins == top, hi).otherwise(within)


# ------------------------------------------------------------------ formatting
UNITS = ("Bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def size_text(size: Column) -> Column:
    """Sizes up to 2^64 - 1 with one decimal, by integer arithmetic."""
    b = size.cast("decimal(20,0)")
    whole = lambda x, i: F.floor(x / F.lit(1 << (10 * i)).cast("decimal(20,0)")).cast("decimal(20,0)")
    out = F.concat(b.cast("string"), F.lit(UNITS[0]))
    for i in range(1, len(UNITS)):
        integer = whole(b, i)
        rest = whole(b - integer * F.lit(1 << (10 * i)).cast("decimal(20,0)"), i - 1)
        milli = F.floor(rest * 1000 / 1024).cast("long")
        tenth = F.floor((milli + 50) / 100).cast("long")
        full = F.when(tenth == 10, integer + 1).otherwise(integer).cast("long")
        carried = F.concat(F.lit("1.0"), F.lit(UNITS[min(i + 1, 6)]))
        here = F.concat(full.cast("string"), F.lit("."), F.when(tenth == 10, 0).otherwise(tenth).cast("string"), F.lit(UNITS[i]))
        text = F.when(full == 1024, carried).otherwise(here) if i < 6 else here
        out = F.when(b >= F.lit(1 << (10 * i)).cast("decimal(20,0)"), text).otherwise(out)
    return out


def size_text_of(size: int) -> str:
    i = min(6, max(0, (size.bit_length() - 1) // 10))
    if not i:
        return f"{size}{UNITS[0]}"
    whole, rest = divmod(size, 1 << (10 * i))
    tenth = ((rest >> (10 * (i - 1))) * 1000 // 1024 + 50) // 100
    if tenth == 10:
        whole, tenth = whole + 1, 0
    if whole == 1024 and i < 6:
        whole, i = 1, i + 1
    return f"{whole}.{tenth}{UNITS[i]}"
