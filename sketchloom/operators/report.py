"""Exact reports over a given layout, and the accuracy of sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.config import IndexConfig
from sketchloom.functions import bloom


SHARE = 500_000  # elements of one task


def dealt(elements: DataFrame) -> DataFrame:
    """Elements dealt by their hash, so all that is counted distinct of one meets in one task; the more
    elements, the more tasks, each with no more memory."""
    least = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return elements.repartition(max(least, elements.count() // SHARE + 1), "h")


def per_bin(layout: DataFrame, elements: DataFrame, cfg: IndexConfig, shared: bool = False, bits: int = 12) -> DataFrame:
    """One row a top-level bin: tb (as laid out), exact, estimated, corrected, shared, ub_count, kind, splits."""
    top = layout.select("ub_id", F.coalesce(F.get("prev_tbs", 0), F.col("storage_tb")).alias("tb"), (F.size("prev_tbs") > 0).alias("merged"), "num_tbs")
    shape = top.groupBy("tb").agg(F.count("*").alias("ub_count"), F.max("merged").alias("merged"), F.max("num_tbs").alias("span"))
    own = dealt(elements).join(F.broadcast(top.select("ub_id", "tb", "merged")), "ub_id")
    # Distinct per (bin, hash) first: the number of user bins that hold a hash gives the intersection.
    if shared:
        each = own.groupBy("tb", "merged", "h").agg(F.count_distinct("ub_id").alias("in_ubs"))
    else:
        each = own.select("tb", "merged", "h").distinct().withColumn("in_ubs", F.lit(0).cast("long"))
    sizes = each.join(shape.select("tb", "ub_count"), "tb").groupBy("tb").agg(
        F.count("*").alias("exact_size"), F.hll_sketch_estimate(F.hll_sketch_agg("h", bits)).alias("estimated_size"), F.count(F.when(F.col("merged") & (F.col("in_ubs") == F.col("ub_count")), 1)).alias("shared_size"))
    p, h = cfg.maximum_fpr, cfg.number_of_hash_functions
    relaxed = bloom.merged_factor(p, cfg.relaxed_fpr, h)
    splits = F.when(F.col("merged"), 1).otherwise(F.col("span"))
    joined = shape.join(sizes, "tb", "left").fillna(0, ["exact_size", "estimated_size", "shared_size"]).withColumn("splits", splits.cast("long"))
    corrected = F.when(F.col("merged"), F.ceil(F.col("exact_size") * relaxed)).otherwise(F.ceil(bloom.ceil_div(F.col("exact_size"), F.col("splits")) * bloom.split_correction(F.col("splits"), p, h)))
    exact = F.when(F.col("merged"), F.col("exact_size")).otherwise(bloom.ceil_div(F.col("exact_size"), F.col("splits")))
    estimated = F.when(F.col("merged"), F.col("estimated_size")).otherwise(bloom.ceil_div(F.col("estimated_size"), F.col("splits")))
    return joined.select("tb", exact.alias("exact_size"), estimated.alias("estimated_size"), corrected.cast("long").alias("fpr_corrected_size"), "shared_size", "ub_count", F.when(F.col("merged"), "merged").otherwise("split").alias("kind"), "splits")


def exploded(records: DataFrame) -> DataFrame:
    """A row for every technical bin: running bin numbers, ``splits`` on the first row only.

    Bins number at most tmax, so the running sum is over a bounded table."""
    order = Window.orderBy("tb")
    first = F.coalesce(F.sum("splits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = records.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("splits") - 1).cast("int"))))
    return rows.select((F.col("first") + F.col("i")).cast("long").alias("tb_index"), "exact_size", "estimated_size", "fpr_corrected_size", "shared_size", "ub_count", "kind", F.when(F.col("i") == 0, F.col("splits")).otherwise(0).alias("splits"))


def general_text(rows: DataFrame, name: str) -> str:
    got = rows.orderBy("tb_index").collect()
    columns = ("tb_index", "exact_size", "estimated_size", "fpr_corrected_size", "shared_size", "ub_count", "kind", "splits")
    return "\n".join([f"# Layout: {name}", "\t".join(columns), *("\t".join(str(r[c]) for c in columns) for r in got)]) + "\n"


def filter_sizes(layout: DataFrame, max_bins: DataFrame, elements: DataFrame, cfg: IndexConfig) -> DataFrame:
    """One row a filter: level, bits, max_elements, too_big, too_many (elements), load_factor."""
    p, h = cfg.maximum_fpr, cfg.number_of_hash_functions
    # Every user bin is in its own filter and, through merged bins, in every filter above.
    up = layout.select("ub_id", "storage_tb", "num_tbs", "prev_tbs", F.explode(F.sequence(F.lit(0), F.size("prev_tbs"))).alias("d"))
    place = up.select("ub_id", F.slice("prev_tbs", F.lit(1), F.col("d")).alias("ibf_path"), (F.col("d") < F.size("prev_tbs")).alias("merged"),
                      F.when(F.col("d") < F.size("prev_tbs"), F.get("prev_tbs", F.col("d"))).otherwise(F.col("storage_tb")).alias("tb"), F.when(F.col("d") < F.size("prev_tbs"), 1).otherwise(F.col("num_tbs")).cast("long").alias("span"))
    bins = place.select("ibf_path", "tb", "merged", "span").distinct()
    n = dealt(elements).join(F.broadcast(place.select("ub_id", "ibf_path", "tb")), "ub_id").select("ibf_path", "tb", "h").distinct().groupBy("ibf_path", "tb").agg(F.count("*").alias("n"))
    sized = bins.join(n, ["ibf_path", "tb"], "left").fillna(0, ["n"])
    tops = sized.join(max_bins.withColumnRenamed("max_tb", "tb"), ["ibf_path", "tb"]).select("ibf_path", F.col("tb").alias("max_tb"), F.col("n").alias("m"), F.col("merged").alias("max_merged"), F.col("span").alias("max_span"))
    rows = sized.join(tops, "ibf_path")
    # The fullest bin sets the size; its own bins count as exactly full.
    load = F.when(F.col("merged"), F.col("n")).otherwise(F.expr("n div span") + 1)
    other = F.col("tb") != F.col("max_tb")
    over, under = other & (F.col("m") < load), other & (F.col("m") >= load)
    got = rows.withColumn("e", load).groupBy("ibf_path", "m", "max_merged", "max_span").agg(
        F.sum("span").alias("bins"), F.sum(F.when(over, F.col("span")).otherwise(0)).alias("too_big"), F.sum(F.when(over, (F.col("e") - F.col("m")) * F.col("span")).otherwise(0)).alias("too_many"), F.sum(F.when(under, (F.col("m") - F.col("e")) * F.col("span")).otherwise(0)).alias("waste"))
    relaxed = bloom.bits(F.col("m"), cfg.relaxed_fpr, h)
    split = F.ceil(bloom.bits(bloom.ceil_div(F.col("m"), F.col("max_span")), p, h) * bloom.split_correction(F.col("max_span"), p, h)).cast("long")
    bits = F.col("bins") * F.when(F.col("max_merged"), relaxed).otherwise(split)
    capacity = F.col("m") * F.col("bins")
    return got.select(F.size("ibf_path").alias("level"), "ibf_path", bits.alias("bits"), F.col("m").alias("max_elements"), "too_big", "too_many", ((capacity - F.col("waste")) / capacity).alias("load_factor"))


def level_sizes(sizes: DataFrame) -> DataFrame:
    g = sizes.groupBy("level").agg(F.sum("bits").alias("bit_size"), F.count("*").alias("ibfs"), F.avg("load_factor").alias("load"), F.sum("too_big").alias("tbs_too_big"), F.sum("too_many").alias("many"), F.sum("max_elements").alias("max"))
    return g.select("level", "bit_size", "ibfs", (F.col("load") * 100).alias("avg_load_factor"), "tbs_too_big", F.expr("many div greatest(tbs_too_big, 1)").alias("avg_tbs_too_big_elements"), F.expr("max div ibfs").alias("avg_max_elements"))


def sizes_text(levels: DataFrame, user_bins: int) -> str:
    got = levels.orderBy("level").collect()
    head = [f"# Levels: {len(got)}", f"# User bins: {user_bins}", "LEVEL\tBIT_SIZE\tIBFS\tAVG_LOAD_FACTOR\tTBS_TOO_BIG\tAVG_TBS_TOO_BIG_ELEMENTS\tAVG_MAX_ELEMENTS"]
    return "\n".join([*head, *(f"{r['level']}\t{r['bit_size']}\t{r['ibfs']}\t{r['avg_load_factor']:.2f}\t{r['tbs_too_big']}\t{r['avg_tbs_too_big_elements']}\t{r['avg_max_elements']}" for r in got)]) + "\n"


def sketch_accuracy(elements: DataFrame, bits: list[int], keys: list[str]) -> DataFrame:
    """Per key and sketch size: estimate, exact count, expected and actual relative error."""
    aggs = [F.hll_sketch_estimate(F.hll_sketch_agg("h", b)).alias(f"e{b}") for b in bits]
    exact = elements.groupBy(*keys).agg(F.count_distinct("h").alias("actual_cardinality"))
    est = elements.groupBy(*keys).agg(*aggs)
    rows = est.join(exact, keys).select(*keys, "actual_cardinality", F.explode(F.array(*[F.struct(F.lit(1 << b).cast("long").alias("sketch_register_size"), F.col(f"e{b}").alias("estimated_cardinality")) for b in bits])).alias("s"))
    return rows.select(*keys, "s.sketch_register_size", "s.estimated_cardinality", "actual_cardinality", (F.lit(1.04) / F.sqrt("s.sketch_register_size")).alias("expected_relative_error"), F.abs(1 - F.col("s.estimated_cardinality") / F.col("actual_cardinality")).alias("actual_relative_error"))
