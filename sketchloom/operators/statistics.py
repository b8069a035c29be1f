"""Sizes and query cost of a layout: bins, filters, levels, totals.

Everything is relational over the layout rows (ord, ub_id, prev_tbs, storage_tb, num_tbs);
filters are keyed by their path, and the tree is walked by a recursive query."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.config import IndexConfig
from sketchloom.functions import bloom, hll
from sketchloom.sources.tables import table

MOST_LEVELS = 100  # of a layout: far above what any number of user bins needs


def bins(layout: DataFrame) -> DataFrame:
    """(ibf_path, ord, kind, tb, span, ubs, child): a split bin a user bin, a merged bin a (filter, bin)."""
    split = layout.select(F.col("prev_tbs").alias("ibf_path"), "ord", F.lit("split").alias("kind"), F.col("storage_tb").alias("tb"), F.col("num_tbs").alias("span"), F.array("ub_id").alias("ubs"), F.lit(None).cast("array<long>").alias("child"))
    steps = layout.where(F.size("prev_tbs") > 0).select("ord", "ub_id", "prev_tbs", F.explode(F.sequence(F.lit(1), F.size("prev_tbs"))).alias("d"))
    at = steps.select("ord", "ub_id", F.slice("prev_tbs", F.lit(1), F.col("d") - 1).alias("ibf_path"), F.element_at("prev_tbs", F.col("d")).alias("tb"))
    merged = at.groupBy("ibf_path", "tb").agg(F.min("ord").alias("ord"), F.collect_list("ub_id").alias("ubs"))
    return split.unionByName(merged.select("ibf_path", "ord", F.lit("merged").alias("kind"), "tb", F.lit(1).cast("long").alias("span"), "ubs", F.concat("ibf_path", F.array("tb")).alias("child")))


PAIR_BLOCK = 64  # merged bins whose unions with as many others one task estimates


def cardinalities(all_bins: DataFrame, counts: DataFrame, cfg: IndexConfig, sketches: DataFrame | None = None, registers: DataFrame | None = None) -> DataFrame:
    """Bins with ``card`` and ``sketch``: of merged bins the union estimate, or the sum.

    Unions come from Spark's ``sketches`` (ub_id, sketch), or from portable ``registers``
    (ub_id, reg, rank), which SQL can follow; ``sketch`` then holds packed registers."""
    flat = all_bins.select("ibf_path", "ord", "kind", "tb", F.explode("ubs").alias("ub_id"))
    sums = flat.join(counts, "ub_id").groupBy("ibf_path", "ord", "kind", "tb").agg(F.sum("kmer_count").alias("sum"))
    out = all_bins.join(sums, ["ibf_path", "ord", "kind", "tb"])
    if cfg.disable_estimate_union or (sketches is None and registers is None):
        return out.withColumn("card", F.col("sum").cast("long")).withColumn("sketch", F.lit(None).cast("binary"))
    if registers is not None:
        rows = flat.where("kind = 'merged'").join(registers, "ub_id").groupBy("ibf_path", "ord", "kind", "tb", "reg").agg(F.max("rank").alias("rank"))
        packed = hll.pack(rows, "ibf_path", "ord", "kind", "tb").withColumnRenamed("regs", "sketch")
        sizes = hll.estimates(rows.withColumn("bin", F.struct("ibf_path", "ord", "kind", "tb")), "bin").select("bin.*", "estimate")
        joined = out.join(packed.join(sizes, ["ibf_path", "ord", "kind", "tb"]), ["ibf_path", "ord", "kind", "tb"], "left")
        return joined.withColumn("card", F.coalesce(F.floor("estimate"), F.col("sum")).cast("long")).drop("estimate")
    unions = flat.where("kind = 'merged'").join(sketches, "ub_id").groupBy("ibf_path", "ord", "kind", "tb").agg(F.hll_union_agg("sketch").alias("sketch"))
    joined = out.join(unions, ["ibf_path", "ord", "kind", "tb"], "left")
    return joined.withColumn("card", F.coalesce(hll.estimate("sketch"), F.col("sum")).cast("long"))


def filters(carded: DataFrame, cfg: IndexConfig) -> DataFrame:
    """One row a filter: level, bins, memory with and without corrections, split statistics."""
    p, h = cfg.maximum_fpr, cfg.number_of_hash_functions
    relaxed = bloom.merged_factor(p, cfg.relaxed_fpr, h)
    each = bloom.ceil_div(F.col("card"), F.col("span"))
    fixed = F.when(F.col("kind") == "merged", F.ceil(F.col("card") * relaxed)).otherwise(F.ceil(each * bloom.split_correction(F.col("span"), p, h)))
    rows = carded.withColumn("plain", F.when(F.col("kind") == "merged", F.col("card")).otherwise(each)).withColumn("fixed", fixed.cast("long"))
    is_split = F.col("kind") == "split"
    got = rows.groupBy("ibf_path").agg(
        F.sum("span").alias("num_tbs"), F.max("fixed").alias("max_fixed"), F.max("plain").alias("max_plain"),
        F.sum(F.when(is_split, F.col("span")).otherwise(0)).alias("split_tbs"), F.count(F.when(is_split, 1)).alias("split_ubs"),
        F.max(F.when(is_split, F.col("span")).otherwise(0)).alias("max_span"),
        F.sum(F.when(is_split, F.col("plain") * F.col("span")).otherwise(0)).alias("split_kmers"), F.sum(F.when(is_split, F.col("fixed") * F.col("span")).otherwise(0)).alias("split_fixed"),
        F.sum(F.when(is_split, F.col("card")).otherwise(0)).alias("own_kmers"))
    return got.select(F.size("ibf_path").alias("level"), "*", (F.col("max_fixed") * F.col("num_tbs")).alias("mem"), (F.col("max_plain") * F.col("num_tbs")).alias("mem_plain"))


def _register_pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Similarities of one block of merged bins to a block of later ones, summed for each of the first."""
    from sketchloom.operators.binning import cardinalities as sizes

    theirs = np.stack([np.frombuffer(x, np.uint8) for x in b["s2"]])
    c2, o2 = b["c2"].to_numpy(), b["o2"].to_numpy()
    out = []
    for own, o, c in zip(a["s"], a["o"], a["c"]):
        union = np.floor(sizes(np.maximum(theirs, np.frombuffer(own, np.uint8))))
        out.append(float((1 - np.clip(2 - (c + c2) / np.maximum(union, 1), 0, 1))[o2 > o].sum()))
    return a[["child"]].assign(part=out)


def penalties(carded: DataFrame, cfg: IndexConfig, registers: bool = False) -> DataFrame:
    """(child, pen): what merged bins pay for their similarity to later ones of their filter.

    All pairs of a filter are wanted, so they are dealt as a matrix of blocks: a bin goes to each
    block pair of its row and its column, and no task holds more than two blocks."""
    m = carded.where("kind = 'merged'")
    if cfg.disable_estimate_union:
        return m.select("child", F.lit(0.0).alias("pen"))
    order = Window.partitionBy("ibf_path")
    place = m.select("ibf_path", "ord").select(
        "ibf_path", "ord", ((F.row_number().over(order.orderBy("ord")) - 1) / PAIR_BLOCK).cast("int").alias("block"), ((F.count("*").over(order) - 1) / PAIR_BLOCK).cast("int").alias("last"))
    rows = m.select("ibf_path", "ord", "child", "card", "sketch").join(place, ["ibf_path", "ord"])
    a = rows.select("ibf_path", F.col("ord").alias("o"), "child", F.col("card").alias("c"), F.col("sketch").alias("s"), F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"))
    b = rows.select("ibf_path", F.col("ord").alias("o2"), F.col("card").alias("c2"), F.col("sketch").alias("s2"), F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"))
    key = ["ibf_path", "x", "y"]
    if registers:
        own, other = (df.select(*[F.col(k).alias(k + end) for k in key], *[c for c in df.columns if c not in key]) for df, end in ((a, "_a"), (b, "_b")))
        parts = own.groupBy(*[k + "_a" for k in key]).cogroup(other.groupBy(*[k + "_b" for k in key])).applyInPandas(lambda p, q: _register_pairs(p, q), "child array<long>, part double")
    else:
        pairs = a.join(b, key).where("o < o2").withColumn("u", hll.union_estimate("s", "s2"))
        parts = pairs.select("child", (1 - bloom.jaccard_distance(F.col("c"), F.col("c2"), F.col("u"))).alias("part"))
    pen = parts.groupBy("child").agg(F.sum("part").alias("pen"))
    return m.select("child").join(pen, "child", "left").select("child", F.coalesce("pen", F.lit(0.0)).alias("pen"))


def costs(stats: DataFrame, pens: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(ibf_path, own_kmers, cost): own cost, penalty and everything above.

    The tree is walked by Spark's recursive common table expression: one plan for all levels."""
    own = stats.select("ibf_path", "own_kmers", bloom.query_cost(F.col("num_tbs"), F.lit(cfg.maximum_fpr)).alias("own"))
    own = own.join(pens.withColumnRenamed("child", "ibf_path"), "ibf_path", "left").withColumn("own", F.col("own") + F.coalesce("pen", F.lit(0.0))).drop("pen")
    return walk_down(own.select(F.col("ibf_path").alias("path"), "own_kmers", "own")).select(F.col("path").alias("ibf_path"), "own_kmers", F.col("total").alias("cost"))


def walk_down(nodes: DataFrame) -> DataFrame:
    """``nodes`` (path array, own, ...) with ``total``: own values summed along the way from the root."""
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)  # as many filters as there are
    view = f"nodes_{uuid.uuid4().hex}"
    table(nodes, "tree").createOrReplaceTempView(view)  # each level reads what is written, not its plan
    out = spark.sql(f"""
        WITH RECURSIVE tree(path, total) MAX RECURSION LEVEL {MOST_LEVELS} AS (
          SELECT path, CAST(own AS DOUBLE) FROM {view} WHERE size(path) = 0
          UNION ALL
          SELECT n.path, t.total + CAST(n.own AS DOUBLE) FROM tree t JOIN {view} n
            ON slice(n.path, 1, greatest(size(n.path) - 1, 0)) = t.path AND size(n.path) > 0)
        SELECT n.*, t.total FROM {view} n JOIN tree t ON n.path = t.path""")
    spark.catalog.dropTempView(view)
    return out


def levels(stats: DataFrame, cfg: IndexConfig) -> DataFrame:
    """Per level: filters, memory, bins, shares and factors of split bins (null without any)."""
    p, h = cfg.maximum_fpr, cfg.number_of_hash_functions
    g = stats.groupBy("level").agg(F.count("*").alias("num_ibfs"), *[F.sum(k).alias(k) for k in ("mem", "mem_plain", "num_tbs", "split_tbs", "split_ubs", "split_kmers", "split_fixed")], F.max("max_span").alias("max_span"))
    has = F.col("max_span") > 0
    return g.select("level", "num_ibfs", "mem", "mem_plain", (bloom.bits(F.col("mem"), p, h) / 8).cast("long").alias("bytes"), (bloom.bits(F.col("mem_plain"), p, h) / 8).cast("long").alias("bytes_plain"), "num_tbs",
                    F.expr("num_tbs div num_ibfs").alias("avg_num_tbs"), (100.0 * F.col("split_tbs") / F.col("num_tbs")).alias("split_percentage"),
                    F.when(has, F.col("max_span")).alias("max_span"), F.when(has, F.col("split_tbs") / F.col("split_ubs")).alias("avg_span"),
                    F.when(has, bloom.split_correction(F.col("max_span"), p, h)).alias("max_factor"), F.when(has, F.col("split_fixed") / F.col("split_kmers")).alias("avg_factor"))


class Summary:
    """The statistics of one layout, collected: a few numbers a level."""

    def __init__(self, layout: DataFrame, counts: DataFrame, cfg: IndexConfig, sketches: DataFrame | None = None, registers: DataFrame | None = None):
        self.cfg = cfg
        carded = table(cardinalities(bins(layout), counts, cfg, sketches, registers), "bins")
        stats = table(filters(carded, cfg), "filters")
        total = counts.agg(F.sum("kmer_count")).first()[0] or 1
        spent = costs(stats, penalties(carded, cfg, registers is not None), cfg).agg(F.sum(F.col("cost") * F.col("own_kmers"))).first()[0] or 0.0
        self.query_cost = spent / total
        self.rows = [r.asDict() for r in levels(stats, cfg).orderBy("level").collect()]
        size = lambda k: bloom.bits_of(sum(r[k] for r in self.rows), cfg.maximum_fpr, cfg.number_of_hash_functions) // 8
        self.bytes, self.bytes_plain = size("mem"), size("mem_plain")

    def line(self, first_bytes: int | None, verbose: bool) -> str:
        ratio = self.bytes / (first_bytes or self.bytes)
        out = [str(self.cfg.tmax), *(f"{x:.2f}" for x in (bloom.cost_of(self.cfg.tmax, self.cfg.maximum_fpr), self.query_cost, ratio, self.query_cost * ratio)), bloom.size_text_of(self.bytes)]
        if verbose:
            show = lambda f: "".join(":" + ("-" if (v := f(r)) is None else v) for r in self.rows)
            two = lambda v: None if v is None else f"{v:.2f}"
            out += [bloom.size_text_of(self.bytes_plain), show(lambda r: str(r["level"])), show(lambda r: str(r["num_ibfs"])), show(lambda r: bloom.size_text_of(r["bytes"])), show(lambda r: bloom.size_text_of(r["bytes_plain"])),
                    show(lambda r: str(r["num_tbs"])), show(lambda r: str(r["avg_num_tbs"])), show(lambda r: two(r["split_percentage"])), show(lambda r: None if r["max_span"] is None else str(r["max_span"])),
                    show(lambda r: two(r["avg_span"])), show(lambda r: two(r["max_factor"])), show(lambda r: two(r["avg_factor"]))]
        return "\t".join(out)


#: Fixed text of the statistics file.
NOTES = """## ### Notation ###
## X-IBF = An IBF with X number of bins.
## X-HIBF = An HIBF with tmax = X, e.g a maximum of X technical bins on each level.
## ### Column Description ###
## tmax : The maximum number of technical bin on each level
## c_tmax : The technical extra cost of querying an tmax-IBF, compared to 64-IBF
## l_tmax : The estimated query cost for an tmax-HIBF, compared to an 64-HIBF
## m_tmax : The estimated memory consumption for an tmax-HIBF, compared to an 64-HIBF
## (l*m)_tmax : Computed by l_tmax * m_tmax
## size : The expected total size of an tmax-HIBF
"""
PLAIN_NOTE = "## uncorr_size : The expected size of an tmax-HIBF without FPR correction\n"
COLUMNS = ("tmax", "c_tmax", "l_tmax", "m_tmax", "(l*m)_tmax", "size")
MORE_COLUMNS = ("uncorr_size", "level", "num_ibfs", "level_size", "level_size_no_corr", "total_num_tbs", "avg_num_tbs", "split_tb_percentage", "max_split_tb", "avg_split_tb", "max_factor", "avg_factor")


def header(verbose: bool) -> str:
    return NOTES + PLAIN_NOTE * verbose + "# " + "\t".join(COLUMNS + MORE_COLUMNS * verbose) + "\n"


def parameters(cfg: IndexConfig) -> str:
    return f"## ### Parameters ###\n## number of user bins = {cfg.number_of_user_bins}\n## number of hash functions = {cfg.number_of_hash_functions}\n## maximum false positive rate = {cfg.maximum_fpr:g}\n## relaxed false positive rate = {cfg.relaxed_fpr:g}\n"


def stop_early(tried: DataFrame) -> DataFrame:
    """Of (t_max, cost) rows those that a search in order of t_max looks at: through the first
    that is no better than all before it, with ``first_bytes`` style columns left as they are."""
    before = F.min("cost").over(Window.orderBy("t_max").rowsBetween(Window.unboundedPreceding, -1))
    failed = tried.withColumn("worse", F.coalesce(F.col("cost") >= before, F.lit(False)).cast("int"))
    seen = F.sum("worse").over(Window.orderBy("t_max").rowsBetween(Window.unboundedPreceding, -1))
    return failed.withColumn("seen", F.coalesce(seen, F.lit(0))).where("seen = 0").drop("worse", "seen")


def relative(tried: DataFrame) -> DataFrame:
    """Of (t_max, cost, bytes) rows: ``m_tmax``, the size relative to the first candidate, and
    ``best``, the first candidate of least cost. A search has at most twelve candidates."""
    order = Window.orderBy("t_max")
    first = F.first("bytes").over(order)
    rank = F.row_number().over(Window.orderBy("cost", "t_max"))
    return tried.select("t_max", F.round(F.col("bytes") / first, 6).alias("m_tmax"), (rank == 1).alias("best"))
