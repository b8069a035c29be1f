"""The engine's end-to-end jobs: layout, search, reports, sketch accuracy."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.config import IndexConfig, RunConfig, reconcile
from sketchloom.functions import hll, kmers, minhash
from sketchloom.operators import binning, report, statistics
from sketchloom.sources import datasource
from sketchloom.sources import files as src
from sketchloom.sources.layouts import Layout, layout_text, read_layout
from sketchloom.sources.tables import table


def elements(spark: SparkSession, bins: DataFrame, config: RunConfig) -> DataFrame:
    """(ub_id, h) of the user bins' files."""
    if config.precomputed_files:
        return src.precomputed(spark, bins)
    return kmers.elements(src.sequences(spark, bins), config.k, config.window_size)


def per_file_elements(spark: SparkSession, bins: DataFrame, config: RunConfig) -> DataFrame:
    """As ``elements``, but every file is read by its own kind (suffix, case-sensitive)."""
    flat = bins.select("ub_id", F.explode("files").alias("f")).withColumn("raw", F.endswith("f", F.lit(".minimiser")))
    of = lambda cond: flat.where(cond).groupBy("ub_id").agg(F.collect_list("f").alias("files"))
    raw, seq = of("raw"), of("not raw")
    out = []
    if not raw.isEmpty():
        out.append(src.precomputed(spark, raw))
    if not seq.isEmpty():
        out.append(kmers.elements(src.sequences(spark, seq), config.k, config.window_size))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def sketch(elements: DataFrame, bits: int) -> DataFrame:
    """(ub_id, sketch, kmer_count). Above 21 index bits counts come from the sparse registers, and
    the stored sketch has Spark's most bits."""
    own = hll.native(elements, min(bits, hll.MOST_BITS))
    if bits <= hll.MOST_BITS:
        return own.withColumn("kmer_count", hll.estimate("sketch"))
    counts = hll.estimates(hll.sparse(elements, bits), bits=bits)
    return own.join(counts.select("ub_id", F.round("estimate").cast("long").alias("kmer_count")), "ub_id")


def packed_registers(elements: DataFrame) -> DataFrame:
    """(ub_id, regs): 4096 one-byte registers, for union estimates inside the optimiser."""
    return hll.pack(hll.registers(elements), "ub_id")


def search(spark: SparkSession, counts: DataFrame, cfg: IndexConfig, verbose: bool = False, force_all: bool = False, regs: DataFrame | None = None, sketches: DataFrame | None = None) -> tuple[Layout, int, str]:
    """(best layout, its number of bins, statistics text). Candidates are laid out two at a time
    (with ``force_all`` all at once), until one is no better than those before."""
    text = statistics.parameters(cfg) + statistics.header(verbose)
    best: tuple[float, int, Layout | None] = (float("inf"), 0, None)
    first = None
    tries = binning.candidates(cfg.tmax, cfg.number_of_user_bins)  # at most 12
    step = len(tries) if force_all else 2
    for at in range(0, len(tries), step):
        rows = binning.layouts(counts, tries[at : at + step], cfg, regs)
        worse = False
        for t in tries[at : at + step]:
            lay = binning.to_layout(rows, t)
            found = statistics.Summary(lay.frames(spark)[0], counts, replace(cfg, tmax=t), sketches)
            first = first or found.bytes
            text += found.line(first, verbose) + "\n"
            worse = found.query_cost >= best[0]
            if not worse:
                best = (found.query_cost, t, lay)
            elif not force_all:
                break
        if worse and not force_all:
            break
    return best[2], best[1], text + f"# Best t_max (regarding expected query runtime): {best[1]}\n"


def write_sketches(sketched: DataFrame, bins: DataFrame, config: RunConfig, path: str, regs: DataFrame | None = None, minhashes: DataFrame | None = None) -> None:
    """Sketches with files, the registers for union estimates, bottom-k sketches (ub_id, minhashes)
    and the whole configuration, as Parquet."""
    if not path.endswith((".sketch", ".sketches")):
        raise ValueError('The sketch output file must have the extension ".sketch" or ".sketches".')
    rows = sketched.join(bins, "ub_id")
    rows = rows.join(regs, "ub_id", "left") if regs is not None else rows.withColumn("regs", F.lit(None).cast("binary"))
    rows = rows.join(minhashes, "ub_id", "left") if minhashes is not None else rows.withColumn("minhashes", F.lit(None).cast("array<long>"))
    rows.withColumn("config", F.lit(json.dumps(asdict(config)))).write.mode("overwrite").parquet(path)


def read_registers(spark: SparkSession, path: str) -> DataFrame | None:
    """(ub_id, regs) of stored sketches; None where they were stored without."""
    df = spark.read.parquet(path)
    if "regs" not in df.columns or df.where("regs is not null").isEmpty():
        return None
    return df.select("ub_id", F.coalesce("regs", F.lit(bytes(hll.REGISTERS))).alias("regs"))


def read_minhashes(spark: SparkSession, path: str) -> DataFrame:
    """(ub_id, minhashes) of stored sketches that have them."""
    return spark.read.parquet(path).where("minhashes is not null").select("ub_id", "minhashes")


def write_single_sketches(spark: SparkSession, sketched: DataFrame, bins: DataFrame, folder: str) -> list[str]:
    """One ``<stem of the first file>.hll`` for each user bin, written by the executors; the paths."""
    name = F.element_at(F.split(F.get("files", 0), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.[^.]*$", "")
    rows = sketched.join(bins, "ub_id").select(F.concat(stem, F.lit(".hll")).alias("file"), F.col("sketch").alias("content"))
    datasource.write_files(rows, folder)
    return sorted(f"{folder.rstrip('/')}/{r['file']}" for r in rows.select("file").toLocalIterator())  # names only


def count_lines(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Lines ``files joined by ";" <tab> count <tab> files joined by ";"`` of user bins, in order."""
    names = F.concat_ws(";", "files")
    return counts.join(bins, "ub_id").orderBy("ub_id").select(F.concat_ws("\t", names, F.col("kmer_count").cast("string"), names).alias("value"))


def read_sketches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, RunConfig]:
    """(sketches, user bins, configuration)"""
    df = spark.read.parquet(path)
    raw = json.loads(df.select("config").first()[0])
    config = RunConfig(**{k: v for k, v in raw.items() if k != "index"}, index=IndexConfig(**raw["index"]))
    return df.select("ub_id", "sketch", "kmer_count"), df.select("ub_id", "files"), config


def make_layout(spark: SparkSession, config: RunConfig, options: set[str] = frozenset(), sketches_to: str = "", timing_to: str = "", prefix: str = "") -> tuple[str, str, list[str]]:
    """(layout text, statistics text, warnings) for a user-bin list or stored sketches."""
    warnings: list[str] = []
    if "window" not in options:
        config = replace(config, window_size=config.k)
    began = time.time()
    regs = own = None
    if sketches_to and not sketches_to.endswith((".sketch", ".sketches")):
        raise ValueError('The sketch output file must have the extension ".sketch" or ".sketches".')
    if config.data_file.endswith((".sketch", ".sketches")):
        sketched, bins, stored = read_sketches(spark, config.data_file)
        config, warnings = reconcile(config, stored, set(options))
        if not config.index.disable_estimate_union:
            regs = read_registers(spark, config.data_file)
            if regs is None:
                warnings.append("[WARNING] The sketch file holds no registers for union estimates: merged bins are sized by sums, and nothing is rearranged.")
    else:
        if config.k > config.window_size:
            raise ValueError("The k-mer size cannot be bigger than the window size.")
        bins = src.user_bins(spark, config.data_file)
        config = replace(config, precomputed_files=src.check_files(spark, bins))
        own = elements(spark, bins, config)
        sketched = table(sketch(own, config.index.sketch_bits), "sketches")
        if not config.index.disable_estimate_union:
            regs = table(packed_registers(own), "registers")
    files = [r["files"] for r in bins.orderBy("ub_id").collect()]
    counts = table(bins.select("ub_id").join(sketched.select("ub_id", "kmer_count"), "ub_id", "left").fillna(0, ["kmer_count"]), "counts")
    sketching = time.time() - began
    began = time.time()
    cfg = config.index.completed(len(files))
    stats = ""
    only = sketched.select("ub_id", "sketch")
    if config.determine_best_tmax:
        layout, tmax, stats = search(spark, counts, cfg, config.output_verbose_statistics, config.force_all_binnings, regs, only)
        cfg = replace(cfg, tmax=tmax)
    else:
        layout = binning.compute(spark, counts, cfg, regs)
        if config.output_verbose_statistics:
            stats = statistics.header(True) + statistics.Summary(layout.frames(spark)[0], counts, cfg, only).line(None, True) + "\n"
    layouting = time.time() - began
    config = replace(config, index=cfg)
    if sketches_to:
        write_sketches(sketched, bins, config, sketches_to, regs, minhash.bottom(own) if own is not None else None)
    if timing_to:
        spent = binning.seconds(spark)
        src.write_text(spark, timing_to, "sketching_in_seconds\tlayouting_in_seconds\tunion_estimation_in_seconds\trearrangement_in_seconds\n" + "\t".join(f"{x:.2f}" for x in (sketching, layouting, *spent)) + "\t")
    return layout_text(files, config, layout, prefix), stats, warnings


def _given(spark: SparkSession, path: str):
    files, config, layout = read_layout(spark, path)
    bins = spark.createDataFrame(list(enumerate(files)), "ub_id long, files array<string>")
    return files, config, layout, per_file_elements(spark, bins, config)


def general_report(spark: SparkSession, path: str, shared: bool = False) -> str:
    files, config, layout, own = _given(spark, path)
    rows = report.per_bin(layout.frames(spark)[0], own, config.index, shared, min(config.index.sketch_bits, hll.MOST_BITS))
    return report.general_text(report.exploded(rows), path)


def sizes_report(spark: SparkSession, path: str) -> str:
    files, config, layout, own = _given(spark, path)
    lay, tops = layout.frames(spark)
    return report.sizes_text(report.level_sizes(report.filter_sizes(lay, tops, own, config.index)), len(files))


def sketch_report(spark: SparkSession, paths: list[str], bits: list[int], k: int = 20) -> DataFrame:
    """Accuracy of sketches for each sequence of some files, forward k-mers."""
    bins = spark.createDataFrame([(0, paths)], "ub_id long, files array<string>")
    seqs = src.sequences(spark, bins).select("id", F.length("seq").alias("sequence_length"), "seq")
    each = seqs.select(F.struct("id", "sequence_length").alias("record"), "seq")
    own = kmers.elements(each, k, seeded=False, key="record").select("record.*", "h")
    return report.sketch_accuracy(own, bits, ["id", "sequence_length"]).withColumnRenamed("id", "sequence_id")


def sketch_lines(rows: DataFrame, head: list[str], names: tuple[str, ...]) -> DataFrame:
    """(at, value): the accuracy table as text lines behind a head, in order of sequence and size."""

    def text(batches):
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in names]
            lines = ["\t".join(f"{x:g}" if isinstance(x, float) else str(x) for x in r) for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("sketch_register_size"), pa.array(lines, pa.string())], ["id", "size", "value"])

    body = rows.mapInArrow(text, "id string, size long, value string")
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "n long, value string")
    at = F.struct(F.lit(1).cast("long").alias("n"), "id", "size").alias("at")
    first = F.struct((F.col("n") - len(head)).alias("n"), F.lit("").alias("id"), F.lit(0).cast("long").alias("size")).alias("at")
    return top.select(first, "value").unionByName(body.select(at, "value"))
