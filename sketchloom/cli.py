"""Command line: ``layout``, ``stats general``, ``stats sizes`` and ``accuracy``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sketchloom.config import IndexConfig, RunConfig
from sketchloom.plans import entries
from sketchloom.sources.files import write_lines, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sketchloom", description="Compute and inspect layouts of hierarchical interleaved Bloom filters.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("layout", help="compute a layout from a list of user bins or from sketches")
    a.add_argument("--input")
    a.add_argument("--output", default="layout.txt")
    a.add_argument("--kmer", type=int)
    a.add_argument("--window", type=int)
    a.add_argument("--tmax", type=int, default=0)
    a.add_argument("--hash", type=int, default=2)
    a.add_argument("--fpr", type=float, default=0.05)
    a.add_argument("--relaxed-fpr", type=float, default=0.3)
    a.add_argument("--empty-bin-fraction", type=float, default=0.0)
    a.add_argument("--alpha", type=float, default=1.2)
    a.add_argument("--max-rearrangement-ratio", type=float, default=0.5)
    a.add_argument("--sketch-bits", type=int)
    a.add_argument("--threads", type=int, default=1)
    a.add_argument("--disable-estimate-union", action="store_true")
    a.add_argument("--disable-rearrangement", action="store_true")
    a.add_argument("--determine-best-tmax", action="store_true")
    a.add_argument("--force-all-binnings", action="store_true")
    a.add_argument("--output-verbose-statistics", action="store_true")
    a.add_argument("--output-sketches-to", default="")
    a.add_argument("--timing-output", default="")
    a.add_argument("--format-prefix", default="", help="tool name in the markers of the layout file")
    b = sub.add_parser("stats", help="exact reports over a layout")
    b.add_argument("report", choices=["general", "sizes"])
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--output-shared-kmers", action="store_true")
    c = sub.add_parser("accuracy", help="sketch estimates against exact counts")
    c.add_argument("-i", "--input", required=True, nargs="+", help="one or more sequence files")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-b", "--bits", type=int, nargs="+", default=[12])
    c.add_argument("-k", "--kmer", type=int, default=20)
    return p


def run(args: list[str], spark: SparkSession | None = None) -> int:
    """Exit code; errors go to stderr as ``[ERROR] message``."""
    a = parser().parse_args(args)
    try:
        if a.command == "layout" and not a.input:
            raise ValueError("Option --input is required but not set.")
        spark = spark or SparkSession.builder.getOrCreate()
        if a.command == "layout":
            given = {k for k, v in (("kmer", a.kmer), ("window", a.window), ("sketch-bits", a.sketch_bits)) if v is not None}
            index = IndexConfig(number_of_hash_functions=a.hash, maximum_fpr=a.fpr, relaxed_fpr=a.relaxed_fpr, threads=a.threads, sketch_bits=a.sketch_bits or 12, tmax=a.tmax, empty_bin_fraction=a.empty_bin_fraction, alpha=a.alpha, max_rearrangement_ratio=a.max_rearrangement_ratio, disable_estimate_union=a.disable_estimate_union, disable_rearrangement=a.disable_rearrangement)
            k = a.kmer or 19
            config = RunConfig(data_file=a.input, k=k, window_size=a.window or k, output_filename=a.output, determine_best_tmax=a.determine_best_tmax, force_all_binnings=a.force_all_binnings, output_verbose_statistics=a.output_verbose_statistics, disable_sketch_output=not a.output_sketches_to, index=index)
            text, stats, warnings = entries.make_layout(spark, config, given, a.output_sketches_to, a.timing_output, a.format_prefix)
            for w in warnings:
                print(w, file=sys.stderr)
            write_text(spark, a.output, text)
            if stats and a.determine_best_tmax:
                write_text(spark, a.output + ".stats", stats)
            elif stats:
                print(stats, end="")
        elif a.command == "stats":
            text = entries.general_report(spark, a.input, a.output_shared_kmers) if a.report == "general" else entries.sizes_report(spark, a.input)
            write_text(spark, a.output, text)
        else:
            names = ("sequence_id", "sequence_length", "sketch_register_size", "estimated_cardinality", "actual_cardinality", "expected_relative_error", "actual_relative_error")
            write_lines(entries.sketch_lines(entries.sketch_report(spark, a.input, a.bits, a.kmer), [f"# input file: {' '.join(a.input)}", f"# k: {a.kmer}", "\t".join(names)], names), a.output)
        return 0
    except Exception as e:  # whatever went wrong is one line for the user
        print(f"[ERROR] {e}", file=sys.stderr)
        return -1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
