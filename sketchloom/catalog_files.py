"""Queries that go through files: the engine's sources, its written forms and its command line.

Each writes what the tables hold in one of the engine's formats, to a work folder that all
machines share (``spark.checkpoint.dir``, else the warehouse), and reads it back."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom import cli
from sketchloom.catalog import BIN, CFG, DNA, LAYOUT, REPORT, SUP, TREE, dna, exact_counts, path_text, query, suppliers
from sketchloom.config import IndexConfig, RunConfig
from sketchloom.functions import hll
from sketchloom.operators import binning, statistics
from sketchloom.plans import entries
from sketchloom.sources import datasource
from sketchloom.sources import files as src
from sketchloom.sources.layouts import Layout, layout_text, read_layout
from sketchloom.sources.tables import new_path as work
from sketchloom.sources.tables import table

FILES = [[f"bins/{i}_a.fa", f"bins/{i}_b.fa"] if i % 3 == 0 else [f"bins/{i}.fa"] for i in range(12)]
CONFIG = RunConfig(data_file="bins.tsv", k=15, window_size=21, output_filename="x.layout", determine_best_tmax=True, index=replace(CFG, number_of_user_bins=12, alpha=1.5))


def text_files(lines: DataFrame, folder: str, ending: str) -> DataFrame:
    """Write lines as text files; returns them as one user bin a file."""
    spark = lines.sparkSession
    lines.write.text(folder)
    src_of = lambda f: f.rsplit("/", 1)[-1]
    names = sorted(spark.read.text(folder).inputFiles())
    moved = []
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in names:  # the ending tells the format
        to = f"{folder}/{src_of(n).removesuffix('.txt')}{ending}"
        fs.rename(fs_path(n), fs_path(to))
        moved.append(to)
    return spark.createDataFrame([(i, [n]) for i, n in enumerate(moved)], "ub_id long, files array<string>")


def written_sets(sets: DataFrame, folder: str) -> DataFrame:
    """The distinct elements of each user bin as a file of 8-byte values; (ub_id, files)."""
    name = F.concat(F.col("ub_id").cast("string"), F.lit(".minimiser"))
    datasource.write_files(sets.select(name.alias("file"), "h"), folder, distinct=True)
    return sets.select("ub_id").distinct().select("ub_id", F.array(F.concat(F.lit(folder + "/"), name)).alias("files"))


def hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_sets(suppliers(spark, sf_dir, 12), work(spark, "hashes"))


# ------------------------------------------------------------------ sources
@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ub_id, CASE WHEN s_suppkey % 2 = 0 THEN 'bins/' || s_suppkey || '_a.fa|bins/' || s_suppkey || '_b.fa' ELSE 'bins/' || s_suppkey || '.fa' END AS files FROM supplier""")
def source_user_bin_list(spark, sf_dir):
    """A list of user bins, files up to the first tab, one or two a bin."""
    key = F.col("s_suppkey").cast("string")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("bins/"), key, F.lit("_a.fa bins/"), key, F.lit("_b.fa"))).otherwise(F.concat(F.lit("bins/"), key, F.lit(".fa")))
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").select(F.concat_ws("\t", names, "s_name").alias("value"))
    path = work(spark, "list")
    lines.coalesce(1).write.text(path)
    return src.user_bins(spark, path).select("ub_id", F.array_join("files", "|").alias("files"))


RECORDS = f"SELECT doc_id, length(s) AS n, md5(s) AS digest FROM ({DNA}) WHERE s IS NOT NULL"


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(F.split("id", " ")[0].cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(RECORDS)
def source_fasta(spark, sf_dir):
    """Records of several lines, with the mark inside their headers."""
    seq = F.regexp_replace(F.upper("seq"), "(.{60})", "$1\n")
    lines = dna(spark, sf_dir).where("seq is not null").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" 5'->3' >x\n"), seq).alias("value"))
    return _records(src.sequences(spark, text_files(lines, work(spark, "fasta"), ".fa")))


@query(RECORDS)
def source_fastq(spark, sf_dir):
    """Records of four lines; every quality line starts with the mark."""
    n = F.length("seq")
    quality = F.when(n == 0, "").otherwise(F.concat(F.lit("@"), F.repeat(F.lit("I"), n - 1)))
    lines = dna(spark, sf_dir).where("seq is not null").select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit(" read @1")), F.upper("seq"), F.lit("+"), quality).alias("value"))
    return _records(src.sequences(spark, text_files(lines, work(spark, "fastq"), ".fq")))


@query(f"SELECT ub_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS total FROM ({BIN}) GROUP BY ub_id")
def source_precomputed(spark, sf_dir):
    bins = hash_files(spark, sf_dir)
    assert src.check_files(spark, bins)
    return src.precomputed(spark, bins).groupBy("ub_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@query(f"SELECT ub_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS total FROM ({BIN}) GROUP BY ub_id")
def source_hash_ranges(spark, sf_dir):
    """The same files in ranges of 4,000 bytes: each file is read by many tasks."""
    bins = hash_files(spark, sf_dir).select("ub_id", F.col("files")[0].alias("path"))
    paths = [r["path"] for r in bins.collect()]
    return datasource.read_hashes(spark, paths, 4000).join(bins, "path").groupBy("ub_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@query(f"SELECT ub_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS total FROM ({BIN}) GROUP BY ub_id")
def source_by_file_kind(spark, sf_dir):
    """As the reports read: the kind of every single file tells how."""
    got = entries.per_file_elements(spark, hash_files(spark, sf_dir), CONFIG)
    return got.groupBy("ub_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@query(f"SELECT ub_id, 8 * count(*) AS bytes FROM ({BIN}) GROUP BY ub_id")
def source_file_sizes(spark, sf_dir):
    return src.file_sizes(spark, hash_files(spark, sf_dir)).select("ub_id", "bytes")


# ------------------------------------------------------------------ sketches in files
NEAR = f"SELECT ub_id, count(*) AS n, true AS near FROM ({{e}}) GROUP BY {'ub_id'}"


def _near(rows: DataFrame, key: str = "ub_id") -> DataFrame:
    """Within five standard errors of a sketch with 12 index bits."""
    return rows.select(key, "n", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(2.0), 5 * 1.04 / 64 * F.col("n"))).alias("near"))


@query(NEAR.format(e=BIN))
def sketch_file(spark, sf_dir):
    """Sketches written with their files, registers and configuration, and read again."""
    el = suppliers(spark, sf_dir, 12)
    bins = spark.createDataFrame(list(enumerate(FILES)), "ub_id long, files array<string>")
    path = work(spark, "x") + ".sketches"
    entries.write_sketches(entries.sketch(el, 12), bins, CONFIG, path, entries.packed_registers(el))
    sketches, _, stored = entries.read_sketches(spark, path)
    assert stored == CONFIG and entries.read_registers(spark, path).count() == sketches.count()
    return _near(sketches.select("ub_id", F.col("kmer_count").alias("estimate")).join(exact_counts(el).withColumnRenamed("kmer_count", "n"), "ub_id"))


@query(f"""SELECT CASE WHEN ub_id % 3 = 0 THEN ub_id || '_a.hll' ELSE ub_id || '.hll' END AS file, count(*) AS n, true AS near, true AS same FROM ({BIN}) GROUP BY ub_id""")
def single_sketch_files(spark, sf_dir):
    """A file for each sketch: what is in it estimates the set, and is the sketch that was written."""
    el = suppliers(spark, sf_dir, 12)
    bins = spark.createDataFrame(list(enumerate(FILES)), "ub_id long, files array<string>")
    sketched, folder = entries.sketch(el, 12), work(spark, "hll")
    entries.write_single_sketches(spark, sketched, bins, folder)
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.hll_sketch_estimate("content").alias("estimate"), "content")
    own = sketched.join(exact_counts(el).withColumnRenamed("kmer_count", "n"), "ub_id")
    name = F.concat(F.col("ub_id").cast("string"), F.when(F.col("ub_id") % 3 == 0, "_a.hll").otherwise(".hll"))
    both = found.join(own.withColumn("file", name), "file")
    return _near(both, "file").join(both.select("file", (F.col("content") == F.col("sketch")).alias("same")), "file")


@query(f"SELECT f || chr(9) || n || chr(9) || f AS line FROM (SELECT CASE WHEN ub_id % 3 = 0 THEN 'bins/' || ub_id || '_a.fa;bins/' || ub_id || '_b.fa' ELSE 'bins/' || ub_id || '.fa' END AS f, count(*) AS n FROM ({BIN}) GROUP BY ub_id)")
def count_file(spark, sf_dir):
    bins = spark.createDataFrame(list(enumerate(FILES)), "ub_id long, files array<string>")
    path = work(spark, "counts")
    entries.count_lines(exact_counts(suppliers(spark, sf_dir, 12)), bins).coalesce(1).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(NEAR.format(e=SUP))
def native_sketch_bounds(spark, sf_dir):
    el = suppliers(spark, sf_dir)
    est = hll.native(el).select("ub_id", hll.estimate().alias("estimate"))
    return _near(est.join(exact_counts(el).withColumnRenamed("kmer_count", "n"), "ub_id"))


@query(f"SELECT ub_id % 8 AS tb, count(DISTINCT h) AS n, true AS near FROM ({SUP}) GROUP BY 1")
def native_union_bounds(spark, sf_dir):
    el = suppliers(spark, sf_dir).withColumn("tb", F.pmod("ub_id", F.lit(8)))
    est = hll.union(hll.native(el.select("ub_id", "h")).withColumn("tb", F.pmod("ub_id", F.lit(8))), "tb").select("tb", hll.estimate().alias("estimate"))
    return _near(est.join(el.groupBy("tb").agg(F.count_distinct("h").alias("n")), "tb"), "tb")


@query(f"""SELECT a.ub_id AS i, b.ub_id AS j, true AS near FROM (SELECT DISTINCT ub_id FROM ({BIN})) a JOIN (SELECT DISTINCT ub_id FROM ({BIN})) b ON b.ub_id = a.ub_id + 1""")
def pair_union_bounds(spark, sf_dir):
    """Union estimates of two sketches against exact unions."""
    el = suppliers(spark, sf_dir, 12)
    sk = hll.native(el)
    a, b = (sk.select(F.col("ub_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ij")
    est = a.join(b, F.col("j") == F.col("i") + 1).select("i", "j", hll.union_estimate("si", "sj").alias("estimate"))
    both = el.select(F.explode(F.array("ub_id", F.col("ub_id") - 1)).alias("i"), "h").groupBy("i").agg(F.count_distinct("h").alias("n"))
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(2.0), 5 * 1.04 / 64 * F.col("n"))
    return est.join(both, "i").select("i", "j", near.alias("near"))


# ------------------------------------------------------------------ layout files
def _layout_file(spark: SparkSession, sf_dir: str) -> str:
    """A layout of the suppliers: a merged bin for each remainder by four, one bin each below."""
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").orderBy("s_suppkey").collect()]  # a layout file is one text
    files = [[f"bins/{k}_a.fa", f"bins/{k}_b.fa"] if k % 3 == 0 else [f"bins/{k}.fa"] for k in keys]
    lay = Layout([(i, (i % 4,), i // 4, 1 + i % 2) for i in range(len(keys))], {(): 0, **{(t,): 0 for t in range(min(4, len(keys)))}})
    path = work(spark, "x") + ".layout"
    src.write_text(spark, path, layout_text(files, replace(CONFIG, index=replace(CONFIG.index, number_of_user_bins=len(keys))), lay, "tool"))
    return path


NUMBERED = "SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier"


@query(f"SELECT i AS ub_id, CASE WHEN k % 3 = 0 THEN 'bins/' || k || '_a.fa|bins/' || k || '_b.fa' ELSE 'bins/' || k || '.fa' END AS files FROM ({NUMBERED})")
def layout_file_user_bins(spark, sf_dir):
    files, _, _ = read_layout(spark, _layout_file(spark, sf_dir))
    return spark.createDataFrame([(i, "|".join(f)) for i, f in enumerate(files)], "ub_id long, files string")


SETTINGS = {"data_file": "bins.tsv", "debug": "False", "sketch_directory": "", "k": "15", "window_size": "21", "disable_sketch_output": "True", "precomputed_files": "False", "output_filename": "x.layout", "determine_best_tmax": "True",
            "force_all_binnings": "False", "output_verbose_statistics": "False", "number_of_hash_functions": "2", "maximum_fpr": "0.05", "relaxed_fpr": "0.3", "threads": "1", "sketch_bits": "12", "tmax": "64",
            "empty_bin_fraction": "0.0", "track_occupancy": "False", "alpha": "1.5", "max_rearrangement_ratio": "0.5", "disable_estimate_union": "True", "disable_rearrangement": "False"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SETTINGS.items()) + ") t(name, value) UNION ALL SELECT 'number_of_user_bins', CAST(count(*) AS VARCHAR) FROM supplier")
def layout_file_settings(spark, sf_dir):
    _, config, _ = read_layout(spark, _layout_file(spark, sf_dir))
    values = {k: v for k, v in asdict(config).items() if k != "index"} | asdict(config.index)
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string")


@query(f"SELECT i AS ord, i AS ub_id, (i % 4) || ';' AS path, i // 4 AS tb, 1 + i % 2 AS span FROM ({NUMBERED})")
def layout_file_bins(spark, sf_dir):
    _, _, lay = read_layout(spark, _layout_file(spark, sf_dir))
    return lay.frames(spark)[0].select("ord", "ub_id", path_text("prev_tbs"), F.col("storage_tb").alias("tb"), F.col("num_tbs").alias("span"))


@query(f"SELECT '' AS path, CAST(0 AS BIGINT) AS max_tb UNION ALL SELECT DISTINCT (i % 4) || ';', CAST(0 AS BIGINT) FROM ({NUMBERED})")
def layout_file_fullest_bins(spark, sf_dir):
    _, _, lay = read_layout(spark, _layout_file(spark, sf_dir))
    return lay.frames(spark)[1].select(path_text("ibf_path"), "max_tb")


# ------------------------------------------------------------------ the command line
def _reported(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Lines of a report that the command line makes of the fixed layout over files of hashes."""
    files = [r["files"] for r in hash_files(spark, sf_dir).orderBy("ub_id").collect()]
    path, out = work(spark, "r") + ".layout", work(spark, "report")
    src.write_text(spark, path, layout_text(files, replace(CONFIG, precomputed_files=True), LAYOUT))
    if cli.run(["stats", kind, "--input", path, "--output", out, *(["--output-shared-kmers"] if kind == "general" else [])], spark):
        raise RuntimeError("the report failed")
    return spark.read.text(out).where(~F.col("value").startswith("#") & ~F.col("value").rlike("^(LEVEL|tb_index)\t")).select(F.split("value", "\t").alias("c"))


@query(REPORT + """, o AS (SELECT *, coalesce(sum(splits) OVER (ORDER BY tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM rec)
SELECT CAST(first + i AS BIGINT) AS tb_index, exact_size, fpr_corrected_size, shared_size, ub_count, kind, CASE WHEN i = 0 THEN splits ELSE 0 END AS splits FROM (SELECT *, unnest(range(0, splits)) AS i FROM o)""")
def cli_general_report(spark, sf_dir):
    c = _reported(spark, sf_dir, "general")
    at = {"tb_index": 0, "exact_size": 1, "fpr_corrected_size": 3, "shared_size": 4, "ub_count": 5, "splits": 7}
    return c.select(*[F.col("c")[i].cast("long").alias(n) for n, i in at.items()], F.col("c")[6].alias("kind"))


@query(TREE + """ SELECT CAST(level AS BIGINT) AS level, CAST(sum(bits) AS BIGINT) AS bit_size, count(*) AS ibfs, printf('%.2f', avg(load_factor) * 100) AS avg_load_factor, CAST(sum(too_big) AS BIGINT) AS tbs_too_big,
CAST(sum(too_many) // greatest(sum(too_big), 1) AS BIGINT) AS avg_tbs_too_big_elements, CAST(sum(max_elements) // count(*) AS BIGINT) AS avg_max_elements FROM z GROUP BY level""")
def cli_sizes_report(spark, sf_dir):
    c = _reported(spark, sf_dir, "sizes")
    names = ("level", "bit_size", "ibfs", "avg_load_factor", "tbs_too_big", "avg_tbs_too_big_elements", "avg_max_elements")
    return c.select(*[(F.col("c")[i] if n == "avg_load_factor" else F.col("c")[i].cast("long")).alias(n) for i, n in enumerate(names)])


def _sequences(spark: SparkSession, sf_dir: str) -> list[str]:
    """FASTA files of one record a document, each written by one of many tasks."""
    folder = work(spark, "records")
    lines = dna(spark, sf_dir).where("seq is not null").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.upper("seq")).alias("value"))
    return [r["files"][0] for r in text_files(lines, folder, ".fa").collect()]  # names only


FORWARD = f"SELECT doc_id, length(s) AS n, count(DISTINCT substr(s, i, 12)) AS exact FROM (SELECT doc_id, s, CAST(unnest(range(1, length(s) - 10)) AS INT) AS i FROM ({DNA}) WHERE length(s) >= 12) GROUP BY doc_id, s"


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS sequence_length, CAST(b AS BIGINT) AS sketch_register_size, exact AS actual_cardinality, printf('%.4f', 1.04 / sqrt(b)) AS expected_relative_error, true AS near FROM ({FORWARD}), (VALUES (1024), (4096)) t(b)")
def cli_accuracy_table(spark, sf_dir):
    """The table that the command line writes for sketches with 10 and 12 index bits, k = 12."""
    out = work(spark, "accuracy")
    if cli.run(["accuracy", "-i", *_sequences(spark, sf_dir), "-o", out, "-b", "10", "12", "-k", "12"], spark):
        raise RuntimeError("the table failed")
    c = spark.read.text(out).where(~F.col("value").startswith("#") & ~F.col("value").startswith("sequence_id")).select(F.split("value", "\t").alias("c"))
    n = lambda i: F.col("c")[i].cast("long")
    expected = F.col("c")[5].cast("double")
    near = (F.col("c")[6].cast("double") <= 6 * expected) | (F.abs(F.col("c")[3].cast("double") - n(4)) <= 3)
    return c.select(n(0).alias("doc_id"), n(1).alias("sequence_length"), n(2).alias("sketch_register_size"), n(4).alias("actual_cardinality"), F.format_string("%.4f", expected).alias("expected_relative_error"), near.alias("near"))


def _searched(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of the statistics and the times of a search over the twelve user bins' files."""
    listed, out, times = work(spark, "list") + ".tsv", work(spark, "out") + ".layout", work(spark, "times") + ".tsv"
    src.write_text(spark, listed, "\n".join(r["files"][0] for r in hash_files(spark, sf_dir).orderBy("ub_id").collect()) + "\n")  # names only
    if cli.run(["layout", "--input", listed, "--output", out, "--tmax", "64", "--determine-best-tmax", "--force-all-binnings", "--timing-output", times], spark):
        raise RuntimeError("the search failed")
    return out + ".stats", times


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))


STATS = [*statistics.parameters(replace(CFG, number_of_user_bins=1)).splitlines(), *statistics.header(False).splitlines(), "64\t1.00\t1.00\t1.00\t1.00", "# Best t_max (regarding expected query runtime): 64"]


@query("SELECT line, replace(value, 'user bins = 1', 'user bins = ' || n) AS value FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(STATS)) + f") t(line, value), (SELECT count(DISTINCT ub_id) AS n FROM ({BIN}))")
def cli_statistics(spark, sf_dir):
    """The statistics file of a search, without its last column (sizes rest on estimates)."""
    lines = _numbered(spark, _searched(spark, sf_dir)[0])
    row = F.col("value").rlike("^[0-9]")
    return lines.select("line", F.when(row, F.regexp_replace("value", "\t[^\t]*$", "")).otherwise(F.col("value")).alias("value"))


@query(f"SELECT 'sketching_in_seconds' || chr(9) || 'layouting_in_seconds' || chr(9) || 'union_estimation_in_seconds' || chr(9) || 'rearrangement_in_seconds' AS head, 4 AS times, true AS well_formed, count(DISTINCT ub_id) AS user_bins FROM ({BIN})")
def cli_timing(spark, sf_dir):
    """The times of the same search: a head, four numbers with two decimals, and a last tab."""
    lines = _numbered(spark, _searched(spark, sf_dir)[1]).groupBy().agg(F.max_by("value", -F.col("line")).alias("head"), F.max_by("value", "line").alias("values"), F.count("*").alias("n"))
    bins = hash_files(spark, sf_dir).agg(F.count("*").alias("user_bins"))
    good = (F.col("n") == 2) & F.col("values").rlike(r"^(\d+\.\d\d\t){4}$")
    return lines.crossJoin(bins).select("head", (F.size(F.split("values", "\t")) - 1).alias("times"), good.alias("well_formed"), "user_bins")


# ------------------------------------------------------------------ what every layout keeps to
def _kept(rows: DataFrame) -> DataFrame:
    """For each run: user bins placed, distinct ones, their elements, bins of the root, and whether
    in every filter the spans fill its bins, start after each other and have one fullest bin."""
    bins = rows.groupBy("run", "ibf_path", "tb").agg(F.max("span").alias("span"), F.max("bins").alias("bins"), F.countDistinct("merged").alias("kinds"), F.max("max_tb").alias("max_tb"), F.count("*").alias("ubs"), F.max(F.col("merged").cast("int")).alias("merged"))
    filters = bins.groupBy("run", "ibf_path").agg(F.sum("span").alias("filled"), F.max("bins").alias("bins"), F.max(F.col("tb") + F.col("span")).alias("end"), F.sum((F.col("tb") == F.col("max_tb")).cast("int")).alias("tops"), F.min((F.col("kinds") == 1) & ((F.col("ubs") > 1) == (F.col("merged") == 1))).alias("plain"))
    good = (F.col("filled") == F.col("bins")) & (F.col("end") == F.col("bins")) & (F.col("tops") == 1) & F.col("plain")
    per_run = filters.groupBy("run").agg(F.min(good).alias("well_formed"), F.max(F.when(F.size("ibf_path") == 0, F.col("bins"))).alias("root_bins"))
    placed = rows.where("not merged").groupBy("run").agg(F.count("*").alias("placed"), F.countDistinct("ub_id").alias("user_bins"), F.sum("kmer_count").alias("elements"))
    return placed.join(per_run, "run").select("run", "placed", "user_bins", "elements", "root_bins", "well_formed")


def _kept_sql(runs: tuple[int, ...]) -> str:
    values = ", ".join(f"({t})" for t in runs)
    return f"SELECT CAST(t AS BIGINT) AS run, n AS placed, n AS user_bins, e AS elements, CAST(t AS BIGINT) AS root_bins, true AS well_formed FROM (SELECT count(DISTINCT ub_id) AS n, count(*) AS e FROM ({SUP})), (VALUES {values}) v(t)"


@query(_kept_sql((64, 128)))
def layout_dp_kept(spark, sf_dir):
    return _kept(binning.layouts(exact_counts(suppliers(spark, sf_dir)), [64, 128], CFG))


@query(_kept_sql((64,)))
def layout_dp_unions_kept(spark, sf_dir):
    el = suppliers(spark, sf_dir)
    return _kept(binning.layouts(exact_counts(el), [64], IndexConfig(tmax=64), table(entries.packed_registers(el), "registers")))


@query(f"SELECT ub_id, count(*) AS n FROM ({SUP}) GROUP BY ub_id")
def cli_layout(spark, sf_dir):
    """The command line's layout of the suppliers, from files of hashes: each user bin in it once,
    with its exact count."""
    written = written_sets(suppliers(spark, sf_dir), work(spark, "bins")).orderBy("ub_id").collect()  # names only
    keys, names = [r["ub_id"] for r in written], [r["files"][0] for r in written]
    listed, out = work(spark, "list") + ".tsv", work(spark, "out") + ".layout"
    src.write_text(spark, listed, "\n".join(names) + "\n")
    if cli.run(["layout", "--input", listed, "--output", out, "--tmax", "64", "--kmer", "15"], spark):
        raise RuntimeError("the layout failed")
    files, config, lay = read_layout(spark, out)
    placed = spark.createDataFrame([(u, keys[u], files[u]) for u, *_ in lay.user_bins], "place long, ub_id long, files array<string>")
    own = entries.per_file_elements(spark, placed.select("ub_id", "files"), config)
    return report_counts(own)


def report_counts(own: DataFrame) -> DataFrame:
    return own.groupBy("ub_id").agg(F.count_distinct("h").alias("n"))
