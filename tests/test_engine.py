"""Results of the engine on hand-checked inputs."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchloom import catalog_files, cli
from sketchloom.config import IndexConfig, RunConfig, next_multiple_of_64, reconcile
from sketchloom.functions import bloom, hll, kmers
from sketchloom.operators import binning, report, statistics
from sketchloom.plans import entries
from sketchloom.sources import files as src
from sketchloom.sources.layouts import Layout, layout_text, user_bins_from, user_bins_text

CFG = IndexConfig(tmax=64, disable_estimate_union=True)


def counts_of(spark, counts):
    return spark.createDataFrame(list(enumerate(counts)), "ub_id long, kmer_count long")


# ------------------------------------------------------------------ scalars
@pytest.mark.parametrize("size,text", [(0, "0Bytes"), (8, "8Bytes"), (8 << 10, "8.0KiB"), (8 << 60, "8.0EiB"), (6174015488, "5.8GiB"), (6174015487, "5.7GiB"), (1048575, "1.0MiB"), (2**64 - 1, "16.0EiB")])
def test_size_text(spark, size, text):
    assert bloom.size_text_of(size) == text
    got = spark.range(1).select(bloom.size_text(F.lit(str(size)).cast("decimal(20,0)")))
    assert got.first()[0] == text


def test_bloom(spark):
    assert bloom.bits_of(153, 0.05, 2) <= bloom.bits_of(479, 0.05, 2)
    assert bloom.bits_of(479, 0.3, 2) * 4 == 4832
    assert [round(bloom.split_factor(s, 0.05, 2), 2) for s in (1, 2, 9, 15, 31)] == [1.0, 1.46, 3.23, 4.20, 6.10]
    assert math.ceil(479 * bloom.merged_factor(0.05, 0.3, 2)) == 153
    rows = spark.range(1, 40).select("id", bloom.split_correction(F.col("id"), 0.05, 2).alias("c"), bloom.bits(F.col("id"), 0.05, 2).alias("b"))
    assert all(abs(r.c - bloom.split_factor(r.id, 0.05, 2)) < 1e-12 and r.b == bloom.bits_of(r.id, 0.05, 2) for r in rows.collect())


def test_query_cost(spark):
    assert bloom.cost_exact(65536, 0.0125) == 54.4134
    for bad in (65537, 32, 100):
        with pytest.raises(ValueError):
            bloom.cost_exact(bad, 0.05)
    with pytest.raises(ValueError):
        bloom.cost_of(65537, 0.05)
    assert bloom.nearest_fpr(0.02) == 0.05 and bloom.nearest_fpr(0.9) == 0.3125
    for f in bloom.COST:
        row = [bloom.cost_exact(1 << i, f) for i in range(6, 17)]
        assert row == sorted(set(row))
    df = spark.createDataFrame([(b, f) for b in (1, 64, 65, 100, 128, 192, 3000, 65535, 65536) for f in (0.0001, 0.003, 0.05, 0.3125, 0.7)], "b long, f double")
    assert all(abs(r.c - bloom.cost_of(r.b, r.f)) < 1e-9 for r in df.withColumn("c", bloom.query_cost(F.col("b"), F.col("f"))).collect())
    assert bloom.cost_table(spark).count() == 77


def test_multiples(spark):
    assert [next_multiple_of_64(x) for x in (0, 1, 64, 65)] == [0, 64, 64, 128]
    got = spark.range(130).select("id", bloom.multiple_of_64(F.col("id")).alias("m"), bloom.ceil_div(F.col("id"), F.lit(7)).alias("d")).collect()
    assert all(r.m == next_multiple_of_64(r.id) and r.d == -(-r.id // 7) for r in got)


# ------------------------------------------------------------------ k-mers
def brute_kmers(seq, k, w, seeded=True):
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    seed = kmers.SEED >> (64 - 2 * k)
    out = set()
    for run in "".join(x if x in code else " " for x in seq.upper()).split():
        hs = []
        for i in range(len(run) - k + 1):
            f = r = 0
            for x in run[i : i + k]:
                f = f * 4 + code[x]
            for x in reversed(run[i : i + k]):
                r = r * 4 + 3 - code[x]
            hs.append(min(f ^ seed, r ^ seed) if seeded else f)
        out |= {min(hs[i : i + w - k + 1]) for i in range(len(hs) - (w - k))} if len(hs) > w - k else set()
    return {kmers.signed(x) for x in out}


@pytest.mark.parametrize("k,w,seeded", [(4, 4, True), (15, 15, True), (15, 20, True), (20, 20, False), (31, 35, True), (32, 32, True), (32, 40, True), (32, 32, False)])
def test_kmers(spark, k, w, seeded):
    rng = random.Random(k * w)
    seqs = {i: "".join(rng.choice("ACGTacgtN" if i else "ACGT") for _ in range(rng.choice([0, 3, k, 120, 300]))) for i in range(12)}
    seqs[12] = "T" * 40
    got = kmers.elements(spark.createDataFrame(list(seqs.items()), "ub_id long, seq string"), k, w, seeded).distinct().groupBy("ub_id").agg(F.collect_set("h").alias("hs")).collect()
    found = {r.ub_id: set(r.hs) for r in got}
    for i, s in seqs.items():
        assert found.get(i, set()) == brute_kmers(s, k, w, seeded)


def test_kmer_bounds(spark):
    with pytest.raises(ValueError):
        kmers.adjusted_seed(33)
    with pytest.raises(ValueError):
        kmers.elements(spark.createDataFrame([], "ub_id long, seq string"), 20, 10)


# ------------------------------------------------------------------ sketches
def test_sketches(spark):
    el = spark.range(20000).select((F.col("id") % 2).alias("ub_id"), (F.col("id") % 7000).alias("h"))
    got = hll.native(el).withColumn("e", hll.estimate()).collect()
    assert all(abs(r.e - 3500) < 350 for r in got)
    regs = hll.registers(el)
    est = {r.ub_id: r.estimate for r in hll.estimates(regs).collect()}
    assert all(abs(e - 3500) < 350 for e in est.values())
    both = hll.estimates(hll.merge(regs.withColumn("tb", F.lit(0)), "tb"), "tb").first()
    assert abs(both.estimate - 7000) < 700
    packed = entries.packed_registers(el).collect()
    import numpy as np

    assert all(abs(binning.cardinalities(np.frombuffer(r.regs, np.uint8)) - est[r.ub_id]) < 1e-6 for r in packed)
    with pytest.raises(ValueError):
        hll.native(el, 22)


# ------------------------------------------------------------------ optimiser
def test_unions_and_rearrangement(spark):
    """Alike sets are cheap to merge: the union estimate is used, and they become neighbours."""
    el = spark.range(140 * 200).select((F.col("id") % 140).alias("ub_id"), F.floor(F.col("id") / 140).alias("i"))
    el = el.select("ub_id", (F.col("i") + 1000 * (F.col("ub_id") % 2)).alias("h"))
    counts = el.groupBy("ub_id").agg(F.count_distinct("h").alias("kmer_count"))
    cfg = IndexConfig(tmax=64).completed(140)
    regs = entries.packed_registers(el)
    lay = binning.compute(spark, counts, cfg, regs)
    merged = {}
    for u, path, _, _ in lay.user_bins:
        if path:
            merged.setdefault(path[0], set()).add(u % 2)
    assert merged and sum(len(x) == 1 for x in merged.values()) >= len(merged) - 1
    sketches = hll.native(el)
    with_union = statistics.Summary(lay.frames(spark)[0], counts, cfg, sketches)
    summed = statistics.Summary(lay.frames(spark)[0], counts, IndexConfig(tmax=64, disable_estimate_union=True).completed(140))
    assert with_union.bytes < summed.bytes and with_union.query_cost >= summed.query_cost


def test_candidates(spark):
    assert binning.candidates(256, 96) == [64, 128, 256] and binning.candidates(64, 10000) == [64, 128]
    tried = spark.createDataFrame([(64, 3.0), (128, 2.0), (256, 2.0), (512, 1.0)], "t_max long, cost double")
    assert [r.t_max for r in statistics.stop_early(tried).orderBy("t_max").collect()] == [64, 128, 256]


def test_search(spark):
    counts = counts_of(spark, [10000 * (i + 1) for i in range(10)])
    cfg = IndexConfig(tmax=128, disable_estimate_union=True).completed(10)
    layout, best, text = entries.search(spark, counts, cfg, verbose=True, force_all=True)
    rows = [x.split("\t") for x in text.splitlines() if not x.startswith("#")]
    assert best == 64 and [r[:3] for r in rows] == [["64", "1.00", "1.00"], ["128", "1.22", "1.22"]]
    # On exact counts; tests/test_layouts.py has the published numbers, on estimates.
    assert rows[0][5:7] == ["1.6MiB", "1.2MiB"] and all(r[7] == ":0" and r[13] == ":100.00" for r in rows)
    assert [r[11] for r in rows] == [":64", ":128"]
    assert text.startswith("## ### Parameters ###\n## number of user bins = 10\n") and text.endswith("query runtime): 64\n")


# ------------------------------------------------------------------ statistics
def test_summary_of_a_given_layout(spark):
    lay = Layout([r for _ in range(4) for r in ((0, (0,), 0, 2), (1, (1,), 0, 2))], {(): 0, (0,): 0, (1,): 0})
    got = statistics.Summary(lay.frames(spark)[0], counts_of(spark, [50, 50]), CFG).line(None, True)
    assert got == "64\t1.00\t8.00\t1.00\t8.00\t711Bytes\t790Bytes\t:0:1\t:1:2\t:126Bytes:584Bytes\t:395Bytes:395Bytes\t:2:16\t:2:8\t:0.00:100.00\t:-:2\t:-:2.00\t:-:1.46\t:-:1.48"


def test_three_levels(spark):
    """Cost adds up along the path at every depth."""
    lay = Layout([(0, (), 1, 1), (1, (0,), 1, 1), (2, (0, 0), 0, 1), (3, (0, 0), 1, 1)], {(): 0, (0,): 0, (0, 0): 0})
    s = statistics.Summary(lay.frames(spark)[0], counts_of(spark, [10, 20, 30, 40]), CFG)
    assert [r["level"] for r in s.rows] == [0, 1, 2] and abs(s.query_cost - (10 * 1 + 20 * 2 + 70 * 3) / 100) < 1e-9


# ------------------------------------------------------------------ files and reports
@pytest.fixture
def fixture(tmp_path):
    """Four user bins; 0 and 1 share a prefix and are merged."""
    rng = random.Random(8)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = seq(300)
    seqs = [common + seq(100), common + seq(180), seq(500), seq(301)]
    for i, s in enumerate(seqs):
        (tmp_path / f"s{i}.fa").write_text(f">seq{i} x\n" + "\n".join(s[a : a + 80] for a in range(0, len(s), 80)) + "\n")
    files = [[str(tmp_path / "s0.fa")], [str(tmp_path / "s1.fa")] * 2, [str(tmp_path / "s2.fa")], [str(tmp_path / "s3.fa")]]
    layout = Layout([(0, (0,), 0, 2), (1, (0,), 2, 2), (2, (), 1, 1), (3, (), 2, 2)], {(): 0, (0,): 0})
    config = RunConfig(k=15, window_size=15, index=IndexConfig(number_of_user_bins=4, tmax=4))
    path = tmp_path / "x.layout"
    path.write_text(layout_text(files, config, layout, "tool"))
    return path, [brute_kmers(s, 15, 15) for s in seqs], files, tmp_path


def test_general_report(spark, fixture):
    path, sets, _, _ = fixture
    for shared in (False, True):
        rows = [x.split("\t") for x in entries.general_report(spark, str(path), shared).splitlines()]
        assert rows[0] == [f"# Layout: {path}"] and rows[1][0] == "tb_index"
        half = -(-len(sets[3]) // 2)
        want = [[len(sets[0] | sets[1]), len(sets[0] & sets[1]) if shared else 0, 2, "merged", 1], [len(sets[2]), 0, 1, "split", 1], [half, 0, 1, "split", 2], [half, 0, 1, "split", 0]]
        for i, (r, w) in enumerate(zip(rows[2:], want)):
            assert r[0] == str(i) and int(r[1]) == w[0] and abs(int(r[2]) - w[0]) <= 0.05 * w[0] + 2 and [r[4], r[5], r[6], r[7]] == [str(w[1]), str(w[2]), w[3], str(w[4])]
        assert rows[2][3] == str(math.ceil(want[0][0] * bloom.merged_factor(0.05, 0.3, 2))) and rows[4][3] == str(math.ceil(half * bloom.split_factor(2, 0.05, 2)))


def test_sizes_report(spark, fixture):
    path, sets, _, _ = fixture
    got = entries.sizes_report(spark, str(path)).splitlines()
    assert got[:2] == ["# Levels: 2", "# User bins: 4"]
    m = len(sets[0] | sets[1])
    loads = [(len(sets[2]) + 1, 1), (len(sets[3]) // 2 + 1, 2)]
    waste = sum((m - e) * s for e, s in loads if m >= e)
    big = [(e - m, s) for e, s in loads if m < e]
    row = got[3].split("\t")
    assert row == ["0", str(4 * bloom.bits_of(m, 0.3, 2)), "1", f"{100 * (4 * m - waste) / (4 * m):.2f}", str(sum(s for _, s in big)), str(sum(x * s for x, s in big) // max(1, sum(s for _, s in big))), str(m)]
    low = len(sets[0])
    bits = 4 * math.ceil(bloom.bits_of(-(-low // 2), 0.05, 2) * bloom.split_factor(2, 0.05, 2))
    assert got[4].split("\t")[:3] == ["1", str(bits), "1"] and got[4].split("\t")[6] == str(low)


def test_published_level_numbers(spark):
    """479 elements in the root's fullest (merged) bin, 385 in a split one below."""
    lay = Layout([(0, (0,), 0, 2), (1, (0,), 2, 2), (2, (), 1, 1), (3, (), 2, 2)], {(): 0, (0,): 0})
    parts = {0: range(385), 1: [*range(371), *range(1000, 1094)], 2: range(5000, 5466), 3: range(9000, 9574)}
    el = spark.createDataFrame([(u, h) for u, hs in parts.items() for h in hs], "ub_id long, h long")
    frames = lay.frames(spark)
    text = report.sizes_text(report.level_sizes(report.filter_sizes(*frames, el, IndexConfig(tmax=4))), 4)
    assert text.splitlines()[3:] == ["0\t4832\t1\t79.44\t0\t0\t479", "1\t8916\t1\t80.26\t0\t0\t385"]
    rows = report.exploded(report.per_bin(frames[0], el, IndexConfig(tmax=4), True)).orderBy("tb_index").collect()
    assert [(r.exact_size, r.fpr_corrected_size, r.shared_size, r.ub_count, r.kind, r.splits) for r in rows] == [(479, 153, 371, 2, "merged", 1), (466, 466, 0, 1, "split", 1), (287, 420, 0, 1, "split", 2), (287, 420, 0, 1, "split", 0)]


def test_texts_round_trip():
    c = RunConfig(data_file="/path/to/data.file", sketch_directory="/d", k=20, window_size=24, precomputed_files=True, output_filename="file.layout", determine_best_tmax=True, force_all_binnings=True,
                  index=IndexConfig(123456789, 4, 0.0001, 0.2, 31, 8, 128, alpha=1.0, max_rearrangement_ratio=0.333, disable_estimate_union=True))
    for prefix in ("", "tool"):
        text = c.to_text(prefix)
        assert RunConfig.from_text("x\n" + text + "y\n") == c and '@        "k": 20,\n' in text and '@            "value0": "file.layout"\n' in text
        files = [["a", "b"], ["c"]]
        assert user_bins_from(user_bins_text(files, prefix)) == files
    body = "#TOP_LEVEL_IBF fullest_technical_bin_idx:111\n#LOWER_LEVEL_IBF_0;0;0;0 fullest_technical_bin_idx:2\n#USER_BIN_IDX\tTECHNICAL_BIN_INDICES\tNUMBER_OF_TECHNICAL_BINS\n7\t0\t1\n5\t0;0;0;0;5\t1;1;1;1;2\n"
    lay = Layout.from_text(body)
    assert lay.to_text() == body and lay.user_bins[1] == (5, (0, 0, 0, 0), 5, 2)
    with pytest.raises(ValueError):
        RunConfig.from_text("nothing")


def test_lists_and_names(spark, tmp_path):
    p = tmp_path / "list"
    p.write_text("a1 a2\tmore\tcolumns\nb\nc1 c2 c3\n")
    assert [r.files for r in src.user_bins(spark, str(p)).orderBy("ub_id").collect()] == [["a1", "a2"], ["b"], ["c1", "c2", "c3"]]
    p.write_text("")
    with pytest.raises(ValueError, match="appears to be empty"):
        src.user_bins(spark, str(p))
    for n in ("x.fa", "y.minimiser", "z.MINIMISER"):
        (tmp_path / n).write_bytes(b"")
    mk = lambda rows: spark.createDataFrame([(i, [str(tmp_path / n) for n in r]) for i, r in enumerate(rows)], "ub_id long, files array<string>")
    assert src.check_files(spark, mk([["x.fa"]])) is False and src.check_files(spark, mk([["y.minimiser"], ["z.MINIMISER"]])) is True
    with pytest.raises(ValueError, match="Mixing"):
        src.check_files(spark, mk([["x.fa"], ["y.minimiser"]]))
    with pytest.raises(ValueError, match="does not exist"):
        src.check_files(spark, mk([["none.fa"]]))


def test_precomputed_and_fastq(spark, tmp_path):
    import gzip
    import struct

    (tmp_path / "a.minimiser").write_bytes(struct.pack("<3Q", 1, 2**64 - 1, 5) + b"xyz")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@r1\nACGTACGTAC\n+\nIIIIIIIIII\n@r2\nTTTTT\n+\nIIIII\n"))
    bins = spark.createDataFrame([(0, [str(tmp_path / "a.minimiser")]), (1, [str(tmp_path / "b.fq.gz")])], "ub_id long, files array<string>")
    got = entries.per_file_elements(spark, bins, RunConfig(k=4, window_size=4)).distinct().collect()
    assert {r.h for r in got if r.ub_id == 0} == {1, -1, 5}
    assert {r.h for r in got if r.ub_id == 1} == brute_kmers("ACGTACGTAC N TTTTT", 4, 4)


def test_reconcile():
    stored = RunConfig(k=19, window_size=19)
    assert reconcile(RunConfig(), stored, set())[1] == []
    got, warn = reconcile(RunConfig(k=20), stored, {"kmer"})
    assert got.k == 20 and got.window_size == 19 and "differs from k-mer size in the sketch file (19)" in warn[0]
    with pytest.raises(ValueError, match="sketch-bits"):
        reconcile(RunConfig(), stored, {"sketch-bits"})
    with pytest.raises(ValueError, match="window"):
        reconcile(RunConfig(window_size=30), stored, {"window"})


def test_command_line(spark, fixture, capsys):
    path, sets, files, tmp = fixture
    lst = tmp / "bins"
    lst.write_text("\n".join(" ".join(f) for f in files) + "\n")
    out, sk, timing = tmp / "out.layout", tmp / "out.sketches", tmp / "t.tsv"
    assert cli.run(["layout", "--input", str(lst), "--output", str(out), "--kmer", "15", "--tmax", "64", "--output-sketches-to", str(sk), "--timing-output", str(timing)], spark) == 0
    assert len(timing.read_text().split("\n")) == 2 and timing.read_text().endswith("\t")
    first = Layout.from_text(out.read_text())
    assert sorted(u[0] for u in first.user_bins) == [0, 1, 2, 3] and sum(n for *_, n in first.user_bins) == 64
    again = tmp / "again.layout"
    assert cli.run(["layout", "--input", str(sk), "--output", str(again), "--tmax", "64"], spark) == 0
    assert Layout.from_text(again.read_text()) == first and RunConfig.from_text(again.read_text()).k == 15
    assert cli.run(["layout", "--input", str(sk), "--output", str(again), "--sketch-bits", "12"], spark) == -1
    assert cli.run(["layout", "--input", str(lst), "--output-sketches-to", str(tmp / "bad.ext")], spark) == -1
    assert cli.run(["layout", "--input", str(lst), "--kmer", "20", "--window", "10"], spark) == -1
    assert cli.run(["layout"], spark) == -1
    err = capsys.readouterr().err
    assert "[ERROR] The k-mer size cannot be bigger than the window size." in err and "[ERROR] Option --input is required but not set." in err and 'extension ".sketch" or ".sketches"' in err
    assert cli.run(["layout", "--input", str(lst), "--output", str(again), "--determine-best-tmax", "--tmax", "128"], spark) == 0
    assert "# Best t_max" in (tmp / "again.layout.stats").read_text()
    for kind in ("general", "sizes"):
        assert cli.run(["stats", kind, "--input", str(out), "--output", str(tmp / kind)], spark) == 0 and (tmp / kind).read_text()
    assert cli.run(["accuracy", "-i", files[2][0], "-o", str(tmp / "acc"), "-b", "8", "12", "-k", "15"], spark) == 0
    rows = [x.split("\t") for x in (tmp / "acc").read_text().splitlines()]
    assert rows[0] == [f"# input file: {files[2][0]}"] and rows[3][:3] == ["seq2 x", "500", "256"] and int(rows[4][4]) == len(brute_kmers(open(files[2][0]).read().split("\n", 1)[1].replace("\n", ""), 15, 15, False))


def test_accuracy_of_several_files(spark, tmp_path):
    """The records of all files are in one table; documents are written as many files, not one."""
    texts = {"b": "ACGTTGCAAC" * 9, "a": "TTGACCA" * 11, "c": "GGCATTACGA" * 7}
    for name, seq in texts.items():
        (tmp_path / f"{name}.fa").write_text(f">{name}\n{seq}\n")
    paths = [str(tmp_path / f"{n}.fa") for n in texts]
    assert cli.run(["accuracy", "-i", *paths, "-o", str(tmp_path / "acc"), "-b", "10", "-k", "12"], spark) == 0
    lines = (tmp_path / "acc").read_text().splitlines()
    assert lines[0] == f"# input file: {' '.join(paths)}" and [x.split("\t")[:2] for x in lines[3:]] == [[n, str(len(texts[n]))] for n in sorted(texts)]
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("acgt").alias("text"), F.lit("x").alias("lang"))
    docs.repartition(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    assert len(catalog_files._sequences(spark, str(tmp_path / "in"))) > 1


def test_streaming(spark, tmp_path):
    from sketchloom.streaming import sketches

    spark.range(3000).select((F.col("id") % 3).alias("ub_id"), F.col("id").alias("h")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ub_id long, h long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sketches.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sketches.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert len(got) == 3 and all(abs(r.estimate - 1000) < 60 for r in got)


# ------------------------------------------------------------------ files with marks inside, long sequences
def test_marks_inside_records(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">seq1 5'->3' strand > x\r\nACGT\r\nAC>GT\r\n>\r\nTT\r\n>seq3\nGG\nCC")
    (tmp_path / "b.fq").write_bytes(b"@r1 a@b\nACGT\n+\n@III\n@r2\nTTTTA\n+r2\n@@@@@\n@r3\n\n+\n\n@r4\nGG\n+\n+@\n")
    bins = spark.createDataFrame([(0, [str(tmp_path / "a.fa")]), (1, [str(tmp_path / "b.fq")])], "ub_id long, files array<string>")
    got = sorted((r.ub_id, r.id, r.seq) for r in src.sequences(spark, bins).collect())
    assert got == [(0, "", "TT"), (0, "seq1 5'->3' strand > x", "ACGTAC>GT"), (0, "seq3", "GGCC"), (1, "r1 a@b", "ACGT"), (1, "r2", "TTTTA"), (1, "r3", ""), (1, "r4", "GG")]
    sizes = {r.ub_id: r.bytes for r in src.file_sizes(spark, bins).collect()}
    assert sizes == {0: (tmp_path / "a.fa").stat().st_size, 1: (tmp_path / "b.fq").stat().st_size}
    assert src.missing(spark, [str(tmp_path / "a.fa"), str(tmp_path / "c.fa"), str(tmp_path / "no" / "d.fa")]) == sorted([str(tmp_path / "c.fa"), str(tmp_path / "no" / "d.fa")])


@pytest.mark.parametrize("k,w", [(15, 15), (15, 24), (32, 32)])
def test_pieces_of_a_long_sequence(spark, monkeypatch, k, w):
    rng = random.Random(w)
    seq = "".join(rng.choice("ACGTN" if i % 40 == 0 else "ACGT") for i in range(3000))
    monkeypatch.setattr(kmers, "PIECE", 128)
    run = kmers._kernel(k, w, True, "key", "seq", True)
    batch = pa.RecordBatch.from_pydict({"key": ["x", "x", None], "seq": [seq, seq[:700], None]})
    got = [h for b in run([batch]) for h in b.column("h").to_pylist()]
    assert set(got) == brute_kmers(seq, k, w)
    monkeypatch.setattr(kmers, "PIECE", 1 << 30)
    assert set(got) == {h for b in kmers._kernel(k, w, True, "key", "seq", False)([batch]) for h in b.column("h").to_pylist()}


def test_fifty_million_bases(spark):
    """One record of 50 Mb: a repeat of 1,000 bases has no more than 1,000 different k-mers."""
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(1000))
    seqs = spark.range(1).select(F.col("id").alias("ub_id"), F.repeat(F.lit(unit), 50_000).alias("seq"))
    got = kmers.elements(seqs, 19)
    assert {r.h for r in got.distinct().collect()} == brute_kmers(unit * 2, 19, 19)


def test_unions_from_stored_sketches(spark, tmp_path):
    """The same layout from stored sketches as from the files, with union estimates."""
    rng = random.Random(2)
    common = [rng.getrandbits(60) for _ in range(400)]
    lines = []
    for i in range(90):
        own = [rng.getrandbits(60) for _ in range(20 + i)] + (common if i % 2 else [])
        (tmp_path / f"{i}.minimiser").write_bytes(b"".join(x.to_bytes(8, "little") for x in own))
        lines.append(str(tmp_path / f"{i}.minimiser"))
    (tmp_path / "list").write_text("\n".join(lines) + "\n")
    config = RunConfig(data_file=str(tmp_path / "list"), index=IndexConfig(tmax=64))
    stored, timing = str(tmp_path / "s.sketches"), str(tmp_path / "timing")
    text, _, _ = entries.make_layout(spark, config, set(), stored, timing)
    again, _, warnings = entries.make_layout(spark, RunConfig(data_file=stored, index=IndexConfig(tmax=64)), set())
    assert Layout.from_text(again) == Layout.from_text(text) and warnings == []
    assert any(len(p) == 1 for _, p, *_ in Layout.from_text(text).user_bins)
    spent = [float(x) for x in open(timing).read().splitlines()[1].split()]
    assert len(spent) == 4 and spent[2] > 0 and spent[3] >= 0
    bins = spark.createDataFrame([(0, [str(tmp_path / "x.fa.gz")])], "ub_id long, files array<string>")
    entries.write_sketches(entries.sketch(spark.createDataFrame([(0, 1)], "ub_id long, h long"), 12), bins, RunConfig(), str(tmp_path / "bare.sketch"))
    assert entries.read_registers(spark, str(tmp_path / "bare.sketch")) is None
    assert entries.write_single_sketches(spark, entries.sketch(spark.createDataFrame([(0, 1)], "ub_id long, h long"), 12), bins, str(tmp_path)) == [f"{tmp_path}/x.hll"]


def test_any_fault_is_one_line(spark, tmp_path, capsys):
    assert cli.run(["stats", "general", "--input", str(tmp_path / "none"), "--output", str(tmp_path / "out")], spark) == -1
    assert capsys.readouterr().err.startswith("[ERROR] ")
