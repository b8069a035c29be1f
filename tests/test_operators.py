"""Joins, bottom-k sketches, sparse registers, file sources and table functions against plain versions."""

import hashlib
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom import catalog_engine
from sketchloom.config import IndexConfig
from sketchloom.functions import hll, kmers, minhash, udtf
from sketchloom.operators import joins, report, statistics
from sketchloom.plans import entries
from sketchloom.sources import datasource
from sketchloom.sources import files as src


# ------------------------------------------------------------------ joins
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("grouped", [False, True])
def test_asof(spark, forward, grouped):
    rng = random.Random(5)
    left = [(i, rng.choice([None, 0, 1, 1, 1]), rng.choice([None, rng.randrange(60) / 2])) for i in range(300)]
    right = [(rng.choice([None, 0, 1, 2]), rng.choice([None, rng.randrange(70) / 2]), rng.choice([None, *range(9)])) for _ in range(40)]
    a = spark.createDataFrame(left, "id long, g long, x double").withColumnRenamed("id", "a.id")
    b = spark.createDataFrame(right, "g long, y double, v long")
    want = []
    for i, g, x in left:
        ok = [(y, v) for h, y, v in right if y is not None and x is not None and (not grouped or (g is not None and h == g)) and (y >= x if forward else y <= x)]
        # Of equal keys the greatest value counts.
        best = max(ok, key=lambda r: (-r[0] if forward else r[0], (r[1] is not None, r[1] or 0))) if ok else (None, None)
        want.append((i, g, x, *best))
    for pieces in (1, 4, 64):
        got = joins.asof(a, b, "x", "y", ["y", "v"], ["g"] if grouped else [], forward, pieces)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert joins.asof(a.limit(0), b, "x", "y", ["y"]).count() == 0
    assert joins.asof(a, b.limit(0), "x", "y", ["v"]).where("v IS NULL").count() == 300


def test_in_intervals(spark):
    rng = random.Random(6)
    points = [(i, rng.randrange(-40, 300)) for i in range(200)]
    spans = [(k, a, a + rng.randrange(0, 120)) for k, a in enumerate(rng.randrange(-50, 250) for _ in range(40))]
    p, s = spark.createDataFrame(points, "id long, x long"), spark.createDataFrame(spans, "k long, low long, high long")
    want = sorted((i, k) for i, x in points for k, a, b in spans if a < x <= b)
    for width in (1, 7, 64, 1000):
        assert sorted(map(tuple, joins.in_intervals(p, s, "x", "low", "high", width).select("id", "k").collect())) == want


# ------------------------------------------------------------------ sketches
def h60(x):
    return int(hashlib.md5(str(x).encode()).hexdigest()[:15], 16)


def test_bottom_k(spark):
    rng = random.Random(7)
    sets = {u: [rng.randrange(400) for _ in range(n)] for u, n in enumerate([0, 1, 39, 40, 41, 300, 900])}
    el = spark.createDataFrame([(u, x) for u, xs in sets.items() for x in xs], "ub_id long, h long").repartition(5)
    got = {r.ub_id: r.minhashes for r in minhash.bottom(el).collect()}
    assert got == {u: sorted({h60(x) for x in xs})[:40] for u, xs in sets.items() if xs}
    parts = minhash.bottom(el).withColumn("tb", F.col("ub_id") % 2)
    merged = {r.tb: r.minhashes for r in minhash.merge(parts, "tb").collect()}
    assert merged == {t: sorted({h60(x) for u, xs in sets.items() if u % 2 == t for x in xs})[:40] for t in (0, 1)}
    pair = spark.createDataFrame([(got[5], got[6])], "a array<long>, b array<long>").select(minhash.similarity("a", "b").alias("s")).first().s
    least = sorted({h60(x) for x in sets[5]} | {h60(x) for x in sets[6]})[:40]
    assert pair == sum(m in got[5] and m in got[6] for m in least) / 40


def test_sparse_registers(spark):
    el = spark.range(30_000).select((F.col("id") % 2).alias("ub_id"), (F.col("id") % 9000).alias("h"))
    for bits in (4, 12, 22, 32):
        got = {r.ub_id: r.estimate for r in hll.estimates(hll.sparse(el, bits), bits=bits).collect()}
        assert all(abs(e - 4500) < max(5 * 1.04 / 2 ** (bits / 2) * 4500, 3) for e in got.values())
    with pytest.raises(ValueError):
        hll.sparse(el, 33)
    wide = entries.sketch(el, 24).collect()
    assert all(abs(r.kmer_count - 4500) <= 3 for r in wide)


def test_copies_are_sketched_once(spark, monkeypatch):
    """The registers of a set are made once, whatever the number of user bins that have it."""
    seen, plain = [], entries.packed_registers
    monkeypatch.setattr(entries, "packed_registers", lambda el: seen.append(el.select("ub_id").distinct().count()) or plain(el))
    rows = catalog_engine.rearranged_copies(spark, "/root/testdata/sf0.001").collect()
    assert seen == [12] and sorted(rows) == [(i, 8, True) for i in range(12)]


def test_reports_deal_elements(spark, monkeypatch):
    """More elements make more tasks, not larger ones, and no hash is in two of them."""
    monkeypatch.setattr(report, "SHARE", 100)
    el = spark.range(3000).select((F.col("id") % 3).alias("ub_id"), (F.col("id") % 500).alias("h"))
    rows = report.dealt(el).select("h", F.spark_partition_id().alias("p")).groupBy("h").agg(F.count_distinct("p").alias("n"), F.max("p").alias("p")).collect()
    assert report.dealt(el).rdd.getNumPartitions() == 31 and {r.n for r in rows} == {1} and len({r.p for r in rows}) > 20


# ------------------------------------------------------------------ files
def test_hash_files_in_ranges(spark, tmp_path):
    """A file of any size is read by many tasks, each its own bytes."""
    rng = np.random.default_rng(3)
    values = {}
    for name, n in (("a", 0), ("b", 1), ("c", 100_003), ("d", 5000)):
        values[name] = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        (tmp_path / name).write_bytes(values[name].astype("<i8").tobytes() + b"tail"[: n % 5])
    paths = [str(tmp_path / n) for n in values]
    df = datasource.read_hashes(spark, paths, 80_001)
    assert df.rdd.getNumPartitions() >= 11
    found = {}
    for r in df.collect():
        found.setdefault(os.path.basename(r.path), []).append(r.h)
    assert {n: sorted(v) for n, v in found.items()} == {n: sorted(v.tolist()) for n, v in values.items() if len(v)}
    assert datasource.read_hashes(spark, []).count() == 0


def test_numbered_hash_files(spark, tmp_path):
    """Rows carry the file's place in the list; a file of two user bins is in both, once each."""
    for name, n in (("a", 3), ("b", 0), ("c", 40)):
        (tmp_path / f"{name}.minimiser").write_bytes(np.arange(n, dtype="<i8").tobytes())
    paths = [str(tmp_path / f"{n}.minimiser") for n in "cab"]
    assert sorted(datasource.read_hashes(spark, paths, 80, numbered=True).collect()) == [(0, h) for h in range(40)] + [(1, h) for h in range(3)]
    bins = spark.createDataFrame([(7, [paths[0]]), (8, [paths[1], paths[2]]), (9, [paths[0], paths[1]])], "ub_id long, files array<string>")
    found = src.precomputed(spark, bins)
    assert sorted(found.collect()) == sorted([(7, h) for h in range(40)] + [(8, h) for h in range(3)] + [(9, h) for n in (40, 3) for h in range(n)])
    assert "regexp_replace" not in found._jdf.queryExecution().toString()


def test_a_folder_is_listed_at_once(spark, tmp_path, monkeypatch):
    """As many calls to the JVM for 400 files of a folder as for 4."""
    sent = []
    client, send = spark._jvm._gateway_client, spark._jvm._gateway_client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: sent.append(1) or send(*a, **k))
    for n in (4, 400):
        folder = tmp_path / f"of {n}"
        folder.mkdir()
        names = [str(folder / f"{i}, {i}.minimiser") for i in range(n)]
        for name in names:
            open(name, "w").close()
        sent.clear()
        lost = [f"{folder}/none", f"file:{folder}/0", str(tmp_path / "nowhere" / "x")]
        assert src.missing(spark, [*names, f"file:{names[0]}", *lost]) == sorted(lost)
        assert len(sent) < 100


def test_many_small_ranges(tmp_path):
    """Ranges of 80 bytes of forty files: a bounded number of partitions, every value once, in order."""
    for i in range(40):
        (tmp_path / str(i)).write_bytes(np.arange(i * 1000, i * 1000 + 1000, dtype="<i8").tobytes())
    reader = datasource.HashReader({"paths": json.dumps([str(tmp_path / str(i)) for i in range(40)]), "range_bytes": "80"})
    parts = reader.partitions()
    assert 200 <= len(parts) <= datasource.MOST_PARTITIONS
    assert [h for p in parts for b in reader.read(p) for h in b.column("h").to_pylist()] == list(range(40_000))
    assert all(r.last - r.first == 80 for p in parts for r in p.ranges)


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Sparse on disk: three ranges of it are read, none of them whole."""
    path = tmp_path / "big"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
        f.seek(2 << 30)
        f.write((12345).to_bytes(8, "little"))
    reader = datasource.HashReader({"paths": f'["{path}"]'})
    parts = reader.partitions()
    assert len(parts) == 48 and parts[-1].last == 3 << 30
    first = next(reader.read(parts[32]))
    assert parts[32].first == 2 << 30 and first.num_rows == datasource.BATCH_VALUES and first.column("h")[0].as_py() == 12345


def test_written_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"{u}.minimiser", rng.randrange(-(2**62), 2**62)) for u in range(20) for _ in range(u * 30)]
    datasource.write_files(spark.createDataFrame(rows, "file string, h long").repartition(7), str(tmp_path / "out"))
    got = {n: np.fromfile(tmp_path / "out" / n, "<i8").tolist() for n in os.listdir(tmp_path / "out")}
    want = {}
    for n, h in rows:
        want.setdefault(n, []).append(h)
    assert got == {n: sorted(v) for n, v in want.items()}
    datasource.write_files(spark.createDataFrame([("one", h % 10) for h in range(99)] + [("two", 3)], "file string, h long").repartition(7), str(tmp_path / "sets"), distinct=True)
    assert [np.fromfile(tmp_path / "sets" / n, "<i8").tolist() for n in ("one", "two")] == [list(range(10)), [3]]
    blobs = [(f"{i}.hll", bytes([i]) * i) for i in range(1, 9)]
    datasource.write_files(spark.createDataFrame(blobs, "file string, content binary"), f"file:{tmp_path}/blobs")
    assert {n: (tmp_path / "blobs" / n).read_bytes() for n in os.listdir(tmp_path / "blobs")} == dict(blobs)


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A task that fails, and a file whose rows come from two tasks."""
    bad = spark.range(100).select((F.col("id") % 5).cast("string").alias("file"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("h"))
    with pytest.raises(Exception):
        datasource.write_files(bad, str(tmp_path / "x"))
    datasource.register(spark)
    torn = spark.createDataFrame([("one", 1), ("one", 2)], "file string, h long").repartition(2)
    with pytest.raises(Exception):
        torn.write.format("userbinfiles").mode("append").save(str(tmp_path / "y"))
    for folder in ("x", "y"):
        assert not os.path.isdir(tmp_path / folder) or not os.listdir(tmp_path / folder)


def test_unknown_stores(spark):
    assert datasource.reachable(["/a", "file:/b", "file:///c", "rel/d"]) and not datasource.reachable(["/a", "nowhere9://x/y"])


# ------------------------------------------------------------------ table functions
def test_table_functions(spark):
    udtf.register(spark)
    got = spark.sql("SELECT h FROM user_bin_elements('acgtNacgta', 4, 4)").collect()
    from sketchloom.functions import kmers

    want = kmers.elements(spark.createDataFrame([(0, "acgtNacgta")], "ub_id long, seq string"), 4).select("h").distinct().collect()
    assert sorted(got) == sorted(want)
    assert spark.sql("SELECT h FROM user_bin_elements(CAST(NULL AS STRING), 4, 4)").count() == 0
    for call in ("user_bin_elements(1, 4, 4)", "user_bin_elements('a', 5, 4)", "user_bin_elements('a', 33, 40)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {call}").collect()
    udtf.register_source(spark, "own_elements", lambda ub: range(ub * 10, ub * 10 + 3))
    rows = spark.sql("SELECT u.id, e.h FROM range(3) u, LATERAL own_elements(u.id) e").collect()
    assert sorted(map(tuple, rows)) == [(u, u * 10 + i) for u in range(3) for i in range(3)]


# ------------------------------------------------------------------ penalties
def test_kmers_of_documents_are_not_shuffled(spark, tmp_path):
    """Rows of one document count together, and nothing spans two of them."""
    rows = [(1, "acgtacgtacgtacgtacgt"), (1, "ttttttttttttttttttttt"), (1, "acgtacgtacgtacgtacgt"), (2, "acgtacgtacgta"), (2, "cgtacgt"), (3, None), (None, "gggggggggggggggg")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog_engine.table_function(spark, str(tmp_path))
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, h#", got._jdf.queryExecution().executedPlan().toString())
    each = kmers.elements(catalog_engine.dna(spark, str(tmp_path)), 15, key="doc_id")
    want = each.groupBy("doc_id").agg(F.count_distinct("h").alias("n"), F.min("h").alias("least")).collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str) and len(want) == 2


def test_penalties_in_blocks(spark, monkeypatch):
    """All pairs, however they are dealt; from Spark's sketches and from registers."""
    n = 23
    el = spark.range(n * 300).select((F.col("id") % n).alias("ub_id"), (F.floor(F.col("id") / n) + F.pmod("id", F.lit(n)) * 40).alias("h"))
    counts = el.groupBy("ub_id").agg(F.count_distinct("h").alias("kmer_count"))
    layout = spark.createDataFrame([(i, i, [i // 2], i % 2, 1) for i in range(n)], "ord long, ub_id long, prev_tbs array<long>, storage_tb long, num_tbs long")
    cfg = IndexConfig(tmax=64)
    found = []
    for block in (64, 3):
        monkeypatch.setattr(statistics, "PAIR_BLOCK", block)
        for registers in (False, True):
            card = statistics.cardinalities(statistics.bins(layout), counts, cfg, None if registers else hll.native(el), hll.registers(el) if registers else None)
            found.append({r.child[0]: r.pen for r in statistics.penalties(card, cfg, registers).collect()})
    sets = [set(range(u * 40, u * 40 + 300)) for u in range(n)]
    bins = [sets[2 * t] | (sets[2 * t + 1] if 2 * t + 1 < n else set()) for t in range((n + 1) // 2)]
    exact = {i: sum(len(a & b) / len(a | b) for b in bins[i + 1 :]) for i, a in enumerate(bins)}
    assert found[0].keys() == exact.keys()
    for one, other in ((0, 2), (1, 3)):
        assert all(abs(found[one][k] - found[other][k]) < 1e-9 for k in exact)
    assert all(abs(f[k] - exact[k]) < 0.25 for f in found for k in exact)


def test_tree_walk(spark):
    rng = random.Random(1)
    nodes = {(): 1.5}
    for _ in range(300):
        p = rng.choice(list(nodes))
        if len(p) < 7:
            nodes[(*p, rng.randrange(9))] = rng.random()
    df = spark.createDataFrame([(list(p), v) for p, v in nodes.items()], "path array<long>, own double")
    got = {tuple(r.path): r.total for r in statistics.walk_down(df).collect()}
    assert got.keys() == nodes.keys()
    assert all(abs(got[p] - sum(nodes[p[:d]] for d in range(len(p) + 1))) < 1e-9 for p in nodes)
