"""Queries over the driver's tables for the engine's own operators, with their SQL.

User bins are suppliers with their part keys (or ``l_partkey % 12`` with order keys where a small
fixed layout is laid over them); k-mers come from the letters a, c, g, t of ``documents.text``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.config import IndexConfig
from sketchloom.functions import bloom, hll, kmers
from sketchloom.operators import binning, report, statistics
from sketchloom.plans import entries
from sketchloom.sources.layouts import Layout
from sketchloom.sources.tables import table

CFG = IndexConfig(tmax=64, disable_estimate_union=True)
LAYOUT = Layout(
    [(0, (0,), 0, 2), (1, (0,), 2, 1), (2, (0,), 3, 1), (3, (1,), 0, 1), (4, (1,), 1, 3), (5, (1, 4), 0, 1), (6, (1, 4), 1, 2), (7, (), 2, 1), (8, (), 3, 2), (9, (), 5, 1), (10, (), 6, 1), (11, (), 7, 2)],
    {(): 0, (0,): 0, (1,): 4, (1, 4): 0},
)
K, W = 15, 19
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def suppliers(spark: SparkSession, sf_dir: str, modulus: int = 0) -> DataFrame:
    ub, h = (F.pmod("l_partkey", F.lit(modulus)), "l_orderkey") if modulus else (F.col("l_suppkey"), "l_partkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(ub.cast("long").alias("ub_id"), F.col(h).alias("h"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "doc_id", F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("seq"))


def exact_counts(el: DataFrame) -> DataFrame:
    return el.groupBy("ub_id").agg(F.count_distinct("h").alias("kmer_count"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and estimated distinct counts of every user bin."""
    el = suppliers(spark, sf_dir)
    return el.groupBy("ub_id").agg(F.count_distinct("h").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("h", 12)).alias("estimated"))


SUP = "SELECT DISTINCT l_suppkey AS ub_id, l_partkey AS h FROM lineitem"
BIN = "SELECT DISTINCT l_partkey % 12 AS ub_id, l_orderkey AS h FROM lineitem"
DNA = "SELECT lang, doc_id, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS s FROM documents"
POS = f"SELECT lang, doc_id, s, i, substr(s, i, {K}) AS f FROM (SELECT lang, doc_id, s, CAST(unnest(range(1, length(s) - {K} + 2)) AS INT) AS i FROM ({DNA}) WHERE length(s) >= {K})"
NUM = "list_sum(list_transform(range(0, 15), lambda j: CAST(substr(translate({x}, 'ACGT', '0123'), CAST(j + 1 AS INT), 1) AS BIGINT) * CAST(4 ** (14 - j) AS BIGINT)))"
SEED = kmers.signed(kmers.adjusted_seed(K))
DISTINCT_K = f"SELECT f, CAST(least(xor(CAST({NUM.format(x='f')} AS BIGINT), {SEED}), xor(CAST({NUM.format(x='r')} AS BIGINT), {SEED})) AS BIGINT) AS h FROM (SELECT f, reverse(translate(f, 'ACGT', 'TGCA')) AS r FROM (SELECT DISTINCT f FROM p))"


# ------------------------------------------------------------------ counts
@query("SELECT ub_id, count(*) AS kmer_count FROM (" + SUP + ") GROUP BY ub_id")
def exact_ub_counts(spark, sf_dir):
    return exact_counts(suppliers(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM (" + SUP + ")")
def total_count(spark, sf_dir):
    return exact_counts(suppliers(spark, sf_dir)).agg(F.sum("kmer_count").alias("total"))


@query(f"WITH p AS ({POS}) SELECT lang, count(DISTINCT f) AS n FROM p GROUP BY lang")
def kmer_set_sizes(spark, sf_dir):
    return kmers.elements(dna(spark, sf_dir), K, seeded=False, key="lang").groupBy("lang").agg(F.count_distinct("h").alias("n"))


@query(f"WITH p AS ({POS}), k AS ({DISTINCT_K}) SELECT lang, count(DISTINCT h) AS n, min(h) AS least, max(h) AS most FROM p JOIN k USING (f) GROUP BY lang")
def canonical_kmers(spark, sf_dir):
    return kmers.elements(dna(spark, sf_dir), K, key="lang").groupBy("lang").agg(F.count_distinct("h").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))


@query(f"""WITH p AS ({POS}), k AS ({DISTINCT_K}),
m AS (SELECT lang, length(s) AS n, i, min(h) OVER (PARTITION BY lang, doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - K} FOLLOWING) AS h FROM p JOIN k USING (f))
SELECT lang, count(DISTINCT h) AS n, min(h) AS least, max(h) AS most FROM m WHERE i <= n - {W} + 1 GROUP BY lang""")
def minimisers(spark, sf_dir):
    return kmers.elements(dna(spark, sf_dir), K, W, key="lang").groupBy("lang").agg(F.count_distinct("h").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))


# ------------------------------------------------------------------ unions, intersections, similarity
@query(f"SELECT ub_id % 8 AS tb, count(DISTINCT h) AS n FROM ({SUP}) GROUP BY 1")
def merged_union_exact(spark, sf_dir):
    return suppliers(spark, sf_dir).groupBy(F.pmod("ub_id", F.lit(8)).alias("tb")).agg(F.count_distinct("h").alias("n"))


@query(f"""WITH e AS (SELECT ub_id, ub_id % 4 AS tb, h FROM ({BIN})), u AS (SELECT tb, count(DISTINCT ub_id) AS m FROM e GROUP BY tb),
x AS (SELECT tb, h, count(*) AS c FROM e GROUP BY tb, h) SELECT u.tb, count(*) FILTER (WHERE c = m) AS shared FROM x JOIN u USING (tb) GROUP BY u.tb""")
def shared_elements(spark, sf_dir):
    e = suppliers(spark, sf_dir, 12).withColumn("tb", F.pmod("ub_id", F.lit(4)))
    m = e.groupBy("tb").agg(F.count_distinct("ub_id").alias("m"))
    each = e.groupBy("tb", "h").agg(F.count_distinct("ub_id").alias("c"))
    return each.join(m, "tb").groupBy("tb").agg(F.count(F.when(F.col("c") == F.col("m"), 1)).alias("shared"))


@query(f"""WITH e AS ({BIN}), n AS (SELECT ub_id, count(*) AS n FROM e GROUP BY ub_id),
c AS (SELECT a.ub_id AS i, b.ub_id AS j, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.ub_id < b.ub_id AND a.ub_id % 4 = b.ub_id % 4 GROUP BY 1, 2)
SELECT x.ub_id AS i, y.ub_id AS j, round(greatest(0, least(1, 2 - (x.n + y.n) / (x.n + y.n - coalesce(c.c, 0))::DOUBLE)), 6) AS distance
FROM n x JOIN n y ON x.ub_id < y.ub_id AND x.ub_id % 4 = y.ub_id % 4 LEFT JOIN c ON c.i = x.ub_id AND c.j = y.ub_id""")
def jaccard_pairs(spark, sf_dir):
    e = suppliers(spark, sf_dir, 12).distinct()
    n = exact_counts(e)
    a, b = n.select(F.col("ub_id").alias("i"), F.col("kmer_count").alias("ni")), n.select(F.col("ub_id").alias("j"), F.col("kmer_count").alias("nj"))
    both = lambda: (F.col("i") < F.col("j")) & (F.pmod("i", F.lit(4)) == F.pmod("j", F.lit(4)))
    common = e.select(F.col("ub_id").alias("i"), "h").join(e.select(F.col("ub_id").alias("j"), "h"), "h").where(both()).groupBy("i", "j").agg(F.count("*").alias("c"))
    pairs = a.withColumn("g", F.pmod("i", F.lit(4))).join(b.withColumn("g", F.pmod("j", F.lit(4))), "g").where("i < j").join(common, ["i", "j"], "left").fillna(0, ["c"])
    return pairs.select("i", "j", F.round(bloom.jaccard_distance(F.col("ni"), F.col("nj"), F.col("ni") + F.col("nj") - F.col("c")), 6).alias("distance"))


# ------------------------------------------------------------------ sketches
REGS = """SELECT ub_id, CAST(('0x' || substr(md5(CAST(h AS VARCHAR)), 1, 3)) AS INT) AS reg,
CAST(max(CASE WHEN CAST(('0x' || substr(md5(CAST(h AS VARCHAR)), 4, 13)) AS BIGINT) = 0 THEN 53 ELSE 53 - length(bin(CAST(('0x' || substr(md5(CAST(h AS VARCHAR)), 4, 13)) AS BIGINT))) END) AS INT) AS rank
FROM ({e}) GROUP BY 1, 2"""
EST = "SELECT {key}, CASE WHEN raw <= 10240 AND used < 4096 THEN 4096 * ln(4096.0 / (4096 - used)) ELSE raw END AS estimate FROM (SELECT {key}, count(*) AS used, 0.7213 / (1 + 1.079 / 4096) * 4096.0 * 4096.0 / (sum(pow(2.0, -rank)) + 4096 - count(*)) AS raw FROM ({r}) GROUP BY {key})"


@query(REGS.format(e=SUP))
def hll_registers(spark, sf_dir):
    return hll.registers(suppliers(spark, sf_dir))


@query(f"SELECT ub_id % 8 AS tb, reg, max(rank) AS rank FROM ({REGS.format(e=SUP)}) GROUP BY 1, 2")
def hll_merge(spark, sf_dir):
    return hll.merge(hll.registers(suppliers(spark, sf_dir)).withColumn("tb", F.pmod("ub_id", F.lit(8))), "tb")


@query(f"SELECT ub_id, round(estimate, 4) AS estimate FROM ({EST.format(key='ub_id', r=REGS.format(e=SUP))})")
def hll_estimate(spark, sf_dir):
    return hll.estimates(hll.registers(suppliers(spark, sf_dir))).select("ub_id", F.round("estimate", 4).alias("estimate"))


@query(f"""WITH x AS ({EST.format(key='ub_id', r=REGS.format(e=SUP))}), n AS (SELECT ub_id, count(*) AS n FROM ({SUP}) GROUP BY ub_id)
SELECT ub_id, n AS actual_cardinality, round(1.04 / sqrt(4096), 6) AS expected_relative_error, round(abs(1 - estimate / n), 6) AS actual_relative_error FROM x JOIN n USING (ub_id)""")
def sketch_accuracy(spark, sf_dir):
    el = suppliers(spark, sf_dir)
    rows = hll.estimates(hll.registers(el)).join(exact_counts(el), "ub_id")
    return rows.select("ub_id", F.col("kmer_count").alias("actual_cardinality"), F.round(F.lit(1.04) / F.sqrt(F.lit(4096.0)), 6).alias("expected_relative_error"), F.round(F.abs(1 - F.col("estimate") / F.col("kmer_count")), 6).alias("actual_relative_error"))


@query()
def native_sketches(spark, sf_dir):
    return hll.native(suppliers(spark, sf_dir)).select("ub_id", hll.estimate().alias("estimate"))


@query()
def native_sketch_unions(spark, sf_dir):
    parts = hll.native(suppliers(spark, sf_dir)).withColumn("tb", F.pmod("ub_id", F.lit(8)))
    return hll.union(parts, "tb").select("tb", hll.estimate().alias("estimate"))


# ------------------------------------------------------------------ sizes and cost
def _values(rows) -> str:
    return ", ".join(f"({', '.join(str(x) for x in r)})" for r in rows)


COST_ROWS = f"(VALUES {_values((f, 1 << (6 + i), c) for f, row in bloom.COST.items() for i, c in enumerate(row))}) t(fpr, bins, cost)"


COSTS = f"SELECT CAST(fpr AS DOUBLE) AS fpr, CAST(bins AS BIGINT) AS bins, CAST(cost AS DOUBLE) AS cost FROM {COST_ROWS}"


@query(f"""WITH t AS ({COSTS}), g AS (SELECT CAST(64 * 2 ** (l_partkey % 11) AS BIGINT) AS bins, l_discount AS fpr, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT g.bins, g.fpr, g.n, t.cost FROM g JOIN t ON t.bins = g.bins AND t.fpr = (SELECT min(x.fpr) FROM t x WHERE x.fpr >= g.fpr)""")
def query_cost_exact(spark, sf_dir):
    """Cost at powers of two, at the tabulated rate next above a discount."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy((F.lit(64) * F.pow(F.lit(2), F.col("l_partkey") % 11)).cast("long").alias("bins"), F.col("l_discount").alias("fpr")).agg(F.count("*").alias("n"))
    return g.select("bins", "fpr", "n", bloom.query_cost(F.col("bins"), F.col("fpr")).alias("cost"))


#: Every line item as a filter: up to 65536 bins, and a rate within the table or above it.
GRID = "SELECT l_orderkey, l_linenumber, 1 + (l_orderkey * 7919 + l_partkey * 31) % 65536 AS bins, l_discount * 4 AS fpr FROM lineitem"
INTERPOLATED = f"""WITH t AS ({COSTS}), g AS (SELECT *, coalesce((SELECT min(t.fpr) FROM t WHERE t.fpr >= x.fpr), 0.3125) AS f FROM ({GRID}) x)
SELECT l_orderkey, l_linenumber, g.bins, CAST(floor((CASE WHEN g.bins <= 64 THEN lo.cost ELSE lo.cost + (hi.cost - lo.cost) * (g.bins - lo.bins) / lo.bins END) * 1000000 + 0.3) AS BIGINT) AS cost_micro
FROM g JOIN t lo ON lo.fpr = g.f JOIN t hi ON hi.fpr = g.f
WHERE (g.bins <= 64 AND lo.bins = 64 AND hi.bins = 64) OR (g.bins > 64 AND lo.bins < g.bins AND g.bins <= hi.bins AND hi.bins = 2 * lo.bins)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", (1 + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % 65536).alias("bins"), (F.col("l_discount") * 4).alias("fpr"))


@query(INTERPOLATED)
def query_cost_interpolated(spark, sf_dir):
    return grid(spark, sf_dir).select("l_orderkey", "l_linenumber", "bins", micro(bloom.query_cost(F.col("bins"), F.col("fpr"))))


def micro(cost: F.Column) -> F.Column:
    """Millionths; costs are fractions of powers of two, so none lies where the floor changes."""
    return F.floor(cost * 1000000 + 0.3).cast("long").alias("cost_micro")


def fill(p) -> str:
    return f"ln(1 - exp(ln({p}) / 2))"


BITS = "CAST(ceil(-(2 * {n}) / " + fill(0.05) + ") AS BIGINT)"
CORR = "(CASE WHEN {s} = 1 THEN 1.0 ELSE " + fill(0.05) + " / " + "ln(1 - exp(ln(1 - exp(ln(1 - 0.05) / {s})) / 2))" + " END)"
RELAXED = f"({fill(0.05)} / {fill(0.3)})"


@query(f"SELECT ub_id, n, {BITS.format(n='n')} AS bits FROM (SELECT ub_id, count(*) AS n FROM ({SUP}) GROUP BY ub_id)")
def bloom_bits(spark, sf_dir):
    return exact_counts(suppliers(spark, sf_dir)).select("ub_id", F.col("kmer_count").alias("n"), bloom.bits(F.col("kmer_count"), 0.05, 2).alias("bits"))


@query(f"SELECT s, count(*) AS n, round({CORR.format(s='s')}, 9) AS factor, round({RELAXED}, 9) AS merged FROM (SELECT l_partkey % 128 + 1 AS s FROM lineitem) GROUP BY s")
def fpr_correction(spark, sf_dir):
    """Growth of the bins that line items of a part are split over."""
    s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_partkey") % 128 + 1).alias("s")).agg(F.count("*").alias("n"))
    return s.select("s", "n", F.round(bloom.split_correction(F.col("s"), 0.05, 2), 9).alias("factor"), F.lit(round(bloom.merged_factor(0.05, 0.3, 2), 9)).alias("merged"))


@query("SELECT o_orderkey, ((o_orderkey + 63) // 64) * 64 AS up, (o_orderkey + 6) // 7 AS sevenths FROM orders")
def rounding(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", bloom.multiple_of_64(F.col("o_orderkey")).alias("up"), bloom.ceil_div(F.col("o_orderkey"), F.lit(7)).alias("sevenths"))


def _size_sql(v: str) -> str:
    out = f"WHEN {v} < 1024 THEN {v} || 'Bytes'"
    for i in range(1, 7):
        u, one, prev = bloom.UNITS[i], 1 << (10 * i), 1 << (10 * (i - 1))
        tenth = f"((({v} % {one}) // {prev}) * 1000 // 1024 + 50) // 100"
        whole = f"({v} // {one} + CASE WHEN {tenth} = 10 THEN 1 ELSE 0 END)"
        top = "" if i == 6 else f" AND {v} < {1 << (10 * (i + 1))}"
        out += f" WHEN {v} >= {one}{top} THEN CASE WHEN {whole} = 1024 THEN '1.0{bloom.UNITS[min(i + 1, 6)]}' ELSE {whole} || '.' || ({tenth}) % 10 || '{u}' END"
    return f"CASE {out} END"


@query(f"SELECT o_orderkey, {_size_sql('b')} AS size FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * (o_custkey % 97 + 1) AS b FROM orders)")
def formatted_size(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", bloom.size_text(F.col("o_orderkey") * F.col("o_orderkey") * (F.col("o_custkey") % 97 + 1)).alias("size"))


# ------------------------------------------------------------------ a fixed layout
ROWS = [(i, u, "".join(f"{x};" for x in p), t, n) for i, (u, p, t, n) in enumerate(LAYOUT.user_bins)]
LAY = f"(VALUES {', '.join(f"({i}, {u}, '{p}', {t}, {n})" for i, u, p, t, n in ROWS)}) l(ord, ub_id, path, tb, span)"
MAX = f"(VALUES {', '.join(f"('{''.join(f'{x};' for x in p)}', {m})" for p, m in LAYOUT.max_bins.items())}) m(path, max_tb)"
#: Every user bin in its own filter and in each filter above (where it is part of merged bin ``tb``).
UP = f"""SELECT ub_id, ord, path, tb, span, 'split' AS kind FROM {LAY} UNION ALL
SELECT ub_id, ord, array_to_string(list_slice(string_split(path, ';'), 1, d), ';') || CASE WHEN d > 0 THEN ';' ELSE '' END, CAST(string_split(path, ';')[d + 1] AS INT), 1, 'merged'
FROM (SELECT *, unnest(range(0, len(string_split(path, ';')) - 1)) AS d FROM {LAY})"""
BINS = f"SELECT path, tb, kind, max(span) AS span, min(ord) AS ord, count(*) AS ubs FROM ({UP}) GROUP BY path, tb, kind"
CARD = f"""WITH e AS ({BIN}), n AS (SELECT ub_id, count(*) AS n FROM e GROUP BY ub_id), up AS ({UP}),
bins AS (SELECT path, tb, kind, CAST(max(span) AS BIGINT) AS span, CAST(min(ord) AS BIGINT) AS ord, count(*) AS ubs, CAST(sum(n) AS BIGINT) AS card FROM up JOIN n USING (ub_id) GROUP BY path, tb, kind)"""
SIZES = CARD + f""", b2 AS (SELECT *, CASE WHEN kind = 'merged' THEN card ELSE (card + span - 1) // span END AS plain FROM bins),
b3 AS (SELECT *, CAST(CASE WHEN kind = 'merged' THEN ceil(card * {RELAXED}) ELSE ceil(plain * {CORR.format(s='span')}) END AS BIGINT) AS fixed FROM b2),
f AS (SELECT path, CAST(len(string_split(path, ';')) - 1 AS INT) AS level, CAST(sum(span) AS BIGINT) AS num_tbs, max(fixed) * sum(span) AS mem, max(plain) * sum(span) AS mem_plain,
 CAST(sum(CASE WHEN kind = 'split' THEN span ELSE 0 END) AS BIGINT) AS split_tbs, CAST(sum(CASE WHEN kind = 'split' THEN 1 ELSE 0 END) AS BIGINT) AS split_ubs, max(CASE WHEN kind = 'split' THEN span ELSE 0 END) AS max_span,
 CAST(sum(CASE WHEN kind = 'split' THEN plain * span ELSE 0 END) AS BIGINT) AS split_kmers, CAST(sum(CASE WHEN kind = 'split' THEN fixed * span ELSE 0 END) AS BIGINT) AS split_fixed,
 CAST(sum(CASE WHEN kind = 'split' THEN card ELSE 0 END) AS BIGINT) AS own_kmers FROM b3 GROUP BY path)"""


def path_text(c: str) -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: F.concat(x.cast("string"), F.lit(";"))), "").alias("path")


def fixed(spark: SparkSession, sf_dir: str):
    lay, tops = LAYOUT.frames(spark)
    el = suppliers(spark, sf_dir, 12)
    return lay, tops, el, statistics.cardinalities(statistics.bins(lay), exact_counts(el), CFG)


@query(CARD + " SELECT path, tb, kind, span, ord, ubs, card FROM bins")
def layout_bins(spark, sf_dir):
    card = fixed(spark, sf_dir)[3]
    return card.select(path_text("ibf_path"), F.col("tb").cast("int").alias("tb"), "kind", "span", "ord", F.size("ubs").cast("long").alias("ubs"), "card")


@query(SIZES + " SELECT path, level, num_tbs, CAST(mem AS BIGINT) AS mem, CAST(mem_plain AS BIGINT) AS mem_plain, split_tbs, split_ubs, max_span, split_kmers, split_fixed FROM f")
def layout_filters(spark, sf_dir):
    return statistics.filters(fixed(spark, sf_dir)[3], CFG).select(path_text("ibf_path"), "level", "num_tbs", "mem", "mem_plain", "split_tbs", "split_ubs", "max_span", "split_kmers", "split_fixed")


@query(SIZES + f""" SELECT level, count(*) AS num_ibfs, {BITS.format(n='sum(mem)')} // 8 AS bytes, {BITS.format(n='sum(mem_plain)')} // 8 AS bytes_plain, CAST(sum(num_tbs) AS BIGINT) AS num_tbs,
CAST(sum(num_tbs) // count(*) AS BIGINT) AS avg_num_tbs, round(100.0 * sum(split_tbs) / sum(num_tbs), 6) AS split_percentage, nullif(max(max_span), 0) AS max_span, round(sum(split_tbs) / nullif(sum(split_ubs), 0), 6) AS avg_span,
round({CORR.format(s='nullif(max(max_span), 0)')}, 6) AS max_factor, round(sum(split_fixed) / nullif(sum(split_kmers), 0), 6) AS avg_factor FROM f GROUP BY level""")
def layout_levels(spark, sf_dir):
    lv = statistics.levels(statistics.filters(fixed(spark, sf_dir)[3], CFG), CFG)
    return lv.select("level", "num_ibfs", "bytes", "bytes_plain", "num_tbs", "avg_num_tbs", *[F.round(c, 6).alias(c) for c in ("split_percentage",)], "max_span", *[F.round(c, 6).alias(c) for c in ("avg_span", "max_factor", "avg_factor")])


@query(SIZES + """ SELECT path, round(CAST(level + 1 AS DOUBLE), 6) AS cost, own_kmers FROM f""")
def layout_query_cost(spark, sf_dir):
    """All filters here have at most 64 bins, so each step of a path costs 1."""
    card = fixed(spark, sf_dir)[3]
    got = statistics.costs(statistics.filters(card, CFG), statistics.penalties(card, CFG), CFG)
    return got.select(path_text("ibf_path"), F.round("cost", 6).alias("cost"), "own_kmers")


REPORT = f"""WITH e AS ({BIN}), top AS (SELECT ub_id, CASE WHEN path = '' THEN tb ELSE CAST(string_split(path, ';')[1] AS INT) END AS tb, path <> '' AS merged, span FROM {LAY}),
shape AS (SELECT tb, count(*) AS ub_count, bool_or(merged) AS merged, CASE WHEN bool_or(merged) THEN 1 ELSE max(span) END AS splits FROM top GROUP BY tb),
x AS (SELECT tb, h, count(DISTINCT ub_id) AS c FROM e JOIN top USING (ub_id) GROUP BY tb, h),
r AS (SELECT s.tb, count(*) AS n, count(*) FILTER (WHERE s.merged AND c = ub_count) AS shared_size, any_value(ub_count) AS ub_count, any_value(s.merged) AS merged, CAST(any_value(splits) AS BIGINT) AS splits FROM x JOIN shape s USING (tb) GROUP BY s.tb),
rec AS (SELECT tb, CASE WHEN merged THEN n ELSE (n + splits - 1) // splits END AS exact_size, CAST(CASE WHEN merged THEN ceil(n * {RELAXED}) ELSE ceil(((n + splits - 1) // splits) * {CORR.format(s='splits')}) END AS BIGINT) AS fpr_corrected_size,
 shared_size, ub_count, CASE WHEN merged THEN 'merged' ELSE 'split' END AS kind, splits FROM r)"""


@query(REPORT + " SELECT CAST(tb AS BIGINT) AS tb, exact_size, fpr_corrected_size, shared_size, ub_count, kind, splits FROM rec")
def tb_report(spark, sf_dir):
    lay, _, el, _ = fixed(spark, sf_dir)
    return report.per_bin(lay, el, CFG, shared=True).drop("estimated_size")


@query(REPORT + """, o AS (SELECT *, coalesce(sum(splits) OVER (ORDER BY tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM rec)
SELECT CAST(first + i AS BIGINT) AS tb_index, exact_size, fpr_corrected_size, shared_size, ub_count, kind, CASE WHEN i = 0 THEN splits ELSE 0 END AS splits FROM (SELECT *, unnest(range(0, splits)) AS i FROM o)""")
def tb_report_exploded(spark, sf_dir):
    lay, _, el, _ = fixed(spark, sf_dir)
    return report.exploded(report.per_bin(lay, el, CFG, shared=True)).drop("estimated_size")


TREE = f"""WITH e AS ({BIN}), up AS ({UP}), mx AS (SELECT path, max_tb FROM {MAX}),
b AS (SELECT path, tb, kind, max(span) AS span, count(DISTINCT h) AS n FROM up JOIN e USING (ub_id) GROUP BY path, tb, kind),
t AS (SELECT b.path, max_tb, n AS m, kind AS mk, span AS ms FROM b JOIN mx ON b.path = mx.path AND b.tb = mx.max_tb),
w AS (SELECT b.*, t.max_tb, t.m, t.mk, t.ms, CASE WHEN kind = 'merged' THEN n ELSE n // span + 1 END AS x FROM b JOIN t USING (path)),
s AS (SELECT path, m, mk, ms, sum(span) AS bins, sum(CASE WHEN tb <> max_tb AND m < x THEN span ELSE 0 END) AS too_big, sum(CASE WHEN tb <> max_tb AND m < x THEN (x - m) * span ELSE 0 END) AS too_many,
 sum(CASE WHEN tb <> max_tb AND m >= x THEN (m - x) * span ELSE 0 END) AS waste FROM w GROUP BY path, m, mk, ms),
z AS (SELECT CAST(len(string_split(path, ';')) - 1 AS INT) AS level, path, CAST(bins * CASE WHEN mk = 'merged' THEN CAST(ceil(-(2 * m) / {fill(0.3)}) AS BIGINT) ELSE CAST(ceil({BITS.format(n='((m + ms - 1) // ms)')} * {CORR.format(s='ms')}) AS BIGINT) END AS BIGINT) AS bits,
 m AS max_elements, CAST(too_big AS BIGINT) AS too_big, CAST(too_many AS BIGINT) AS too_many, (m * bins - waste) / (m * bins)::DOUBLE AS load_factor FROM s)"""


@query(TREE + " SELECT level, path, bits, max_elements, too_big, too_many, round(load_factor, 6) AS load_factor FROM z")
def filter_sizes(spark, sf_dir):
    lay, tops, el, _ = fixed(spark, sf_dir)
    return report.filter_sizes(lay, tops, el, CFG).select("level", path_text("ibf_path"), "bits", "max_elements", "too_big", "too_many", F.round("load_factor", 6).alias("load_factor"))


@query(TREE + """ SELECT level, CAST(sum(bits) AS BIGINT) AS bit_size, count(*) AS ibfs, round(avg(load_factor) * 100, 6) AS avg_load_factor, CAST(sum(too_big) AS BIGINT) AS tbs_too_big,
CAST(sum(too_many) // greatest(sum(too_big), 1) AS BIGINT) AS avg_tbs_too_big_elements, CAST(sum(max_elements) // count(*) AS BIGINT) AS avg_max_elements FROM z GROUP BY level""")
def level_sizes(spark, sf_dir):
    lay, tops, el, _ = fixed(spark, sf_dir)
    rows = report.level_sizes(report.filter_sizes(lay, tops, el, CFG))
    return rows.withColumn("avg_load_factor", F.round("avg_load_factor", 6))


# ------------------------------------------------------------------ search
@query(f"""WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT DISTINCT t_max FROM (SELECT CAST(64 * 2 ** i AS BIGINT) AS t_max FROM (SELECT unnest(range(0, 5)) AS i) UNION ALL SELECT CAST((CAST(ceil(sqrt(n)) AS BIGINT) + 63) // 64 * 64 AS BIGINT) FROM n)""")
def tmax_candidates(spark, sf_dir):
    n = suppliers(spark, sf_dir).select("ub_id").distinct().count()
    return spark.createDataFrame([(t,) for t in binning.candidates(1024, n)], "t_max long")


@query("""WITH c AS (SELECT l_linenumber AS t_max, sum(l_quantity) / count(*) AS cost FROM lineitem GROUP BY 1),
b AS (SELECT *, min(cost) OVER (ORDER BY t_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c),
s AS (SELECT *, coalesce(sum(CASE WHEN cost >= best THEN 1 ELSE 0 END) OVER (ORDER BY t_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM b)
SELECT CAST(t_max AS BIGINT) AS t_max, CAST(cost AS DOUBLE) AS cost FROM s WHERE seen = 0""")
def best_tmax_stop(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tried = li.groupBy(F.col("l_linenumber").cast("long").alias("t_max")).agg((F.sum("l_quantity") / F.count("*")).alias("cost"))
    return statistics.stop_early(tried)


@query()
def layout_dp(spark, sf_dir):
    """The optimiser's rows for two candidates, on exact counts."""
    rows = binning.layouts(exact_counts(suppliers(spark, sf_dir)), [64, 128], CFG)
    return rows.select("run", path_text("ibf_path"), "ub_id", "tb", "span", "merged", "max_tb")


@query()
def layout_dp_unions(spark, sf_dir):
    """The same with union estimates and rearrangement."""
    el = suppliers(spark, sf_dir)
    cfg = IndexConfig(tmax=64)
    rows = binning.layouts(exact_counts(el), [64], cfg, table(entries.packed_registers(el), "registers"))
    return rows.select("run", path_text("ibf_path"), "ub_id", "tb", "span", "merged", "max_tb")


@query()
def best_layout(spark, sf_dir):
    """The whole search: one row for each filter of the best layout."""
    counts = table(exact_counts(suppliers(spark, sf_dir)), "counts")
    lay, best, _ = entries.search(spark, counts, IndexConfig(tmax=256, disable_estimate_union=True).completed(counts.count()))
    return lay.frames(spark)[1].withColumn("t_max", F.lit(best)).select("t_max", path_text("ibf_path"), "max_tb")
