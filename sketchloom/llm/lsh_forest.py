"""MinHash near-dedup by an LSH forest (operator 7).

* Sets are the distinct ``shingle``-word shingles (64-bit hashes); equal sets are one *class*
  from here on, so a thousand copies cost one. A class's node id is its set's hash.
* Each of ``TREES`` sorted orders ranks all classes by ``DEPTH`` minhash labels of its own.
  Classes that share the first ``START`` labels are a region of that order. With similarity s
  two classes share no region with probability ``(1 - s**START) ** TREES`` (3e-6 at s = 0.8).
* Classes without any possible partner leave first: in regions of up to ``region`` members all
  signatures are compared (a pair is possible if sizes allow the similarity and the 144 labels
  do not rule it out, at 4.5 sigma); members of larger regions all stay.
* In each round the orders are sorted anew and every class meets its neighbours by longest
  common prefix that are in another component (the depth that counts so adapts to the region);
  each takes its ``BEST`` most alike ones to the full comparison. Links join components;
  ``ROUNDS`` rounds do, as groups mostly join in the first.
* What the rounds leave open is settled exactly: classes that still have a possible partner in another component are joined by the prefix filter. In
  ascending order of frequency, two sets that are similar enough share one of their first
  tokens, and how many is known from the sizes. A token's largest component is never joined
  with itself, and positions rule out most of the other pairs. A family of texts that are all
  nearly alike enough is compared pair by pair here.
* A link is confirmed on the full sets, by ``percent * union <= 100 * intersection``.
  Components come from min-label propagation with pointer jumping, by joins over written
  tables; later links are added between components only.

Defined results: words are taken after lower-casing A-Z; a text with fewer words than
``shingle`` has one shingle, the whole sequence; a text without words, or null, has an empty
set and is linked with nothing; so is a row without ``doc_id``. Repeated rows have equal sets
and share a component; the smallest ``doc_id`` of a component names it (all rows with that id
are ``kept``). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.llm import common as c

TREES, DEPTH, START = 24, 6, 4
REGION = 32
PERCENT, SHINGLE = 80, 5
ROUNDS, BEST = 2, 3
RATIO = 1.05  # of the size classes of the exact join
_draw = np.random.default_rng(77)
FLIPS = _draw.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
FACTORS = _draw.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# ------------------------------------------------------------------ sets and signatures
def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all texts, and the offsets of each text."""
    words, at, *_ = c.hash_words(texts, lower=True)
    n = np.diff(at)
    size = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    stops = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    first = at[:-1][doc] + np.arange(int(stops[-1])) - stops[:-1][doc]
    value = np.zeros(len(first), c.U64)
    for k in range(shingle):
        inside = np.minimum(first + k, max(len(words) - 1, 0))
        here = (k < n[doc]) & (first + k < len(words))
        if len(words):
            value = np.where(here, c.mix(value * c.U64(c.BASES[1]) + words[inside]), value)
    out, ends = [], [0]
    for i in range(len(n)):
        own = np.sort(value[stops[i] : stops[i + 1]])
        if len(own) > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate([*out, np.zeros(0, c.U64)]), np.array(ends)


def set_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash a set; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, c.U64), np.cumsum(c.mix(flat ^ c.U64(c.BASES[0])), dtype=c.U64)])
    n = np.diff(at)
    return np.where(n > 0, c.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(c.U64) * c.GOLD), c.U64(0))


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, trees * depth) minhash values; rows of empty sets are all ones."""
    n = np.diff(at)
    out = np.full((len(n), len(FLIPS)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n > 0)
    if len(full):
        low = (flat >> c.U64(32)).astype(np.uint32)
        for k in range(len(FLIPS)):
            out[full, k] = np.minimum.reduceat((low ^ FLIPS[k]) * FACTORS[k], at[full])
    return out


def _describe(shingle: int):
    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", 2 << 20):
                flat, at = shingle_sets(part.column("text").to_pylist(), shingle)
                sig = signatures(flat, at)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(at)), pa.array(set_keys(flat, at).view(np.int64)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ], ["doc_id", "n", "node", "sig"])

    return run


# ------------------------------------------------------------------ sorted orders
def _bytes(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _places(batches):
    """Each class's place in each order: its region, and the labels that rank it there."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = _bytes(part.column("sig"), np.uint32, TREES * DEPTH).reshape(-1, TREES, DEPTH)
            key = np.tile((np.arange(TREES, dtype=c.U64) + c.U64(1)) * c.GOLD, (len(sig), 1))
            for d in range(START):
                key = c.mix(key * c.U64(c.BASES[0]) + sig[:, :, d])
            rest = np.zeros_like(key)
            for d in range(START, DEPTH):
                rest = (rest << c.U64(32)) | sig[:, :, d]
            node = np.repeat(part.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([
                pa.array(node), pa.array(key.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)),
            ], ["node", "key", "rest"])


def _low_bytes(batches):
    """One byte of each label: unequal ones agree by chance once in 256."""
    for batch in batches:
        sig = _bytes(batch.column("sig"), np.uint32, TREES * DEPTH).astype(np.uint8)
        small = pa.array([r.tobytes() for r in sig], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), small], ["node", "n", "sig"])


def _alike(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How many labels agree, for pairs (i, j); -1 where size or labels rule the similarity out."""
    least = percent / 100
    cut = (least - 4.5 * np.sqrt(least * (1 - least) / sig.shape[1])) * sig.shape[1]
    like = np.full(len(i), -1, np.int32)
    may = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    for at in range(0, len(may), 8192):
        some = may[at : at + 8192]
        same = np.count_nonzero(sig[i[some]] == sig[j[some]], axis=1)
        like[some] = np.where(same >= cut, same, -1)
    return like


def _possible(percent: int):
    """Of whole regions in sorted batches: the nodes with a possible partner in another component."""

    def nodes(rows: pa.Table):
        key, comp, n = (rows.column(x).to_numpy() for x in ("key", "comp", "n"))
        sig = _bytes(rows.column("sig"), np.uint8, TREES * DEPTH)
        good = np.zeros(len(key), bool)
        for d in range(1, len(key)):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[(comp[i + d] != comp[i]) & ~(good[i] & good[i + d])]
            i = i[_alike(n, sig, i, i + d, percent) >= 0]
            good[i] = good[i + d] = True
        return pa.RecordBatch.from_arrays([pa.array(np.unique(rows.column("node").to_numpy()[good]))], ["node"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield nodes(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and len(held):
            yield nodes(held)

    return run


def _neighbours(percent: int):
    """In one order's rows, as sorted: the neighbours of different components in one region."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            held = rows.slice(max(0, len(rows) - 1))
            key, comp, n, node = (rows.column(x).to_numpy() for x in ("key", "comp", "n", "node"))
            sig = _bytes(rows.column("sig"), np.uint8, TREES * DEPTH)
            i = np.flatnonzero((key[1:] == key[:-1]) & (comp[1:] != comp[:-1]))
            like = _alike(n, sig, i, i + 1, percent)
            i, like = i[like >= 0], like[like >= 0]
            a, b = np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a, b])), *(pa.array(np.concatenate([x, x])) for x in (a, b, like)),
            ], ["node", "a", "b", "like"])

    return run


# ------------------------------------------------------------------ links on full sets
def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            sides = []
            for x in ("tokens_a", "tokens_b"):
                column = batch.column(x)
                sides.append((column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()))
            (flat_a, at_a), (flat_b, at_b) = sides
            good = []
            for i in range(batch.num_rows):
                both = np.concatenate([flat_a[at_a[i] : at_a[i + 1]], flat_b[at_b[i] : at_b[i + 1]]])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * same >= percent * (len(both) - same):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; one set a pair travels."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return c.table(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_confirm(percent), "a long, b long"), "links")


# ------------------------------------------------------------------ components
def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of an edge table (a, b): comp is the least node reachable.

    In each round a node takes the least label of its neighbours, and that label's own label of
    the round before."""
    edges = c.table(links.select("a", "b").union(links.select("b", "a")).where("a <> b"), "edges")
    labels = c.table(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        old = labels.select("node", "comp")
        heard = edges.join(old, edges.a == old.node).groupBy("b").agg(F.min("comp").alias("heard"))
        told = old.join(heard, old.node == F.col("b")).select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("low"))
        further = told.join(old.select(F.col("node").alias("to"), F.col("comp").alias("further")), F.col("low") == F.col("to"), "left")
        new = c.table(further.select("node", "old", F.least("low", "further").alias("comp")), "labels")
        done = new.where("old <> comp").isEmpty()
        c.drop(labels)
        labels = new
        if done:
            c.drop(edges)
            return c.renamed(labels.select("node", "comp"), labels)


def joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` after more links: only components are walked again, not their nodes."""
    if comps is None:
        return components(links)
    of_a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    of_b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(edges)
    new = top.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    both = comps.join(new, F.col("comp") == F.col("was"), "full")
    out = c.table(both.select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "comp").alias("comp")), "comps")
    c.drop(top, comps)
    return out


# ------------------------------------------------------------------ the exact join
def _size_class(n: F.Column) -> F.Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(RATIO))).cast("int")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, comp) of different components that sizes and the first
    tokens, in order of frequency, do not rule out. No similar pair is left out.

    With o common tokens the first common one is among the first ``n - o + 1`` of both sets;
    o is at least ``percent * (n + m) / (100 + percent)``. Larger sets show as many tokens as
    the partners of a size class (steps of ``RATIO``) ask for."""
    own = c.table(nodes.join(sets, "node").select("node", "comp", F.size("tokens").alias("n"), "tokens"), "exact-sets")
    each = own.select("node", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(often, "token", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "token"))).alias("tokens"))
    least = lambda n, m: F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    n, smallest = F.col("n"), F.ceil(F.col("n") * percent / 100)
    listed = ranked.join(own.select("node", "comp", "n"), "node").select("node", "comp", "n", F.posexplode(F.slice("tokens", F.lit(1), (n - smallest + 1).cast("int"))).alias("i", "t"))
    shown = c.table(listed.where("t.f > 1").select("node", "comp", "n", (F.col("i") + 1).alias("pos"), "t.token"), "exact-prefixes")
    left = shown.where(F.col("pos") <= n - least(n, n) + 1).withColumn("k", _size_class(n))
    right = shown.withColumn("k", F.explode(F.sequence(_size_class(smallest), _size_class(n))))
    partner = F.greatest(smallest, F.floor(F.pow(F.lit(RATIO), F.col("k"))))
    right = right.where(F.col("pos") <= n - least(n, partner) + 1)
    sides = c.table(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), "exact-sides")
    by_comp = sides.groupBy("token", "k", "comp").agg(F.count("*").alias("m"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    main = by_comp.groupBy("token", "k").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    main = c.table(main.where("comps > 1 and lo = 0 and hi = 1").select("token", "k", F.col("top.comp").alias("main")), "exact-main")
    rows = sides.join(main, ["token", "k"])
    # Lane 0 holds the larger sets outside the main component, lane 1 those in it.
    inside = F.col("comp") == F.col("main")
    lanes = F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    names = lambda x, df: df.select("token", "k", "lane", *[F.col(y).alias(f"{y}_{x}") for y in ("node", "comp", "n", "pos")])
    small = names("x", rows.where("side = 0").withColumn("lane", F.explode(lanes)))
    large = names("y", rows.where("side = 1").withColumn("lane", inside.cast("int")))
    order = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    fits = 100 * F.col("n_x") >= percent * F.col("n_y")
    bound = 1 + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= least(F.col("n_x"), F.col("n_y"))
    keys = [F.col(f"s.{x}") == F.col(f"l.{x}") for x in ("token", "k", "lane")]
    met = small.alias("s").join(large.alias("l"), [*keys, F.col("comp_x") != F.col("comp_y"), order, fits, bound])
    out = c.table(met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "exact-pairs")
    c.drop(own, shown, sides, main)
    return out


# ------------------------------------------------------------------ all together
def _exact(shingle: int):
    """Tokens of the texts; of several rows with one id only those with the class's set."""

    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", 2 << 20):
                flat, at = shingle_sets(part.column("text").to_pylist(), shingle)
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                same = set_keys(flat, at).view(np.int64) == part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("node"), tokens], ["node", "tokens"]).filter(pa.array(same, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens) of the classes ``wanted`` (node, doc_id), each once."""
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
    found = rows.mapInArrow(_exact(shingle), "node long, tokens array<long>")
    return c.table(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "class-sets")


def _linked(docs: DataFrame, classes: DataFrame, percent: int, shingle: int, region: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) that connect all that are linked, and the components (node, comp)."""
    n_parts = c.partitions(docs.sparkSession)
    nodes = classes.where("n > 0")
    places = c.table(nodes.select("node", "sig").mapInArrow(_places, "node long, key long, rest long"), "places")
    shared = places.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    held = c.table(places.join(shared, "key"), "held")
    sigs = nodes.select("node", "n", "sig").mapInArrow(_low_bytes, "node long, n long, sig binary")

    def possible(rows: DataFrame) -> DataFrame:
        """Nodes that may have a partner in another component; all of the large regions."""
        few = rows.where(f"m <= {region}").select("key", "node", "comp", "n", "sig")
        seen = few.repartition("key").sortWithinPartitions("key").mapInArrow(_possible(percent), "node long")
        return seen.unionByName(rows.where(f"m > {region}").select("node")).distinct()

    some = held.join(sigs, "node")
    alive = c.table(possible(some.withColumn("comp", F.col("node"))), "alive")
    members = c.table(some.join(alive, "node", "left_semi"), "members")
    sets = _sets_of(docs, alive.join(classes.select("node", "doc_id"), "node"), shingle)
    c.drop(places, held, alive)
    comps, found, tested = None, [], None

    def placed() -> DataFrame:
        """Members of the regions that hold several components, with these."""
        if comps is None:
            return members.withColumn("comp", F.col("node"))
        rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        torn = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return rows.join(torn, "key", "left_semi")

    for _ in range(rounds):
        order = placed().repartitionByRange(n_parts, "key", "rest", "node").sortWithinPartitions("key", "rest", "node")
        near = order.select("key", "node", "comp", "n", "sig").mapInArrow(_neighbours(percent), "node long, a long, b long, like int")
        if tested is not None:
            near = near.join(tested, ["a", "b"], "left_anti")
        # A class has two neighbours an order, so at most 48 here.
        best = near.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("like")).alias("like"), "a", "b"))), 1, BEST).alias("best"))
        pairs = c.table(best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct(), "pairs")
        won = confirmed(pairs, sets, percent)
        seen = pairs if tested is None else c.table(tested.unionByName(pairs), "tested")
        if tested is not None:
            c.drop(tested, pairs)
        tested = seen
        if won.isEmpty():
            c.drop(won)
            break
        found.append(won)
        comps = joined(comps, won)
    rest = placed()
    left = possible(rest).join(comps, "node", "left") if comps is not None else possible(rest).withColumn("comp", F.col("node"))
    left = c.table(left.select("node", F.coalesce("comp", "node").alias("comp")), "left")
    pairs = c.table(prefix_pairs(left, sets, percent).join(tested, ["a", "b"], "left_anti"), "pairs") if tested is not None else prefix_pairs(left, sets, percent)
    won = confirmed(pairs, sets, percent)
    comps = joined(comps, won)
    links = c.table(_union([*found, won]), "all-links")
    c.drop(members, sets, left, pairs, won, *found, *([tested] if tested is not None else []))
    return links, comps


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, region: int = REGION, rounds: int = ROUNDS) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect all that are linked."""
    return _linked(docs, classes, percent, shingle, region, rounds)[0]


def _named(docs: DataFrame, percent: int, shingle: int, region: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and (node, component_id, comp, doc_id) of every class."""
    c.check_columns(docs, "doc_id", "text")
    found = docs.select("doc_id", "text").mapInArrow(_describe(shingle), "doc_id long, n long, node long, sig binary")
    described = c.table(found, "sets")
    groups = described.where("n > 0 and doc_id is not null").groupBy("node", "n")
    classes = c.table(groups.agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "classes")
    rows = c.table(described.select("doc_id", "n", "node"), "rows")
    c.drop(described)
    edges, comps = _linked(docs, classes, percent, shingle, region, ROUNDS)
    placed = c.table(classes.select("node", "doc_id").join(comps, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp")), "placed")
    least = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    names = placed.join(least, "comp").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("head"))
    names = c.table(names, "names")
    c.drop(classes, edges, comps, placed)
    return rows, names


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    rows, names = _named(docs, percent, shingle, region)
    known = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = known.join(names, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, region: int = REGION) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of one document a component.

    Rows with one ``doc_id`` and one set are one document, of which the row with the least text
    (then the least in JSON form) stays; under one ``doc_id`` different sets are different
    documents. Of rows without words, or without a ``doc_id``, none is a copy of another id's;
    rows without a ``doc_id`` all stay."""
    rows, names = _named(docs, percent, shingle, region)
    known = rows.where("doc_id is not null").join(names, "node", "left")
    stays = (F.col("n") == 0) | ((F.col("component_id") == F.col("doc_id")) & (F.col("head") == F.col("node")))
    ids = known.groupBy("doc_id").agg(F.count("*").alias("m"), F.max(stays.cast("int")).alias("stays"))
    ids = c.table(ids.where("m > 1 or stays = 0"), "dropped-ids")  # ids that do not simply stay
    columns = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    all_ = docs.select(columns, F.col("doc_id").alias("id"))
    plain = all_.join(ids.select(F.col("doc_id").alias("id")), "id", "left_anti").select("row.*")
    again = ids.where("m > 1").select(F.col("doc_id").alias("id"))

    def tag(batches):
        for batch in batches:
            for part in c.slices(batch, "text", 2 << 20):
                flat, at = shingle_sets(part.column("text").to_pylist(), shingle)
                node = pa.array(set_keys(flat, at).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, node], [*part.schema.names, "node"])

    repeated = docs.select(columns, F.col("doc_id").alias("id"), "text").join(again, "id", "left_semi")
    schema = repeated.schema
    tagged = repeated.mapInArrow(tag, type(schema)([*schema.fields, rows.schema["node"]]))
    heads = known.where(stays).select(F.col("doc_id").alias("id"), "node").distinct()
    own = Window.partitionBy("id", "node").orderBy("text", F.to_json("row"))
    some = tagged.join(heads, ["id", "node"], "left_semi").withColumn("place", F.row_number().over(own)).where("place = 1")
    return plain.unionByName(some.select("row.*"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
