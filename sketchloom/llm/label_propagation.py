"""Sharding by balanced label propagation (operator 4), in DataFrame functions only.

Documents are linked through hubs (here: equal texts), so a group of ``m`` copies is ``m``
links, not ``m**2`` pairs. Every document starts in a hashed shard. In each round every hub
finds the shard that most of its documents are in, and its other documents ask to move there;
a request is granted as far as the shard's quota allows, by the hub's hash, so a hub moves as
a whole. What the driver sees of a round is one number for each pair of shards.

Hubs of more than a quarter of a shard (a few for each shard at most) are placed before, the
largest first, where most room is left; only one that fits nowhere is cut, into the fewest
pieces, and the pieces don't move any more.

The law is ``rows``: counts at most one apart. A hub stays whole in the label of most of its
documents while that shard has room; hubs beyond it, then single documents, fill what is left
of the shards in order. So, beside hubs that are larger than a shard, at most ``shards - 1`` are
cut, and none where the linked documents of no label are more than a shard holds.

Ranks come from counts by cell (label, 10 bits of the hub's hash, for large hubs and single
documents 8 or 10 bits of the row's), so no group is sorted in one task.

Defined results: null text has size 8 and the checksum of the empty text, and is linked to
other null or empty texts; ties go to the shard with the larger hash for that hub; repeated rows get slots of their
own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.llm import common as c

SHARDS = 24
ROUNDS = 8
SLACK = 0.1


CELLS = 1024
PARTS = 256


def capacities(n: int, shards: int) -> list[int]:
    return [(s + 1) * n // shards - s * n // shards for s in range(shards)]


def place_large(sizes: list[tuple[int, int]], room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """(hub, rows) to [(rows, shard), ...]: the largest first, each where most room is left, cut
    only if it fits nowhere."""
    room, out = list(room), {}
    for hub, m in sorted(sizes, key=lambda x: (-x[1], x[0])):
        pieces = []
        while m:
            s = max(range(len(room)), key=lambda i: (room[i], -i))
            take = min(m, room[s])
            pieces.append((take, s))
            room[s] -= take
            m -= take
        out[hub] = pieces
    return out


def _lookup(table: dict[int, object], key: F.Column, none: F.Column) -> F.Column:
    """The entry of a small literal table, or null."""
    if not table:
        return none
    entry = lambda v: F.array(*[F.lit(x).cast("long") for x in v]) if isinstance(v, list) else F.lit(v)
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k).cast("long"), entry(v))]), key)


def propagate(nodes: DataFrame, n: int, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 3, free: list[int] | None = None) -> DataFrame:
    """``nodes`` (hub long, key long, fixed int, ...) with a balanced ``label`` that few hubs cross;
    where ``fixed`` is not null it is the label. ``free`` is what the fixed ones leave of each
    shard: the others start in proportion to it."""
    ends = [sum(free[: s + 1]) for s in range(shards)] if free and sum(free) else list(range(1, shards + 1))
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(ends[-1]).cast("long"))
    first = F.coalesce("fixed", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= draw)).cast("int"))
    start = c.table(nodes.withColumn("label", first), "labels")
    room = int(n / shards * (1 + SLACK)) + 1
    for turn in range(rounds):
        counts = start.groupBy("hub", "label").agg(F.count("*").alias("m"))
        best = counts.groupBy("hub").agg(F.max(F.struct("m", F.xxhash64("hub", "label").alias("draw"), "label")).alias("b"), F.sum("m").alias("all"))
        wish = c.table(best.where("all > b.m").select("hub", F.col("b.label").alias("wish")), "wishes")
        flows = start.join(wish, "hub").groupBy("label", "wish").agg(F.count("*").alias("m")).collect()  # shards**2 rows at most
        moves = [(r["label"], r["wish"], r["m"]) for r in flows if r["label"] != r["wish"]]
        if not moves:
            c.drop(wish)
            break
        sizes = {r["label"]: r["count"] for r in start.groupBy("label").count().collect()}
        granted = []
        for s in range(shards):
            asked = sum(m for a, b, m in moves if b == s)
            leaving = sum(m for a, b, m in moves if a == s)
            granted.append(min(1.0, max(0.0, (room - sizes.get(s, 0) + leaving) / asked)) if asked else 1.0)
        if not any(granted[b] > 0 for _, b, _ in moves):
            c.drop(wish)
            break
        share = F.get(F.array(*[F.lit(g) for g in granted]), F.col("wish"))
        lot = F.pmod(F.xxhash64("hub", F.lit(seed + turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = start.join(wish, "hub", "left").withColumn("label", F.when(F.col("wish").isNotNull() & (lot < share), F.col("wish")).otherwise(F.col("label"))).drop("wish")
        after = c.table(moved, "labels")
        c.drop(start, wish)
        start = after
    return start


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the label before the cut."""
    c.check_columns(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    group = F.xxhash64(F.xxhash64(text), (F.octet_length(text) + 8).cast("long"), F.crc32(text))
    rows = c.table(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("hub")), "rows")
    n = rows.count()
    room = capacities(n, shards)
    groups = c.table(rows.groupBy("hub").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    # A few for each shard at most.
    large = place_large([(r["hub"], r["m"]) for r in groups.where(F.col("m") > min(room) // 4).collect()], room)
    whole = {h: p[0][1] for h, p in large.items() if len(p) == 1}
    cut = {h: p for h, p in large.items() if len(p) > 1}
    long_none, list_none = F.lit(None).cast("int"), F.lit(None).cast("array<long>")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text_crc32")).join(groups, "hub", "left")
    part = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(PARTS)).cast("int")
    split = F.coalesce(_lookup({h: True for h in cut}, F.col("hub"), F.lit(None).cast("boolean")), F.lit(False))
    free = [r - sum(m for p in large.values() for m, to in p if to == s) for s, r in enumerate(room)]
    nodes = keyed.select("doc_id", "size", "text_crc32", "key", "hub", F.col("m").isNull().alias("single"), F.coalesce(F.col("m") > min(room) // 4, F.lit(False)).alias("large"), part.alias("part"), split.alias("split"),
                         _lookup(whole, F.col("hub"), long_none).cast("int").alias("fixed"))
    if cut:
        nodes = c.table(nodes, "nodes")
        before = F.sum("m").over(Window.partitionBy("hub").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
        parts = nodes.where("split").groupBy("hub", "part").agg(F.count("*").alias("m")).select("hub", "part", before.alias("before"))
        rank = F.row_number().over(Window.partitionBy("hub", "part").orderBy("key", "doc_id")) - 1 + F.col("before")
        ends = {h: [sum(x for x, _ in p[: i + 1]) for i in range(len(p))] for h, p in cut.items()}
        to = {h: [s for _, s in p] for h, p in cut.items()}
        piece = F.size(F.filter(_lookup(ends, F.col("hub"), list_none), lambda e: e <= F.col("rank")))
        placed_cut = nodes.where("split").join(parts, ["hub", "part"]).withColumn("rank", rank).withColumn("fixed", F.get(_lookup(to, F.col("hub"), list_none), piece).cast("int"))
        nodes = nodes.where("not split").unionByName(placed_cut.withColumn("hub", F.xxhash64("hub", "fixed")).drop("before", "rank"))
    placed = propagate(nodes.drop("split"), n, shards, rounds, free=free)
    # Whole hubs: what the quotas left apart follows its majority.
    counts = placed.where("not single and fixed is null").groupBy("hub", "label").agg(F.count("*").alias("m"))
    best = counts.groupBy("hub").agg(F.max(F.struct("m", F.xxhash64("hub", "label").alias("draw"), "label")).alias("b"), F.sum("m").alias("all"))
    apart = best.where("all > b.m").select("hub", F.col("b.label").alias("most"))
    one = placed.join(apart, "hub", "left").withColumn("label", F.coalesce("most", "label"))
    # Cells: in each label large hubs one by one, then the other hubs, then single documents.
    kind = F.when(F.col("single"), 2).when(F.col("large"), 0).otherwise(1).alias("kind")
    a = F.when(F.col("single"), F.pmod(F.xxhash64("key", F.lit(6)), F.lit(CELLS))).when(F.col("large"), F.col("hub")).otherwise(F.pmod("hub", F.lit(CELLS))).alias("a")
    d = F.when(F.col("large"), F.col("part")).otherwise(0).alias("d")
    celled = c.table(one.select("doc_id", "size", "text_crc32", "key", "hub", "label", kind, a, d), "cells")
    # At most shards * 2 * CELLS rows and PARTS for each large hub, whatever the input.
    sums = celled.groupBy("label", "kind", "a", "d").agg(F.count("*").alias("m"))
    caps = F.get(F.array(*[F.lit(x).cast("long") for x in room]), F.col("label"))
    own = Window.partitionBy("label").orderBy("kind", "a", "d").rowsBetween(Window.unboundedPreceding, 0)
    hub_end = F.max("through").over(Window.partitionBy("label", "kind", "a"))  # a large hub stays or goes as a whole
    marked = sums.withColumn("through", F.sum("m").over(own)).withColumn("stays", (F.col("kind") < 2) & (hub_end <= caps))
    marked = c.table(marked.select("label", "kind", "a", "d", "m", "stays", (F.col("through") - F.col("m")).alias("inner")), "marked")
    kept = {r["label"]: r["m"] for r in marked.where("stays").groupBy("label").agg(F.sum("m").alias("m")).collect()}
    free, vacant = [0], []
    for s in range(shards):
        vacant.append(room[s] - kept.get(s, 0))
        free.append(free[-1] + vacant[-1])
    line = Window.orderBy("kind", "label", "a", "d").rowsBetween(Window.unboundedPreceding, 0)
    moved = marked.where("not stays").withColumn("before", F.sum("m").over(line) - F.col("m"))
    offsets = c.table(marked.where("stays").withColumn("before", F.col("inner")).unionByName(moved).select("label", "kind", "a", "d", "stays", "before"), "offsets")
    place = F.row_number().over(Window.partitionBy("label", "kind", "a", "d").orderBy("hub", "key", "doc_id")) - 1
    ranked = celled.withColumn("place", place).join(F.broadcast(offsets), ["label", "kind", "a", "d"]).withColumn("r", F.col("place") + F.col("before"))
    edges = F.array(*[F.lit(x).cast("long") for x in free[1:]])
    filled = F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in range(shards)])
    starts = F.array(*[F.lit(x).cast("long") for x in free[:-1]])
    to = F.when(F.col("stays"), F.col("label")).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("r")))).cast("int")
    out = ranked.withColumn("shard", to)
    slot = F.when(F.col("stays"), F.col("r")).otherwise(F.get(filled, F.col("shard")) + F.col("r") - F.get(starts, F.col("shard"))).cast("long").alias("slot")
    c.drop(groups, marked, placed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"), "label")


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
