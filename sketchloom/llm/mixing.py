"""Mixing sources to target weights by min-cost flow (operator 5).

Documents are aggregated by membership pattern (the set of sources they belong to); only
one total for each pattern that occurs reaches the driver (100,000 take it about a second). A flow network routes words from patterns through sources
to the sink: a pattern gives its size once for free, again at cost 1, a third time at cost 2
(convex repetition costs), a source takes its target. The cheapest largest flow says how many
words each pattern gives; every document of the pattern is taken the whole number of times
that fits, and documents in seeded hash order are taken once more for the rest.

The order is found without sorting a pattern in one task: sums by (pattern, 12 leading bits
of the hash) show in which cell the cut falls, and only that cell's documents are ranked.

Targets: ``share`` of all sizes by weight, none above ``most`` times its source's size; what
is above is shared again by weight.

Defined results: null text has size 0, and size 0 is never taken; a null source is a source
of its own, last in order; a document in several sources counts for the one that its
pattern's flow serves; whole documents only, so a source may miss its target by up to half of
the document at the cut; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sketchloom.llm import common as c

WEIGHTS = (5, 2, 1)
CELL_BITS = 12
MOST_BROADCAST = 100_000  # rows of a plan that every task may hold; beyond it is joined


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Shares of ``share`` of all sizes by weight, with no more than ``most`` times a size."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


class Flow:
    """Min-cost maximum flow where only arcs out of the source cost anything.

    A path that adds to the flow never takes back what an arc out of the source carries, so the
    cheapest largest flow is found level by level: as much as the free arcs can carry, then as
    much more as those of cost 1 can, and so on. Within a level flow is blocked along shortest
    paths (Dinic), whatever its amounts."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.waiting: dict[int, list[tuple[int, int]]] = {}  # cost -> (arc, room) not open yet

    def add(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r in ((a, b, 0 if cost else room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        if cost:
            self.waiting.setdefault(cost, []).append((len(self.to) - 2, room))
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        self._fill(source, sink)
        for cost in sorted(self.waiting):
            for e, room in self.waiting[cost]:
                self.room[e] = room
            self._fill(source, sink)

    def _fill(self, source: int, sink: int) -> None:
        while True:
            far = [-1] * len(self.arcs)
            far[source] = 0
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.arcs[a]:
                    if self.room[e] > 0 and far[self.to[e]] < 0:
                        far[self.to[e]] = far[a] + 1
                        queue.append(self.to[e])
            if far[sink] < 0:
                return
            turn = [0] * len(self.arcs)  # the arc of each node to look at next
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                own = self.arcs[at]
                while turn[at] < len(own) and not (self.room[own[turn[at]]] > 0 and far[self.to[own[turn[at]]]] == far[at] + 1):
                    turn[at] += 1
                if turn[at] < len(own):
                    path.append(own[turn[at]])
                    at = self.to[own[turn[at]]]
                elif path:
                    e = path.pop()
                    at = self.to[e ^ 1]
                    turn[at] += 1
                else:
                    break


def route(patterns: list[tuple[frozenset[int], int]], wanted: list[int], repeats: int = 2) -> list[int]:
    """Words that each (sources, size) pattern gives so that sources get what they want."""
    n, m = len(patterns), len(wanted)
    net = Flow(n + m + 2)
    first = []
    for p, (members, size) in enumerate(patterns):
        first.append([net.add(n + m, p, size, r) for r in range(repeats)])
        for s in sorted(members):
            net.add(p, n + s, repeats * size, 0)
    for s, want in enumerate(wanted):
        net.add(n + s, n + m + 1, want, 0)
    net.run(n + m, n + m + 1)
    return [sum(net.room[e ^ 1] for e in arcs) for arcs in first]


def _sizes(column: str):
    def run(batches):
        for batch in batches:
            n = [0 if t is None else len(t.encode("utf-8", "surrogatepass").split()) for t in batch.column(column).to_pylist()]
            names = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(n, pa.int64())], [*names, "size"])

    return run


def mix(docs: DataFrame, keys: list[str], sources: str = "sources", weights: tuple[int, ...] = WEIGHTS, repeats: int = 2, seed: int = 11, ordered: list[str] | None = None) -> DataFrame:
    """``docs`` with an array column of sources and a ``text``: how many words to take of each.

    Returns ``keys``, size, source_size and target (of the first source), taken. The seeded
    order is by the keys ``ordered`` (all, unless given)."""
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.transform(F.col(sources), lambda x: F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), x)))))
    first = F.get(F.col(sources), 0)
    draw = [F.col(k) for k in ordered or keys]
    kept = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], names.alias("pattern"), F.when(first.isNull(), "n").otherwise(F.concat(F.lit("a"), first)).alias("own"),
                       F.xxhash64(*draw, F.lit(seed)).alias("h"), F.xxhash64(F.lit(seed), *draw).alias("h2"), *([] if "text" in keys else ["text"]))
    fields = [f for f in kept.schema.fields if f.name != "text"]
    sized = c.table(kept.mapInArrow(_sizes(f"k{keys.index('text')}" if "text" in keys else "text"), T.StructType([*fields, T.StructField("size", T.LongType())])), "sized")
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").collect()
    # Code point order is the order of UTF-8 bytes; "n" (null) follows every "a...".
    order = sorted({s for t in totals for s in t["pattern"]}, key=lambda s: s.encode())
    at = {s: i for i, s in enumerate(order)}
    sizes = [0] * len(order)
    for t in totals:
        for s in t["pattern"]:
            sizes[at[s]] += t["size"]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(order))])
    given = route([(frozenset(at[s] for s in t["pattern"]), t["size"]) for t in totals], [round(a) for a in aims], repeats)
    plan = spark.createDataFrame([(list(t["pattern"]), g // t["size"] if t["size"] else 0, g % t["size"] if t["size"] else 0) for t, g in zip(totals, given)], "pattern array<string>, times long, rest long")
    aim = spark.createDataFrame([(s, sizes[at[s]], float(aims[at[s]])) for s in order], "own string, source_size long, target double")
    near = F.broadcast if max(len(totals), len(order)) <= MOST_BROADCAST else lambda df: df
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS).alias("cell")
    cells = sized.groupBy("pattern", cell).agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    runs = cells.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).join(near(plan), "pattern")
    cut = c.table(runs.where("before < rest and before + size >= rest").select("pattern", F.col("cell").alias("cut"), (F.col("rest") - F.col("before")).alias("missing")), "cut")
    # One row a pattern; the driver holds them all.
    joined = sized.withColumn("cell", cell).join(near(plan), "pattern").join(near(cut), "pattern", "left").join(near(aim), "own")
    at_cut = F.col("cell").eqNullSafe(F.col("cut"))
    clear = joined.where(~at_cut).withColumn("extra", F.when(F.col("cell") < F.col("cut"), 1).otherwise(0))
    through = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "h2", "size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = joined.where(at_cut).withColumn("through", through)
    closer = 2 * (F.col("through") - F.col("missing")) < F.col("size")  # the document at the cut, if that is nearer
    ranked = ranked.withColumn("extra", F.when((F.col("through") <= F.col("missing")) | closer, 1).otherwise(0)).drop("through")
    return clear.unionByName(ranked).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("extra"))).alias("taken"))


def repeat_mixed(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    Columns of any names and types will do; maps go into the seeded order by their JSON form."""
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
    parts = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    order = [f"part {i}" for i in range(len(parts))]
    wide = docs.select(row.alias("row"), *[p.alias(n) for p, n in zip(parts, order)], F.col("text").alias("text"), F.array(F.col(source)).alias("sources"))
    plan = mix(wide, ["row"], ordered=order)
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    return plan.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", F.array("source").alias("sources")), ["doc_id"])
