"""Conversation structure repair by cheapest edits (operator 12).

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Rows are kept,
get another role or go; empty rows may be put in anywhere. Positions between rows and the
states of that pattern are the nodes of a graph, edits its arcs. Costs from the front and to
the back make an arc *tight* if both and its own add up to the least cost; the tight arcs
hold exactly the cheapest repairs and form no cycle. From the front, the set of all nodes
reached by the same letters (the frontier) follows the least letter on its tight arcs.

Costs relative to their least have few values, so each step is worked out once and kept.

A conversation of any length is spread over tasks. Rows (without texts) are sorted in ranges
and cut into blocks of up to ``BLOCK`` rows and 8 MB of text; a block stands for a matrix of least costs
between states, then for a table from frontier to frontier. Only conversations of several
blocks need these: their matrices and tables (a few hundred bytes a block) are put in a
row, which gives every block what comes before and after it. All passes read written
tables, so a lost executor repeats little and row numbers stay what they are. Texts move twice: to their edits, by row number,
and joined by blocks. The digest of a conversation of many blocks is taken by a stream over
its blocks in order (SHA-256 cannot be split), so memory stays at one block.

Defined results: rows of one turn are ordered by role and the SHA-256 of their text; null turns
come first; null
roles and texts are one space, a null conversation is one of its own; a role whose first
character is not u, a or s fits nowhere and must change or go; a first s may only be kept;
equal rows are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua?"  # the last for all that fits nowhere
NONE = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
ENTRY = (0, NONE, NONE, NONE)
LINE = "part int, block int, j int, id long, line_role string"


# ------------------------------------------------------------------ the graph
def kind(initial: str, must_go: bool, truncated: bool) -> int:
    """Everything about a row that its edits depend on, as one byte."""
    return (INITIALS[:3].find(initial) if initial else -1) % 4 + 4 * truncated + 8 * must_go


@functools.cache
def arcs(row: int) -> tuple[tuple[str, int, int, int, str], ...]:
    """(letter, cost, from, to, new role) of the edits that use up a row."""
    out = [("D", DELETE, s, s, "") for s in range(4)]
    if row < 8:
        late = row // 4
        out += [("K", KEEP + late, s, t, "") for s, t in AFTER.get(INITIALS[row % 4], {}).items()]
        out += [("R", REROLE + late, s, t, role) for role in ("user", "assistant") for s, t in AFTER[role[0]].items()]
    return tuple(out)


INSERTS = tuple(("I", INSERT, s, t, role) for role in ("user", "assistant") for s, t in AFTER[role[0]].items())


def _least(v: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(x - low if x < NONE else NONE for x in v), low


def _relax(v: list[int], backward: bool) -> list[int]:
    for _ in range(2):  # two empty rows lead from anywhere to anywhere
        for _, cost, s, t, _ in INSERTS:
            if backward:
                v[s] = min(v[s], cost + v[t])
            else:
                v[t] = min(v[t], cost + v[s])
    return v


@functools.lru_cache(1 << 16)
def inserted(v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from the front at a position after empty rows were put in there."""
    return tuple(_relax(list(v), False))


@functools.lru_cache(1 << 16)
def forward(v: tuple[int, ...], row: int) -> tuple[tuple[int, ...], int]:
    """Least costs from the front behind a row, given those before it; relative, and their least."""
    before, out = inserted(v), [NONE] * 4
    for _, cost, s, t, _ in arcs(row):
        out[t] = min(out[t], before[s] + cost)
    return _least(out)


@functools.lru_cache(1 << 16)
def backward(v: tuple[int, ...], row: int) -> tuple[tuple[int, ...], int]:
    """Least costs to the back before a row (and the empty rows before it), given those behind it."""
    out = [NONE] * 4
    for _, cost, s, t, _ in arcs(row):
        out[s] = min(out[s], cost + v[t])
    return _least(_relax(out, True))


CLOSING = tuple(_relax([0, NONE, NONE, 0], True))


@functools.lru_cache(1 << 16)
def follow(frontier: tuple[int, ...], front: tuple[int, ...], row: int, back: tuple[int, ...]) -> tuple[str, tuple[int, ...], tuple[str, ...], int]:
    """Letters, frontier behind the row, roles of the letters, and their cost.

    ``front``: costs before the row; ``back``: costs behind it. ``row`` -1 is the end."""
    before = inserted(front)
    last = [0 if s in (START, ASSISTANT) else NONE for s in range(4)]
    rows = () if row < 0 else arcs(row)
    after = list(last) if row < 0 else [NONE] * 4
    for _, cost, s, t, _ in rows:
        after[s] = min(after[s], cost + back[t])
    after = _relax(after, True)
    total = min(before[s] + after[s] for s in range(4))
    letters, roles, spent = "", [], 0
    while True:
        if row < 0 and all(last[s] == 0 == after[s] for s in frontier):
            return letters, frontier, tuple(roles), spent
        tight = [(x, cost, t, role) for x, cost, s, t, role in INSERTS if s in frontier and before[s] + cost + after[t] == total]
        tight += [(x, cost, t, role) for x, cost, s, t, role in rows if s in frontier and before[s] + cost + back[t] == total]
        letter = min(x for x, *_ in tight)
        tight = [x for x in tight if x[0] == letter]
        frontier = tuple(sorted({t for _, _, t, _ in tight}))
        letters += letter
        roles.append(tight[0][3])
        spent += tight[0][1]
        if letter != "I":
            return letters, frontier, tuple(roles), spent


def matrix(rows: bytes) -> list[int]:
    """Least costs from each state before the rows to each behind them (16 numbers)."""
    out = []
    for s in range(4):
        v, sum_ = tuple(0 if t == s else NONE for t in range(4)), 0
        for row in rows:
            v, more = forward(v, row)
            sum_ += more
        out += [x + sum_ if x < NONE else NONE for x in v]
    return out


def borders(matrices: list[list[int]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Costs before and behind each block of one conversation, from its blocks' matrices."""
    front, v = [], ENTRY
    for m in matrices:
        front.append(v)
        v = _least([min(v[s] + m[4 * s + t] for s in range(4)) for t in range(4)])[0]
    back, v = [], CLOSING
    for m in reversed(matrices):
        back.append(v)
        v = _least(_relax([min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4)], True))[0]
    return list(zip(front, reversed(back)))


def solve(rows: bytes, front: tuple[int, ...], back: tuple[int, ...], frontier: tuple[int, ...], last: bool):
    """(letters, roles, cost) of each row of a block (and of its end), and the frontier behind it."""
    fronts, v = [], front
    for row in rows:
        fronts.append(v)
        v = forward(v, row)[0]
    fronts.append(v)
    backs, v = [], back
    for row in reversed(rows):
        backs.append(v)
        v = backward(v, row)[0]
    out = []
    for i, row in enumerate(rows):
        letters, frontier, roles, cost = follow(frontier, fronts[i], row, backs[-1 - i])
        out.append((letters, roles, cost))
    if last:
        letters, frontier, roles, cost = follow(frontier, fronts[-1], -1, CLOSING)
        out.append((letters, roles, cost))
    return out, frontier


SETS = [tuple(s for s in range(4) if mask >> s & 1) for mask in range(16)]


def frontier_table(rows: bytes, front: tuple[int, ...], back: tuple[int, ...]) -> list[int]:
    """Frontier behind the block for every frontier before it whose nodes are all on cheapest ways."""
    total = min(x + y for x, y in zip(front, _behind(rows, back)))
    on = [s for s, (x, y) in enumerate(zip(front, _behind(rows, back))) if x + y == total]
    out = [0] * 16
    for mask, states in enumerate(SETS):
        if states and all(s in on for s in states):
            out[mask] = sum(1 << s for s in solve(rows, front, back, states, False)[1])
    return out


def _behind(rows: bytes, back: tuple[int, ...]) -> tuple[int, ...]:
    for row in reversed(rows):
        back = backward(back, row)[0]
    return back


# ------------------------------------------------------------------ blocks
def _blocks(most: int):
    """Sorted rows of one range as blocks of up to ``most`` rows of one conversation each."""

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        conv, held, size = None, [], 0

        def flush():
            ids, initials, kinds = zip(*held)
            rows = bytes(kinds)
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            return conv, part, block, list(ids), rows, pairs, initials[0], initials[-1]

        names = ["conv_id", "part", "block", "ids", "kinds", "pairs", "first", "last"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            out = []
            for own, id_, initial, must_go, late, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "id", "initial", "must_go", "late", "bytes"))):
                if held and (own != conv or len(held) == most or size + n > BLOCK_BYTES):
                    out.append(flush())
                    block, held, size = block + 1, [], 0
                conv, size = own, size + n
                held.append((id_, initial, kind(initial, must_go, late)))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([flush()])

    return run


def _matrices(batches):
    for batch in batches:
        some = [matrix(x) for x in batch.column("kinds").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("conv_id", "part", "block")] + [pa.array(some, pa.list_(pa.int64()))], ["conv_id", "part", "block", "matrix"])


def _borders(batches):
    for batch in batches:
        for blocks in batch.column("blocks").to_pylist():
            both = borders([b["matrix"] for b in blocks])
            yield pa.RecordBatch.from_arrays([
                pa.array([b["part"] for b in blocks], pa.int32()), pa.array([b["block"] for b in blocks], pa.int32()), pa.array([list(x) for x, _ in both], pa.list_(pa.int64())),
                pa.array([list(x) for _, x in both], pa.list_(pa.int64())), pa.array([i + 1 == len(blocks) for i in range(len(blocks))]),
            ], ["part", "block", "front", "back", "end"])


def _tables(batches):
    for batch in batches:
        some = [frontier_table(k, tuple(f), tuple(b)) for k, f, b in zip(*(batch.column(x).to_pylist() for x in ("kinds", "front", "back")))]
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("conv_id", "part", "block")] + [pa.array(some, pa.list_(pa.int32()))], ["conv_id", "part", "block", "to"])


def _entries(batches):
    for batch in batches:
        for blocks in batch.column("blocks").to_pylist():
            at, mask = [], 1
            for b in blocks:
                at.append(mask)
                mask = b["to"][mask]
            yield pa.RecordBatch.from_arrays([
                pa.array([b["part"] for b in blocks], pa.int32()), pa.array([b["block"] for b in blocks], pa.int32()), pa.array(at, pa.int32())], ["part", "block", "entry"])


def _edits(batches):
    """Audit and cost of each block, and a line for each row that stays or is put in."""
    names = ["conv_id", "part", "block", "pairs", "first", "last", "single", "cost", "audit", "lines"]
    line = pa.list_(pa.struct([("j", pa.int32()), ("id", pa.int64()), ("line_role", pa.string())]))
    for batch in batches:
        cols = [batch.column(x).to_pylist() for x in ("ids", "kinds", "front", "back", "end", "entry")]
        costs, audits, lines = [], [], []
        for ids, kinds, front, back, end, entry in zip(*cols):
            single = front is None
            steps, _ = solve(kinds, ENTRY if single else tuple(front), CLOSING if single else tuple(back), SETS[1 if single else entry], single or end)
            costs.append(sum(x for *_, x in steps))
            audits.append("".join(x for x, *_ in steps))
            own = []
            for i, (letters, roles, _) in enumerate(steps):
                for letter, role in zip(letters, roles):
                    if letter != "D":
                        own.append({"j": len(own), "id": None if letter == "I" else ids[i], "line_role": role or None})
            lines.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in names[:6]] + [pa.array([x is None for x in cols[2]]), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(lines, line)], names)


def _digests(batches):
    """SHA-256 of the blocks of each conversation, which come one after another."""
    conv, sha, some = None, None, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for own, chunk in zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist()):
            if sha is None or own != conv:
                if sha is not None:
                    yield row()
                conv, sha, some = own, hashlib.sha256(), False
            sha.update(("\n" if some else "").encode() + chunk.encode("utf-8", "surrogatepass"))
            some = True
    if sha is not None:
        yield row()


# ------------------------------------------------------------------ Spark
TERMINAL = r"[.!?]"
SEEN = r"[^\x20\x09-\x0D]"


def repair(rows: DataFrame, block_rows: int = BLOCK) -> dict[str, DataFrame]:
    """``rows``: id (unique), conv_id, turn, role, text. Frames of the result:

    ``faults``: conv_id, turn, blank, duplicate, truncated of every row; ``blocks``: conv_id,
    part, block (their order), pairs (illegal neighbours inside), first, last (role initials),
    cost, audit; ``chunks``: conv_id, part, block, chunk (repaired lines), single."""
    c.check_columns(rows, "id", "conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    rows = rows.select("id", "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = c.table(rows, "conversation-rows")  # ids stay what they are, however the input is computed
    tail = F.regexp_extract("text", r"(" + SEEN + r")[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select("id", "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), (~F.col("text").rlike(SEEN)).alias("blank"), (~tail.rlike(TERMINAL)).alias("late"))
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "id")).alias("at")).select(F.col("at.id").alias("id"), F.lit(True).alias("new"))
    flagged = narrow.join(first, "id", "left").withColumn("duplicate", ~F.col("blank") & F.col("new").isNull()).withColumn("late", F.col("late") & ~F.col("blank"))
    flagged = flagged.withColumn("must_go", F.col("blank") | F.col("duplicate")).withColumn("initial", F.substring("role", 1, 1))
    flagged = c.table(flagged.drop("new"), "conversation-faults")
    faults = flagged.select("conv_id", "turn", F.col("blank").cast("int"), F.col("duplicate").cast("int"), (F.col("late") & ~F.col("must_go")).cast("int").alias("truncated"))

    order = ["conv_id", "turn", "role", "digest", "id"]
    ranged = flagged.repartitionByRange(c.partitions(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", "id", "initial", "must_go", (F.col("late") & ~F.col("must_go")).alias("late"), "bytes")
    blocks = c.table(ranged.mapInArrow(_blocks(block_rows), "conv_id long, part int, block int, ids array<long>, kinds binary, pairs long, first string, last string"), "conversation-blocks")

    key = ["part", "block"]
    many = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    several = blocks.join(many, blocks.conv_id.eqNullSafe(many.conv_id), "left_semi")
    gather = lambda df, what: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", what))).alias("blocks")).select("blocks")
    sums = several.mapInArrow(_matrices, "conv_id long, part int, block int, matrix array<long>")
    edges = c.table(gather(sums, "matrix").mapInArrow(_borders, "part int, block int, front array<long>, back array<long>, end boolean"), "conversation-borders")
    tables = blocks.join(edges, key).mapInArrow(_tables, "conv_id long, part int, block int, to array<int>")
    entries = gather(tables, "to").mapInArrow(_entries, "part int, block int, entry int")
    known = blocks.join(edges.join(entries, key), key, "left")
    edited = c.table(known.mapInArrow(_edits, "conv_id long, part int, block int, pairs long, first string, last string, single boolean, cost long, audit string, lines array<struct<j:int,id:long,line_role:string>>"), "conversation-edits")
    c.drop(blocks, edges)

    lines = edited.select(*key, F.explode("lines").alias("x")).select(*key, "x.*")
    text = rows.select("id", "role", "text")
    kept = lines.where("id IS NOT NULL").join(text, "id").select(*key, "j", F.concat_ws(":", F.coalesce("line_role", "role"), "text").alias("line"))
    new = lines.where("id IS NULL").select(*key, "j", F.concat("line_role", F.lit(":")).alias("line"))
    joined = kept.unionByName(new).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("j", "line"))).alias("lines"))
    chunks = joined.select(*key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("chunk")).join(edited.select("conv_id", *key, "single"), key)
    return {"faults": faults, "blocks": edited.drop("lines"), "chunks": chunks}


def report(conversations: DataFrame, rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each conv_id of ``conversations``: what was wrong in ``rows``, and its repair."""
    out = repair(rows, block_rows)
    turns = out["faults"].groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    in_order = out["blocks"].groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("pairs").alias("pairs"), F.sort_array(F.collect_list(F.struct("part", "block", "audit", "first", "last"))).alias("b"))
    meet = F.aggregate(
        F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), F.struct(F.col("b")[0]["last"].alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x["last"].alias("last"), (a["n"] + (~F.concat(a["last"], x["first"]).isin("su", "ua", "au")).cast("long")).alias("n")))
    edits = in_order.select("conv_id", "cost", (F.col("pairs") + meet["n"]).alias("illegal"), F.array_join(F.transform("b", lambda x: x["audit"]), "").alias("audit"))
    chunks = out["chunks"]
    short = chunks.where("single").select("conv_id", F.sha2("chunk", 256).alias("repaired_sha256"))
    stream = chunks.where("NOT single").repartition(c.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "block")
    long = stream.select("conv_id", "chunk").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for df in (turns, edits, short, long):
        all_ = all_.unionByName(df, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_.groupBy("conv_id").agg(
        *[F.coalesce(F.max(x), F.lit(0)).cast("long").alias(x) for x in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    c.check_columns(conversations, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    rows = conversations.select(
        F.monotonically_increasing_id().alias("id"), "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20).alias("fault"))
    rows = rows.where("fault <> 0").select(
        (F.col("id") * 2).alias("id"), "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", TERMINAL, "")).otherwise(F.col("text")).alias("text"), "fault")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.explode(copies).alias("copy"), "*").select((F.col("id") + F.col("copy")).alias("id"), "conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(conversations, damaged(conversations))
