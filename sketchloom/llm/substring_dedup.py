"""Substring dedup: level-wise doubling over word windows (operator 3).

A window is ``width`` consecutive words of one document; it is a repeat if its words also
start at any other place of the corpus. Three lengths are tested, each about twice the one
before (9, 18, 35 for ``width=35``): a window can only repeat if the shorter windows inside
it do, so each level only sees what survived the level below.

* Level 1. Every window is represented by the smallest-hash short window inside it (its
  *anchor*, leftmost on ties). Equal windows have anchors at equal offsets, so nothing is
  lost, and only about 2 / (width - short + 2) of all positions are shuffled. The windows
  that share an anchor are neighbours; the words they span together are the anchor's *hull*.
  Anchors whose short window occurs once are dropped with all their windows. Where all
  occurrences of an anchor have the same hull, all their windows repeat: no further level.
* Level 2. One occurrence of each remaining hull is cut out of its text again; the
  double-length windows around the anchor must repeat in some other hull.
* Level 3. What is left is decided on whole windows by 128-bit hashes.

Counts travel, not pairs: every level is a count by hash and a join against the hashes that
repeat, so a passage with a million copies costs a million rows, and no group is collected.

Defined results: null text has no words; texts shorter than ``width`` lose nothing; repeated
rows are copies of each other; a null ``doc_id`` is kept as it is; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

WIDTH = 35
OUT = "rid long, doc_id long, n_words long, n_removed long, kept_text string"


def _levels(width: int) -> tuple[int, int]:
    short = max(1, (width + 3) // 4)
    return short, min(2 * short, width)


def _anchors(words: np.ndarray, at: np.ndarray, spans: c.Spans, width: int, short: int):
    """(anchor, first window, last window, document) of each run of windows with one anchor."""
    n_windows = np.maximum(np.diff(at) - width + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    first = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + at[:-1][doc]
    place = np.arange(len(words) - short + 1)
    key = (spans.get(place, place + short) & c.U64(0xFFFFFFFF00000000)) | place.astype(c.U64)
    reach, have = width - short + 1, 1  # minima over `reach` positions, by doubling
    low = key
    while 2 * have <= reach:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(key) - reach + 1], low[reach - have : len(key) - have + 1])
    owner = (low[first] & c.U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(cut[1:], total) - 1
    return owner[cut], first[cut], first[last], doc[cut]


def _anchor_rows(width: int):
    short, _ = _levels(width)

    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                words, at = c.hash_words(part.column("text").to_pylist())[:2]
                one = c.Spans(words, c.BASES[0])
                p, lo, hi, doc = _anchors(words, at, one, width, short)
                short_hash, hull_hash = one.get(p, p + short), one.get(lo, hi + width)
                two = one = c.Spans(words, c.BASES[1])  # one set of sums at a time
                shape = ((p - lo) * 4096 + (hi - lo)).astype(c.U64) * c.GOLD
                yield pa.RecordBatch.from_arrays([
                    part.column("rid").take(pa.array(doc)),
                    part.column("doc_id").take(pa.array(doc)),
                    pa.array((p - at[:-1][doc]).astype(np.int64)),
                    pa.array((p - lo).astype(np.int32)),
                    pa.array((hi - lo + 1).astype(np.int32)),
                    pa.array(short_hash.view(np.int64)),
                    pa.array(c.mix(hull_hash + shape).view(np.int64)),
                    pa.array(c.mix(two.get(lo, hi + width) + shape).view(np.int64)),
                ], ["rid", "doc_id", "p", "back", "n", "h", "hull", "hull2"])

    return run


def _window_rows(width: int):
    """Hashes of the double-length and whole windows of the hulls cut out of each text."""
    short, double = _levels(width)

    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                words, at = c.hash_words(part.column("text").to_pylist())[:2]
                cuts = part.column("cuts")
                per = np.array(pa.compute.list_value_length(cuts), np.int64)
                flat = cuts.flatten()
                get = {k: np.array(flat.field(k)) for k in ("p", "back", "n", "hull", "hull2", "times")}
                p = get["p"] + np.repeat(at[:-1], per)
                n = get["n"].astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = (p - get["back"])[row] + offset
                right = p[row] + double <= start + width
                mid = np.where(right, p[row], np.maximum(start, p[row] + short - double))
                one = c.Spans(words, c.BASES[0])
                double_hash, whole_hash = one.get(mid, mid + double), one.get(start, start + width)
                two = one = c.Spans(words, c.BASES[1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(get["hull"][row]), pa.array(get["hull2"][row]), pa.array(get["times"][row]),
                    pa.array(offset.astype(np.int32)),
                    pa.array(double_hash.view(np.int64)),
                    pa.array(whole_hash.view(np.int64)),
                    pa.array(two.get(start, start + width).view(np.int64)),
                ], ["hull", "hull2", "times", "offset", "d", "w", "w2"])

    return run


def _removal(width: int):
    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                texts = part.column("text").to_pylist()
                buf, at_b = c.text_buffer(texts)
                starts, ends = c.word_bounds(buf)
                at = np.searchsorted(starts, at_b)
                spans = part.column("spans")
                per = np.array(pa.compute.fill_null(pa.compute.list_value_length(spans), 0), np.int64)
                flat = spans.flatten()
                first = np.array(flat.field("first"), np.int64) + np.repeat(at[:-1], per)
                mask = np.array(flat.field("mask"), np.int64).view(np.uint64)
                edge = np.zeros(len(starts) + 1, np.int64)
                for bit in range(64):
                    on = first[(mask >> c.U64(bit)) & c.U64(1) == 1] + bit
                    if len(on):
                        np.add.at(edge, on, 1)
                        np.add.at(edge, on + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                n_gone = lost[at[1:]] - lost[at[:-1]]
                kept = []
                for i in range(len(texts)):
                    a, b = at[i], at[i + 1]
                    words = buf[at_b[i] : at_b[i + 1]].tobytes().split()
                    if n_gone[i]:
                        words = [w for w, g in zip(words, gone[a:b].tolist()) if not g]
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([
                    part.column("rid"), part.column("doc_id"), pa.array(np.diff(at)), pa.array(n_gone.astype(np.int64)), pa.array(kept, pa.string()),
                ], ["rid", "doc_id", "n_words", "n_removed", "kept_text"])

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, first, mask): bit ``i`` of mask says that the window at word ``first + i`` repeats."""
    if not 2 <= width <= 64:
        raise ValueError("width must lie between 2 and 64 words")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    anchors = c.table(rows.mapInArrow(_anchor_rows(width), "rid long, doc_id long, p long, back int, n int, h long, hull long, hull2 long"), "anchors")
    hull = ["h", "hull", "hull2"]
    # The least (rid, p) of each hull stands for it.
    hulls = c.table(anchors.groupBy(*hull).agg(F.count("*").alias("times"), F.min(F.struct("rid", "p", "back", "n")).alias("at")), "hulls")
    short = c.table(hulls.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("times").alias("places")).where("places > 1"), "short")
    live = c.table(hulls.join(short, "h"), "live")
    whole = live.where("kinds = 1").select("hull", "hull2", ((F.expr("shiftleft(1L, at.n - 1)") - 1) * 2 + 1).alias("mask"))
    mixed = live.where("kinds > 1").select(F.col("at.rid").alias("rid"), F.struct("at.p", "at.back", "at.n", "hull", "hull2", "times").alias("cut"))
    cuts = c.table(mixed.groupBy("rid").agg(F.collect_list("cut").alias("cuts")), "cuts")
    windows = c.table(
        rows.join(cuts, "rid").dropDuplicates(["rid"]).select("text", "cuts").mapInArrow(_window_rows(width), "hull long, hull2 long, times long, offset int, d long, w long, w2 long"), "windows")
    double = c.table(windows.groupBy("d").agg(F.sum("times").alias("places")).where("places > 1").select("d"), "double")
    alive = c.table(windows.join(double, "d", "left_semi").select("hull", "hull2", "times", "offset", "w", "w2"), "alive")
    full = c.table(alive.groupBy("w", "w2").agg(F.sum("times").alias("places")).where("places > 1").select("w", "w2"), "full")
    some = alive.join(full, ["w", "w2"], "left_semi").groupBy("hull", "hull2").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    masks = c.table(whole.unionByName(some), "masks")
    found = anchors.join(masks, ["hull", "hull2"]).select("rid", (F.col("p") - F.col("back")).alias("first"), "mask")
    found = c.table(found, "found")
    c.drop(anchors, hulls, short, live, cuts, windows, double, alive, full, masks)
    return found


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with the words outside repeated windows.

    Returns rid, doc_id, n_words, n_removed, kept_text (words joined by one space)."""
    c.check_columns(docs, "doc_id", "text")
    spans = repeated_windows(docs, width).groupBy("rid").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    return rows.join(spans, "rid", "left").mapInArrow(_removal(width), OUT)


def strip_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns as they are but ``text`` (and ``n_chars``) of what is kept."""
    c.check_columns(docs, "doc_id", "text")
    names = docs.columns
    spans = repeated_windows(docs, width).groupBy("rid").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))
    whole = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text", c.whole_row(docs))
    own = whole.join(spans, "rid", "left")

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                texts = pa.concat_arrays([b.column("kept_text") for b in removal(iter([part]))])
                row = part.column("row")
                new = {"text": texts, "n_chars": pa.compute.utf8_length(texts)}
                out = [new[n].cast(row.type.field(i).type) if n in new else row.field(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(out, names)

    removal = _removal(width)
    return own.mapInArrow(run, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
