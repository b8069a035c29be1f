"""Document fingerprints: locally consistent parsing by deterministic coin tossing (operator 8).

A text is an array of code points. At every level runs of one symbol collapse to one symbol;
deterministic coin tossing turns each symbol into a small label that depends on it and a few
symbols to its left (``2 * lowest differing bit + own bit``, repeated until the labels are
below 6); local minima of the labels start new phrases, and a phrase is named by a 64-bit hash
of the names in it. Those names are the next level's symbols. Cuts depend on nearby symbols
only, so equal substrings get the same interior names wherever they stand.

The fingerprint is a bottom-k sketch of the names of levels 2 and 3 (about 9 and 27 code
points); likeness is the sketch estimate of the Jaccard coefficient. Whole texts are parsed,
batches of texts at once, in numpy; no dictionary of names is shared or collected.

Defined results: null text is empty; the empty text's fingerprint is the empty string; two
empty texts are alike 1, an empty and another 0; texts too short for level 2 use lower levels,
at last their own hash. "Next document" runs down ``doc_id`` (null ids last, equal ids by
text) and wraps; a sole document is its own next. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

SKETCH = 64
LEVELS = (2, 3)
SLICE_CHARS = 1 << 20

_bits = np.arange(65536, dtype=np.uint32)
#: Number of trailing zero bits of 16-bit values (16 for zero).
TZ16 = np.where(_bits == 0, 16, np.log2((_bits & -_bits.astype(np.int64)).clip(1)).astype(np.uint8)).astype(np.uint8)
_prev, _cur = _bits >> 8, _bits & 255
_tz = TZ16[_prev ^ _cur].clip(0, 7)
#: One round of coin tossing for 8-bit labels: entry (left << 8) | own.
TOSS = (2 * _tz + ((_cur >> _tz) & 1)).astype(np.uint8)
FIRST = 255  # label of a text's first symbol before the rounds


def _labels(sym: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 6 with unequal neighbours, but for the first symbols of texts."""
    x = sym[1:] ^ sym[:-1]
    t = TZ16[(x & c.U64(0xFFFF)).astype(np.uint16)]
    rest = np.flatnonzero(t == 16)
    if len(rest):
        y = x[rest] >> c.U64(16)
        add = np.zeros(len(rest), np.uint8)
        for _ in range(3):
            low = TZ16[(y & c.U64(0xFFFF)).astype(np.uint16)]
            add += low
            y = np.where(low == 16, y >> c.U64(16), c.U64(1))
        t[rest] += add
    t = np.minimum(t, 63)
    lab = np.empty(len(sym), np.uint8)
    lab[1:] = 2 * t + ((sym[1:] >> t.astype(c.U64)) & c.U64(1)).astype(np.uint8)
    lab[head] = FIRST
    for _ in range(3):
        new = np.empty_like(lab)
        new[1:] = TOSS[(lab[:-1].astype(np.uint16) << 8) | lab[1:]]
        new[head] = 7
        lab = new
    return lab


def _level(sym: np.ndarray, at: np.ndarray):
    """Phrase names one level up, and the texts' offsets in them. No text may be empty."""
    head = np.zeros(len(sym), bool)
    head[at[:-1]] = True
    new = head.copy()
    new[1:] |= sym[1:] != sym[:-1]
    start = np.flatnonzero(new)
    if len(start) < len(sym):
        runs = np.diff(np.append(start, len(sym)))
        one = sym[start]
        long = runs > 1
        one[long] = c.mix(one[long] + runs[long].astype(c.U64) * c.GOLD)
        sym, head = one, head[start]
    lab = _labels(sym, np.flatnonzero(head))
    cut = head.copy()
    cut[1:-1] |= (lab[1:-1] < lab[:-2]) & (lab[1:-1] < lab[2:]) & ~head[2:]
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(sym)))
    pw = c.powers(c.BASES[0], int(size.max()) + 1)
    place = np.arange(len(sym)) - np.repeat(start, size)
    names = c.mix(np.add.reduceat(sym * pw[place], start) + size.astype(c.U64) * c.GOLD)
    return names, np.append(np.flatnonzero(head[start]), len(start))


CODE = c.U64(0xA24BAED4963EE407)


def parse(texts: list[str], levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, offsets) of levels 0 to ``levels`` of non-empty texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    out = [((points.astype(c.U64) + c.U64(1)), at)]
    for _ in range(levels):
        out.append(_level(*out[-1]))
    return out


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Ascending distinct 32-bit values of each text's sketch; empty for an empty text."""
    out: list = [np.zeros(0, np.uint32)] * len(texts)
    todo = [i for i, t in enumerate(texts) if t]
    while todo:
        n, size = 0, 0
        while n < len(todo) and (n == 0 or size + len(texts[todo[n]]) <= SLICE_CHARS):
            size += len(texts[todo[n]])
            n += 1
        part, todo = todo[:n], todo[n:]
        found = parse([texts[i] for i in part], max(LEVELS))
        short = [(c.mix(names * CODE) >> c.U64(32)).astype(np.uint32) for names, _ in found]
        for k, i in enumerate(part):
            use = LEVELS if found[LEVELS[0]][1][k + 1] - found[LEVELS[0]][1][k] > 3 else range(1, max(LEVELS) + 1)
            values = np.concatenate([short[v][found[v][1][k] : found[v][1][k + 1]] for v in use])
            values.sort()
            out[i] = values[np.append(True, values[1:] != values[:-1])][:SKETCH]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard coefficient from two bottom-k sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    new = np.concatenate([[True], ~twice])
    distinct = both[new]
    k = min(SKETCH, len(distinct))
    return float((both[:-1][twice] <= distinct[k - 1]).sum()) / k


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k] if k else text


def _run():
    def rows(ids, texts, nexts):
        edited = [_edited(t, n) for t, n in zip(texts, nexts)]
        all_ = sketches([*texts, nexts[-1], *edited])
        own, other = all_[: len(texts) + 1], all_[len(texts) + 1 :]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": [fingerprint(s) for s in own[:-1]], "edited_fingerprint": [fingerprint(s) for s in other],
            "near_edited": [likeness(s, e) for s, e in zip(own, other)],
            "near_next": [likeness(s, n) for s, n in zip(own, own[1:])],
        })

    def run(batches):
        ids, texts, size, first = [], [], 0, None
        for batch in batches:
            for i, text, lent in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("lent").to_pylist()):
                text = text or ""
                first = text if first is None else first
                if texts and (size > SLICE_CHARS or lent):
                    yield rows(ids, texts, [*texts[1:], text])
                    ids, texts, size = [], [], 0
                if lent:
                    return  # the next range's first document was all that was missing
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield rows(ids, texts, [*texts[1:], first])

    return run


def with_next(docs: DataFrame) -> DataFrame:
    """Ranges of ``doc_id`` sorted downwards, one a partition, each followed by the first
    document of the next range (``lent``). The driver sees one number a range."""
    n = c.partitions(docs.sparkSession)
    bounds = c.range_bounds(docs, "doc_id", n)
    rows = docs.select("doc_id", "text", c.range_bucket("doc_id", bounds).alias("bucket"))
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(b for b in tops if tops[b] is not None)
    if len(order) < 2:
        return rows.select("doc_id", "text", F.lit(False).alias("lent"), F.lit(0).alias("to")).repartitionById(1, "to").sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    # The range above takes the top document of this one; the lowest takes the top of all.
    borrower = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    whole = max(order) + 1
    top = F.array(*[F.lit(tops.get(b)).cast("long") for b in range(whole)])
    to = F.array(*[F.lit(borrower.get(b, 0)) for b in range(whole)])
    is_top = F.get(top, F.col("bucket")) == F.col("doc_id")
    places = F.when(is_top, F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("lent")), F.struct(F.get(to, F.col("bucket")).alias("to"), F.lit(True).alias("lent")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("lent"))))
    spread = rows.select("doc_id", "text", F.inline(places))
    return spread.repartitionById(max(n, whole), "to").sortWithinPartitions("lent", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``COLUMNS`` for each row of ``docs`` (doc_id, text)."""
    c.check_columns(docs, "doc_id", "text")
    rows = with_next(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", "lent").mapInArrow(_run(), COLUMNS)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
