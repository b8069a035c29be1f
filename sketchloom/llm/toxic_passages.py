"""Toxicity by maximum-scoring segments (operator 2).

* A token is a run of letters, lower-cased. Its weight is the log-odds of toxic against clean
  labelled documents under an informative Dirichlet prior (the corpus frequencies), kept if
  its z-score is significant; rare words fall back to their first 5 or 4 letters.
  A toxic document counts for a token only as far as the token's neighbours differ (62-bit maps
  of hashed contexts, merged by OR): else copies of one toxic document would make all its
  words look toxic.
* A neutral token costs ``drift``. All maximal scoring segments of a document are found in one
  linear scan (a stack of cumulative sums); only tokens with a weight are visited.
* Extreme-value calibration: lambda solves E[exp(lambda s)] = 1 over clean tokens, K is
  fitted to the clean documents' best segments, so a segment of score S in n tokens has
  E-value K n exp(-lambda S). The evidence of a document is the sum of -log E over its
  significant segments; a logistic curve fitted on labelled rows turns it into a probability.

Labels are learned from rows whose crc32(doc_id) mod 4 is not 2, from at most about
``sample`` of them (chosen by hash; the bound of the broadcast). Remainder 3 fits the curve
with weights learned without it, then all three remainders give the final weights. Counts are
added up in Spark; the driver gets the features of at least ``MIN_COUNT`` toxic documents of the
sample (more than ``most_features`` are an error, none is left out), one count for each
weight, and the segment scores of the sample's texts.

Defined results: a null or empty text has no passage and gets the curve's lowest score; with
no labels of one class every score is the share of toxic labels (0 without labels); repeated
or contradicting labels count as toxic if one says so; null labels are ignored; repeated rows
repeat; an empty table gives an empty result; only text, never another column, is scored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

LETTERS = re.compile(r"[^\W\d_]+")
SAMPLE = 40_000
MIN_COUNT = 4
PRIOR = 200.0
Z_LEAST = 3.0
DRIFT = 0.25
MOST_WEIGHT = 6.0
MOST_FEATURES = 5_000_000
CACHE = 500_000
CONTEXTS = 62  # bits of a non-negative long
THRESHOLD = 0.3


def features(word: str) -> tuple[str, ...]:
    return (word, f"{word[:5]}~", f"{word[:4]}~~")


class Weights(dict):
    """Weight of every token seen so far (0: neutral); forgotten when too many."""

    def __init__(self, table: dict[str, float], counts: dict[str, int]):
        super().__init__()
        self.table, self.counts = table, counts

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        weight = 0.0
        for f in features(word):  # the most specific feature that is known well enough
            if f in self.counts:
                weight = self.table.get(f, 0.0)
                break
        self[word] = weight
        return weight

    def __reduce__(self):
        return Weights, (self.table, self.counts)


def contexts(bitmaps: list[int]) -> int:
    """How many different contexts bitmaps of hashed contexts stand for (linear counting)."""
    bits = 0
    for m in bitmaps:
        bits |= m
    free = CONTEXTS - bits.bit_count()
    return round(CONTEXTS * math.log(CONTEXTS / free)) if free else 1 << 60


def log_odds(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """Weights of the significant features, from document counts."""
    out = {}
    for f, y1 in toxic.items():
        y0 = clean.get(f, 0)
        a = PRIOR * (y1 + y0) / (n1 + n0)
        d = math.log((y1 + a) / (n1 + PRIOR - y1 - a)) - math.log((y0 + a) / (n0 + PRIOR - y0 - a))
        if d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= Z_LEAST:
            # Shrinking by the prior is undone by one prior document a class: what is left is the contrast.
            out[f] = min(MOST_WEIGHT, math.log((y1 + 0.5) / (n1 + 1)) - math.log((y0 + 0.5) / (n0 + 1)))
    return {f: w for f, w in out.items() if w > 0.5}


def segments(places: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place): linear in the weights.

    Tokens between places cost ``drift`` each. A segment on the stack is (sum before it, sum
    through it, first, last); a new one joins the nearest earlier segment that starts lower
    and has not risen as high, else it stands alone."""
    stack: list[tuple[float, float, int, int]] = []
    total, at = 0.0, -1
    for p, w in zip(places, weights):
        total -= drift * (p - at - 1)
        low, high, first = total, total + w, p
        total, at = high, p
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k -= 1
            if k < 0 or stack[k][1] >= high:
                break
            low, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((low, high, first, p))
    return [(h - lo, a, b) for lo, h, a, b in stack]


class Model:
    """Weights, extreme-value parameters and the curve."""

    def __init__(self, weights: Weights | None, rate: float):
        self.weights, self.rate = weights, rate
        self.lam, self.k = 1.0, 0.1
        self.curve = (0.0, 0.0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        words = LETTERS.findall(text.lower()) if text else []
        hits = [(i, w) for i, w in enumerate(map(self.weights.__getitem__, words)) if w]
        return len(words), segments([i for i, _ in hits], [w for _, w in hits]) if hits else []

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, list[tuple[float, int, int]]]:
        """Sum of -log E over significant segments, and these."""
        bits = [(self.lam * s - math.log(self.k * max(n, 1)), s, a, b) for s, a, b in found]
        good = [x for x in bits if x[0] > 0]
        if not good:
            return (min(0.0, max((x[0] for x in bits), default=-10.0)) if bits else -10.0), []
        return sum(x[0] for x in good), [x[1:] for x in good]

    def score(self, text: str | None) -> tuple[float, int]:
        if self.weights is None:
            return self.rate, 0
        n, found = self.scan(text)
        value, good = self.evidence(n, found)
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * max(-10.0, min(value, 40.0)) + b)))), len(good)

    def calibrate(self, share: dict[float, float], rows: list[tuple[int, list, int]]) -> None:
        """``share``: weight -> share of clean tokens that have it; rows: (n, segments, label)."""
        neutral = max(1e-9, 1 - sum(share.values()))
        mean = lambda x: neutral * math.exp(-x * DRIFT) + sum(p * math.exp(x * w) for w, p in share.items())
        lo, hi = 1e-3, 3.0
        if mean(hi) <= 1:
            self.lam = hi
        else:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
            self.lam = max(0.3, lo)
        # Clean documents without a segment score 0: P(S > s) = 1 - exp(-K n exp(-lambda s)).
        clean = [(n, max((s for s, *_ in f), default=0.0)) for n, f, y in rows if not y and n]
        over = sum(1 for n, s in clean if s > 2.0)
        room = sum(n * math.exp(-self.lam * 2.0) for n, s in clean)
        self.k = max(1e-6, (over + 0.5) / max(room, 1e-9))
        x = np.array([max(-10.0, min(self.evidence(n, f)[0], 40.0)) for n, f, _ in rows])
        y = np.array([r[2] for r in rows], float)
        # Penalised logistic regression: convex, and with a finite optimum for separable classes.
        z = np.stack([x / 10, np.ones(len(x))], 1)
        ridge = np.array([0.5, 0.01])
        loss = lambda w: np.logaddexp(0, z @ w).sum() - (y * (z @ w)).sum() + (ridge * w * w).sum() / 2
        w = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            grad = z.T @ (p - y) + ridge * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * (grad @ step):
                size /= 2
            w = w - size * step
            if abs(size * step).max() < 1e-7:
                break
        a, b = w[0] / 10, w[1]
        self.curve = (max(0.0, float(a)), float(b))


def _count(batches):
    c.release()
    for batch in batches:
        for part in c.slices(batch, "text", c.SLICE_BYTES):
            found: dict[str, list[int]] = {}
            for text, toxic, fold in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), part.column("fold").to_pylist()):
                k = 2 * (fold == 3) + toxic
                words = LETTERS.findall((text or "").lower())
                seen = {f for w in set(words) for f in features(w)}
                seen.add("")  # counts the documents
                for f in seen:
                    found.setdefault(f, [0] * 6)[k] += 1
                if toxic:
                    for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                        bit = 1 << (zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) % CONTEXTS)
                        for f in features(w):
                            found[f][4 + (fold == 3)] |= bit
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in range(6))], ["f", "c0", "t0", "c3", "t3", "m0", "m3"])


def remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> Model:
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = c.table(one.select("doc_id", "toxic", remainder().cast("int").alias("fold")).where("fold <> 2"), "labelled")  # ids and labels
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About `sample` rows of three numbers, whatever the corpus.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold")
    sums = rows.mapInArrow(_count, "f string, c0 long, t0 long, c3 long, t3 long, m0 long, m3 long").groupBy("f").agg(*[F.sum(k).alias(k) for k in ("c0", "t0", "c3", "t3")], *[F.bit_or(k).alias(k) for k in ("m0", "m3")])
    sums = c.table(sums.where(f"t0 + t3 >= {MIN_COUNT} or f = ''"), "features")
    found = sums.count()
    if found > most_features:
        raise ValueError(f"{found} features of toxic documents are more than {most_features}; take a smaller sample")
    counts = {r["f"]: r for r in sums.collect()}
    c.drop(sums)
    n = counts.pop("", None)
    if n is None or not n["c0"] + n["c3"] or not n["t0"] + n["t3"]:
        done = (n["c0"] + n["c3"] + n["t0"] + n["t3"]) if n else 0
        return Model(None, (n["t0"] + n["t3"]) / done if done else 0.0)

    def weights(keys):
        toxic = {f: min(sum(r[f"t{k}"] for k in keys), contexts([r[f"m{k}"] for k in keys])) for f, r in counts.items()}
        clean = {f: sum(r[f"c{k}"] for k in keys) for f, r in counts.items()}
        n1, n0 = sum(n[f"t{k}"] for k in keys), sum(n[f"c{k}"] for k in keys)
        known = {f: v for f, v in toxic.items() if v + clean[f] >= MIN_COUNT}
        return Weights(log_odds(known, clean, max(n1, 1), max(n0, 1)), known)

    inner = n["t0"] and n["c0"] and n["t3"] and n["c3"]
    model = Model(weights((0,) if inner else (0, 3)), 0.0)

    def look(batches):
        """A row for each text (size, segment scores, label), and rows (count, [weight], -1) of the
        tokens of a batch's clean texts."""
        for batch in batches:
            out, often = [], {}
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    size, found = model.scan(text)
                    out.append((size, [s for s, *_ in found], toxic))
                    for w in map(model.weights.__getitem__, LETTERS.findall((text or "").lower()) if not toxic else ()):
                        if w:
                            often[round(w, 3)] = often.get(round(w, 3), 0) + 1
            out += [(k, [w], -1) for w, k in often.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64())), pa.array([x[2] for x in out], pa.int32())], ["n", "segments", "toxic"])

    fit = rows.where("fold = 3") if inner else rows
    looked = c.table(fit.mapInArrow(look, "n long, segments array<double>, toxic int"), "looked")
    seen = looked.where("toxic >= 0").collect()  # part of the sample
    tokens = sum(r["n"] for r in seen if not r["toxic"]) or 1
    often = looked.where("toxic < 0").groupBy(F.get("segments", 0).alias("w")).agg(F.sum("n").alias("n")).collect()
    share_of = {r["w"]: r["n"] / tokens for r in often}  # weights have three decimals
    model.calibrate(share_of, [(r["n"], [(s, 0, 0) for s in r["segments"]], r["toxic"]) for r in seen])
    c.drop(looked)
    model.weights = weights((0, 3))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages of every row."""

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                got = [model.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""

    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                low = pa.array([model.score(t)[0] < threshold for t in part.column("text").to_pylist()], pa.bool_())
                row = part.column("row").filter(low)
                yield pa.RecordBatch.from_arrays([row.field(i) for i in range(len(names))], names)

    whole = docs.select("text", c.whole_row(docs))
    return whole.mapInArrow(run, docs.schema)


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder() == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
