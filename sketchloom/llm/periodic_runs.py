"""Periodic run detection in word sequences (operator 11).

A run is a maximal stretch of words with smallest period ``q`` and length at least
``max(least, 2 * q)``. Every run starts one of its periods with the longest Lyndon word at
that place, under the order of words or its reverse (Bannai et al., the runs theorem). So a
stack is scanned from right to left under both orders: ``nxt[i]``, the next smaller suffix,
ends the longest Lyndon word at ``i``. Suffixes are compared by their first words, and where
these are equal by the longest common extension, found by doubling and halving over rolling
hashes modulo 2**61 - 1 with a base that each process draws anew. Each Lyndon word is
extended to both sides in the same way.

Only stretches that can hold a run are scanned. In a run, at least ``k = ceil(least / 2)``
consecutive words have an equal word ``q`` further on, and the ``k``-word windows among them
and their copies cover the whole run without a gap. So each run lies in one stretch of words
covered by windows that occur twice in that stretch. These stretches come from one sort of
window hashes for all texts of a batch, and shrink while windows lose their partner.

Every run found is verified on the words themselves: equal at distance ``q`` inside, not at
its two ends. Where hashes misled, the document is scanned again on exact word numbers.

Memory is bounded by 2 MB of texts, or one longer text. Defined results: null text has no
words, texts without words no runs; repeated rows and equal or null ids are kept as they are;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

LEAST = 12
MODULUS = (1 << 61) - 1
BASE = random.SystemRandom().randrange(1 << 32, MODULUS - 1)
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Stretch:
    """The runs of one sequence of small integers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.sums, self.powers = [0], [1]
        h, p = 0, 1
        for w in words:
            h = (h * BASE + w + 1) % MODULUS
            p = p * BASE % MODULUS
            self.sums.append(h)
            self.powers.append(p)

    def _same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % MODULUS == 0

    def ahead(self, i: int, j: int) -> int:
        """Equal words from ``i`` and ``j`` (the larger) on."""
        w, most, n = self.words, self.n - j, 0
        while n < most and w[i + n] == w[j + n]:
            n += 1
            if n == 4:
                break
        else:
            return n
        step = 4
        while n + step <= most and self._same(i + n, j + n, step):
            n += step
            step *= 2
        while step:
            if n + step <= most and self._same(i + n, j + n, step):
                n += step
            step //= 2
        return n

    def behind(self, i: int, j: int) -> int:
        """Equal words that end before ``i`` (the smaller) and ``j``."""
        w, n, step = self.words, 0, 1
        if not i or w[i - 1] != w[j - 1]:
            return 0
        while n + step <= i and self._same(i - n - step, j - n - step, step):
            n += step
            step *= 2
        while step:
            if n + step <= i and self._same(i - n - step, j - n - step, step):
                n += step
            step //= 2
        return n

    def lyndon_ends(self, reverse: bool) -> list[int]:
        """Where the longest Lyndon word that starts at each place ends."""
        w, n = self.words, self.n
        nxt = [n] * n
        for i in range(n - 2, -1, -1):
            j, a = i + 1, w[i]
            while j < n:
                b = w[j]
                if a == b:
                    same = self.ahead(i, j)
                    if j + same == n:
                        break
                    a_next, b_next = w[i + same], w[j + same]
                else:
                    a_next, b_next = a, b
                if (a_next > b_next) != reverse:
                    break
                j = nxt[j]
            nxt[i] = j
        return nxt

    def runs(self, least: int) -> set[tuple[int, int, int]]:
        """(start, length, period) of every run."""
        found: set[tuple[int, int, int]] = set()
        if not self.n:
            return found
        words, place = np.array(self.words), np.arange(self.n)
        for reverse in (False, True):
            end = np.array(self.lyndon_ends(reverse))
            right = words == words[np.minimum(end, self.n - 1)]
            right &= end < self.n
            left = words[place - 1] == words[end - 1]
            left[0] = False
            last: dict[int, int] = {}  # the end of the latest run of a period
            for i in np.flatnonzero(right | left).tolist():
                q = int(end[i]) - i
                if i + q <= last.get(q, 0):
                    continue
                back = self.behind(i, i + q)
                ahead = self.ahead(i, i + q) if right[i] else 0
                length = back + q + ahead
                if length >= 2 * q:
                    last[q] = i - back + length
                    if length >= least:
                        found.add((i - back, length, q))
        return found


def _covered(words: np.ndarray, home: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a ``k``-word window that occurs twice in its ``home`` (ascending numbers)."""
    n = len(words) - k + 1
    out = np.zeros(len(words) + 1, np.int32)
    if n < 2:
        return out[:-1] > 0
    place = np.flatnonzero(home[:n] == home[k - 1 :])
    key = c.mix(c.Spans(words, c.BASES[0]).get(place, place + k) + home[place].astype(c.U64) * c.GOLD)
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    at = place[order[twin]]
    np.add.at(out, at, 1)
    np.add.at(out, at + k, -1)
    return np.cumsum(out[:-1]) > 0


def stretches(words: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches that hold all runs; ``at``: where each text's words begin."""
    k = (least + 1) // 2
    home = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(words))
    while len(place):
        on = _covered(words[place], home, k)
        kept = place[on]
        gap = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(home[on]) > 0)])[: len(kept)]
        if on.all():
            break
        place, home = kept, np.cumsum(gap)
    if not len(place):
        return []
    first = np.flatnonzero(gap)
    return list(zip(place[first].tolist(), (place[np.append(first[1:], len(place)) - 1] + 1).tolist()))


def holds(words: list[bytes], start: int, length: int, q: int) -> bool:
    """Whether the stretch has period ``q`` and neither neighbour extends it."""
    end = start + length
    return (words[start : end - q] == words[start + q : end]
            and not (start and words[start - 1] == words[start + q - 1]) and not (end < len(words) and words[end] == words[end - q]))


def runs_of_words(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs of one text, from exact numbers of its words."""
    number: dict[bytes, int] = {}
    return sorted(Stretch([number.setdefault(w, len(number)) for w in words]).runs(least), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[str | None], least: int = LEAST) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words and runs, by start and period, of each text."""
    hashes, at = c.hash_words(texts)[:2]
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = stretches(hashes, at, least)
    home = np.searchsorted(at, np.array([a for a, _ in parts], np.int64), side="right") - 1
    for (a, b), i in zip(parts, home.tolist()):
        numbers = np.unique(hashes[a:b], return_inverse=True)[1].tolist()
        runs[i] += [(a - int(at[i]) + s, n, q) for s, n, q in Stretch(numbers).runs(least)]
    for i, own in enumerate(runs):
        own.sort(key=lambda r: (r[0], r[2]))
        if not all(holds(words[i], *r) for r in own):
            runs[i] = runs_of_words(words[i], least)
    return words, runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge) > 0).tolist()) if not gone]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, and the text with one period of each run (words joined by one space)."""
    if least < 2:
        raise ValueError("runs have at least two words")
    c.check_columns(docs, "doc_id", "text")

    def run(batches):
        c.release()
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                words, runs = runs_of_texts(part.column("text").to_pylist(), least)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, x]) for x in range(3)], ["start", "length", "period"])
                edges = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
                text = [b" ".join(collapse(w, own)).decode("utf-8", "surrogatepass") for w, own in zip(words, runs)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), fields), pa.array(text, pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts whose id's checksum ends in 0 repeat a stretch from some word on."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    own = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    n, g = F.size("ws"), F.expr("h div 10")
    out = own.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("ws"))
    out = out.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.expr("(size(ws) - a) div (3 + (h div 10) % 8)")).cast("int"))
    head, period = F.slice("ws", F.lit(1), F.col("a")), F.slice("ws", F.col("a") + 1, F.col("p"))
    times = F.expr("cast((size(ws) - a) div p + 1 AS int)")
    looped = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(period, times))), F.lit(1), n), " ")
    return out.select("doc_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(looped).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(with_loops(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.length div -best.q").alias("exponent_milli"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
