"""Approximate nearest neighbours by additive quantisation (operator 10).

A vector is coded as the sum of one full-dimensional codeword from each of ``books``
codebooks. Codebooks are learned by residual k-means on a bounded seeded sample
(``sample`` rows, at most) and refined by least squares; every vector is encoded by beam
search over the codebooks and stored with the squared norm of its reconstruction. A query
scores all codes by lookup tables (``|x|^2 - 2 q.x`` with one table of dot products a
codebook), slice by slice; of each partition the best ``rerank`` so far, and all that tie with the
last of them, are measured exactly on the original vectors, and the exact distances alone decide
the result. What is measured grows with the logarithm of a partition's rows.

The index holds each distinct vector once, with its ``k + 1`` smallest ids (one may be the query's
own), so a group of equal vectors takes one of the ``rerank`` places. Each partition measures
its candidates where the vectors lie; only ``k`` ids a query and partition are shuffled, and the
final top ``k`` is an aggregate over these.

Defined results: vectors that are null, zero, of another length than most of the sample's or hold
null or non-finite components take no part; distance ties go to the smaller ``vec_id``;
repeated rows of one id count once, at the least of their distances, and the least of a query
id's vectors is the query; distances too large for a double are the largest double; with fewer candidates than ``k`` all are returned; an empty table gives an
empty result. Queries are a stated set (``vec_id`` divisible by ``every``), held in blocks of
``block`` by the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

RESULT = "query_id long, rank int, vec_id long, score double"


LARGEST = np.finfo(np.float64).max


def _single(x: np.ndarray) -> np.ndarray:
    """As float32, kept where squares and sums stay finite; only the approximate scores see it."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis, also where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = np.clip(x - q, -LARGEST, LARGEST)
        out = np.sqrt((diff**2).sum(-1))
        odd = ~np.isfinite(out)
        if odd.any():
            far = diff[odd]
            top = np.abs(far).max(-1)
            out[odd] = np.minimum(top * np.sqrt(((far / top[:, None]) ** 2).sum(-1)), LARGEST)
    return out


class AdditiveQuantiser:
    """Codebooks of shape (books, words, dim)."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks.astype(np.float32)
        b, k, d = self.codebooks.shape
        flat = self.codebooks.reshape(b * k, d)
        self.cross = (flat @ flat.T).reshape(b, k, b, k)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 16, words: int = 128, rounds: int = 4, seed: int = 7) -> AdditiveQuantiser:
        if not 1 <= words <= 256:
            raise ValueError("a codebook has 1 to 256 words: codes are bytes")
        rng = np.random.default_rng(seed)
        x = _single(x)
        words = min(words, len(x))
        res, found = x.copy(), []
        for _ in range(books):
            cents = res[rng.choice(len(res), words, replace=False)].copy()
            for _ in range(rounds):
                near = np.argmin((cents**2).sum(1) - 2 * res @ cents.T, 1)
                sums = np.zeros_like(cents)
                np.add.at(sums, near, res)
                n = np.bincount(near, minlength=words)
                cents[n > 0] = sums[n > 0] / n[n > 0, None]
            near = np.argmin((cents**2).sum(1) - 2 * res @ cents.T, 1)
            res = res - cents[near]
            found.append(cents)
        model = cls(np.array(found))
        for _ in range(2):  # all codebooks at once, by least squares on the codes
            codes, _ = model.encode(x)
            hot = np.zeros((books * words, books * words), np.float32)
            rhs = np.zeros((books * words, x.shape[1]), np.float32)
            col = codes.astype(np.int64) + np.arange(books) * words
            for a in range(books):
                np.add.at(rhs, col[:, a], x)
                for b in range(books):
                    np.add.at(hot, (col[:, a], col[:, b]), 1)
            hot += np.eye(len(hot), dtype=np.float32) * 0.1
            rhs += 0.1 * model.codebooks.reshape(-1, x.shape[1])
            model = cls(np.linalg.solve(hot, rhs).reshape(books, words, -1))
        return model

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) by beam search, and squared norms of the reconstructions."""
        books, words, _ = self.codebooks.shape
        codes = np.zeros((len(x), books), np.uint8)
        norms = np.zeros(len(x), np.float32)
        for at in range(0, len(x), 256):
            part = _single(x[at : at + 256])
            dots = np.einsum("nd,bkd->nbk", part, self.codebooks, optimize=True)
            own = np.einsum("bkbk->bk", self.cross)
            n = len(part)
            err = (own[0] - 2 * dots[:, 0])[:, None, :]  # |r|^2 - |x|^2 of (row, beam, word)
            path = np.zeros((n, 1, 0), np.int64)
            row = np.arange(n)[:, None]
            for b in range(books):
                if b:
                    err = (own[b] - 2 * dots[:, b])[:, None, :] + score[:, :, None]
                    for a in range(b):  # what the path so far adds to each next word
                        err += 2 * self.cross[a, :, b][path[:, :, a]]
                flat = err.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, 1)[:, :keep]
                score = np.take_along_axis(flat, best, 1)
                parent, word = best // words, best % words
                path = np.concatenate([path[row, parent], word[:, :, None]], 2)
            top = np.argmin(score, 1)
            codes[at : at + n] = path[np.arange(n), top]
            recon = sum(self.codebooks[b, codes[at : at + n, b]] for b in range(books))
            norms[at : at + n] = (recon**2).sum(1)
        return codes, norms

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """-2 q.c for each (query, codebook, word)."""
        return -2 * np.einsum("qd,bkd->qbk", _single(queries), self.codebooks, optimize=True)


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: finite, not null, not zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good & F.exists(v, lambda a: a != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def _least_ids(k: int):
    """Of each batch's equal vectors the rows with the ``k + 1`` smallest ids."""

    def run(batches):
        for batch in batches:
            raw = [np.array(v).tobytes() for v in batch.column("v").to_pylist()]
            seen = pd.DataFrame({"raw": raw, "id": batch.column("vec_id").to_numpy()}).drop_duplicates().sort_values("id", kind="stable")
            yield batch.take(pa.array(np.sort(seen.index[seen.groupby("raw").cumcount() <= k])))

    return run


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids) of the distinct vectors, with their ``k + 1`` smallest ids in order."""
    least = rows.mapInArrow(_least_ids(k), "vec_id long, v array<double>")
    return least.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))


def _encode(model: AdditiveQuantiser, dim: int, beam: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            codes, norms = model.encode(x, beam)
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("v"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norms)], ["ids", "v", "code", "norm"])

    return run


def _search(model: AdditiveQuantiser, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int):
    dim, lut = q.shape[1], model.tables(q)

    def least(ids, d):
        """The first ``k`` by (distance, id) of each row, every id once; the rest is infinite."""
        order = np.lexsort((d, ids), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        d[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        order = np.lexsort((ids, d), axis=1)[:, :k]
        more = ((0, 0), (0, k - order.shape[1]))
        return np.pad(np.take_along_axis(ids, order, 1), more), np.pad(np.take_along_axis(d, order, 1), more, constant_values=np.inf)

    def best(ids, there, x, codes, norms, at, kept):
        """Of one slice the nearest to the queries ``at``; ``kept`` are their least scores so far."""
        approx = np.repeat(norms[None, :], len(q[at]), 0)
        for b in range(codes.shape[1]):
            approx += lut[at, b, :][:, codes[:, b]]
        few = min(rerank, len(ids))
        low = np.concatenate([kept[at], np.partition(approx, few - 1, 1)[:, :few]], 1)
        kept[at] = np.partition(low, rerank - 1, 1)[:, :rerank]
        wanted = approx <= kept[at].max(1)[:, None]  # ties with the last count
        keep = max(1, int(wanted.sum(1).max()))
        step = max(1, 64 * 320 // (keep * ids.shape[1]))
        out = []
        for i in range(0, len(approx), step):
            own = q[at][i : i + step]
            near = np.argpartition(approx[i : i + step], keep - 1, 1)[:, :keep]
            exact = distances(x[near], own[:, None, :])
            counts = np.take_along_axis(wanted[i : i + step], near, 1)[:, :, None] & there[near] & (ids[near] != q_ids[at][i : i + step, None, None])
            out.append(least(ids[near].reshape(len(own), -1), np.where(counts, exact[:, :, None], np.inf).reshape(len(own), -1)))
        return tuple(np.concatenate(z) for z in zip(*out))

    def merged(old, new):
        return new if old is None else least(np.concatenate([old[0], new[0]], 1), np.concatenate([old[1], new[1]], 1))

    def run(batches):
        top, kept = None, np.full((len(q), rerank), np.inf, np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, count = _matrix(part.column("v"), dim), pa.compute.list_value_length(part.column("ids")).to_numpy()
                there = np.arange(count.max()) < count[:, None]
                ids = np.zeros(there.shape, np.int64)
                ids[there] = part.column("ids").flatten().to_numpy()
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                norms = part.column("norm").to_numpy().astype(np.float32)
                found = [best(ids, there, x, codes, norms, slice(i, i + 64), kept) for i in range(0, len(q), 64)]
                top = merged(top, tuple(np.concatenate(z) for z in zip(*found)))
        if top is not None:
            ids, d = top
            row, col = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[row, col]), pa.array(d[row, col])], ["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, rerank: int = 320, books: int = 16, words: int = 128, beam: int = 4, sample: int = 20_000, block: int = 2_000, seed: int = 7) -> DataFrame:
    """The ``k`` nearest other rows of each query row, by (score, vec_id)."""
    spark = df.sparkSession
    c.check_columns(df, vec_id, vector)
    rows = valid(df, vec_id, vector)
    train = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toPandas()
    empty = spark.createDataFrame([], RESULT)
    if not len(train):
        return empty
    dim = int(train["v"].map(len).mode()[0])
    rows = rows.where(F.size("v") == dim)
    x = np.array([v for v in train["v"] if len(v) == dim], np.float64)
    model = AdditiveQuantiser.fit(x, books, words, seed=seed)
    index = c.table(distinct(rows, k).select("ids", "v").mapInArrow(_encode(model, dim, beam), "ids array<long>, v array<double>, code binary, norm float"), "aq-index")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = None
    count, last = queries.count(), None
    while count > 0:  # blocks of the stated query set, in id order
        part = (queries if last is None else queries.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).toPandas()
        if not len(part):
            break
        ids, q = part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.float64)
        last, count = int(ids[-1]), count - len(part)
        one = index.select("ids", "v", "code", "norm").mapInArrow(_search(model, ids, q, k, rerank), "query_id long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return empty
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
