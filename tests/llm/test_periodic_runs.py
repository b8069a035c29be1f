"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest

from sketchloom.llm import periodic_runs as pr
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


def plain(words, least=12):
    """All runs by comparing the words at every distance; the smallest period of a stretch wins."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= 2 * q:
                found.setdefault((i, length), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= least), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return [w for t, w in enumerate(words) if not any(s + q <= t < s + n for s, n, q in runs)]


def texts():
    rng = random.Random(6)
    out = []
    for k in range(700):
        some = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        n = rng.randrange(90)
        w = [rng.choice(some) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(n - a)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.2:
            w = w * 2
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(600))
    return [*out, " ".join(fib[-1]), " ".join(thue), "x " * 500, None, "", "   ", " ".join("abcdef" * 2), " ".join("abcde" * 2), " ".join("z" * 11), " ".join("z" * 12)]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_all_runs(least):
    all_ = texts()
    words, runs = pr.runs_of_texts(all_, least)
    for t, w, got in zip(all_, words, runs):
        assert w == h.words(t) and got == plain(w, least)
        assert pr.collapse(w, got) == plain_collapse(w, got)
        assert pr.runs_of_words(w, least) == got


def test_a_batch_is_its_texts(monkeypatch):
    all_ = texts()
    assert pr.runs_of_texts(all_)[1] == [pr.runs_of_texts([t])[1][0] for t in all_]


def test_misleading_hashes(monkeypatch):
    """Words with one hash for all: the words themselves decide."""
    all_ = [" ".join("abcabdabcabeabcabd" * 2), " ".join("ab" * 8 + "ac" * 8)]
    want = [plain(h.words(t)) for t in all_]
    real = pr.c.hash_words

    def same(t, lower=False):
        out = list(real(t, lower))
        out[0] = out[0] * pr.c.U64(0)
        return tuple(out)

    monkeypatch.setattr(pr.c, "hash_words", same)
    assert pr.runs_of_texts(all_)[1] == want


def test_long_runs():
    """Work does not grow with the square of a text."""
    rng = random.Random(8)
    for p in (1, 3, 5000):
        unit = [f"w{rng.randrange(50)}" for _ in range(p)]
        w = (unit * (40_000 // p + 1))[:40_000] + ["end"]
        got = pr.runs_of_texts([" ".join(w)])[1][0]
        assert max((n, -q) for _, n, q in got) == (40_000, -len(set(unit)) if p == 1 else -p)


def test_rows(spark):
    rows = h.odd_rows()
    for docs in (h.frame(spark, rows), h.frame(spark, rows).withColumnRenamed("key", "runs").withColumnRenamed("spans", "a.b")):
        got = pr.periodic_runs(docs).collect()
        want = []
        for doc_id, t, *_ in rows:
            w = h.words(t)
            runs = plain(w) if len(w) < 1000 else pr.runs_of_words(w)
            want.append((doc_id, len(w), runs, b" ".join(plain_collapse(w, runs)).decode()))
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert pr.periodic_runs(h.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(h.frame(spark, []), 1)


def brute(doc_id, text):
    w = h.words(text)
    n = len(w)
    crc = zlib.crc32(str(doc_id).encode())
    g = crc // 10
    if crc % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain(w) if n < 700 else pr.runs_of_words(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(plain_collapse(w, runs))))


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in pr.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert got == {i: brute(i, t) for i, t in docs}


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in h.odd_rows()] + [(k, f"one two {k}" * (k % 3)) for k in range(1000, 1300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = [(i, *(brute(i, t) if i is not None else brute("x1", t))) for i, t in rows]
    assert zlib.crc32(b"x1") % 10 and got == sorted(want, key=str)
