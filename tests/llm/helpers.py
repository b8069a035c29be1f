"""Odd rows for every operator, and plain versions of what they compute."""

import random
import string

WORDS = [a + b for a in "ka lo mi ne ru".split() for b in "ta si vo".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, rid string, node long, key string, spans string"


def words(t):
    return (t or "").encode().split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "é"]) for _ in range(n))


def odd_rows(seed=1, n=40):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.choice([3, 20, 80]))) for i in range(n)]
    base = sentence(rng, 120)
    for k in range(6):  # near copies
        w = base.split()
        w[k * 7] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, base) for k in range(4)]  # exact copies
    rows += [(300 + k, f"{sentence(rng, 30)} {passage} {sentence(rng, 10)}") for k in range(3)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "one"), (405, "Two words"), (406, "two WORDS"), (407, "!!! 123"), (408, sentence(rng, 6000)), (409, "x" * 5000), (410, "a b " * 60)]
    rows += [(500, "same row here"), (500, "same row here"), (None, "no id at all"), (None, None)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "z", "é", None]), len(t or ""), 0.5, 7, "r", 1, "k", "s") for i, t in rows]


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(odd_rows() if rows is None else rows, schema)


def repeats(texts, width):
    """Which words of each text are covered by a window that occurs elsewhere."""
    all_ = [words(t) for t in texts]
    count = {}
    for w in all_:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in all_:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return all_, out


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(t, n=5):
    w = words((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_components(rows, percent=80, n=5):
    """doc_id -> least doc_id reachable, by comparing all pairs."""
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, q in sets[:a]:
            if s and q and 100 * len(s & q) >= percent * len(s | q):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}
