"""Every operator against a plain version, on rows with nulls, copies, ties and long texts."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import additive_quantisation as aq
from sketchloom.llm import byte_cnn, common, fingerprints, grammar_tokens, label_propagation, lsh_forest, mixing, sentencepiece_codec, substring_dedup, toxic_passages
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


def test_word_hashes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé漢") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 3000]
    old, common.SLICE_BYTES = common.SLICE_BYTES, 64
    got, at, *_ = common.hash_words(texts)
    common.SLICE_BYTES = old
    again, *_ = common.hash_words(texts)
    assert (got == again).all()
    seen = {}
    for i, t in enumerate(texts):
        w = h.words(t)
        assert at[i + 1] - at[i] == len(w)
        for word, x in zip(w, got[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)
    spans = common.Spans(got, common.BASES[0])
    a, b = spans.get(np.array([0, 3]), np.array([5, 9]))
    assert a == common.Spans(got[:5], common.BASES[0]).get(np.array([0]), np.array([5]))[0] and b == common.Spans(got[3:9], common.BASES[0]).get(np.array([0]), np.array([6]))[0]


# ------------------------------------------------------------------ 1
def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(3, 9, rng.integers(0, 400)).astype(np.uint32), np.uint32(2)) for _ in range(60)]
    docs += [np.append(np.full(999, 5, np.uint32), np.uint32(2))] * 3 + [np.array([2], np.uint32)] * 4
    block = grammar_tokens.Block.build(docs, 50, 2)
    back = grammar_tokens.Block.load(block.dump())
    assert len(block.seq) < sum(map(len, docs)) / 2 and len(block.rules)
    assert all((a == b).all() for a, b in zip(docs, back.documents()))
    assert all((docs[i] == back.document(i)).all() for i in range(len(docs)))
    for i in (0, 7, 60):
        a = len(docs[i]) // 3
        assert (docs[i][a : a + 50] == back.part(i, a, min(a + 50, len(docs[i])))).all() and (docs[i] == back.part(i, 0, len(docs[i]))).all()
    assert back.lengths.max() >= 256  # a long run is one rule of rules
    for i, (x, y) in enumerate(back.rules.tolist()):
        n = sum(int(back.lengths[s - 50]) if s >= 50 else 1 for s in (x, y))
        assert n == back.lengths[i]


def plain_library():
    """The vocabulary as the library loads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(grammar_tokens.default_tokenizer())


def test_chunk_encoder():
    e = grammar_tokens.encoder(grammar_tokens.default_tokenizer())
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab  \n\t étheß漢🙂'!|#\x1c\x85 s1") for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", " ", "   ", "it's <|endoftext|> x"]
    texts += [t + rng.choice(["<|endoftext|>", " <|endoftext|>", "<|endoftext|> "]) + t for t in texts[:300]]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in plain_library().encode_batch(texts, add_special_tokens=False)]


def test_chunk_encoder_work(monkeypatch):
    """Words with one mark take no regular expressions, and new words don't copy all that are kept."""
    own = grammar_tokens.ChunkEncoder(grammar_tokens.encoder(grammar_tokens.default_tokenizer()).library)
    rng, searched, copied = random.Random(4), [], 0
    word = lambda: "".join(rng.choices("abcdeé", k=7))
    monkeypatch.setattr(grammar_tokens, "MIXED", type("Watched", (), {"fullmatch": lambda self, x: searched.append(x)})())
    for _ in range(40):
        text = " ".join(word() + rng.choice(["", ".", ",", "?"]) for _ in range(200))
        room = own.flat.base
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_special_tokens=False).ids
        copied += own.flat.base is not room
    assert not searched and copied < 15


def test_frequent_pairs():
    rng = np.random.default_rng(5)
    for least in (1, 2, 3, 12):
        for size in (0, 1, 11, 12, 500):
            key = rng.integers(0, 30, size, dtype=np.uint64)
            want = {k: n for k, n in zip(*(x.tolist() for x in np.unique(key, return_counts=True))) if n >= least}
            got, count = grammar_tokens._frequent(key.copy(), least)
            assert dict(zip(got.tolist(), count.tolist())) == want


def test_token_files(spark):
    rows = h.odd_rows()
    out = grammar_tokens.read_tokens(grammar_tokens.write_tokens(h.frame(spark, rows), block_tokens=500)).collect()
    lib = plain_library()
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    start, want = 0, []
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


@pytest.mark.parametrize("ids", [[None] * 30, [7] * 30])
def test_equal_ids_of_token_files_and_fingerprints(spark, ids):
    rng = random.Random(9)
    rows = [(i, h.sentence(rng, rng.randrange(12))) for i in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(grammar_tokens.read_tokens(grammar_tokens.write_tokens(frame, block_tokens=60)).collect(), key=lambda r: r.start)
    lib = plain_library()
    want = sorted(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for _, t in rows)
    assert [r.ids_crc32 for r in out] == [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in want]
    assert [r.start for r in out] == [0, *itertools.accumulate(r.n_tokens for r in out)][:-1]
    assert sorted(r.n_chars for r in fingerprints.fingerprints(frame).collect()) == sorted(len(t) for _, t in rows)


# ------------------------------------------------------------------ 2
def test_segments_are_maximal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 14)
        places = sorted(rng.sample(range(20), n))
        weights = [rng.choice([0.5, 1, 2, 0.2]) for _ in places]
        line = [-0.25] * 20
        for p, w in zip(places, weights):
            line[p] = w
        sums = [0.0, *itertools.accumulate(line)]

        def split(a, b):  # the best segment (shortest on ties), then what is left and right of it
            best = max(((round(sums[j] - sums[i], 9), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*split(a, i), (best[0], i, j - 1), *split(j, b)]

        got = [(round(s, 9), a, b) for s, a, b in toxic_passages.segments(places, weights, 0.25)]
        assert abs(sum(x[0] for x in got) - sum(x[0] for x in split(0, 20))) < 1e-9


def test_segments_one_by_one():
    """Weights without ties: every segment, its score and its ends."""
    rng = random.Random(14)
    for _ in range(400):
        n = rng.randrange(1, 16)
        places = sorted(rng.sample(range(24), n))
        weights = [rng.uniform(0.05, 1.5) for _ in places]
        line = [-0.25] * 24
        for p, w in zip(places, weights):
            line[p] = w
        sums = [0.0, *itertools.accumulate(line)]

        def split(a, b):
            best = max(((sums[j] - sums[i], i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            return [*split(a, best[1]), (round(best[0], 9), best[1], best[2] - 1), *split(best[2], b)]

        assert [(round(s, 9), a, b) for s, a, b in toxic_passages.segments(places, weights, 0.25)] == split(0, 24)


def test_toxicity_learns(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = h.sentence(rng, 60).split()
        toxic = i % 7 == 0
        if toxic:
            for k in rng.sample(range(60), 5):
                w[k] = rng.choice(["vexgrim", "Vexdolt,", "snarbol"])
        rows.append((i, " ".join(w)))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxic_passages.train(docs, spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxic_passages.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 7 == 0) for i, _ in rows)
    odd = h.frame(spark)
    assert toxic_passages.score(odd, model).count() == odd.count() and all(0 <= r.score <= 1 for r in toxic_passages.score(odd, model).collect())
    kept = toxic_passages.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    with pytest.raises(ValueError, match="smaller sample"):
        toxic_passages.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_features=3)
    none = toxic_passages.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("x") == (0.0, 0)
    one = toxic_passages.train(docs, spark.createDataFrame([(0, 0), (1, 0), (3, 0)], "doc_id long, toxic int"))
    assert one.score("x")[0] == 0.0


def test_toxicity_on_held_out_rows(spark):
    got = toxic_passages.op2_toxic_passages(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.6 * sum(r.toxic for r in got) and hit >= 0.8 * sum(r.predicted for r in got)


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("width", [5, 35])
def test_substring_dedup(spark, width):
    rows = h.odd_rows()
    got = substring_dedup.remove_repeats(h.frame(spark, rows), width).collect()
    all_, gone = h.repeats([r[1] for r in rows], width)
    want = [(r[0], len(w), sum(g), " ".join(x.decode() for x, y in zip(w, g) if not y)) for r, w, g in zip(rows, all_, gone)]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    if width == 35:
        kept = substring_dedup.strip_repeats(h.frame(spark, rows))
        assert kept.columns == h.frame(spark, rows).columns
        assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((w[0], w[3])) for w in want)


# ------------------------------------------------------------------ 4
def test_sharding(spark):
    rows = h.odd_rows(n=90) + [(10_000 + i, "hot", "en", "a", 3, 0.5, 7, "r", 1, "k", "s") for i in range(700)]
    got = label_propagation.shard(h.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    n = [len(by.get(s, [])) for s in range(24)]
    assert max(n) - min(n) <= 1 and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == 8 + len((text[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    again = label_propagation.shard(h.frame(spark, list(reversed(rows)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_linked_documents_come_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(1500)]
    got = label_propagation.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 0.2 * len(shards)


def cut_links(rows, got, shards=24):
    """For each text: how many of its documents are outside the shard that most of them are in."""
    at = {r.doc_id: r.shard for r in got}
    by = {}
    for i, t in rows:
        by.setdefault(t, {}).setdefault(at[i], 0)
        by[t][at[i]] += 1
    return {t: sum(v.values()) - max(v.values()) for t, v in by.items()}, {t: len(v) for t, v in by.items()}


def test_groups_are_cut_only_if_they_must_be(spark):
    rng = random.Random(3)
    sizes = {"a": 60, "b": 55, "c": 40, "d": 230, "e": 100, "f": 7, "g": 3}  # a shard holds 100 rows
    rows = [(t, k) for t, m in sizes.items() for k in range(m)] + [(f"pair {i}", k) for i in range(300) for k in range(2)]
    rows += [(f"alone {i}", 0) for i in range(2400 - len(rows))]
    rng.shuffle(rows)
    rows = [(i, t) for i, (t, _) in enumerate(rows)]
    got = label_propagation.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    n = [sum(r.shard == s for r in got) for s in range(24)]
    assert n == [100] * 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(100))
    lost, pieces = cut_links(rows, got)
    assert pieces["d"] == 3 and lost["d"] == 130  # the least possible for 230 rows
    assert {t for t, k in pieces.items() if k > 1} == {"d"}


def test_nothing_but_linked_documents(spark):
    rows = [(i, f"text {i % 340}") for i in range(1020)] + [(2000 + i, f"big {i % 7}") for i in range(210)]
    got = label_propagation.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(n) - min(n) <= 1 and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(n[s])]
    _, pieces = cut_links(rows, got)
    assert sum(k > 1 for k in pieces.values()) <= 23


def test_large_groups_are_placed_first():
    room = label_propagation.capacities(1000, 7)
    assert sum(room) == 1000 and max(room) - min(room) <= 1
    got = label_propagation.place_large([(1, 300), (2, 140), (3, 60)], room)
    assert [x for x, _ in got[1]] == [143, 143, 14] and len(got[2]) == len(got[3]) == 1
    assert label_propagation.place_large([], room) == {}


# ------------------------------------------------------------------ 5
def test_targets():
    t = mixing.targets([100, 100, 100, 0], [5, 2, 1, 5])
    assert sum(t) == Fraction(450) and t[0] == 200 and t[3] == 0 and t[1] / t[2] == 2 or t[1] == 200
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0]


def test_flow_is_cheapest():
    rng = random.Random(9)
    for _ in range(40):
        pats = [(frozenset(rng.sample(range(3), rng.randrange(1, 4))), rng.randrange(4)) for _ in range(3)]
        want = [rng.randrange(5) for _ in range(3)]
        got = mixing.route(pats, want)

        def possible(give):  # Hall's condition for sending exactly `give`
            return all(sum(g for g, (m, _) in zip(give, pats) if m <= set(s)) <= sum(want[x] for x in s) for k in range(4) for s in itertools.combinations(range(3), k))

        cost = lambda give: sum(max(0, g - n) for g, (_, n) in zip(give, pats))
        every = [g for g in itertools.product(*[range(2 * n + 1) for _, n in pats]) if possible(g)]
        best = max(every, key=lambda g: (sum(g), -cost(g)))
        assert possible(got) and (sum(got), cost(got)) == (sum(best), cost(best))


def test_mixing(spark):
    rows = h.odd_rows(n=300)
    docs = h.frame(spark, rows)
    run = lambda d: mixing.mix(d.select("doc_id", "text", F.array("source").alias("sources")), ["doc_id"]).collect()
    got = run(docs)
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, run(docs)))
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + len(h.words(r[1]))
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    aims = dict(zip(order, mixing.targets([total[s] for s in order], [5, 2, 1, 5, 2])))
    per = {(total[s], float(aims[s])) for s in order}
    taken = {}
    for r in got:
        assert (r.source_size, r.target) in per
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    largest = max(len(h.words(r[1])) for r in rows)
    assert all(abs(v - k[1]) <= largest / 2 + 1 for k, v in taken.items())
    out = mixing.repeat_mixed(docs)
    assert out.columns == docs.columns and sum(len(h.words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs.select("*", F.array("source").alias("m")), docs.columns, "m").toDF(*docs.columns, "a", "b", "c", "taken").collect())


def test_flow_of_many_patterns():
    import time

    rng = random.Random(2)
    pats = [(frozenset(rng.sample(range(12), rng.randrange(1, 5))), rng.randrange(1, 500)) for _ in range(20_000)]
    want = [int(sum(n for m, n in pats if s in m) * rng.choice([0.1, 0.4, 1.5])) for s in range(12)]
    began = time.time()
    got = mixing.route(pats, want)
    assert time.time() - began < 60 and all(0 <= g <= 2 * n for g, (_, n) in zip(got, pats)) and sum(got) <= sum(want)


def test_overlapping_sources_get_what_the_flow_says(spark):
    """Three sources with shared documents; the targets can't be met from single members alone."""
    rng = random.Random(21)
    kinds = [["x"], ["x", "y"], ["y", "z"], ["z"], ["x", "y", "z"], [None, "z"]]
    rows = []
    for i in range(900):
        members = kinds[i % 6] if i % 3 else kinds[1]
        rows.append((i, "w " * rng.randrange(1, 30), members))
    frame = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = {r.doc_id: r for r in mixing.mix(frame, ["doc_id"]).collect()}
    order = ["x", "y", "z", None]
    sizes = {}
    for i, t, m in rows:
        key = frozenset(order.index(s) for s in m)
        sizes[key] = sizes.get(key, 0) + len(t.split())
    per = [sum(n for k, n in sizes.items() if s in k) for s in range(4)]
    aims = [round(a) for a in mixing.targets(per, [5, 2, 1, 5])]
    pats = sorted(sizes.items(), key=lambda x: sorted(x[0]))

    def possible(give):  # by Hall's condition
        return all(sum(g for g, (m, _) in zip(give, pats) if m <= set(s)) <= sum(aims[x] for x in s) for k in range(5) for s in itertools.combinations(range(4), k))

    taken = {}
    for i, t, m in rows:
        assert got[i].taken in (0, len(t.split()), 2 * len(t.split()))
        key = frozenset(order.index(s) for s in m)
        taken[key] = taken.get(key, 0) + got[i].taken
    flow = mixing.route(pats, aims)
    assert possible(flow) and all(abs(taken[m] - g) <= 30 for (m, _), g in zip(pats, flow))
    # No pattern is repeated while another that could take its place has words left over.
    free = [n - g for (_, n), g in zip(pats, flow)]
    for i, (m, n) in enumerate(pats):
        for j, (o, _) in enumerate(pats):
            if flow[i] > n and free[j] > 0 and m <= o:
                raise AssertionError((m, o))


def test_odd_columns_are_kept(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", {"k": i}, i) for i in range(40)], "doc_id long, text string, source string, `a.map` map<string,int>, once long")
    out = mixing.repeat_mixed(docs)
    assert out.columns == docs.columns and sum(1 for _ in out.collect()) == 60


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x", "y"] if i % 2 else ["x"]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), ["doc_id"]).collect()
    assert all(r.taken <= 2 * r["size"] for r in got) and sum(r.taken for r in got) > 0


# ------------------------------------------------------------------ 6
def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = byte_cnn.train(docs)
    got = byte_cnn.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(byte_cnn.remainder() == 2).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.85 * len(got)
    odd = {r.doc_id: r for r in byte_cnn.identify(h.frame(spark), model).collect()}
    assert odd[400].lang_pred == odd[401].lang_pred == odd[402].lang_pred == odd[407].lang_pred == "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert byte_cnn.train(docs.where("false")) is None and {r.lang_pred for r in byte_cnn.identify(docs.limit(3), None).collect()} == {"und"}


def test_letters_are_of_category_l():
    import unicodedata

    odd = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert all(byte_cnn.has_letter(x) == unicodedata.category(x).startswith("L") for x in odd)
    assert not byte_cnn.has_letter("½ ² ① 12 _!") and byte_cnn.has_letter("½ ² a")
    assert byte_cnn.ByteCnn(["a", "b"]).predict(["½ ² ①", None, "漢"])[:2] == [("und", 1.0)] * 2


def test_gradients_are_slopes():
    """Back-propagation against differences of the loss."""
    m = byte_cnn.ByteCnn(["a", "b", "c"])
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (6, byte_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for k in byte_cnn.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))

    def loss():
        z = m.logits(x)
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(6), y]).mean())

    grads = m.gradients(x, y)
    for k in byte_cnn.NAMES:
        w, g = getattr(m, k), grads[k]
        for at in [np.unravel_index(i, w.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-4 * max(1, abs(g[at])) + 1e-6


def test_gradients():
    m = byte_cnn.ByteCnn(["a", "b"])
    rng = np.random.default_rng(0)
    x = rng.integers(97, 101, (200, byte_cnn.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 2, 200)
    x[y == 1, ::9] = 122
    m.train(x, y, epochs=8)
    assert (m.logits(x).argmax(1) == y).mean() > 0.95
    texts = ["ab" * 400, "z" * 5]
    alone = [m.predict([t])[0] for t in texts]
    assert [p for p, _ in m.predict(texts)] == [p for p, _ in alone]


# ------------------------------------------------------------------ 7
@pytest.mark.parametrize("region", [256, 3])
def test_near_duplicates(spark, region):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in h.odd_rows()]
    base = h.sentence(rng, 80).split()
    for k in range(30):  # a chain of texts, each near the next
        base = base[:]
        base[(k * 3) % 80] = f"z{k}"
        rows.append((1000 - k, " ".join(base)))
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, region=region).collect()
    want = h.near_components(rows, n=2)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {i: len(h.shingle_set(t, 2)) for i, t in rows if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)
    if region == 256:
        frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node string")
        kept = lsh_forest.drop_near_duplicates(frame, shingle=2)
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == frame.columns and sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_links_inside_large_regions(spark):
    rng = random.Random(8)
    texts = [h.sentence(rng, 60) for _ in range(60)]
    texts += [f"{t} last" for t in texts[:12]]  # each near one other text only
    flat, at = lsh_forest.shingle_sets(texts, 2)
    node, n = lsh_forest.set_keys(flat, at).view(np.int64).tolist(), np.diff(at).tolist()
    sig = bytes(4 * len(lsh_forest.FLIPS))  # no label tells them apart: one region in every tree
    classes = spark.createDataFrame([(*r, sig) for r in zip(node, n, range(72))], "node long, n long, doc_id long, sig binary")
    got = lsh_forest.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classes, shingle=2, region=2).collect()
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset((node[i], node[60 + i])) for i in range(12)}


def template_family(rng, members, planted):
    """Texts of one template, each too far from the others (0.77), and for some one partner (0.82)."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(400)]
    rows = []
    for _ in range(members):
        rows.append(base[:340] + [word() for _ in range(50)] + base[390:])
    for p in range(planted):
        w = rows[p]
        rows.append(w[:100] + [word() for _ in range(38)] + w[138:])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_partners_inside_a_large_family(spark):
    rows = template_family(random.Random(5), 400, 40)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i, _ in rows}


def test_five_words_by_default(spark):
    rng = random.Random(12)
    rows = [(r[0], r[1]) for r in h.odd_rows(7)]
    base = h.sentence(rng, 100).split()
    for k in (1, 2, 5, 9):  # five scattered words apart: near by two words, not by five
        w = base[:]
        for j in range(5):
            w[j * 19 + k] = f"q{k}{j}"
        rows.append((2000 + k, " ".join(w)))
    rows.append((1999, " ".join(base)))
    want = h.near_components(rows)
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == want.get(r.doc_id) for r in got) and want[2005] == 2005
    assert h.near_components(rows, n=2)[2005] == 1999


def test_one_id_with_several_texts(spark):
    rng = random.Random(13)
    base = h.sentence(rng, 120)
    rows = [(1, base), (2, base + " end"), (2, h.sentence(rng, 90)), (3, None), (3, ""), (4, base), (4, base), (2, base + " end"), (5, h.sentence(rng, 3)), (5, None)]
    frame = spark.createDataFrame([(i, t, {"a": k % 2}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `dotted.name` map<string,int>")
    kept = lsh_forest.drop_near_duplicates(frame)
    want = [(1, base), (2, rows[2][1]), (3, None), (5, rows[8][1]), (5, None)]
    assert kept.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 201)]
    rng = random.Random(1)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.comp for r in lsh_forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[201] == 200


# ------------------------------------------------------------------ 8
def test_fingerprints(spark):
    rows = h.odd_rows()
    got = fingerprints.fingerprints(h.frame(spark, rows)).collect()
    order = sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(map(str, want))
    prints = {}
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or "" if r.doc_id is not None else None
        if text is not None:
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[""] == ""


def test_likeness_is_the_jaccard_of_phrase_names():
    rng = random.Random(31)
    letters = "abcdefghij klmnop"
    errors = []
    for k in range(40):
        a = "".join(rng.choice(letters) for _ in range(1500))
        cut = rng.randrange(1500)
        b = a[:cut] + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 1500 - cut + 2)))
        levels = fingerprints.parse([a, b], max(fingerprints.LEVELS))
        names = [set().union(*[set(levels[v][0][levels[v][1][i] : levels[v][1][i + 1]].tolist()) for v in fingerprints.LEVELS]) for i in (0, 1)]
        true = len(names[0] & names[1]) / len(names[0] | names[1])
        one, two = fingerprints.sketches([a, b])
        for own, sketch in zip(names, (one, two)):  # the least of all hashed names
            assert sketch.tolist() == sorted({int(fingerprints.c.mix(np.array([x], np.uint64) * fingerprints.CODE)[0] >> np.uint64(32)) for x in own})[: fingerprints.SKETCH]
        errors.append(abs(fingerprints.likeness(one, two) - true))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.06


def test_parsing_is_local():
    """Equal substrings have equal interior names, wherever they stand."""
    rng = random.Random(8)
    mid = "".join(rng.choice("abcdefg é漢") for _ in range(600))
    texts = ["".join(rng.choice("abcdefg") for _ in range(k)) + mid + "tail" * k for k in (0, 1, 7, 100)]
    for level in (1, 2, 3):
        names, at = fingerprints.parse(texts, level)[level]
        sets = [set(names[a:b].tolist()) for a, b in zip(at, at[1:])]
        alone, _ = fingerprints.parse([mid], level)[level]
        assert all(len(set(alone.tolist()) & s) >= 0.7 * len(set(alone.tolist())) for s in sets)
    a, b, other = fingerprints.sketches([mid, mid + "x" * 40, "".join(rng.choice("hijk lmn") for _ in range(600))])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.7 and fingerprints.likeness(a, other) < 0.1
    one = fingerprints.sketches(["", "a", "ab", "a" * 1000, "\U0010ffff" * 9])
    assert len(one[0]) == 0 and all(len(x) for x in one[1:])


# ------------------------------------------------------------------ 9
def test_codec_equals_library():
    import sentencepiece

    path = sentencepiece_codec.default_model()
    own, lib = sentencepiece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab  \n\tétheinß漢字🙂▁'!|#") for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 300, "", " ", "x  y   z    w", " " * 37, None]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode([t or "" for t in texts])
    assert own.decode(ids) == [(t or "").replace("▁", " ") for t in texts]


def test_very_long_words():
    import sentencepiece

    path = sentencepiece_codec.default_model()
    own, lib = sentencepiece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    old, sentencepiece_codec.PROBES = sentencepiece_codec.PROBES, 1000
    texts = ["".join(rng.choice(abc) for _ in range(n)) for abc, n in (("abcdeinrst", 9000), ("漢字かな", 5000), ("a", 3000), ("étheinßu!🙂.", 4000), ("xyz", sentencepiece_codec.LONG - 1), ("xyz", sentencepiece_codec.LONG))]
    got = own.encode(texts)
    sentencepiece_codec.PROBES = old
    assert [x.tolist() for x in got] == lib.encode(texts) and own.decode(got) == texts


def test_cuts_cross_no_piece():
    own = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    words = ["▁there,", "▁a.\nb", "▁漢字", "▁word"]
    parts, first = own.cuts(words)
    assert ["".join(parts[a:b]) for a, b in zip(first, first[1:])] == words and len(parts) > len(words)
    inside = {x + y for p in own.by_text for x, y in zip(p, p[1:])}
    assert all(parts[k - 1][-1] + parts[k][0] not in inside for k in range(1, len(parts)) if k not in first)


def test_unigram_viterbi(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    keep = [p for p in proto.pieces if p.type != 1]
    names = sorted({"▁", *"abc", *("".join(rng.choice("▁abc" if k == 0 else "abc") for k in range(rng.randrange(2, 5))) for _ in range(60))})
    del proto.pieces[:]
    proto.pieces.extend(keep)
    score = {n: -rng.random() * 9 - 0.5 for n in names}
    for n in names:
        proto.pieces.add(piece=n, score=score[n], type=1)
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    own = sentencepiece_codec.Codec(str(path))
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        full = "▁" + word
        best = [0.0] + [-1e18] * len(full)
        for j in range(1, len(full) + 1):
            best[j] = max((best[i] + score[full[i:j]] for i in range(j) if full[i:j] in score), default=-1e18)
        for ids in (own.encode([word])[0], own._long(full)):
            assert abs(sum(own.scores[i] for i in ids) - best[-1]) < 1e-4 and own.decode([ids]) == [word]


def test_encode_documents(spark):
    rows = h.odd_rows()
    got = sentencepiece_codec.encode_documents(h.frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in got) == sorted(str((r[0], r[1] or "")) for r in rows)
    assert all(len(r.ids) == r.n_pieces and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


# ------------------------------------------------------------------ 10
def test_search_is_exact_where_it_looks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[500:560] = x[7]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [float("inf")] + [1.0] * 15), (2400, [None] + [1.0] * 15), (2500, [1.0]), (None, [1.0] * 16), (3, x[3].tolist())]
    got = {}
    for r in aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    x, found = x.astype(np.float64), 0
    for q, hits in got.items():
        hits.sort()
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [k for k, *_ in hits] == list(range(1, 11)) and all(v != q and abs(s - d[v]) < 1e-12 for _, v, s in hits)
        assert hits == sorted(hits, key=lambda t: (t[2], t[1]))
        d[q] = np.inf
        found += len({v for _, v, _ in hits} & set(np.lexsort((np.arange(900), d))[:10].tolist()))
    assert found >= 0.9 * 10 * len(got)


def test_many_equal_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + int(i), x[0].tolist()) for i in rng.permutation(900)]  # more than are reranked
    rows += [(5000, (x[100] + 0.001).tolist())] * 15 + [(5000, (x[100] + 0.002 * j).tolist()) for j in range(2, 14)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = {}
    for r in aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 500, 100):
        d = {}
        for i, v in rows:
            d[i] = min(d.get(i, np.inf), np.sqrt(((np.array(v) - x[q]) ** 2).sum()))
        want = sorted((s, i) for i, s in d.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(want)]


def test_recall_where_the_codes_decide():
    """100,000 clustered vectors in one partition: about one in a hundred is measured exactly."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 32))
    x = (centres[rng.integers(0, 400, 100_000)] + 0.4 * rng.normal(size=(100_000, 32))).round(4)
    model = aq.AdditiveQuantiser.fit(x[:20_000], 8, 64)
    codes, norms = model.encode(x)
    q_ids = np.arange(0, 100_000, 2_500)
    measured = []
    old, aq.distances = aq.distances, lambda a, b: (measured.append(a.shape[0] * a.shape[1]), old(a, b))[1]
    ids = pa.array([[i] for i in range(len(x))], pa.list_(pa.int64()))
    table = pa.table({"ids": ids, "v": pa.array(list(x), pa.list_(pa.float64())), "code": pa.array([r.tobytes() for r in codes], pa.binary()), "norm": pa.array(norms)})
    out = pa.Table.from_batches(list(aq._search(model, q_ids, x[q_ids], 10, 320)(table.combine_chunks().to_batches(max_chunksize=10_000)))).to_pandas()
    aq.distances = old
    hit = 0
    for i in q_ids:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & set(out.vec_id[out.query_id == i].tolist()))
    assert hit >= 0.9 * 10 * len(q_ids) and sum(measured) <= 0.04 * len(x) * len(q_ids)


def test_huge_and_ambiguous_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1e200, 0.0]), (2, [-1e308, 1e308]), (3, [0.5, 0.25]), (3, [9.0, 9.0])]
    got = sorted((r["rank"], r.vec_id, r.score) for r in aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [(k, v) for k, v, _ in got] == [(1, 3), (2, 1), (3, 2)] and got[0][2] == 0.25 and got[1][2] == 1e200 and abs(got[2][2] / 2**0.5 / 1e308 - 1) < 1e-9


def test_few_vectors(spark):
    got = aq.search(spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 5), (0, 2, 7)]


def test_codebooks_fit_a_byte():
    x = np.random.default_rng(1).normal(size=(400, 4))
    with pytest.raises(ValueError):
        aq.AdditiveQuantiser.fit(x, 2, 257)
    assert aq.AdditiveQuantiser.fit(x, 2, 256).encode(x)[0].max() > 200


def test_mixing_with_many_patterns(spark, monkeypatch):
    """Plans too large to broadcast are joined, with the same result."""
    docs = spark.createDataFrame([(i, "w " * (i % 9), [f"s{i % 5}", f"t{i % 7}"]) for i in range(200)], "doc_id long, text string, sources array<string>")
    want = sorted(mixing.mix(docs, ["doc_id"]).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    assert sorted(mixing.mix(docs, ["doc_id"]).collect()) == want


# ------------------------------------------------------------------ odd columns
def test_filters_keep_any_columns(spark):
    """Dotted names, and lengths that are ints."""
    rows = h.odd_rows()
    docs = h.frame(spark, rows).withColumnRenamed("key", "a.b").withColumn("n_chars", F.col("n_chars").cast("int")).withColumn("`x y`", F.lit("z"))
    model = toxic_passages.train(docs, spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, toxic int"))
    kept = substring_dedup.strip_repeats(docs)
    assert kept.schema == docs.schema
    assert all(r["n_chars"] == len(r["text"]) and r["a.b"] == "k" for r in kept.collect())
    low = toxic_passages.drop_toxic(docs, model, 2.0)
    assert low.schema == docs.schema and sorted(map(str, low.collect())) == sorted(map(str, docs.collect()))


# ------------------------------------------------------------------ empty tables
def test_empty_tables(spark):
    docs = h.frame(spark, [])
    model = toxic_passages.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (
        grammar_tokens.read_tokens(grammar_tokens.write_tokens(docs)), toxic_passages.score(docs, model), toxic_passages.drop_toxic(docs, model), substring_dedup.remove_repeats(docs), substring_dedup.strip_repeats(docs),
        label_propagation.shard(docs), mixing.mix(docs.select("doc_id", "text", F.array("source").alias("sources")), ["doc_id"]), mixing.repeat_mixed(docs), byte_cnn.identify(docs, byte_cnn.train(docs)),
        lsh_forest.near_duplicates(docs), lsh_forest.drop_near_duplicates(docs), fingerprints.fingerprints(docs), sentencepiece_codec.encode_documents(docs), aq.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0


def test_worker_memory(monkeypatch):
    """A reused worker forgets the encoder's words before near-dedup reads texts, in small parts."""
    texts = ["".join(random.Random(i).choices("ab ", k=300_000)) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    path = sentencepiece_codec.default_model()
    own = sentencepiece_codec.codec(path)
    read = []
    plain = lsh_forest.shingle_sets
    monkeypatch.setattr(lsh_forest, "shingle_sets", lambda t, n: read.append(sum(map(len, t))) or plain(t, n))
    for kernel in (lsh_forest._describe(5), lsh_forest._exact(5)):
        assert sum(x.num_rows for x in sentencepiece_codec._encode(path)(iter([batch.slice(0, 1)]))) == 1 and own.cache and own.parts
        nodes = lsh_forest.set_keys(*plain(texts, 5)).view(np.int64)
        got = list(kernel(iter([batch.append_column("node", pa.array(nodes))])))
        assert not own.cache and not own.parts and len(own.flat) == len(own.part_flat) == 0
        assert sum(x.num_rows for x in got) == 20 and max(read) <= 2_400_000
