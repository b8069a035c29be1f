"""Byte-level BPE against the tiktoken library, on odd texts and odd rows."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from sketchloom.llm import byte_bpe
from tests.llm import helpers as h

PATH, PATTERN = byte_bpe.default_files()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    some = "aab  \n\t étheß漢🙂'!|#\x1c\x85 s1’ 　日本０²ابت́"
    out = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(2000)]
    out += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)]
    return [*out, "", " ", "it's <|endoftext|> x", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 500 + "x", "� é"]


@pytest.mark.parametrize("pattern", [PATTERN, PATTERN + "|x", r"\s+|\S"])
def test_ids_equal_the_library(pattern):
    """The usual pattern, and others by the splitter's general form."""
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    own = byte_bpe.codec(PATH, pattern)
    assert (own.chunks is not None) == (pattern == PATTERN)
    all_ = texts()
    ids, n = own.encode(all_)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode_ordinary(t) for t in all_]
    data, _ = own.token_bytes(ids)
    assert bytes(data) == "".join(all_).encode()


def test_long_texts_in_parts(library, monkeypatch):
    own = byte_bpe.codec(PATH, PATTERN)
    rng = random.Random(4)
    words = ["word", "Ünï", "12", "it's", "  ", "\n", "x.", "—", "漢字", " \t"]
    for size in (1, 7, 40):
        monkeypatch.setattr(byte_bpe, "PART_CHARS", size)
        for _ in range(60):
            text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ""]) for _ in range(80))
            parts = own.parts(text)
            assert "".join(parts) == text and len(parts) > 1
            assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_offsets_and_split_characters():
    own = byte_bpe.codec(PATH, PATTERN)
    all_ = texts()[-800:]
    ids, n = own.encode(all_)
    data, at = own.token_bytes(ids)
    token_at = np.concatenate([[0], np.cumsum(n)])
    start, end, cut = byte_bpe.char_spans(data, at, at[token_at], n)
    found = 0
    for k, text in enumerate(all_):
        place = [0]
        for x in text:
            place.append(place[-1] + len(x.encode()))
        for t in range(token_at[k], token_at[k + 1]):
            a, b = at[t] - at[token_at[k]], at[t + 1] - at[token_at[k]]
            assert start[t] == max(i for i, p in enumerate(place[:-1]) if p <= a) and end[t] == min(i for i, p in enumerate(place) if p >= b)
            assert cut[t] == (a not in place or b not in place)
            found += cut[t]
        said = own.texts(ids[token_at[k] : token_at[k + 1]])
        assert "".join(said) == text and len(said) == n[k]
    assert found > 100


def test_damaged_ids():
    own = byte_bpe.codec(PATH, PATTERN)
    ids, _ = own.encode(["a漢b🙂c"])
    for a in range(len(ids)):
        for b in range(a, len(ids) + 1):
            part = ids[a:b]
            assert "".join(own.texts(part)) == bytes(own.token_bytes(part)[0]).decode("utf-8", "replace")
    with pytest.raises(ValueError):
        own.token_bytes(np.array([60_000]))
    with pytest.raises(ValueError):
        own.token_bytes(np.array([-1]))


def test_rows(spark, library):
    rows = h.odd_rows()
    frame = h.frame(spark, rows)
    clash = frame.withColumnRenamed("key", "ids").withColumnRenamed("spans", "a.b")
    for docs in (frame, clash):
        got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
        want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(h.frame(spark, []))).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in byte_bpe.op13_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
