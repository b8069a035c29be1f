"""Byte-level BPE encoding and decoding over Arrow batches (operator 13).

A rank file (base64 of a token's bytes, its rank) is turned into a ``tokenizers`` model: each
byte is written as one printable character (``ALPHABET``), and each token's merge is found by
merging its own bytes by lower ranks. Texts are split by the pattern, each piece is merged
alone, and a piece that is a token as a whole is that token. Ids are ranks. With the usual
pattern, distinct words go to the library once while up to ``MOST_CHUNKS`` are kept.

Long texts go to the library in parts, cut between a letter or digit and a single space,
where no match of a pattern that takes white space only at its front can cross (``CUT``); so
memory is bounded by the longest stretch without such a place, and ids don't change.

Offsets come from the bytes: ids give token lengths in bytes, their sums byte offsets, and a
count of the bytes that begin a character maps these to characters. A token that holds part
of a character spans the whole of it. Decoding looks up each id's bytes in one table; a
character split over several tokens is whole again once its last byte is there
(``texts``), and what never becomes whole is U+FFFD, as in the usual decoders.

Defined results: null text is empty; an empty text has no ids; repeated rows and equal ids
are kept as they are; ids without a token raise; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c
from sketchloom.llm.grammar_tokens import ChunkEncoder

PART_CHARS = 1 << 18
MOST_CHUNKS = 300_000
#: The splitter that the library has built in, and keeps distinct words apart for.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile("[A-Za-z0-9](?= [^ ])")
OFFSETS = ", char_starts array<int>, char_ends array<int>"


def byte_alphabet() -> list[str]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts of every token in order of rank, as far as lower ranks lead to two parts."""
    none = max(ranks.values(), default=0) + 1
    out = []
    for token, own in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            i = rank.index(min(rank))
            if rank[i] >= own:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBPE:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        merges = [("".join(ALPHABET[x] for x in a), "".join(ALPHABET[x] for x in b)) for a, b in merges_of(ranks)]
        vocabulary = {"".join(ALPHABET[x] for x in token): rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.chunks = None
        if pattern == USUAL:
            self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            self.chunks = ChunkEncoder(self.library, MOST_CHUNKS)
        else:
            self.library.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._table(self.library.get_vocab())

    def _table(self, vocabulary: dict[str, int]) -> None:
        """Bytes of all tokens in one array, by the alphabet read backwards."""
        byte_of = {x: b for b, x in enumerate(ALPHABET)}
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for name, i in vocabulary.items():
            tokens[i] = bytes(map(byte_of.__getitem__, name))
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    # -------------------------------------------------------------- encoding
    @staticmethod
    def parts(text: str) -> list[str]:
        if len(text) <= PART_CHARS:
            return [text]
        out, a = [], 0
        while len(text) - a > PART_CHARS and (m := CUT.search(text, a + PART_CHARS)):
            out.append(text[a : m.end()])
            a = m.end()
        return [*out, text[a:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        ids, n = [], np.zeros(len(texts), np.int64)
        parts = [(i, p) for i, t in enumerate(texts) for p in self.parts(t) if p]
        first = 0
        while first < len(parts):
            last, room = first, PART_CHARS
            while last < len(parts) and (room > 0 or last == first):
                room -= len(parts[last][1])
                last += 1
            some = [p for _, p in parts[first:last]]
            for (i, _), x in zip(parts[first:last], self.chunks.encode(some) if self.chunks else self._library_ids(some)):
                n[i] += len(x)
                ids.append(x)
            first = last
        return (np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)), n

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        if self.chunks:
            self.chunks._forget()

    # -------------------------------------------------------------- decoding
    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one array, and where each id's begin (and the last's end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id without a token")
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(at[-1]) + np.repeat(self.at[ids] - at[:-1], size)], at

    def texts(self, ids: np.ndarray) -> list[str]:
        """The text that each id adds: a character comes with the id that holds its last byte."""
        data, at = self.token_bytes(np.asarray(ids, np.int64))
        text = bytes(data).decode("utf-8", "replace")
        ends = np.cumsum([len(x.encode()) if x != "�" else 0 for x in text]) if "�" not in text else _ends_with_faults(bytes(data))
        done = np.searchsorted(ends, at, side="right")
        return [text[a:b] for a, b in zip(done, done[1:])]


def _ends_with_faults(data: bytes) -> np.ndarray:
    """Where each character of the text of damaged bytes ends: read piece by piece."""
    ends, at = [], 0
    while at < len(data):
        try:
            good, fault = data[at:].decode("utf-8"), 0
        except UnicodeDecodeError as e:
            good, fault = data[at : at + e.start].decode("utf-8"), e.end - e.start
        for x in good:
            at += len(x.encode())
            ends.append(at)
        if fault:
            at += fault
            ends.append(at)
    return np.array(ends, np.int64)


def char_spans(data: np.ndarray, at: np.ndarray, doc_at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters that each token spans (from, to; counted in its own text), and whether it cuts one.

    ``at`` holds the tokens' places in the bytes of all texts, ``doc_at`` the texts', ``n`` the
    tokens of each text."""
    begins = np.concatenate([(data & 0xC0) != 0x80, [True]])
    chars = np.concatenate([[0], np.cumsum(begins[:-1])])  # characters that begin before a byte
    shift = np.repeat(chars[doc_at[:-1]], n)
    start, end = at[:-1], at[1:]
    first = chars[start] - ~begins[start]
    cut = ~begins[start] | ~begins[end]
    return (first - shift).astype(np.int32), (chars[end] - shift).astype(np.int32), cut


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """doc_id, ids, n_split (tokens that hold part of a character), and each token's character offsets."""
    c.check_columns(docs, "doc_id", "text")
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def run(batches):
        own = codec(path, pattern)
        c.keeps("byte_bpe", own.forget)
        for batch in batches:
            for part in c.slices(batch, "text", c.SLICE_BYTES):
                ids, n = own.encode([t or "" for t in part.column("text").to_pylist()])
                data, at = own.token_bytes(ids)
                token_at = np.concatenate([[0], np.cumsum(n)])
                start, end, cut = char_spans(data, at, at[token_at], n)
                cuts = np.concatenate([[0], np.cumsum(cut)])
                out = [part.column("doc_id"), _lists(ids, n), pa.array(np.diff(cuts[token_at]))]
                more = [_lists(start, n), _lists(end, n)] if offsets else []
                yield pa.RecordBatch.from_arrays(out + more, ["doc_id", "ids", "n_split", "char_starts", "char_ends"][: len(out + more)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_split long" + (OFFSETS if offsets else ""))


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, n_split as they are, and ``decoded``, the bytes of the ids (null ids: none)."""
    c.check_columns(encoded, "doc_id", "ids", "n_split")
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            n = np.array(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), np.int64)
            group = np.cumsum(n) // (c.SLICE_BYTES // 4)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)] if len(n) else [0]
            for a, b in zip(cuts, cuts[1:]):
                some = batch.slice(a, b - a)
                data, at = codec(path, pattern).token_bytes(np.array(some.column("ids").flatten(), np.int64))
                edges = at[np.concatenate([[0], np.cumsum(n[a:b])])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), some.column("n_split"), decoded], ["doc_id", "ids", "n_split", "decoded"])

    return encoded.select("doc_id", "ids", "n_split").mapInArrow(run, "doc_id long, ids array<int>, n_split long, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode_documents(encode_documents(docs, offsets=False))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
