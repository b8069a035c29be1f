"""Token-ID output: Re-Pair grammar compression in a binary shard format (operator 1).

Texts are encoded by the ``tokenizers`` library. A text may be cut before any single space
that follows a non-space without changing its ids (the vocabulary's splitter always cuts
there), so each distinct chunk is encoded once and ids are gathered from those. The string of
a special token in a text is that token, as in the library as it is loaded.

Ids go to ranges of ``doc_id`` (one a partition, sorted; only the ids are shuffled, in the
narrowest unsigned type) and are cut into blocks of whole documents of about
``block_tokens`` ids. Each block is compressed by Re-Pair: in every round all adjacent pairs
are counted by sorting, the most frequent pairs become nonterminals, and their occurrences
are replaced from left to right; rounds go on until no pair occurs ``MIN_COUNT`` times or one
saves less than ``LEAST_GAIN`` of the symbols (a rarer pair costs about as much as it saves:
its rule takes three numbers). No rule spans a document's end. Rules and their expansion lengths are stored, and each document's place in
the compressed sequence, so one document can be decoded alone (``Block.document``).

A shard file is a Parquet file written by Spark (so by its commit protocol, to any store)
with one row a block: shard, block, doc_ids, n_tokens and a payload (``MAGIC``, counts, rule
pairs, expansion lengths, ids a document, symbols a document, sequence; little-endian).

Defined results: null text is empty; an empty text is its end id alone; a very long text is
a block of its own; null ids come first, equal ids are ordered by their tokens; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.llm import common as c

MAGIC = b"RPG1"
END_ID = 2
BLOCK_TOKENS = 1 << 20
RULES_A_ROUND, MIN_COUNT = 4096, 12
LEAST_GAIN = 0.002  # a round that saves a smaller share of the symbols is the last
SLOT_BITS = 17
CACHE_CHUNKS = 1_200_000
GROUP = 1024  # runs of letters that are encoded by one call
LATIN_END = 0x250
# What the splitter keeps whole: Latin letters; and chunks of these, digits, marks without a
# meaning of their own, and single line feeds between others.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-\u024F]+")
PIECES = re.compile("[A-Za-zÀ-ÖØ-öø-\u024F]+|[0-9]+|[!#$%&()*+,./:;=?@^~-]+|\n")
MIXED = re.compile("(?:[A-Za-zÀ-ÖØ-öø-\u024F]+|[0-9]+|[!#$%&()*+,./:;=?@^~-]+)(?:\n?(?:[A-Za-zÀ-ÖØ-öø-\u024F]+|[0-9]+|[!#$%&()*+,./:;=?@^~-]+))*")
MARKS = frozenset("!#$%&()*+,./:;=?@^~-")
UNSAFE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


# ------------------------------------------------------------------ encoding
def _longer(held: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``held`` and ``more`` in one array; room behind ``held`` is used before it is copied."""
    room, n = held if held.base is None else held.base, len(held) + len(more)
    if n > len(room):
        room = np.empty(2 * n, held.dtype)
        room[: len(held)] = held
    room[len(held) : n] = more
    return room[:n]


class ChunkEncoder:
    """Ids of texts by the library, each distinct chunk encoded once while it is kept.

    Where the vocabulary's splitter is the usual one of byte-level BPE (contractions, letters,
    digits, other marks, white space), chunks are cut into the splitter's own pieces, and runs
    of Latin letters go to the library in its byte alphabet, many at once, past the splitter."""

    def __init__(self, library, most_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.library, self.most_chunks = library, most_chunks
        self.vocabulary = self.library.get_vocab_size()
        #: Texts that hold one of these as a string go to the library whole: it finds them first.
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        splitter = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        self.usual = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        if self.usual:
            self.runs = Tokenizer.from_str(self.library.to_str())
            self.runs.pre_tokenizer = None
            if hasattr(self.runs.model, "_resize_cache"):
                self.runs.model._resize_cache(0)  # no run comes twice while its ids are kept here
            split = self.library.pre_tokenizer.pre_tokenize_str
            self.alphabet = {x: split(chr(x))[0][0] for x in range(0xC0, LATIN_END) if chr(x).isalpha()}
            self.space = split(" a")[0][0][:-1]
            self.begins = np.zeros(self.vocabulary, bool)
            self.begins[[i for x, i in self.library.get_vocab().items() if x.startswith(self.space)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, known: dict[str, int], chunks: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        known.update(zip(chunks, range(len(self.at) - 1, len(self.at) - 1 + len(chunks))))
        self.flat = _longer(self.flat, ids)
        self.at = _longer(self.at, self.at[-1] + np.cumsum(size))

    def _index(self, chunks: list[str], lead: str = "") -> np.ndarray:
        """Where the ids of ``lead`` + chunk stand; what is not known yet is encoded."""
        known = self.known[lead]
        out = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0).tolist()
        if not missing:
            return out
        fresh = list(dict.fromkeys([chunks[i] for i in missing]))
        letters, ended, mixed, other = [], [], [], []
        for x in fresh if self.usual else ():
            if x.isalpha():
                (letters if x.isascii() or LETTERS.fullmatch(x) else other).append(x)
            elif x[-1:] in MARKS and (head := x[:-1]).isalpha() and (x.isascii() or LETTERS.fullmatch(head)):
                ended.append(x)
            else:
                (mixed if MIXED.fullmatch(x) and not PIECES.fullmatch(x) else other).append(x)
        other = other if self.usual else fresh
        if letters:
            mark = self.space if lead else ""
            runs = [mark + (x if x.isascii() else x.translate(self.alphabet)) for x in letters]
            # After a space the mark shows where a run begins, so one call can take many.
            step = GROUP if lead else 1
            found = self.runs.encode_batch_fast([runs[i : i + step] for i in range(0, len(runs), step)], is_pretokenized=True, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
            if lead:
                size = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
            else:
                size = np.array([len(e.ids) for e in found])
            self._add(known, letters, ids, size)
        if other:
            found = [e.ids for e in self.library.encode_batch_fast([lead + x for x in other] if lead else other, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self._add(known, other, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size)
        if ended:  # letters and one mark
            heads = [x[:-1] for x in ended]
            where = np.empty(2 * len(ended), np.int64)
            where[::2] = self._index(heads, lead) if lead else self._plain(heads)
            where[1::2] = self._plain([x[-1] for x in ended])
            ids, ends = self._gather(where)
            self._add(known, ended, ids, np.diff(ends[::2]))
        if mixed:
            pieces = [PIECES.findall(x) for x in mixed]
            first = np.cumsum([0, *map(len, pieces)])
            flat = list(chain.from_iterable(pieces))
            heads = first[:-1].tolist()
            where = np.empty(len(flat), np.int64)
            where[heads] = self._index([flat[i] for i in heads], lead) if lead else 0
            rest = np.ones(len(flat), bool)
            rest[heads] = not lead
            rest = np.flatnonzero(rest)
            where[rest] = self._plain([flat[i] for i in rest.tolist()])
            ids, ends = self._gather(where)
            self._add(known, mixed, ids, np.diff(ends[first]))
        out[missing] = [known[chunks[i]] for i in missing]
        return out

    def _plain(self, pieces: list[str]) -> np.ndarray:
        """Pieces without a space before them; none is cut any further."""
        known = self.known[""]
        fresh = [x for x in dict.fromkeys(pieces) if x not in known]
        letters = [x for x in fresh if LETTERS.fullmatch(x)]
        self._index(letters)
        other = [x for x in fresh if x not in known]
        if other:
            found = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
            self._add(known, other, np.array(list(chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found]))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _gather(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and where each chunk's begin and end."""
        start = self.at[chunk]
        n = self.at[chunk + 1] - start
        stops = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(start - stops[:-1], n) + np.arange(int(stops[-1]))], stops

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.at) > self.most_chunks:
            self._forget()
        rows = [t or "" for t in texts]
        whole = {i for i, t in enumerate(rows) if any(x in t for x in self.added)}
        plain = ["" if i in whole or UNSAFE.search(t) else t for i, t in enumerate(rows)]
        words = pa.compute.split_pattern(pa.array(plain, pa.large_string()), " ")
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        flat = words.flatten().dictionary_encode()
        chunk = self._index(flat.dictionary.to_numpy(zero_copy_only=False).tolist(), " ")[flat.indices.to_numpy(zero_copy_only=False)]
        chunk[ends[:-1]] = self._index([t.split(" ", 1)[0] for t in plain])
        ids, stops = self._gather(chunk)
        cut = stops[ends]
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        for i, (t, p) in enumerate(zip(rows, plain)):
            if i in whole:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
            elif t and not p:
                out[i] = np.concatenate([self.flat[self.at[k] : self.at[k + 1]] for k in self._index(CUT.split(t))])
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[path] = ChunkEncoder(Tokenizer.from_file(path))
    return _encoders[path]


# ------------------------------------------------------------------ Re-Pair
def _frequent(key: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys that occur ``min_count`` times or more, and how often.

    Sorted, a key that equals the one ``min_count - 1`` places on is one of these; between two
    of them lie as many places that don't."""
    key.sort()
    if min_count < 2:
        return np.unique(key, return_counts=True)
    step = min_count - 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], key[step:] == key[:-step], [False]])))
    return key[edge[::2]], edge[1::2] - edge[::2] + step


def repair(seq: np.ndarray, first_rule: int, end_id: int = END_ID, per_round: int = RULES_A_ROUND, min_count: int = MIN_COUNT, least_gain: float = LEAST_GAIN):
    """(compressed sequence, rule pairs, expansion lengths); rule i is symbol ``first_rule + i``."""
    seq = seq.astype(np.uint32)
    rules = [np.zeros((0, 2), np.uint32)]
    lengths = [np.zeros(0, np.int64)]
    known = 0
    inner = seq != end_id  # symbols that do not end with the end id
    while len(seq) > 1:
        key = seq[:-1].astype(c.U64)
        key <<= c.U64(32)
        key |= seq[1:]
        inside = inner[:-1]
        pairs, count = _frequent(key[inside], min_count)
        if not len(pairs):
            break
        pairs = pairs[np.argsort(count, kind="stable")][-per_round:]  # the most frequent last
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        # Of pairs with one slot the most frequent stays; the others wait.
        table[(pairs * c.GOLD) >> c.U64(64 - SLOT_BITS)] = np.arange(len(pairs))
        slot = key * c.GOLD
        slot >>= c.U64(64 - SLOT_BITS)
        found = table[slot.view(np.int64)]
        at = np.flatnonzero(found >= 0)
        at = at[(pairs[found[at]] == key[at]) & inside[at]]
        fresh = np.append(True, np.diff(at) != 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        taken = found[at]
        held = np.bincount(taken, minlength=len(pairs)) > 0
        used, which = np.flatnonzero(held), (np.cumsum(held) - 1)[taken]
        new = np.stack([(pairs[used] >> c.U64(32)).astype(np.uint32), (pairs[used] & c.U64(0xFFFFFFFF)).astype(np.uint32)], 1)
        size = np.concatenate(lengths)
        length = np.zeros(len(new), np.int64)
        for side in (0, 1):
            rule = new[:, side].astype(np.int64) - first_rule
            length += np.where(rule >= 0, size[np.maximum(rule, 0)] if len(size) else 1, 1)
        inner[at] = inner[at + 1]
        seq[at] = first_rule + known + which
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, inner = seq[keep], inner[keep]
        rules.append(new)
        lengths.append(length)
        known += len(new)
        if len(at) < least_gain * len(keep):
            break
    return seq, np.concatenate(rules), np.concatenate(lengths)


class Block:
    """One block of a shard file."""

    def __init__(self, first_rule: int, rules: np.ndarray, lengths: np.ndarray, n_tokens: np.ndarray, n_symbols: np.ndarray, seq: np.ndarray):
        self.first_rule, self.rules, self.lengths = first_rule, rules, lengths.astype(np.int64)
        self.n_tokens, self.n_symbols, self.seq = n_tokens.astype(np.int64), n_symbols.astype(np.int64), seq

    @classmethod
    def build(cls, docs: list[np.ndarray], first_rule: int, end_id: int) -> Block:
        """``docs`` hold their end ids. Symbols a document are found from the expansion lengths."""
        seq, rules, lengths = repair(np.concatenate(docs), first_rule, end_id)
        n_tokens = np.fromiter(map(len, docs), np.int64, len(docs))
        size = np.ones(len(seq), np.int64)
        inner = seq.astype(np.int64) - first_rule
        size[inner >= 0] = lengths[inner[inner >= 0]]
        stops = np.searchsorted(np.cumsum(size), np.cumsum(n_tokens)) + 1
        return cls(first_rule, rules, lengths, n_tokens, np.diff(np.append(0, stops)), seq)

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<IIII", self.first_rule, len(self.rules), len(self.n_tokens), len(self.seq))
        return head + b"".join(np.ascontiguousarray(x).astype("<u4").tobytes() for x in (self.rules, self.lengths, self.n_tokens, self.n_symbols, self.seq))

    @classmethod
    def load(cls, raw: bytes) -> Block:
        if raw[:4] != MAGIC:
            raise ValueError("not a block")
        first, n_rules, n_docs, n_seq = struct.unpack("<IIII", raw[4:20])
        flat = np.frombuffer(raw, "<u4", offset=20)
        a, b = 2 * n_rules, 3 * n_rules
        return cls(first, flat[:a].reshape(-1, 2), flat[a:b], flat[b : b + n_docs], flat[b + n_docs : b + 2 * n_docs], flat[b + 2 * n_docs : b + 2 * n_docs + n_seq])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: every pass replaces all rules by their pairs."""
        out = symbols.astype(np.int64)
        while True:
            inner = out - self.first_rule
            rule = inner >= 0
            if not rule.any():
                return out.astype(np.uint32)
            start = np.cumsum(1 + rule) - 1 - rule
            more = np.empty(int(start[-1]) + 1 + int(rule[-1]), np.int64)
            more[start] = np.where(rule, self.rules[np.maximum(inner, 0), 0], out)
            more[start[rule] + 1] = self.rules[inner[rule], 1]
            out = more

    def document(self, i: int) -> np.ndarray:
        """Document ``i`` alone: only its symbols, and the rules that they need, are read."""
        stop = int(self.n_symbols[: i + 1].sum())
        return self._expand(self.seq[stop - int(self.n_symbols[i]) : stop])

    def part(self, i: int, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of document ``i``: expansion lengths show which symbols to read."""
        end = int(self.n_symbols[: i + 1].sum())
        own = self.seq[end - int(self.n_symbols[i]) : end]
        ends = np.cumsum(self._size(own.astype(np.int64) - self.first_rule))
        a = int(np.searchsorted(ends, first, side="right"))
        b = int(np.searchsorted(ends, stop)) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[first - before : stop - before]

    def documents(self) -> list[np.ndarray]:
        """All documents: every rule is written out once, then the sequence is gathered."""
        ends = np.cumsum(self.lengths)
        at = ends - self.lengths
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        depth = np.zeros(len(self.rules), np.int64)
        inner = self.rules.astype(np.int64) - self.first_rule
        todo = np.arange(len(self.rules))
        while len(todo):  # rules of the same depth at once
            ready = ((inner[todo] < 0) | (depth[np.maximum(inner[todo], 0)] > 0)).all(1)
            now = todo[ready]
            for side in (0, 1):
                place = at[now] + (self.lengths[now] - self._size(inner[now, 1]) if side else 0)
                own = inner[now, side]
                flat[place[own < 0]] = self.rules[now[own < 0], side]
                place, own = place[own >= 0], own[own >= 0]
                n = self.lengths[own]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(place, n) + step] = flat[np.repeat(at[own], n) + step]
            depth[now] = 1
            todo = todo[~ready]
        symbol = self.seq.astype(np.int64) - self.first_rule
        n = self._size(symbol)
        table = np.concatenate([flat, self.seq.astype(np.uint32)])
        start = np.where(symbol >= 0, at[np.maximum(symbol, 0)] if len(at) else 0, len(flat) + np.arange(len(symbol)))
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(start - stops[:-1], n) + np.arange(int(stops[-1]))]
        return np.split(ids, np.cumsum(self.n_tokens)[:-1])

    def _size(self, inner: np.ndarray) -> np.ndarray:
        """Expansion lengths of symbols, given as rule numbers (below 0: an id)."""
        return np.where(inner >= 0, self.lengths[np.maximum(inner, 0)], 1) if len(self.lengths) else np.ones(len(inner), np.int64)


# ------------------------------------------------------------------ Spark
def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokens(path: str, bounds: list[int], end_id: int, kind: str):
    edges = np.array(bounds, np.int64)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for part in c.slices(batch, "text"):
                ids = own.encode(part.column("text").to_pylist())
                keys = part.column("doc_id")
                shard = np.searchsorted(edges, keys.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
                end = np.array([end_id], kind).tobytes()
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard), pa.array([x.astype(kind).tobytes() + end for x in ids], pa.binary())], ["doc_id", "shard", "ids"])

    return run


def _blocks(kind: str, first_rule: int, end_id: int, block_tokens: int):
    def row(shard, number, keys, docs):
        block = Block.build(docs, first_rule, end_id)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([int(block.n_tokens.sum())], pa.int64()), pa.array([block.dump()], pa.binary())], ["shard", "block", "doc_ids", "n_tokens", "payload"])

    def run(batches):
        shard, number, keys, docs, size = None, 0, [], [], 0
        for batch in batches:
            for key, s, raw in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), kind).astype(np.uint32)
                if docs and (s != shard or size + len(ids) > block_tokens):
                    yield row(shard, number, keys, docs)
                    number = number + 1 if s == shard else 0
                    keys, docs, size = [], [], 0
                shard = s
                keys.append(key)
                docs.append(ids)
                size += len(ids)
        if docs:
            yield row(shard, number, keys, docs)

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the shard files of ``docs`` (doc_id, text); returns them as read back."""
    c.check_columns(docs, "doc_id", "text")
    path = tokenizer or default_tokenizer()
    first_rule = encoder(path).vocabulary
    kind = "<u2" if first_rule <= 1 << 16 else "<u4"
    n = c.partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    ids = rows.mapInArrow(_tokens(path, c.range_bounds(rows, "doc_id", n), end_id, kind), "doc_id long, shard int, ids binary")
    ordered = c.in_ranges(ids, "shard", n, F.asc_nulls_first("doc_id"), "ids")
    return c.table(ordered.mapInArrow(_blocks(kind, first_rule, end_id, block_tokens), "shard int, block int, doc_ids array<long>, n_tokens long, payload binary"), "tokens")


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            docs = Block.load(batch.column("payload")[k].as_py()).documents()
            n = np.fromiter(map(len, docs), np.int64, len(docs))
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("shard")[k].as_py()] * len(docs), pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(docs), pa.int32()),
                batch.column("doc_ids")[k].values, pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
            ], ["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard files."""
    blocks = files.select("shard", "block", F.col("n_tokens").alias("n"))
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row a shard, and there are at most as many as shuffle partitions.
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = blocks.withColumn("inside", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("base"))
    docs = files.select("shard", "block", "doc_ids", "payload").mapInArrow(_read, "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(c.table(starts, "starts"), ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_grammar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
