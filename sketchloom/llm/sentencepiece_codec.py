"""SentencePiece encoding and decoding: batched numpy Viterbi (operator 9).

A text is cut at spaces into words (``▁`` and what follows; no piece has ``▁`` after another
character, so words are independent), and words between any two characters that no piece has
side by side, so no piece can cross the cut. Distinct parts of equal length advance together,
one position at a time: hashes of all substrings ending there probe the sorted piece keys, and
a vectorised maximum over the candidate pieces stores one backpointer a part and position.
Parts of more than ``LONG`` characters advance alone: all their substrings are probed at once,
and only the few pieces found are walked.

The lattice's transition scores depend on the model's kind:

* unigram models: the score of a path is the sum of its pieces' scores (characters outside
  the vocabulary cost 10 less than the worst piece), as in the library;
* BPE models: a transition is allowed (score 0) if merging would leave that border between
  the two pieces standing, else forbidden. A path of allowed transitions is exactly one merge
  result, so the best path is the library's own encoding. (Adding up a BPE model's scores,
  which are only merge ranks, would find a different segmentation.) Whether the border stands
  is decided for all candidates at once by undoing the later of the two pieces' last merges
  and asking whether the pair at the border would have merged earlier.

Characters outside the vocabulary become byte pieces. Runs of spaces are merged leftmost
first, as the library does. Decoding looks pieces up in one byte table and drops the dummy
prefix; ``decode(encode(x)) == x`` for every text without U+2581 (which is the escaped space).

Defined results: null and empty texts have no ids and decode to the empty string; very long
words advance in a batch of their own; repeated rows repeat; an empty table gives an empty
result. The model's path is a parameter; the vocabulary travels to the tasks (bounded by the
model), never the corpus.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

SPACE = "▁"
BASE = c.BASES[1]
INF = np.int64(1 << 40)
CACHE_WORDS = 250_000
LONG = 256  # characters
MEMO = 1_000_000
PROBES = 1 << 16  # positions of a long part that are probed at once
OUT = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded string"


def _raw(points: np.ndarray) -> np.ndarray:
    return c.mix(points.astype(c.U64) + c.U64(1))


class Codec:
    """A SentencePiece model (identity normalisation, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        kind = np.array([p.type for p in proto.pieces])
        self.scores = np.array([p.score for p in proto.pieces], np.float64)
        normal = np.flatnonzero(kind == 1)
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece crosses a word's border")
        self.unk = int(np.flatnonzero(kind == 2)[0])
        self.byte_id = np.full(256, self.unk, np.int64)
        for i in np.flatnonzero(kind == 6):
            self.byte_id[int(self.pieces[i][3:5], 16)] = i
        # Bytes of each piece, for decoding.
        out = [self.pieces[i].replace(SPACE, " ").encode() if k == 1 else bytes([int(self.pieces[i][3:5], 16)]) if k == 6 else b"" for i, k in enumerate(kind)]
        out[self.unk] = " ⁇ ".encode()
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        # Piece keys: polynomial hashes of code points, sorted.
        self.length = np.array([len(p) for p in self.pieces])
        self.longest = int(self.length[normal].max())
        self.pw = c.powers(BASE, self.longest + 2)
        self.hash = np.zeros(len(self.pieces), c.U64)
        for n in np.unique(self.length[normal]):
            ids = normal[self.length[normal] == n]
            points = np.frombuffer("".join(self.pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), n)
            self.hash[ids] = (_raw(points) * self.pw[:n]).sum(1, dtype=c.U64)
        order = normal[np.argsort(self.hash[normal], kind="stable")]
        self.keys, self.key_ids = self.hash[order], order
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.by_text = {self.pieces[i]: int(i) for i in normal}
        # Pairs of code points that stand side by side in some piece, as one sorted number each.
        pairs = {(ord(x) << 32) | ord(y) for p in self.by_text for x, y in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), c.U64)
        self.ascii_pairs = np.zeros((128, 128), bool)
        for x in pairs:
            if x >> 32 < 128 and x & 0xFFFFFFFF < 128:
                self.ascii_pairs[x >> 32, x & 0xFFFFFFFF] = True
        self.seen = np.zeros(1 << 20, bool)  # leading bits of the keys: most probes end here
        self.seen[(self.keys >> c.U64(44)).astype(np.int64)] = True
        self._forget()
        self.runs: dict[int, list[int]] = {}
        if self.bpe:
            self._histories(normal)

    # ------------------------------------------------------------ merges
    def _merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging of a short symbol list; also the last pair that merged."""
        last = None
        while True:
            best = None
            for i in range(len(symbols) - 1):
                k = self.by_text.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i)
            if best is None:
                return symbols, last
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    def _histories(self, normal: np.ndarray) -> None:
        """Each piece's rank (when it forms) and the pair it forms from; -1 where it never does."""
        n = len(self.pieces)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -1, np.int64)
        self.forms = np.zeros(n, bool)
        place = np.empty(n, np.int64)
        place[np.argsort(-self.scores, kind="stable")] = np.arange(n)
        for i in normal:
            text = self.pieces[i]
            if len(text) == 1:
                self.forms[i] = True
            elif not text.startswith(SPACE * 2):
                left, pair = self._merge(list(text))
                if len(left) == 1:
                    self.forms[i] = True
                    self.rank[i] = place[i]
                    self.left[i], self.right[i] = (self.by_text.get(p, -1) for p in pair)

    def _probe(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        can = np.flatnonzero(self.seen[(h >> c.U64(44)).astype(np.int64)])
        if len(can):
            own = h[can]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[at] == own
            out[can[hit]] = self.key_ids[at[hit]]
        return out

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}  # words
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.parts: dict[str, int] = {}
        self.part_flat, self.part_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.border: dict[tuple[int, int], bool] = {}

    def _stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between pieces a and b outlives merging; -1 never merges."""
        ok = np.ones(len(a), bool)
        go = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[go], b[go]
        limit = np.full(len(go), INF)  # the pair must not have merged before this rank
        while len(go):
            pair = self._probe(self.hash[a] + self.hash[b] * self.pw[np.minimum(self.length[a], self.longest + 1)])
            merged = (pair >= 0) & (self.length[a] + self.length[b] <= self.longest)
            merged &= np.where(pair >= 0, self.rank_or_last[pair], INF) < limit
            ok[go[merged]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~merged & ((ra >= 0) | (rb >= 0))
            go, a, b, ra, rb = go[more], a[more], b[more], ra[more], rb[more]
            undo_a = ra > rb
            # On equal rank the left one merges first: strictly before for a, at or before for b.
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    @property
    def rank_or_last(self) -> np.ndarray:
        if not hasattr(self, "_rank_or_last"):
            place = np.empty(len(self.pieces), np.int64)
            place[np.argsort(-self.scores, kind="stable")] = np.arange(len(self.pieces))
            self._rank_or_last = place
        return self._rank_or_last

    # ------------------------------------------------------------ Viterbi
    def _viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of ``n`` code points each, and how many each has."""
        m = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        raw = _raw(points)
        back = np.zeros((n + 1, m), np.int32)
        piece = np.full((n + 1, m), -1, np.int64)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        unknown = self.scores.min() - 10
        for j in range(1, n + 1):
            h = np.zeros(m, c.U64)
            for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
                h = h * c.U64(BASE) + raw[:, i]
                found = self._probe(h)
                if self.bpe:
                    can = np.flatnonzero((found >= 0) & (best[i] > -np.inf))
                    can = can[self.forms[found[can]]]
                    if i and len(can):
                        can = can[self._stands(piece[i, can], found[can])]
                    score = np.full(m, -np.inf)
                    score[can] = 0
                else:
                    score = np.where(found >= 0, best[i] + self.scores[found], -np.inf)
                if i == j - 1:  # one character: a piece of its own, in or outside the vocabulary
                    score = np.where(found < 0, 0 if self.bpe else best[i] + unknown, score)
                up = score > best[j]
                best[j, up], back[j, up], piece[j, up] = score[up], i, found[up]
        # All words step back together; unknown characters are filled in afterwards.
        path, at, row = [], np.full(m, n), np.arange(m)
        while at.any():
            path.append(np.where(at > 0, np.where(piece[at, row] >= 0, piece[at, row], -1 - at), -10_000_000))
            at = np.where(at > 0, back[at, row], 0)
        steps = np.array(path[::-1]).T
        flat = steps[steps > -10_000_000]
        size = (steps > -10_000_000).sum(1)
        if (flat >= 0).all():
            return flat.astype(np.int32), size
        out = []
        for w, word in enumerate(steps.tolist()):
            ids: list[int] = []
            for p in word:
                if p >= 0:
                    ids.append(p)
                elif p > -10_000_000:
                    ids.extend(self.byte_id[x] for x in chr(points[w, -2 - p]).encode("utf-8", "surrogatepass"))
            size[w] = len(ids)
            out += ids
        return np.array(out, np.int32), size

    def _long(self, word: str) -> np.ndarray:
        """Ids of one long part: all substrings are probed at once, then one walk over the
        pieces found."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, raw = len(points), _raw(points)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        unknown = float(self.scores.min()) - 10
        for first in range(0, n, PROBES):
            ends = np.arange(first, min(n, first + PROBES))
            h = np.zeros(len(ends), c.U64)
            starts, ids, at = [], [], []
            for k in range(self.longest):  # substrings of k + 1 characters, by their last one
                inside = ends - k >= 0
                h = np.where(inside, h * c.U64(BASE) + raw[np.maximum(ends - k, 0)], h)
                found = np.where(inside, self._probe(h), -1)
                hit = np.flatnonzero(found >= 0)
                at.append(hit)
                starts.append(ends[hit] - k)
                ids.append(found[hit])
            order = np.argsort(np.concatenate(at), kind="stable")
            at, starts, ids = (np.concatenate(x)[order] for x in (at, starts, ids))
            stops = np.searchsorted(at, np.arange(len(ends) + 1)).tolist()
            starts, ids = starts.tolist(), ids.tolist()
            for e in range(len(ends)):
                j = first + e + 1
                known = False
                for k in range(stops[e], stops[e + 1]):
                    i, p = starts[k], ids[k]
                    known |= i == j - 1
                    if best[i] == -np.inf:
                        continue
                    if not self.bpe:
                        score = best[i] + self.scores[p]
                    elif self.forms[p] and (i == 0 or self._border(piece[i], p)):
                        score = 0.0
                    else:
                        continue
                    if score > best[j]:
                        best[j], back[j], piece[j] = score, i, p
                if not known:  # a character outside the vocabulary
                    score = 0.0 if self.bpe else best[j - 1] + unknown
                    if score > best[j]:
                        best[j], back[j], piece[j] = score, j - 1, -1
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            out += [piece[j]] if piece[j] >= 0 else [int(self.byte_id[x]) for x in reversed(word[i].encode("utf-8", "surrogatepass"))]
            j = i
        return np.array(out[::-1], np.int32)

    def _border(self, a: int, b: int) -> bool:
        """``_stands`` of one pair, kept."""
        got = self.border.get((a, b))
        if got is None:
            rank, last, pieces = self.walk
            x, y, limit, got = a, b, int(INF), True
            while x >= 0 and y >= 0:
                pair = self.by_text.get(pieces[x] + pieces[y])
                if pair is not None and last[pair] < limit:
                    got = False
                    break
                if rank[x] < 0 and rank[y] < 0:
                    break
                if rank[x] > rank[y]:
                    x, limit = int(self.right[x]), rank[x]
                else:
                    y, limit = int(self.left[y]), rank[y] + 1
            if len(self.border) > MEMO:
                self.border.clear()
            self.border[a, b] = got
        return got

    @functools.cached_property
    def walk(self) -> tuple[list[int], list[int], list[str]]:
        return self.rank.tolist(), self.rank_or_last.tolist(), self.pieces

    def cuts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Parts of the words that no piece crosses, and where each word's parts start."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        left, right = points[:-1], points[1:]
        beside = np.zeros(len(left), bool)
        plain = (left < 128) & (right < 128)
        beside[plain] = self.ascii_pairs[left[plain], right[plain]]
        other = np.flatnonzero(~plain)
        key = (left[other].astype(c.U64) << c.U64(32)) | right[other]
        if len(self.pairs):
            beside[other] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        edge = ~beside
        edge[ends[:-1] - 1] = True
        cut = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(points)]])
        text = "".join(words)
        parts = [text[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist())]
        return parts, np.searchsorted(cut, np.concatenate([[0], ends]))

    def _encode_parts(self, parts: list[str]) -> np.ndarray:
        """Where the ids of each part stand in ``part_flat``."""
        fresh: dict[int, list[str]] = {}
        for w in dict.fromkeys(parts):
            if w not in self.parts:
                fresh.setdefault(len(w), []).append(w)
        flats, sizes = [self.part_flat], []
        for n, group in fresh.items():
            step = max(1, (1 << 17) // n) if n <= LONG else 1
            for at in range(0, len(group), step):
                some = group[at : at + step]
                if n <= LONG:
                    ids, size = self._viterbi(some, n)
                else:
                    ids = self._long(some[0])
                    size = np.array([len(ids)])
                self.parts.update(zip(some, range(len(self.parts), len(self.parts) + len(some))))
                flats.append(ids)
                sizes.append(size)
        if sizes:
            self.part_flat = np.concatenate(flats)
            self.part_at = np.concatenate([self.part_at, self.part_at[-1] + np.cumsum(np.concatenate(sizes))])
        return np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))

    def encode_words(self, words: list[str]) -> np.ndarray:
        """Where the ids of ``▁`` + word stand in ``flat``, for distinct words.

        Coded words are kept until there are ``CACHE_WORDS``; then all are forgotten."""
        if len(self.cache) > CACHE_WORDS:
            self._forget()
        cache = self.cache
        fresh = [w for w in words if w not in cache]
        if fresh:
            parts, first = self.cuts([SPACE + w for w in fresh])
            at = self._encode_parts(parts)
            n = self.part_at[at + 1] - self.part_at[at]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.part_flat[np.repeat(self.part_at[at] - ends[:-1], n) + np.arange(int(ends[-1]))]
            cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh))))
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + ends[first[1:]]])
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))

    def _run(self, m: int) -> list[int]:
        """Ids of ``m`` spaces: the leftmost symbol takes in its neighbour while it can."""
        if m not in self.runs:
            if self.bpe:
                left = [SPACE] * m
                i = 0
                while i < len(left) - 1:
                    if left[i] + left[i + 1] in self.by_text:
                        left[i : i + 2] = [left[i] + left[i + 1]]
                        i = 0 if i == 0 else i - 1
                    else:
                        i += 1
                self.runs[m] = [self.by_text[p] for p in left]
            else:
                self.runs[m] = self._viterbi([SPACE * m], m)[0].tolist()
        return self.runs[m]

    # ------------------------------------------------------------ texts
    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        rows = [(t or "").replace(SPACE, " ") for t in texts]
        words = pa.compute.split_pattern(pa.array(rows, pa.large_string()), " ")
        per = words.value_lengths().to_numpy()
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        code = flat.indices.to_numpy(zero_copy_only=False)
        word = self.encode_words(distinct)[code]
        n = self.at[word + 1] - self.at[word]
        place = np.repeat(self.at[word] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
        tokens = self.flat[place]
        ends = np.concatenate([[0], np.cumsum(per)])
        cut = np.concatenate([[0], np.cumsum(n)])[ends]
        out = [tokens[cut[i] : cut[i + 1]] for i in range(len(rows))]
        for i, t in enumerate(rows):
            if not t:
                out[i] = np.zeros(0, np.int32)
            elif "  " in t or t[0] == " " or t[-1] == " ":
                out[i] = self._with_runs(t)
        return out

    def _with_runs(self, text: str) -> np.ndarray:
        out: list[int] = []
        run = 0
        alone = self.by_text.get(SPACE)
        words = text.split(" ")
        distinct = list(dict.fromkeys(words))
        known = {w: self.flat[self.at[k] : self.at[k + 1]] for w, k in zip(distinct, self.encode_words(distinct).tolist())}
        for w in words:
            if not w:
                run += 1
                continue
            ids = known[w].tolist()
            if run and ids[0] == alone:
                out += self._run(run + 1)
                ids = ids[1:]
            elif run:
                out += self._run(run)
            out += ids
            run = 0
        if run:
            out += self._run(run)
        return np.array(out, np.int32)

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        per = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        n = np.diff(self.out_at)[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(self.out_at[ids] - ends[:-1], n) + np.arange(int(ends[-1]))
        raw = self.out_bytes[place].tobytes()
        cut = ends[np.concatenate([[0], np.cumsum(per)])]
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a process and model."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _forget() -> None:
    for own in _codecs.values():
        own._forget()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded."""
    c.check_columns(docs, "doc_id", "text")
    return docs.select("doc_id", "text").mapInArrow(_encode(model or default_model()), OUT)


def _encode(model: str):
    def run(batches):
        own = codec(model)
        c.keeps("sentencepiece", _forget)
        for batch in batches:
            for part in c.slices(batch, "text", 2 << 20):
                ids = own.encode(part.column("text").to_pylist())
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array(own.decode(ids), pa.string()),
                ], ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded"])

    return run


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
