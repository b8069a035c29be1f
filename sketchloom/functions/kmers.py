"""K-mers, canonical k-mers and minimisers of sequences.

Hashes are 64-bit patterns in a signed BIGINT; unsigned order is signed order after flipping
the top bit. Bases other than A, C, G, T break a sequence: no k-mer spans them.

Single k-mers are column expressions. All k-mers of sequences come from one Arrow kernel: bases
become 2-bit codes, values of k bases are put together by doubling, and minima of windows
likewise. A sequence of any length is read in pieces that overlap by a window less one, and
what repeats within a piece leaves before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 0x8F3F73B5CF1C9ADE
TOP = -(1 << 63)
PIECE = 1 << 20  # bases a kernel step reads
CODES = np.full(256, 4, np.uint8)
for _letters in (b"ACGT", b"acgt"):
    CODES[list(_letters)] = range(4)


def adjusted_seed(k: int) -> int:
    """The seed's leading 2k bits; k must lie in 1 .. 32."""
    if not 1 <= k <= 32:
        raise ValueError("k must lie between 1 and 32")
    return SEED >> (64 - 2 * k)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def base4(text: Column) -> Column:
    """A string of ACGT as a base-4 number (two's complement at 32 letters)."""
    return F.conv(F.translate(text, "ACGT", "0123"), 4, -10).cast("long")


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(text, "ACGT", "TGCA"))


def forward(text: Column) -> Column:
    return base4(text)


def canonical(text: Column, k: int) -> Column:
    """The lesser of the seeded forward and reverse complement numbers (unsigned order)."""
    seed = F.lit(signed(adjusted_seed(k)))
    a, b = base4(text).bitwiseXOR(seed), base4(reverse_complement(text)).bitwiseXOR(seed)
    if k < 32:
        return F.least(a, b)
    top = F.lit(TOP)
    return F.least(a.bitwiseXOR(top), b.bitwiseXOR(top)).bitwiseXOR(top)


def windows(codes: np.ndarray, k: int, window: int, seeded: bool) -> np.ndarray:
    """Hashes of all k-mers of a stretch of codes, or the least of each ``window`` of bases.

    Only windows without a break (code 4) count; they come in order, as unsigned numbers."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.minimum(codes, 3).astype(np.uint64)
    parts = [(1, base, np.uint64(3) - base)]  # (bases, values, values of the reverse complement)
    while 2 * parts[-1][0] <= k:
        m, a, b = parts[-1]
        shift = np.uint64(2 * m)
        parts.append((2 * m, (a[:-m] << shift) | a[m:], b[:-m] | (b[m:] << shift)))
    done, value, other = parts[-1]
    for m, a, b in reversed(parts[:-1]):
        if done + m <= k:
            size = len(codes) - done - m + 1
            value = (value[:size] << np.uint64(2 * m)) | a[done : done + size]
            other = other[:size] | (b[done : done + size] << np.uint64(2 * done))
            done += m
    if seeded:
        seed = np.uint64(adjusted_seed(k))
        value = np.minimum(value ^ seed, other ^ seed)
    broken = np.concatenate([[0], np.cumsum(codes == 4)])
    if window > k:
        # Broken k-mers are part of broken windows only, so their values don't matter.
        span, held = window - k + 1, 1
        while 2 * held <= span:
            value = np.minimum(value[:-held], value[held:])
            held *= 2
        value = np.minimum(value[:n], value[span - held : span - held + n])
    return value[:n][broken[window:] == broken[:-window]]


def _kernel(k: int, window: int, seeded: bool, key: str, seq: str, distinct: bool):
    def found(keys: pa.Array, at: list[int], texts: pa.Array):
        """Batches of one key's sequences; ``at`` are their rows."""
        held, size = [], 0
        for i in at:
            raw = texts[i].as_buffer() if texts[i].is_valid else None
            codes = CODES[np.frombuffer(raw, np.uint8)] if raw is not None else np.zeros(0, np.uint8)
            for first in range(0, max(len(codes) - window + 1, 0), PIECE):
                part = codes[first : first + PIECE + window - 1]
                held += [part, np.array([4], np.uint8)]
                size += len(part)
                if size >= PIECE:
                    yield out(keys, at[0], held)
                    held, size = [], 0
        if held:
            yield out(keys, at[0], held)

    def out(keys: pa.Array, i: int, held: list[np.ndarray]):
        h = windows(np.concatenate(held), k, window, seeded)
        h = (np.unique(h) if distinct else h).view(np.int64)
        return pa.RecordBatch.from_arrays([keys.take(pa.array([i])).take(pa.array(np.zeros(len(h), np.int64))), pa.array(h)], [key, "h"])

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(key), batch.column(seq)
            groups: dict[str, list[int]] = {}
            for i, v in enumerate(keys.to_pylist()):
                groups.setdefault(repr(v), []).append(i)
            for at in groups.values():
                yield from found(keys, at, texts)

    return run


def elements(seqs: DataFrame, k: int, window: int | None = None, seeded: bool = True, key: str = "ub_id", seq: str = "seq", distinct: bool = True) -> DataFrame:
    """(key, h): k-mers of the sequences, or the minimisers of windows of ``window`` bases.

    With ``distinct`` repeats within one stretch that a task reads are left out."""
    window = k if window is None else window
    if window < k:
        raise ValueError("The k-mer size cannot be bigger than the window size.")
    adjusted_seed(k)
    rows = seqs.select(key, F.col(seq).cast("string").alias(seq))
    schema = T.StructType([rows.schema[key], T.StructField("h", T.LongType())])
    return rows.mapInArrow(_kernel(k, window, seeded, key, seq, distinct), schema)
