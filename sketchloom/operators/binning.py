"""The layout optimiser: which user bins are split over technical bins, which are merged.

One filter is a dynamic programme over user bins in descending size. ``best[j, i]`` is the
cheapest way to place the first j user bins in i technical bins: the weight of the fullest bin
times i, plus ``alpha`` times what merged bins add on lower levels. Either the last user bin is
split over s bins, or a run of the last ones shares one.

A greedy layout bounds the cost from above, and the user bins that cannot be alone bound what
is added below. So no bin may be heavier than a cap, and only runs below it are looked at: the
table is a band, and work grows with the number of user bins times the length of such runs,
not with its square.

The tree is built level by level, all filters of a level (and all candidates of a search) in
one job. Small filters are one task each. In a large one with union estimates, tasks of
``INTERVAL`` user bins put similar ones next to each other, tasks of ``BLOCK`` positions
estimate the unions of the band, and one task fills the table from those numbers. Where nothing
bounds the runs there is no band: one task fills the table as registers pass by. Registers of a
whole filter are never held in one place."""

from __future__ import annotations

import heapq
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.config import IndexConfig, next_multiple_of_64
from sketchloom.functions import bloom
from sketchloom.sources.layouts import Layout
from sketchloom.sources.tables import table

ROWS = "run long, ibf_path array<long>, ub_id long, kmer_count long, tb long, span long, merged boolean, max_tb long, bins long, pos long"
INTERVAL = 256  # user bins that are clustered together at most
BLOCK = 256  # positions whose unions one task estimates
WHOLE = 512  # user bins of a filter whose registers go to one task (2 MB)
CHUNK = 64


def _corrections(t: int, cfg: IndexConfig) -> np.ndarray:
    """Per-bin load factor of a user bin split over s bins, for s = 1 .. t (index 0 unused)."""
    return np.array([np.inf, *(bloom.split_factor(s, cfg.maximum_fpr, cfg.number_of_hash_functions) / s for s in range(1, t + 1))])


def _relaxed(cfg: IndexConfig) -> float:
    return bloom.merged_factor(cfg.maximum_fpr, cfg.relaxed_fpr, cfg.number_of_hash_functions)


def spread(counts: np.ndarray, t: int, cfg: IndexConfig) -> list[tuple[int, int, int, int]]:
    """Split every user bin; least possible fullest bin. Rows (first, last, first bin, span).

    Giving the next technical bin to the user bin that is fullest now finds that least weight,
    because every load only falls with more bins. Each user bin then takes as few bins as weigh no
    more, in whole elements, and the largest all that are left. ``counts`` descend; the largest
    comes first."""
    load = _corrections(t, cfg)
    span = [1] * len(counts)
    heap = [(-float(c) * load[1], i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    for _ in range(t - len(counts)):
        _, i = heap[0]
        span[i] += 1
        heapq.heapreplace(heap, (-float(counts[i]) * load[span[i]], i))
    least = np.floor(-heap[0][0])
    for i, c in enumerate(counts):
        while span[i] > 1 and np.floor(float(c) * load[span[i] - 1]) <= least:
            span[i] -= 1
    span[0] += t - sum(span)
    out, tb = [], 0
    for i in range(len(counts)):
        out.append((i, i, tb, span[i]))
        tb += span[i]
    return out


def levels_below(n: np.ndarray, t: int) -> np.ndarray:
    """Levels that a merged bin of ``n`` user bins needs below it, with t bins a filter."""
    out, room = np.ones(len(n), np.int64), t
    while (n > room).any():
        out += n > room
        room *= max(t, 2)
    return out


def slack(counts: np.ndarray, t: int, cfg: IndexConfig) -> float:
    """How much more than what must lie below the least cost can be: some layout's cost (by sums,
    which are never less than unions) minus the least sum that cannot be alone.

    For a cap on weights, runs from the end are filled to it, and as many user bins as then
    fit are split as far as the cap asks."""
    n, load, relaxed = len(counts), _corrections(t, cfg), _relaxed(cfg)
    if n <= t:
        return t * max(counts[a] * load[s] for a, _, _, s in spread(np.sort(counts)[::-1], t, cfg))
    counts = np.asarray(counts, float)
    sums = np.concatenate([[0.0], np.cumsum(counts)])
    must = float(np.sort(counts)[: n - t + 1].sum())
    best = np.inf
    low = max(relaxed * sums[-1] / t, 1.0)
    for cap in low * np.geomspace(1, 64, 40):
        spans = 1 + np.searchsorted(-load[1:], -cap / np.maximum(counts, 1e-9))
        ahead = np.concatenate([[0], np.cumsum(spans)])
        if spans.max() > t:
            ahead[int(np.argmax(spans > t)) + 1 :] = t + 1
        at, runs = n, 0
        while at > 1:
            a = max(int(np.searchsorted(sums, sums[at] - cap / relaxed)), at - t)
            first = int(np.searchsorted(ahead, t - runs - 1, side="right")) - 1  # user bins before it may be alone
            if ahead[at] + runs <= t:
                break
            if at - a < 2:
                runs = t + 1
                break
            at, runs = max(a, min(first, at - 2)), runs + 1
        if runs <= t and ahead[at] + runs <= t:
            cost = t * cap + cfg.alpha * (sums[-1] - sums[at])
            best = min(best, cost)
    return best - cfg.alpha * must


def reach(counts: np.ndarray, t: int, cfg: IndexConfig, room: float) -> np.ndarray:
    """For each j the first user bin that a run of the last ones of j may begin with, by what more
    than one level below would add."""
    sums = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    j = np.arange(len(counts) + 1)
    if not np.isfinite(room):
        return np.zeros(len(counts) + 1, np.int64)
    by_weight = np.searchsorted(sums, sums - room / max(cfg.alpha, 1e-12) - 1e-9)
    return np.minimum(np.maximum(j - t, 0), by_weight)


class _Least:
    """Places of least keys in stretches, the last of equal ones; a table over powers of two."""

    def __init__(self, keys: np.ndarray, longest: int):
        self.keys, self.at = keys, [np.arange(len(keys), dtype=np.int32)]
        half = 1
        while 2 * half <= min(longest, len(keys)):
            a, b = self.at[-1][:-half], self.at[-1][half:]
            self.at.append(np.where(keys[a] < keys[b], a, b))
            half *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low .. high; -1 where that is empty."""
        out = np.full(len(low), -1, np.int64)
        some = high >= low
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        for p in np.unique(k[some]).tolist():
            own = np.flatnonzero(some & (k == p))
            a, b = self.at[p][low[own]], self.at[p][high[own] - (1 << p) + 1]
            out[own] = np.where(self.keys[a] < self.keys[b], a, b)
        return out


MIXED = 1 << 20  # cells that are looked at one by one at a time
PAIRS = 256  # blocks of beginnings, each for a number of bins, that are looked at at a time


def _by_columns(counts: np.ndarray, sums: np.ndarray, first: np.ndarray, t: int, cfg: IndexConfig, cap: float):
    """The table without unions, a number of bins after the other, for all user bins at once.

    A run from a to j weighs the more of what stands before it and its own sum. Apart from what j
    adds to all, either cost depends on a alone, so the best of a stretch comes from a table of
    least keys, and work grows with the number of user bins, however long runs may be. Where
    either weight may be the greater, cells are looked at one by one."""
    n = len(counts)
    relaxed, load = _relaxed(cfg), _corrections(t, cfg)
    j = np.arange(1, n + 1)
    low_a = np.maximum(first[1:], np.searchsorted(sums, sums[1:] - cap / relaxed - 1e-9) if np.isfinite(cap) else 0)
    longest = int((j - low_a).max())
    full, low = np.full((t + 1, n + 1), np.inf), np.zeros((t + 1, n + 1))
    full[0, 0] = 0
    from_j, from_i = np.zeros((n + 1, t + 1), np.int32), np.zeros((n + 1, t + 1), np.int16)
    spans, room, shortest = [], t, 2  # (levels below, shortest run, longest run)
    while shortest <= longest:
        spans.append((len(spans) + 1, shortest, room))
        shortest, room = room + 1, room * max(t, 2)
    for i in range(1, t + 1):
        best, k = np.full(n, np.inf), np.zeros(n, np.int16)
        for over in range(i, 0, -1):
            score = np.maximum(full[i - over, :n], counts * load[over]) * i + cfg.alpha * low[i - over, :n]
            less = score < best
            best[less], k[less] = score[less], i - over
        weight, below = np.maximum(full[k, j - 1], counts * load[i - k]), low[k, j - 1]
        place_j, place_i = j - 1, k.astype(np.int64)
        before, under = full[i - 1], low[i - 1]
        there = np.isfinite(before)
        if there.any():
            reached = sums + before / relaxed  # the run's sum is the less up to this j
            rising = np.maximum.accumulate(np.where(there, reached, -np.inf))
            lasting = np.minimum.accumulate(np.where(there, reached, np.inf)[::-1])[::-1]
            near = 1e-9 * sums[-1]  # what rounding may turn is looked at
            pure = np.searchsorted(lasting, sums[1:] + near)  # from here what stands before is the more
            mixed = np.minimum(np.searchsorted(rising, sums[1:] - near), pure)  # up to here the sum
            run, weight_, below_, from_ = np.full(n, np.inf), np.zeros(n), np.zeros(n), np.full(n, -1)

            def offer(rows, a, level):
                ell = under[a] + (sums[rows + 1] - sums[a]) * level
                m = np.maximum(before[a], (sums[rows + 1] - sums[a]) * relaxed)
                score = m * i + cfg.alpha * ell
                better = (score < run[rows]) | ((score == run[rows]) & (a > from_[rows]))
                rows, a = rows[better], a[better]
                run[rows], weight_[rows], below_[rows], from_[rows] = score[better], m[better], ell[better], a

            for level, short, long in spans:
                lo, hi = np.maximum(low_a, j - long), j - short
                inner = under - level * sums
                for keys, left, right in ((i * before + cfg.alpha * inner, np.maximum(lo, pure), hi), (cfg.alpha * inner - i * relaxed * sums, lo, np.minimum(hi, mixed - 1))):
                    keys = np.where(there, keys, np.inf)
                    least = _Least(keys, min(long, longest))(left, right)
                    rows = np.flatnonzero((least >= 0) & there[least])
                    offer(rows, least[rows], level)
                left, right = np.maximum(lo, mixed), np.minimum(hi, pure - 1)
                size = np.maximum(right - left + 1, 0)
                rows = np.flatnonzero(size)
                while len(rows):
                    part = max(int(np.searchsorted(np.cumsum(size[rows]), MIXED)), 1)
                    own, rows = rows[:part], rows[part:]
                    starts = np.cumsum(size[own]) - size[own]
                    each = np.repeat(own, size[own])
                    a = right[each] - (np.arange(len(each)) - np.repeat(starts, size[own]))
                    m = np.maximum(before[a], (sums[each + 1] - sums[a]) * relaxed)
                    score = np.where(there[a], m * i + cfg.alpha * (under[a] + (sums[each + 1] - sums[a]) * level), np.inf)
                    least = np.minimum.reduceat(score, starts)
                    hits = np.flatnonzero((score == np.repeat(least, size[own])) & there[a])
                    one, at = np.unique(each[hits], return_index=True)  # the first is the shortest run
                    offer(one, a[hits][at], level)
            better = run < best
            weight, below = np.where(better, weight_, weight), np.where(better, below_, below)
            place_j, place_i = np.where(better, from_, place_j), np.where(better, i - 1, place_i)
        ok = weight <= cap
        full[i, 1:], low[i, 1:] = np.where(ok, weight, np.inf), np.where(ok, below, 0)
        from_j[1:, i], from_i[1:, i] = place_j, place_i
    return from_j, from_i, bool(np.isfinite(full[t, n]))


def _way_back(n: int, t: int, from_j: np.ndarray, from_i: np.ndarray) -> list[tuple[int, int, int, int]]:
    out, tb, j, i = [], 0, n, t
    while j:
        a, k = int(from_j[j, i]), int(from_i[j, i])
        out.append((a, j - 1, tb, i - k))
        tb += i - k
        j, i = a, k
    return out


def optimise(counts: np.ndarray, t: int, cfg: IndexConfig, unions=None, room: float | None = None) -> list[tuple[int, int, int, int]]:
    """Rows (first, last, first bin, span) over ``counts``.

    ``unions(j, first, most)`` gives the sizes of the unions of a .. j-1 for a = j-2, j-3, ... as
    far as ``first``, or a size above ``most``. Of equal costs, splits come before runs, more
    bins before fewer, short runs before long ones. ``room`` is the ``slack`` (infinite: look at
    everything)."""
    n = len(counts)
    counts = np.asarray(counts, float)
    if not n:
        return []
    room = slack(counts, t, cfg) * (1 + 1e-9) if room is None else room
    cap = room / t
    first = reach(counts, t, cfg, room)
    sums = np.concatenate([[0.0], np.cumsum(counts)])
    relaxed, load = _relaxed(cfg), _corrections(t, cfg)
    if unions is None:
        from_j, from_i, done = _by_columns(counts, sums, first, t, cfg, cap)
        return _way_back(n, t, from_j, from_i) if done else optimise(counts, t, cfg, None, np.inf)
    full = np.full((n + 1, t + 1), np.inf)
    low = np.zeros((n + 1, t + 1))
    full[0, 0] = 0
    from_j = np.zeros((n + 1, t + 1), np.int32)
    from_i = np.zeros((n + 1, t + 1), np.int32)
    bins = np.arange(1, t + 1)
    over = bins[:, None] - np.arange(t)[None, :]  # bins that a user bin is split over
    split = load[np.maximum(over, 1)]
    for j in range(1, n + 1):
        m = np.maximum(full[j - 1, None, :t], np.where(over > 0, counts[j - 1] * split, np.inf))
        score = m * bins[:, None] + cfg.alpha * low[j - 1, None, :t]
        k = score.argmin(1)
        best, weight, below = score[bins - 1, k], m[bins - 1, k], low[j - 1, k]
        place_j, place_i = np.full(t, j - 1), k
        if j >= 2 and first[j] <= j - 2:
            size = unions(j, int(first[j]), cap / relaxed)
            a = np.arange(j - 2, j - 2 - len(size), -1)
            size = np.minimum(size, sums[j] - sums[a])
            inner = (sums[j] - sums[a]) * levels_below(j - a, t)
            if len(a):
                m = np.maximum(full[a, :t], (size * relaxed)[:, None])
                ell = low[a, :t] + inner[:, None]
                score = m * bins + cfg.alpha * ell
                pick = score.argmin(0)
                one = bins - 1
                better = score[pick, one] < best
                weight = np.where(better, m[pick, one], weight)
                below = np.where(better, ell[pick, one], below)
                place_j, place_i = np.where(better, a[pick], place_j), np.where(better, one, place_i)
        ok = weight <= cap
        full[j, 1:] = np.where(ok, weight, np.inf)
        low[j, 1:] = np.where(ok, below, 0)
        from_j[j, 1:], from_i[j, 1:] = place_j, place_i
    if not np.isfinite(full[n, t]):  # estimates that contradict each other
        return optimise(counts, t, cfg, unions, np.inf)
    return _way_back(n, t, from_j, from_i)


# ------------------------------------------------------------------ registers
_SHARE = np.exp2(-np.arange(256.0))


def cardinalities(regs: np.ndarray) -> np.ndarray:
    """HyperLogLog estimates of rows of registers."""
    m = regs.shape[-1]
    held = 127 - regs.astype(np.int32)
    held <<= 23  # as the exponent of a float: a power of two, for ranks below 127
    return _estimate(m, held.view(np.float32).sum(-1, dtype=np.float64), m - np.count_nonzero(regs, axis=-1))


def _estimate(m: int, share: np.ndarray, zero: np.ndarray) -> np.ndarray:
    raw = 0.7213 / (1 + 1.079 / m) * m * m / share
    return np.where((raw <= 2.5 * m) & (zero > 0), m * np.log(m / np.maximum(zero, 1)), raw)


def _fewest(m: int, share: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """What the estimate of a union is at least, if a part of it has these registers: estimates
    may fall where the one formula takes over from the other."""
    raw = 0.7213 / (1 + 1.079 / m) * m * m / share
    return np.where((raw <= 2.5 * m) & (zero > 0), np.minimum(raw, m * np.log(m / np.maximum(zero, 1))), raw)


class Table:
    """The table of ``optimise`` with unions where nothing bounds a run, filled as user bins come in
    with their registers.

    Of each register the last position with each rank is held, so the unions of all runs that end
    here are sums of what each position adds to a longer run. The best run for a number of bins
    is looked for in blocks of beginnings: a block's least weights and least costs below bound it,
    and only blocks that may hold the best are looked at one by one. Counts and the parts of
    those sums are whole or powers of two, so bounds are exact, and ties fall as in ``optimise``."""

    def __init__(self, n: int, t: int, m: int, cfg: IndexConfig):
        self.t, self.m, self.cfg, self.j = t, m, cfg, 0
        self.block = 1 << max(round(np.log2(max(n, 2)) / 2) - 1, 2)
        number = n // self.block + 1
        places = number * self.block
        self.sums, self.level = np.zeros(places), levels_below(np.arange(n + 1), t)
        self.full, self.low = np.full((t + 1, number, self.block), np.inf), np.zeros((t + 1, number, self.block))
        self.full[0, 0, 0] = 0
        self.least_full = np.full((number, t), np.inf)
        self.least_low = np.zeros((int(self.level[-1]) + 1, number, t))
        self.last = np.full((m, len(_SHARE)), -1, np.int32)
        self.fall, self.used = np.zeros((number, self.block)), np.zeros((number, self.block))
        self.from_j, self.from_i = np.zeros((n + 1, t + 1), np.int32), np.zeros((n + 1, t + 1), np.int16)
        self.size = np.zeros((n + 1, t + 1))
        self.before = np.zeros(t, np.int64)  # where the last user bin's best runs began
        self.relaxed, self.load = _relaxed(cfg), _corrections(t, cfg)
        self.bins = np.arange(1, t + 1)
        self.over = self.bins[:, None] - np.arange(t)[None, :]
        self.split = self.load[np.maximum(self.over, 1)]

    def _take(self, at: int, regs: np.ndarray) -> None:
        some = np.flatnonzero(regs)
        ranks = regs[some].astype(np.int64)
        reg = np.repeat(some, ranks)
        rank = np.arange(len(reg)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + 1
        old = self.last[reg, rank]
        self.last[reg, rank] = at
        share, held = _SHARE[rank], old >= 0
        fall, used = self.fall.reshape(-1), self.used.reshape(-1)
        np.subtract.at(fall, old[held], share[held])
        np.subtract.at(used, old[held & (rank == 1)], 1)
        fall[at], used[at] = share.sum(), len(some)

    def add(self, count: float, regs: np.ndarray) -> None:
        """The next user bin."""
        self._take(self.j, regs)
        self.j += 1
        j, t, bins, alpha = self.j, self.t, self.bins, self.cfg.alpha
        self.sums[j] = self.sums[j - 1] + count
        b, r = divmod(j - 1, self.block)
        m = np.maximum(self.full[None, :t, b, r], np.where(self.over > 0, count * self.split, np.inf))
        score = m * bins[:, None] + alpha * self.low[None, :t, b, r]
        k = score.argmin(1)
        best, weight, below = score[bins - 1, k], m[bins - 1, k], self.low[k, b, r]
        place_j, place_i, size = np.full(t, j - 1), k, np.zeros(t)
        if j >= 2:
            run, a, run_weight, run_below, run_size = self._runs(best)
            better = run < best
            weight, below = np.where(better, run_weight, weight), np.where(better, run_below, below)
            place_j, place_i, size = np.where(better, a, place_j), np.where(better, bins - 1, place_i), np.where(better, run_size, size)
        b, r = divmod(j, self.block)
        self.full[1:, b, r], self.low[1:, b, r] = weight, below
        self.from_j[j, 1:], self.from_i[j, 1:], self.size[j, 1:] = place_j, place_i, size
        if r == self.block - 1:
            full, low, own = self.full[:t, b], self.low[:t, b], self.sums[b * self.block : j + 1]
            self.least_full[b] = full.min(1)
            for level in range(1, len(self.least_low)):
                least = np.where(np.isfinite(full), low - level * own, np.inf).min(1)
                self.least_low[level, b] = np.where(np.isfinite(least), least, 0)

    def _runs(self, best: np.ndarray):
        """For each number of bins the cheapest run that ends here: cost, beginning, weight, what
        lies below, size."""
        j, t, alpha, wide = self.j, self.t, self.cfg.alpha, self.block
        done = (j - 1) // wide  # blocks all of whose places a run may begin with
        fall, used = self.fall[: done + 1], self.used[: done + 1]
        behind = [x.sum(1)[::-1].cumsum()[::-1] for x in (fall, used)]
        behind = [np.append(x[1:], 0) for x in behind]  # of the blocks behind each
        got = [np.full(t, np.inf), np.full(t, -1), np.zeros(t), np.zeros(t), np.zeros(t)]

        def look(blocks, cols):
            there = np.zeros(done + 1, np.int64)
            there[blocks] = 1
            own, back = np.flatnonzero(there), (there.cumsum() - 1)[blocks]
            share, zero = (self.m - (x[own, ::-1].cumsum(1)[:, ::-1] + y[own, None]) for x, y in zip((fall, used), behind))
            a = own[:, None] * wide + np.arange(wide)
            whole = self.sums[j] - self.sums[a]
            size = np.minimum(_estimate(self.m, share, zero), whole)
            size[a > j - 2] = np.inf
            m = np.maximum(self.full[cols, blocks], (size * self.relaxed)[back])
            ell = self.low[cols, blocks] + (whole * self.level[np.maximum(j - a, 0)])[back]
            score = m * (cols + 1)[:, None] + alpha * ell
            pick = wide - 1 - score[:, ::-1].argmin(1)
            row = np.arange(len(cols))
            found = [score[row, pick], a[back, pick], m[row, pick], ell[row, pick], size[back, pick]]
            order = np.lexsort((-found[1], found[0], cols))  # short runs before long ones
            order = order[np.append(True, np.diff(cols[order]) > 0)]
            found, cols = [x[order] for x in found], cols[order]
            less = (found[0] < got[0][cols]) | ((found[0] == got[0][cols]) & (found[1] > got[1][cols]))
            for x, y in zip(got, found):
                x[cols[less]] = y[less]

        columns = np.arange(t)
        near = np.minimum(self.before // wide, done)  # they tell at once how cheap a run can be
        look(np.append(near, np.full(t, done)), np.append(columns, columns))
        if done:
            share, zero = (self.m - (x[:done, -1] + y[:done]) for x, y in zip((fall, used), behind))
            ends = np.arange(1, done + 1) * wide - 1
            least = np.minimum(_fewest(self.m, share, zero), self.sums[j] - self.sums[ends]) * self.relaxed
            level = self.level[j - ends]
            bound = np.maximum(self.least_full[:done], least[:, None]) * self.bins + alpha * (self.least_low[level, np.arange(done)] + (level * self.sums[j])[:, None])
            bound[near[near < done], columns[near < done]] = np.inf

            def open_(blocks, cols, bounds):
                return (bounds < best[cols]) & ((bounds < got[0][cols]) | ((bounds == got[0][cols]) & (blocks * wide + wide - 1 > got[1][cols])))

            blocks, cols = np.nonzero(bound < np.minimum(best, np.nextafter(got[0], np.inf)))
            bounds = bound[blocks, cols]
            while len(blocks):
                keep = open_(blocks, cols, bounds)
                blocks, cols, bounds = blocks[keep], cols[keep], bounds[keep]
                if len(blocks) > PAIRS:
                    order = np.argsort(bounds - got[0][cols], kind="stable")
                    blocks, cols, bounds = blocks[order], cols[order], bounds[order]
                if len(blocks):
                    look(blocks[:PAIRS], cols[:PAIRS])
                blocks, cols, bounds = blocks[PAIRS:], cols[PAIRS:], bounds[PAIRS:]
        self.before = np.maximum(got[1], 0)
        return got

    def rows(self) -> tuple[list[tuple[int, int, int, int]], dict[int, float]]:
        """The rows of ``optimise``, and the unions' sizes of their runs, by last position."""
        out = _way_back(self.j, self.t, self.from_j, self.from_i)
        return out, {b: float(self.size[b + 1, self.t - tb]) for a, b, tb, _ in out if b > a}


def unions_of(regs: np.ndarray, base: int = 0):
    """``unions`` of ``optimise`` from the registers of positions ``base``, ``base`` + 1, ...

    A longer run raises few registers, so sums are kept up to date from those alone."""
    m = regs.shape[1]

    def sizes(j: int, first: int, most: float) -> np.ndarray:
        at, out = j - 1 - base, []
        held = regs[at : at + 1]
        share, zero = float(_SHARE[held].sum()), int((held == 0).sum())
        while at > first - base:
            part = np.concatenate([held, regs[max(at - CHUNK, first - base) : at][::-1]])
            n = len(part) - 1
            for i in range(n):  # numpy's own accumulation along rows is far slower
                np.maximum(part[i], part[i + 1], out=part[i + 1])
            flat = part.reshape(-1)
            place = np.flatnonzero(flat[m:] != flat[:-m])
            row, old, new = place // m, flat[place], flat[place + m]
            shares = share + np.cumsum(np.bincount(row, _SHARE[new] - _SHARE[old], n))
            zeros = zero - np.cumsum(np.bincount(row[old == 0], minlength=n))
            out.append(_estimate(m, shares, zeros))
            held, at, share, zero = part[-1:], at - n, float(shares[-1]), int(zeros[-1])
            if out[-1][-1] > most:
                break
        return np.concatenate(out) if out else np.zeros(0)

    return sizes


def distances(regs: np.ndarray, counts: np.ndarray, one: np.ndarray, count: float) -> np.ndarray:
    """Estimated Jaccard distances of rows of registers to one more."""
    union = cardinalities(np.maximum(regs, one))
    return np.clip(2 - (counts + count) / np.maximum(union, 1), 0, 1)


class _Alike:
    """Distances of sets and of their unions, as ``distances`` tells them, from bits that say which
    registers reach a rank: a union's bits are both sets', and what two sets share is counted."""

    def __init__(self, regs: np.ndarray):
        n, self.m = regs.shape
        self.ranks = max(int(regs.max(initial=0)), 1)
        bits = np.zeros((2 * n, self.ranks, -(-self.m // 64) * 8), np.uint8)
        for k in range(self.ranks):
            one = np.packbits(regs > k, axis=1)
            bits[:n, k, : one.shape[1]] = one
        self.bits = bits.view(np.uint64)
        self.worth = np.exp2(-np.arange(1.0, self.ranks + 1))
        self.fall, self.used, self.size = np.zeros(2 * n), np.zeros(2 * n, np.int64), np.zeros(2 * n)
        self._measure(slice(0, n))

    def _counted(self, bits: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits).sum(-1, dtype=np.uint32)

    def _measure(self, which: slice) -> None:
        number = self._counted(self.bits[which])
        self.fall[which], self.used[which] = number @ self.worth, number[:, 0]
        self.size[which] = _estimate(self.m, self.m - self.fall[which], self.m - self.used[which])

    def join(self, i: int, k: int, new: int) -> None:
        np.bitwise_or(self.bits[i], self.bits[k], out=self.bits[new])
        self._measure(slice(new, new + 1))

    def __call__(self, others, one: int) -> np.ndarray:
        reached = max(int(np.flatnonzero(self.bits[one].any(1)).max(initial=0)) + 1, 1)
        shared = self._counted(self.bits[others, :reached] & self.bits[one, :reached])
        share = self.m - self.fall[others] - self.fall[one] + shared @ self.worth[:reached]
        union = _estimate(self.m, share, self.m - self.used[others] - self.used[one] + shared[:, 0])
        return np.clip(2 - (self.size[others] + self.size[one]) / np.maximum(union, 1), 0, 1)


def cluster(regs: np.ndarray) -> list[int]:
    """An order in which alike sets are neighbours: the closest two clusters, by the distance of
    their unions, become one until one is left; each time the closer ends meet."""
    n = len(regs)
    alike = _Alike(regs)
    between = np.stack([alike(slice(0, n), i) for i in range(n)])
    order = {i: [i] for i in range(n)}
    heap = [(d, i, k) for i in range(n) for k, d in enumerate(between[i, i + 1 :].tolist(), i + 1)]
    heapq.heapify(heap)
    new = n
    while len(order) > 1:
        _, i, k = heapq.heappop(heap)
        if i not in order or k not in order:
            continue
        a, b = order.pop(i), order.pop(k)
        ways = [(between[x[-1], y[0]], w) for w, (x, y) in enumerate(((a, b), (a, b[::-1]), (a[::-1], b), (a[::-1], b[::-1])))]
        way = min(ways)[1]
        alike.join(i, k, new)
        if order:
            others = np.fromiter(order, np.int64)
            for x, d in zip(others.tolist(), alike(others, new).tolist()):
                heapq.heappush(heap, (d, x, new))
        order[new] = (a[::-1] if way > 1 else a) + (b[::-1] if way % 2 else b)
        new += 1
    return next(iter(order.values()))


def intervals(counts: np.ndarray, ratio: float) -> np.ndarray:
    """Numbers of the stretches of descending counts that are rearranged together."""
    out, start = np.zeros(len(counts), np.int64), 0
    for i in range(1, len(counts)):
        if counts[i] < counts[start] * ratio or i - start == INTERVAL:
            start = i
            out[i:] += 1
    return out


def flips(ends: list[tuple[np.ndarray, np.ndarray]]) -> list[bool]:
    """Which stretches to turn round, so that each begins with what is closer to the one before."""
    out, last = [], None
    for head, tail in ends:
        turn = False
        if last is not None:
            both = np.stack([head, tail])
            turn = bool(np.diff(distances(both, cardinalities(both), last, float(cardinalities(last))))[0] < 0)
        out.append(turn)
        last = head if turn else tail
    return out


def order_by_similarity(counts: np.ndarray, regs: np.ndarray, ratio: float) -> np.ndarray:
    """The whole rearrangement of one filter's user bins (in descending size)."""
    number = intervals(counts, ratio)
    parts = [np.flatnonzero(number == k) for k in range(int(number[-1]) + 1)]
    parts = [p[cluster(regs[p])] for p in parts]
    turn = flips([(regs[p[0]], regs[p[-1]]) for p in parts])
    return np.concatenate([p[::-1] if x else p for p, x in zip(parts, turn)])


_spent: dict[str, object] = {}  # accumulators of the driver, by what they measure


def _clock(spark: SparkSession, name: str):
    if name not in _spent or _spent[name][0] is not spark.sparkContext:
        _spent[name] = (spark.sparkContext, spark.sparkContext.accumulator(0.0))
    return _spent[name][1]


def seconds(spark: SparkSession) -> tuple[float, float]:
    """Seconds that tasks spent on union estimates and on rearrangement since the last call."""
    out = []
    for name in ("unions", "rearrangement"):
        clock = _clock(spark, name)
        out.append(float(clock.value))
        clock.value = 0.0
    return out[0], out[1]


def _bins(n: int, tmax: int, root: bool) -> int:
    return tmax if n > tmax or root else min(tmax, next_multiple_of_64(n))


def _placed(pdf: pd.DataFrame, t: int, usable: int, rows, cfg: IndexConfig, unions) -> pd.DataFrame:
    """The layout rows of one filter, whose user bins are in the order of ``rows``."""
    counts = pdf["kmer_count"].to_numpy(np.float64)
    relaxed, load = _relaxed(cfg), _corrections(t, cfg)
    ids, sizes = pdf["ub_id"].tolist(), pdf["kmer_count"].tolist()
    run, path = int(pdf["run"].iloc[0]), [int(x) for x in pdf["ibf_path"].iloc[0]]
    out, fullest, top = [], -1.0, 0
    for a, b, tb, span in rows:
        if a == b:
            weight = counts[a] * load[span]
        else:
            total = counts[a : b + 1].sum()
            weight = relaxed * (min(total, unions(b + 1, a, np.inf)[b - a - 1]) if unions else total)
        if weight > fullest:
            fullest, top = weight, tb
        out += [(run, path, ids[k], sizes[k], tb, span, a != b) for k in range(a, b + 1)]
    got = pd.DataFrame(out, columns=["run", "ibf_path", "ub_id", "kmer_count", "tb", "span", "merged"])
    return got.assign(max_tb=top, bins=usable, pos=np.arange(len(got)))


def _descending(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, int]:
    """The filter's rows by size, its bins, and those that are not to stay empty."""
    pdf = pdf.sort_values(["kmer_count", "ub_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    return pdf, int(pdf["tmax"].iloc[0]), len(pdf["ibf_path"].iloc[0])


def _rows_of(counts: np.ndarray, tmax: int, depth: int, cfg: IndexConfig, unions=None, room: float | None = None):
    t = _bins(len(counts), tmax, not depth)
    usable = max(t - int(t * cfg.empty_bin_fraction), 1)
    if depth and len(counts) <= usable:
        return spread(counts, usable, cfg), t, usable
    return optimise(counts, usable, cfg, unions, room), t, usable


def _kernel(cfg: IndexConfig, has_regs: bool, spent, moves):
    """One filter in one task: counts, and registers of small filters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, tmax, depth = _descending(pdf)
        unions = None
        if has_regs and len(pdf) > _bins(len(pdf), tmax, not depth):
            regs = np.stack([np.frombuffer(r, np.uint8) for r in pdf["regs"]])
            began = time.perf_counter()
            if not cfg.disable_rearrangement:
                order = order_by_similarity(pdf["kmer_count"].to_numpy(np.float64), regs, cfg.max_rearrangement_ratio)
                pdf, regs = pdf.iloc[order].reset_index(drop=True), regs[order]
            moves.add(time.perf_counter() - began)
            plain = unions_of(regs)

            def unions(j, first, most):
                began = time.perf_counter()
                out = plain(j, first, most)
                spent.add(time.perf_counter() - began)
                return out

        rows, t, usable = _rows_of(pdf["kmer_count"].to_numpy(np.float64), tmax, depth, cfg, unions)
        return _placed(pdf, t, usable, rows, cfg, unions)

    return run


FILTER = ["run", "ibf_path"]
_ROW = "run long, ibf_path array<long>, ub_id long, kmer_count long, tmax long"


PLACED = _ROW + ", pos long, first long, most double, room double, size long, blocks array<long>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rearranged(work: DataFrame, regs: DataFrame, cfg: IndexConfig, moves) -> DataFrame:
    """Rows of filters with many user bins in their final order (``pos``), and what the band needs:
    how far back runs reach, the weights' caps, and the blocks that want a position's registers."""

    def number(pdf):
        pdf = _descending(pdf)[0]
        counts = pdf["kmer_count"].to_numpy(np.float64)
        return pdf.assign(part=np.zeros(len(pdf), np.int64) if cfg.disable_rearrangement else intervals(counts, cfg.max_rearrangement_ratio), pos=np.arange(len(pdf)))

    def order(pdf):
        began = time.perf_counter()
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        all_ = np.stack([np.frombuffer(r, np.uint8) for r in pdf["regs"]])
        pdf = pdf.iloc[cluster(all_)].reset_index(drop=True)
        ends = pdf["regs"].where((pdf.index == 0) | (pdf.index == len(pdf) - 1), None)
        moves.add(time.perf_counter() - began)
        return pdf.assign(inner=np.arange(len(pdf)), regs=ends)

    def place(pdf):
        if not cfg.disable_rearrangement:
            began = time.perf_counter()
            parts = [p.sort_values("inner") for _, p in pdf.groupby("part", sort=True)]
            bytes_of = lambda r: np.frombuffer(r, np.uint8)
            turn = flips([(bytes_of(p["regs"].iloc[0]), bytes_of(p["regs"].iloc[-1])) for p in parts])
            pdf = pd.concat([p.iloc[::-1] if x else p for p, x in zip(parts, turn)], ignore_index=True)
            moves.add(time.perf_counter() - began)
        else:
            pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        counts = pdf["kmer_count"].to_numpy(np.float64)
        t = int(pdf["tmax"].iloc[0])
        usable = max(t - int(t * cfg.empty_bin_fraction), 1)
        room = slack(counts, usable, cfg) * (1 + 1e-9)
        n = len(pdf)
        own = pdf[["run", "ibf_path", "ub_id", "kmer_count", "tmax"]].assign(pos=np.arange(n), room=room, size=n)
        if not np.isfinite(room):
            return own.assign(first=0, most=np.inf, blocks=[[]] * n)[_names(PLACED)]
        first = reach(counts, usable, cfg, room)[1:]  # of the runs that end with a position
        low = np.minimum.reduceat(first, np.arange(0, n, BLOCK))
        low = np.minimum.accumulate(low[::-1])[::-1]  # of a block and all behind it
        last = np.searchsorted(low, np.arange(n), side="right") - 1
        return own.assign(first=first, most=room / usable / _relaxed(cfg), blocks=[list(range(p // BLOCK, max(b, p // BLOCK) + 1)) for p, b in enumerate(last.tolist())])[_names(PLACED)]

    numbered = work.groupBy(*FILTER).applyInPandas(number, _ROW + ", part long, pos long")
    if not cfg.disable_rearrangement:
        with_regs = numbered.join(regs, "ub_id").select(*numbered.columns, "regs")
        numbered = with_regs.groupBy(*FILTER, "part").applyInPandas(order, _ROW + ", part long, pos long, regs binary, inner long")
    return numbered.groupBy(*FILTER).applyInPandas(place, PLACED)


def rearrange(counts: DataFrame, regs: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(ub_id, pos): all user bins in descending size, similar ones next to each other."""
    work = counts.select(F.lit(cfg.tmax).cast("long").alias("run"), F.array().cast("array<long>").alias("ibf_path"), "ub_id", F.col("kmer_count").cast("long").alias("kmer_count"), F.lit(cfg.tmax).cast("long").alias("tmax"))
    return _rearranged(work, regs, cfg, _clock(counts.sparkSession, "rearrangement")).select("ub_id", "pos")


def _large(work: DataFrame, regs: DataFrame, cfg: IndexConfig, spent, moves) -> DataFrame:
    """Layout rows of filters with many user bins and union estimates: registers only meet within
    an interval, and within a block of positions and the runs that reach into it. Where nothing
    bounds the runs, one task fills the table as registers pass by, and holds none."""

    def passing(batches):
        began, held, table_ = 0.0, [], None

        def end():
            rows, sizes = table_.rows()
            pdf = pd.concat(held, ignore_index=True)
            spent.add(began)
            return _placed(pdf, int(pdf["tmax"].iloc[0]), table_.t, rows, cfg, lambda j, a, _: {j - a - 2: sizes[j - 1]})

        for batch in batches:
            starts = np.flatnonzero(batch["pos"].to_numpy() == 0).tolist()
            for a, b in zip([0, *starts], [*starts, len(batch)]):
                part = batch.iloc[a:b]
                if not len(part):
                    continue
                if part["pos"].iloc[0] == 0:
                    if table_:
                        yield end()
                    t = int(part["tmax"].iloc[0])
                    began, held, table_ = 0.0, [], Table(int(part["size"].iloc[0]), max(t - int(t * cfg.empty_bin_fraction), 1), len(part["regs"].iloc[0]), cfg)
                since = time.perf_counter()
                for count, regs in zip(part["kmer_count"].tolist(), part["regs"]):
                    table_.add(float(count), np.frombuffer(regs, np.uint8))
                began += time.perf_counter() - since
                held.append(part.drop(columns="regs"))
        if table_:
            yield end()

    def bands(pdf):
        began = time.perf_counter()
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        base = int(pdf["pos"].iloc[0])
        sizes = unions_of(np.stack([np.frombuffer(r, np.uint8) for r in pdf["regs"]]), base)
        own = pdf[pdf["pos"] // BLOCK == pdf["block"]]
        got = [sizes(int(p) + 1, int(f), m).astype(np.float32) for p, f, m in zip(own["pos"], own["first"], own["most"])]
        spent.add(time.perf_counter() - began)
        return own[["run", "ibf_path", "pos"]].assign(sizes=got)

    def solve(pdf):
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        band = pdf["sizes"].tolist()

        def unions(j, first, most):
            return np.asarray(band[j - 1][: j - 1 - first], np.float64)

        rows, t, usable = _rows_of(pdf["kmer_count"].to_numpy(np.float64), int(pdf["tmax"].iloc[0]), len(pdf["ibf_path"].iloc[0]), cfg, unions, float(pdf["room"].iloc[0]))
        return _placed(pdf, t, usable, rows, cfg, unions)

    placed = table(_rearranged(work, regs, cfg, moves), "placed")
    endless = F.col("room") == float("inf")
    free = _dealt(placed.where(endless).join(regs, "ub_id").select(*FILTER, "ub_id", "kmer_count", "tmax", "pos", "size", "regs")).sortWithinPartitions(*FILTER, "pos").mapInPandas(passing, ROWS)
    placed = placed.where(~endless)
    spread_ = placed.join(regs, "ub_id").select("run", "ibf_path", "pos", "first", "most", "regs", F.explode("blocks").alias("block"))
    band = spread_.groupBy(*FILTER, "block").applyInPandas(bands, "run long, ibf_path array<long>, pos long, sizes array<float>")
    return placed.drop("blocks").join(band, [*FILTER, "pos"]).groupBy(*FILTER).applyInPandas(solve, ROWS).unionByName(free)


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """Filters dealt over all tasks: their rows are few bytes, which Spark would put into one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *FILTER, *more)


def layouts(counts: DataFrame, candidates: list[int], cfg: IndexConfig, regs: DataFrame | None = None) -> DataFrame:
    """Rows of ``ROWS`` for each candidate number of technical bins (column ``run``).

    ``counts`` is (ub_id, kmer_count), ``regs`` optionally (ub_id, regs binary). The loop ends
    when no filter of a level has merged bins; a layout has few levels, each a written table."""
    spark = counts.sparkSession
    use = regs is not None and not cfg.disable_estimate_union
    spent, moves = _clock(spark, "unions"), _clock(spark, "rearrangement")
    tries = spark.createDataFrame([(t, t) for t in candidates], "run long, tmax long")  # a few rows
    front = counts.select("ub_id", F.col("kmer_count").cast("long").alias("kmer_count")).crossJoin(F.broadcast(tries)).select("run", F.array().cast("array<long>").alias("ibf_path"), "ub_id", "kmer_count", "tmax")
    done: list[DataFrame] = []
    while True:
        if use:
            size = front.groupBy(*FILTER, "tmax").count()
            large = size.where(f"count > {WHOLE} AND count > tmax").drop("count", "tmax")
            many = large.count()
            small = front.join(large, FILTER, "left_anti") if many else front
            level = _dealt(small.join(regs, "ub_id")).groupBy(*FILTER).applyInPandas(_kernel(cfg, True, spent, moves), ROWS)
            if many:
                level = level.unionByName(_large(front.join(large, FILTER, "left_semi"), regs, cfg, spent, moves))
        else:
            level = _dealt(front).groupBy(*FILTER).applyInPandas(_kernel(cfg, False, spent, moves), ROWS)
        level = table(level, "layout-level")
        done.append(level)
        front = level.where("merged").select("run", F.concat("ibf_path", F.array("tb")).alias("ibf_path"), "ub_id", "kmer_count", F.col("run").alias("tmax"))
        if front.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def to_layout(rows: DataFrame, run: int) -> Layout:
    """One candidate's rows as a layout (its size is the number of user bins)."""
    own = rows.where(F.col("run") == run)
    lay = Layout()
    for r in own.where("not merged").select("ibf_path", "pos", "ub_id", "tb", "span").collect():
        lay.user_bins.append((r["ub_id"], tuple(r["ibf_path"]), r["tb"], r["span"]))
    lay.user_bins.sort(key=lambda u: ([*u[1], u[2]], u[0]))
    lay.max_bins = {tuple(r["ibf_path"]): r["max_tb"] for r in own.select("ibf_path", "max_tb").distinct().collect()}
    return lay


def candidates(tmax: int, user_bins: int) -> list[int]:
    """Powers of two from 64 to ``tmax``, and the multiple of 64 at the square root."""
    out, t = set(), 64
    while t <= tmax:
        out.add(t)
        t *= 2
    root = int(np.ceil(np.sqrt(user_bins)))
    return sorted(out | {next_multiple_of_64(root)})


def compute(spark: SparkSession, counts: DataFrame, cfg: IndexConfig, regs: DataFrame | None = None) -> Layout:
    return to_layout(layouts(counts, [cfg.tmax], cfg, regs), cfg.tmax)
