"""The nearest rows of a block of queries among donors that arrive a packet at a time.

A distance is measured only where a lower bound of it does not exceed the k-th least one found so far. The bounds are
sums over the entries of a base, a square and waves of their differences: products of two matrices in single precision,
whatever the power. Between them and the results lies no guess: a bound is true for every difference, and what rounding
can take from it is added to the limit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gaugewright.functions.scalars import DIGITS

FIRST = 64  # donors that are measured with all queries; then twice as many with each step
STEP = 1 << 12  # donors, and queries, whose bounds are taken at once
TILE = 1 << 8
PAIRS = 1 << 12  # pairs that are measured at once
_ONES = np.uint64(0x0101010101010101)


class Bound(NamedTuple):
    """``abs(t) ** p >= base + square * t * t + sum(c * cos(w * t))`` for every t, closest where the mean power is ``usual``."""

    base: float
    square: float
    waves: tuple[tuple[float, float], ...]
    usual: float


# The waves that leave least between the bound and the power for differences spread like normal ones.
BOUNDS = {
    1: Bound(1.7691, 0.0, ((-1.4784204, 0.8589480), (-0.1998401, 2.5050535), (-0.0908847, 4.3890477)), 0.82),
    2: Bound(0.0, 1.0, (), 1.0),
    3: Bound(-1.5298, 2.7317617, ((1.4905696, 1.7240722),), 1.91),
}


def bound_of(p: int) -> Bound:
    """For other powers the tangent of the power of the square."""
    return BOUNDS.get(p) or Bound(1.0 - p / 2, p / 2, (), 1.0)


def distances(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances of all rows of x to the few rows of y."""
    found = np.empty((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    for start in range(0, len(x), TILE):
        total = np.zeros((len(x[start : start + TILE]), len(y)))
        for j, column in enumerate(columns):
            gap = np.abs(x[start : start + TILE, j, None] - column)
            power = gap.copy()
            for _ in range(p - 1):
                power *= gap
            total += power
        found[start : start + TILE] = total ** (1.0 / p)
    return found


def places_within(far: np.ndarray) -> np.ndarray:
    """Flat places of the few entries that are False, eight looked at together."""
    flat = far.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != _ONES)
    near = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return near[~flat[near]]


def ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, missing ones first."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy(zero_copy_only=False)


class Closest:
    """The k nearest donors so far of each query: (at, dist, value, ids), equal distances by id.

    ``limit`` is a distance within which each query is known to have k donors; ``center`` and ``spread`` say where the
    entries lie, on them depends only how much the bounds leave out.
    """

    def __init__(self, query: np.ndarray, k: int, p: int, limit: np.ndarray, center: np.ndarray, spread: np.ndarray):
        self.query, self.k, self.p, self.limit, self.center = query, k, p, limit, center
        self.bound = bound_of(p)
        least = spread.max(initial=0.0) * 1e-6 or 1.0
        self.spread, self.by, self.scale = np.maximum(np.where(np.isfinite(spread), spread, least), least), 0.0, spread
        self.at, self.dist, self.value, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.seen = self.fresh = 0

    def feed(self, donor: np.ndarray, value: np.ndarray, ids: pa.Array, least: np.ndarray) -> None:
        """Donors with their values and ids; ``least`` is a distance below which no query has one of them."""
        start = 0
        while start < len(donor):
            stop = start + min(STEP, max(FIRST, self.seen))
            who = np.flatnonzero(~(least > self.limit * (1 + 1e-9) + 1e-6))
            if len(who):
                self._compare(who, donor[start:stop], value[start:stop], ids[start:stop])
            self.seen += len(donor[start:stop])
            start = stop
            if 2 * self.fresh > self.k * len(self.query):
                self.settle()

    def _tuned(self) -> None:
        """Features of the queries, in units of the distances that count now."""
        known = self.limit[np.isfinite(self.limit)]
        by = self.by or 1.0
        if len(known):
            with np.errstate(over="ignore"):
                by = float((np.median(known) ** self.p / (self.bound.usual * (self.spread**self.p).sum())) ** (1.0 / self.p))
            by = by if np.isfinite(by) and by > 1e-9 else self.by or 1.0
        if not self.by or abs(by / self.by - 1) > 0.05:
            self.by, self.scale = by, self.spread * by
            self.asked, self.own, self.widest = self._features(self.query, True)

    def _features(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows whose products with those of the other side are bounds without their own squares, these, the largest entry."""
        u, weight = (x - self.center) / self.scale, self.scale**self.p
        parts = []
        if self.bound.square:
            parts.append(u * (-2.0 * self.bound.square * weight) if query else u)
        for c, w in self.bound.waves:
            turns = u * (w / (2.0 * np.pi))
            turns = ((turns - np.rint(turns)) * (2.0 * np.pi)).astype("float32")
            parts += [f(turns) * (c * weight) if query else f(turns) for f in (np.cos, np.sin)]
        own = (u * u) @ (self.bound.square * weight)
        parts.append(np.ones((len(x), 1)) if query else own[:, None])
        return np.concatenate(parts, axis=1, dtype="float32", casting="same_kind"), own, float(np.abs(u).max(initial=0.0))

    def _compare(self, who: np.ndarray, donor: np.ndarray, value: np.ndarray, ids: pa.Array) -> None:
        with np.errstate(over="ignore", invalid="ignore"):  # what leaves the numbers is measured
            self._tuned()
            given, own, widest = self._features(donor, False)
            weight, waves = (self.scale**self.p).sum(), self.bound.waves
            power = (self.limit + 2.0 * 10.0**-DIGITS) ** self.p * (1 + 1e-12)
            lost = (given.shape[1] + 16) * np.finfo("float32").eps * (self.own + 2 * own.max() + 2 * weight * sum(abs(c) for c, _ in waves))
            lost += 16 * np.finfo("float64").eps * (1 + max(widest, self.widest)) * weight * sum(abs(c) * w for c, w in waves)
            lost += 64 * np.finfo("float32").eps * weight * sum(abs(c) for c, _ in waves)
            most = power - self.own - self.bound.base * weight + lost
            most = (most + 4e-7 * np.abs(most)).astype("float32")
            for start in range(0, len(who), TILE):
                some = who[start : start + TILE]
                asked = self.asked[some[0] : some[-1] + 1] if some[-1] - some[0] + 1 == len(some) else self.asked[some]
                near = places_within(asked @ given.T > most[some, None])
                for first in range(0, len(near), PAIRS):
                    row, column = np.divmod(near[first : first + PAIRS], len(donor))
                    self._measure(some[row], column, donor, value, ids, power)

    def _measure(self, at: np.ndarray, near: np.ndarray, donor: np.ndarray, value: np.ndarray, ids: pa.Array, power: np.ndarray) -> None:
        gap = self.query.take(at, axis=0)
        gap -= donor.take(near, axis=0)
        np.abs(gap, out=gap)
        if self.p == 1:
            sums = np.einsum("ij->i", gap)
        else:
            factor = gap if self.p == 2 else gap * gap
            for _ in range(self.p - 3):
                factor *= gap
            sums = np.einsum("ij,ij->i", gap, factor)
        kept = np.flatnonzero(np.isfinite(sums) & ~(sums > power[at] * (1 + 1e-12)))
        if not len(kept):
            return
        at, near, dist = at[kept], near[kept], np.round(sums[kept] ** (1.0 / self.p), DIGITS)
        self.held.append((at, dist, value[near], ids.take(pa.array(near))))
        self.fresh += len(at)

    def settle(self) -> None:
        """Only the first k of each query stay."""
        if not self.held:
            return
        parts = [*([(self.at, self.dist, self.value, self.ids)] if self.ids is not None else []), *self.held]
        at, dist, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
        ids = pa.concat_arrays([p[3] for p in parts])
        order = np.argsort(dist)
        order = order[np.argsort(at[order].astype(np.min_scalar_type(len(self.query))), kind="stable")]  # by digits if few
        owner, far = at[order], dist[order]
        if ((owner[1:] == owner[:-1]) & (far[1:] == far[:-1])).any():
            order = np.lexsort((ranks(ids), dist, at))
        many = np.bincount(at, minlength=len(self.query))
        begin = np.cumsum(many) - many
        full = np.flatnonzero(many >= self.k)
        self.limit[full] = np.minimum(self.limit[full], dist[order[begin[full] + self.k - 1]])
        order = order[np.arange(len(order)) - np.repeat(begin, many) < self.k]
        self.at, self.dist, self.value, self.ids = at[order], dist[order], value[order], ids.take(pa.array(order))
        self.held, self.fresh = [], 0
