"""Shares of lines near a network of segments, over Arrow arrays; the closed form of geo.near_interval() over numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def near_interval(a: np.ndarray, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, some) of segments a near segments q, rows (ax, ay, bx, by) pair by pair: geo.near_interval(), NaN in place of null. lo and hi hold where some."""
    ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], q[2] - q[0], q[3] - q[1]
    px, py, rx, ry = a[0] - q[0], a[1] - q[1], a[0] - q[2], a[1] - q[3]
    near = lambda x, y: x * x + y * y - radius * radius
    with np.errstate(invalid="ignore", divide="ignore"):
        l = np.sqrt(vx * vx + vy * vy)
        wx, wy = (np.where(l > 0, v / l, np.nan) for v in (vx, vy))
        uu = ux * ux + uy * uy

        def disc(b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
            inside = b * b - uu * c
            return [np.where((inside >= 0) & (uu > 0), (-b + sign * np.sqrt(inside)) / uu, np.nan) for sign in (-1, 1)]

        def slab(v0: np.ndarray, v1: np.ndarray, lo, hi) -> list[np.ndarray]:
            within = (v0 >= lo) & (v0 <= hi)
            ends = (lo - v0) / v1, (hi - v0) / v1
            return [np.where(v1 == 0, np.where(within, far, np.nan), pick(*ends)) for pick, far in ((np.minimum, -1e18), (np.maximum, 1e18))]

        d1, e1 = disc(ux * px + uy * py, near(px, py))
        d2, e2 = disc(ux * rx + uy * ry, near(rx, ry))
        along = slab(px * wx + py * wy, ux * wx + uy * wy, 0.0, l)
        across = slab(px * wy - py * wx, ux * wy - uy * wx, -radius, radius)
        s, e = np.maximum(along[0], across[0]), np.minimum(along[1], across[1])
        rect = s <= e
        lo = np.fmax(np.fmin(np.fmin(d1, d2), np.where(rect, s, np.nan)), 0.0)
        hi = np.fmin(np.fmax(np.fmax(e1, e2), np.where(rect, e, np.nan)), 1.0)
        return lo, hi, (~np.isnan(d1) | ~np.isnan(d2) | rect) & (lo < hi)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, nth) of counts[i] entries of each i, in order."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Grid:
    """Segments (rows ax, ay, bx, by) of kinds (numbers below n_kinds), listed by the cells that their boxes, widened by radius, touch.

    About as many cells as segments, over their common box: a segment that is asked for meets each at most once by cell.
    """

    def __init__(self, segments: np.ndarray, kinds: np.ndarray, n_kinds: int, radius: float):
        self.segments, self.kinds, self.n_kinds, self.radius = segments, kinds, n_kinds, radius
        n = segments.shape[1]
        self.side = max(1, min(256, int(np.ceil(np.sqrt(n)))))
        box = self._box(segments, radius)
        self.corner = np.array([box[0].min(), box[1].min()]) if n else np.zeros(2)
        self.far = np.array([box[2].max(), box[3].max()]) if n else np.zeros(2)
        self.step = np.maximum((self.far - self.corner) / self.side, 1e-9)
        self.box, self.low = box, self._cells(box)
        owner, cell = self._listed(self.low)
        order = np.argsort(cell, kind="stable")
        self.members = owner[order]
        self.start = np.searchsorted(cell[order], np.arange(self.side * self.side + 1))
        self.sums = np.zeros((self.side + 1, self.side + 1), np.int64)  # of members over cells, for counts by rectangle
        self.sums[1:, 1:] = np.diff(self.start).reshape(self.side, self.side).cumsum(0).cumsum(1)

    @staticmethod
    def _box(s: np.ndarray, by: float) -> np.ndarray:
        return np.array([np.minimum(s[0], s[2]) - by, np.minimum(s[1], s[3]) - by, np.maximum(s[0], s[2]) + by, np.maximum(s[1], s[3]) + by])

    def _cells(self, box: np.ndarray) -> np.ndarray:
        at = lambda v, k: np.clip(np.floor((v - self.corner[k]) / self.step[k]), 0, self.side - 1).astype(np.int64)
        return np.array([at(box[0], 0), at(box[1], 1), at(box[2], 0), at(box[3], 1)])

    def _listed(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = c[3] - c[1] + 1
        owner, nth = spread((c[2] - c[0] + 1) * high)
        return owner, (c[0][owner] + nth // high[owner]) * self.side + c[1][owner] + nth % high[owner]

    def near_lengths(self, own: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """(n_kinds, len): for each segment of own (rows ax, ay, bx, by) its length within radius of segments of each kind. At most about `most` pairs are held at once, and one segment's."""
        out = np.zeros((self.n_kinds, own.shape[1]))
        box = self._box(own, 0.0)
        met = np.flatnonzero((box[2] >= self.corner[0]) & (box[0] <= self.far[0]) & (box[3] >= self.corner[1]) & (box[1] <= self.far[1])) if len(self.kinds) else np.zeros(0, np.int64)
        c, s = self._cells(box[:, met]), self.sums
        work = s[c[2] + 1, c[3] + 1] - s[c[0], c[3] + 1] - s[c[2] + 1, c[1]] + s[c[0], c[1]] + (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
        chunk = np.cumsum(work) // most
        for part in np.split(np.arange(len(met)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(part):
                self._add(own, met[part], box[:, met[part]], c[:, part], out)
        return out

    def _add(self, own: np.ndarray, ids: np.ndarray, box: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        k, cell = self._listed(c)
        pick, nth = spread(self.start[cell + 1] - self.start[cell])
        k, cell = k[pick], cell[pick]
        q = self.members[self.start[cell] + nth]
        first = (cell // self.side == np.maximum(c[0][k], self.low[0][q])) & (cell % self.side == np.maximum(c[1][k], self.low[1][q]))  # each pair once, in the first cell of both
        touch = (box[2][k] >= self.box[0][q]) & (box[0][k] <= self.box[2][q]) & (box[3][k] >= self.box[1][q]) & (box[1][k] <= self.box[3][q])
        k, q = k[first & touch], q[first & touch]
        lo, hi, some = near_interval(own[:, ids[k]], self.segments[:, q], self.radius)
        k, q, lo, hi = k[some], q[some], lo[some], hi[some]
        group = k * self.n_kinds + self.kinds[q]
        order = np.lexsort((hi, lo, group))
        group, lo, hi = group[order], lo[order], hi[order]
        n = len(group)
        if not n:
            return
        # the running maximum of hi in each group, by rank: exact
        by_rank = np.argsort(hi, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_rank] = np.arange(n)
        _, number = np.unique(group, return_inverse=True)
        before = np.concatenate([[-1], np.maximum.accumulate(number * n + rank)[:-1]])
        reached = np.where(before // n == number, hi[by_rank[before % n]], lo)
        fresh = np.maximum(hi - np.maximum(lo, reached), 0.0)
        a = own[:, ids[group // self.n_kinds]]
        dx, dy = a[0] - a[2], a[1] - a[3]
        np.add.at(out, (group % self.n_kinds, ids[group // self.n_kinds]), fresh * np.sqrt(dx * dx + dy * dy))

    def shares(self, lines: pa.Array) -> np.ndarray:
        """(n_kinds, len): of each line (list of struct x, y) the share of its length within radius; 0 for null lines and those without length."""
        counts = np.asarray(lines.value_lengths().fill_null(0))
        at = lines.flatten()  # without what lies under nulls
        x, y = (np.asarray(at.field(c), float) for c in ("x", "y"))
        owner = np.repeat(np.arange(len(lines)), counts)
        i = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
        own = np.array([x[i], y[i], x[i + 1], y[i + 1]])
        dx, dy = own[0] - own[2], own[1] - own[3]
        total = np.bincount(owner[i], np.sqrt(dx * dx + dy * dy), len(lines))
        near = self.near_lengths(own)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.array([np.where(total > 0, np.bincount(owner[i], near[j], len(lines)) / total, 0.0) for j in range(self.n_kinds)])
