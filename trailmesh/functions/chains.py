"""Hidden Markov map-matching of whole trips over numpy arrays, against a road network that one process holds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .overlap import spread


def whole_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole trips, of batches in which each trip's rows lie one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("trip_id")
        if not len(ids):
            continue
        cuts = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
        last = int(cuts[-1]) + 1 if len(cuts) else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column("trip_id")[-1] != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class Network:
    """Links (names in ascending order, places a and b as numbers, length), their segments (rows ax, ay, bx, by, of link `of`, in order) listed by the cells of radius that they touch widened by it, and edges (a, b, cost)."""

    def __init__(self, names: list, a: np.ndarray, b: np.ndarray, length: np.ndarray, segments: np.ndarray, of: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], places: int, radius: float, most: int):
        self.names, self.a, self.b, self.length, self.segments, self.of = pa.array(names), a, b, length, segments, of
        self.radius, self.most, self.places = radius, most, places
        order = np.argsort(edges[0], kind="stable")
        self.targets, self.weights = edges[1][order].tolist(), edges[2][order].tolist()
        self.first = np.searchsorted(edges[0][order], np.arange(places + 1)).tolist()
        dx, dy = segments[0] - segments[2], segments[1] - segments[3]
        self.l = np.sqrt(dx * dx + dy * dy)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        self.before = np.concatenate([np.append(0.0, np.cumsum(own)[:-1]) for own in np.split(self.l, starts[1:])]) if len(of) else np.zeros(0)
        c = self.boxes(segments, radius)
        high = c[3] - c[1] + 1
        owner, nth = spread((c[2] - c[0] + 1) * high)
        cx, cy = c[0][owner] + nth // high[owner], c[1][owner] + nth % high[owner]
        self.corner = np.array([cx.min(), cy.min()]) if len(cx) else np.zeros(2, np.int64)
        self.size = np.array([cx.max(), cy.max()]) - self.corner + 1 if len(cx) else np.zeros(2, np.int64)
        key = (cx - self.corner[0]) * self.size[1] + cy - self.corner[1]
        order = np.argsort(key, kind="stable")
        self.keys, self.members = key[order], owner[order]
        self.known, self.cost = None, None

    @staticmethod
    def boxes(s: np.ndarray, radius: float) -> np.ndarray:
        """Rows of the first and last cells, by x and y, of segments widened by radius."""
        return np.floor(np.array([np.minimum(s[0], s[2]) - radius, np.minimum(s[1], s[3]) - radius, np.maximum(s[0], s[2]) + radius, np.maximum(s[1], s[3]) + radius]) / radius).astype(np.int64)

    def between(self, origins: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Costs of shortest paths, inf where there is none. Each origin is solved once in a process."""
        if self.known is None:
            self.known, self.cost = np.zeros(self.places, bool), np.full((self.places, self.places), np.inf)
        for o in np.unique(origins[~self.known[origins]]).tolist():
            best, done, heap = {o: 0.0}, set(), [(0.0, o)]
            while heap:
                c, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                for k in range(self.first[u], self.first[u + 1]):
                    v, d = self.targets[k], c + self.weights[k]
                    if v not in done and d < best.get(v, np.inf):
                        best[v] = d
                        heapq.heappush(heap, (d, v))
            self.cost[o, list(best)] = list(best.values())
            self.known[o] = True
        return self.cost[origins, targets]

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(point, link, dist, offset), by point and link: the at most `most` nearest links of each point within radius; see matching.candidates()."""
        rows = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        cx, cy = (np.floor(v[rows] / self.radius) - c for v, c in zip((x, y), self.corner))
        inside = (cx >= 0) & (cx < self.size[0]) & (cy >= 0) & (cy < self.size[1])
        rows, key = rows[inside], (cx[inside] * self.size[1] + cy[inside]).astype(np.int64)
        lo = np.searchsorted(self.keys, key)
        own, nth = spread(np.searchsorted(self.keys, key, "right") - lo)
        p, s = rows[own], self.members[lo[own] + nth]
        ax, ay, bx, by = self.segments[:, s]
        dx, dy, px, py = bx - ax, by - ay, x[p], y[p]
        size = dx * dx + dy * dy
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(size > 0, np.minimum(np.maximum(((px - ax) * dx + (py - ay) * dy) / size, 0.0), 1.0), 0.0)
        ex, ey = px - (ax + dx * t), py - (ay + dy * t)
        dist = np.sqrt(ex * ex + ey * ey)
        near = dist < self.radius
        p, s, dist, t = p[near], s[near], dist[near], t[near]
        link, offset = self.of[s], self.before[s] + t * self.l[s]
        order = np.lexsort((offset, dist, link, p))
        p, link, dist, offset = p[order], link[order], dist[order], offset[order]
        nearest = np.append(True, (p[1:] != p[:-1]) | (link[1:] != link[:-1]))[: len(p)]
        p, link, dist, offset = p[nearest], link[nearest], dist[nearest], offset[nearest]
        order = np.lexsort((link, dist, p))
        starts = np.flatnonzero(np.append(True, np.diff(p) != 0))[: len(p)]
        counts = np.diff(np.append(starts, len(p)))
        kept = np.sort(order[spread(counts)[1] < self.most])
        return p[kept], link[kept], dist[kept], offset[kept]

    def match(self, trips: pa.Table, sigma: float, beta: float) -> pa.Table:
        """(trip_id, seq, next_seq, link_a, link_b, offset_a, offset_b, route) of whole trips (trip_id, seq, x, y): each trip's cheapest chain, see matching.decode(); a trip without one has one row, null but for its trip_id.

        Layer by layer over all trips at once, so that what is held beside the candidates is one layer's transitions.
        """
        ids = trips["trip_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        x, y, seq = (trips[c].to_numpy() for c in ("x", "y", "seq"))
        fresh = np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
        trip, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        dx, dy = x - np.append(x[1:], np.nan), y - np.append(y[1:], np.nan)
        gps = np.sqrt(dx * dx + dy * dy)  # at a trip's last point never asked for
        point, link, dist, offset = self.candidates(x, y)
        n = len(point)
        start = np.flatnonzero(np.append(True, np.diff(point) != 0))[:n]
        count = np.diff(np.append(start, n))
        at = point[start]  # of layers
        new = np.append(True, np.diff(trip[at]) != 0)[: len(at)]
        place = spread(np.diff(np.append(np.flatnonzero(new), len(at))))[1]  # of a layer in its trip
        steps = np.flatnonzero(~new) - 1  # from a layer to the next
        steps = steps[np.argsort(place[steps], kind="stable")]
        total, by, routes = np.where(place == 0, 0.0, np.inf).repeat(count), np.full(n, -1), np.zeros(n)
        far = dist / sigma
        emission = 0.5 * (far * far)
        for own in np.split(steps, np.flatnonzero(np.diff(place[steps])) + 1) if len(steps) else []:
            na, nb = count[own], count[own + 1]
            step, nth = spread(na * nb)
            a, b = start[own][step] + nth % na[step], start[own + 1][step] + nth // na[step]
            la, lb = link[a], link[b]
            route = np.where(la == lb, offset[b] - offset[a], self.between(self.b[la], self.a[lb]) + self.length[la] - offset[a] + offset[b])
            sums = total[a] + (emission[a] + np.abs(route - gps[at[own]][step]) / beta)
            sums[np.isnan(sums)] = np.inf
            sizes = np.repeat(na, nb)  # transitions into each candidate, from links in ascending order
            heads_ = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(sums, heads_)
            rows = np.flatnonzero(sums == np.repeat(least, sizes))
            rows = rows[np.append(True, np.diff(b[rows]) != 0)]  # the first of equal ones
            into = b[rows]
            total[into], routes[into] = least, route[rows]
            by[into] = np.where(np.isfinite(least), a[rows], -1)
        last = np.flatnonzero(np.append(new[1:], True)[: len(at)] & (place > 0))
        ends = np.zeros(0, np.int64)
        if len(last):
            own, nth = spread(count[last])
            c = start[last][own] + nth
            heads_ = np.flatnonzero(nth == 0)
            rows = np.flatnonzero(total[c] == np.repeat(np.minimum.reduceat(total[c], heads_), count[last]))
            rows = rows[np.append(True, np.diff(own[rows]) != 0)]
            ends = c[rows][np.isfinite(total[c[rows]])]
        passed, here = [], ends
        while len(here):
            here = here[by[here] >= 0]
            passed.append(here)
            here = by[here]
        b = np.sort(np.concatenate(passed)) if passed else np.zeros(0, np.int64)
        a = by[b]
        left = np.setdiff1d(np.arange(len(heads)), trip[point[ends]])
        nulls = lambda v: pa.concat_arrays([v, pa.nulls(len(left), v.type)])
        columns = {
            "trip_id": pa.concat_arrays([ids.take(pa.array(point[a])), ids.take(pa.array(heads[left]))]), "seq": nulls(pa.array(seq[point[a]], pa.int32())), "next_seq": nulls(pa.array(seq[point[b]], pa.int32())), "link_a": nulls(self.names.take(pa.array(link[a]))), "link_b": nulls(self.names.take(pa.array(link[b]))),
            "offset_a": nulls(pa.array(offset[a])), "offset_b": nulls(pa.array(offset[b])), "route": nulls(pa.array(routes[b])),
        }
        return pa.table(columns)
