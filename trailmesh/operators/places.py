"""Home and work places: density clusters of each phone's points."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, times
from .points import accurate, deltas

HOME_HOURS = (20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6, 7)
WORK_HOURS = tuple(range(9, 20))
DAYS_OFF = (19, 20, 26, 27)


def _dbscan_dense(x: np.ndarray, y: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """dbscan() of few points, by the whole matrix of neighbours."""
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core, label, number = near.sum(1) >= min_samples, np.full(len(x), -1), 0
    while len(left := np.flatnonzero(core & (label < 0))):
        front = np.zeros(len(x), bool)
        front[left[0]] = True
        while front.any():
            label[front] = number
            front = near[front & core].any(0) & (label < 0)
        number += 1
    return label


def dbscan(x: np.ndarray, y: np.ndarray, eps: float = 100.0, min_samples: int = 2, dense: int = 256) -> np.ndarray:
    """Cluster numbers by first core point, -1 for noise; a border point belongs to the first cluster that reaches it.

    Equal places are one, with a weight. Places are put in cells so small that all of a cell are neighbours; cells are
    linked where any two of their core places are, so no list of neighbours is held: memory grows with the number of
    distinct places, and comparisons are made in bounded pieces. At most `dense` points are compared at once instead, with the same result.
    """
    if len(x) <= dense:
        return _dbscan_dense(x, y, eps, min_samples)
    spots, first, own, weight = np.unique(np.stack([x, y], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    own = own.ravel()
    cell = np.floor(spots / (eps / np.sqrt(2)) * (1 - 1e-12)).astype(np.int64)
    grid: dict[tuple[int, int], np.ndarray] = {}
    order = np.lexsort((cell[:, 1], cell[:, 0]))
    edges = np.flatnonzero(np.any(np.diff(cell[order], axis=0), axis=1)) + 1
    for members in np.split(order, edges):
        grid[tuple(cell[members[0]].tolist())] = members
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]

    def close(a: np.ndarray, b: np.ndarray):
        """Pieces (places of a, whether each is near each of b)."""
        step = max(1, 1_000_000 // len(b))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            d = spots[part][:, None] - spots[b][None]
            yield part, (d * d).sum(2) <= eps * eps

    core = np.zeros(len(spots), bool)
    for key, members in grid.items():
        total = int(weight[members].sum())
        if total >= min_samples:
            core[members] = True
            continue
        near = np.full(len(members), total)
        for i, j in around:
            other = grid.get((key[0] + i, key[1] + j))
            if other is not None:
                near += np.concatenate([hit @ weight[other] for _, hit in close(members, other)])
        core[members] = near >= min_samples
    parent = {key: key for key, members in grid.items() if core[members].any()}

    def root(key):
        while parent[key] != key:
            parent[key] = key = parent[parent[key]]
        return key

    for key in parent:
        mine = grid[key][core[grid[key]]]
        for i, j in around:
            other = (key[0] + i, key[1] + j)
            if other > key and other in parent and root(other) != root(key) and any(hit.any() for _, hit in close(mine, grid[other][core[grid[other]]])):
                parent[root(other)] = root(key)
    start: dict[tuple[int, int], int] = {}
    for key in parent:
        at = int(first[grid[key][core[grid[key]]]].min())
        start[root(key)] = min(at, start.get(root(key), at))
    number = {key: n for n, key in enumerate(sorted(start, key=start.__getitem__))}
    label = np.full(len(spots), -1)
    for key, members in grid.items():
        if key in parent:
            label[members] = number[root(key)]  # its others are within eps of its core places
        for k in members[~core[members]]:
            reached = [label[k]] if label[k] >= 0 else []
            for i, j in around:
                other = (key[0] + i, key[1] + j)
                if other in parent and any(hit.any() for _, hit in close(np.array([k]), grid[other][core[grid[other]]])):
                    reached.append(number[root(other)])
            label[k] = min(reached, default=-1)
    return label[own]


def main_place(points: DataFrame, name: str, eps: float = 100.0, min_samples: int = 2, noise: bool = True) -> DataFrame:
    """(phone_id, name): the mean of the distinct points of the phone's most frequent cluster; of equal ones the one seen first. noise: single points together count as a cluster.

    Clusters need all of a phone's points at once: one phone's points in hours of a kind, which devices' sampling rates bound.
    """
    kind = dict(points.dtypes)["phone_id"]

    def place(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["ts", "ord"])
        x, y = df["x"].to_numpy(float), df["y"].to_numpy(float)
        label = dbscan(x, y, eps, min_samples)
        count = Counter(label.tolist() if noise else label[label >= 0].tolist())
        if not count:
            return pd.DataFrame({"phone_id": [], "px": [], "py": []})
        best = count.most_common(1)[0][0]
        own = np.unique(np.stack([x[label == best], y[label == best]], 1), axis=0)
        return pd.DataFrame({"phone_id": [df["phone_id"].iloc[0]], "px": [own[:, 0].mean()], "py": [own[:, 1].mean()]})

    out = points.select("phone_id", "ts", "ord", "x", "y").groupBy("phone_id").applyInPandas(place, f"phone_id {kind}, px double, py double")
    return out.select("phone_id", geo.point(F.col("px"), F.col("py")).alias(name))


def at_hours(points: DataFrame, hours: tuple[int, ...], days_off: tuple[int, ...] = (), most: float = 50, speed_filter: bool = False, kmh: float = 2) -> DataFrame:
    """Accurate points in hours (UTC), not on days_off; speed_filter drops points that were reached faster than kmh."""
    p = points
    if speed_filter:
        p = deltas(p).filter(F.col("s") < kmh).drop("d", "t", "s", "new_phone")
    p = accurate(p, most).filter(times.hour(F.col("ts")).isin(list(hours)))
    return p.filter(~F.dayofmonth(times.date(F.col("ts"))).isin(list(days_off))) if days_off else p


def home_places(points: DataFrame, **how) -> DataFrame:
    return main_place(at_hours(points, HOME_HOURS, **how), "domicile")


def work_places(points: DataFrame, **how) -> DataFrame:
    return main_place(at_hours(points, WORK_HOURS, DAYS_OFF, **how), "emploi")
