"""Road networks: two-way links, splitting, nodes, shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def two_way(links: DataFrame, oneway: str = "0") -> DataFrame:
    """links with the reverse of those whose oneway is the given one: columns *_r in place of their namesakes, a and b swapped, geometry turned, index with _r."""
    turned = {c[:-2]: F.col(c) for c in links.columns if c.endswith("_r") and c[:-2] in links.columns}
    turned |= {"a": F.col("b"), "b": F.col("a"), "geometry": geo.reverse_line(F.col("geometry")), "index": F.concat("index", F.lit("_r"))}
    back = links.filter(F.col("oneway") == oneway).select(*[turned.get(c, F.col(c)).alias(c) for c in links.columns])
    return links.unionByName(back)


def split(links: DataFrame, max_length: float = 100, rounds: int = 10) -> DataFrame:
    """Each link in 2^k equal parts, k the halvings that bring them to max_length, at most rounds; adds parent and part."""
    l = geo.line_length(F.col("geometry"))
    halvings = F.greatest(F.ceil(F.log2(F.greatest(l / max_length, F.lit(1.0))) - 1e-12), F.lit(0))
    k = F.least(halvings, F.lit(rounds)).cast("int")
    n = links.withColumn("_l", l).withColumn("_n", F.pow(F.lit(2.0), k).cast("int"))
    n = n.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = F.col("_l") / F.col("_n")
    n = n.withColumn("geometry", F.when(F.col("_n") == 1, F.col("geometry")).otherwise(geo.substring(F.col("geometry"), F.col("part") * step, (F.col("part") + 1) * step)))
    return n.withColumn("parent", F.col("index")).withColumn("length", step).drop("_l", "_n")


def intersections(links: DataFrame) -> DataFrame:
    """(x, y): coordinates that occur more than once over all links."""
    p = links.select(F.explode("geometry").alias("p"))
    return p.groupBy("p.x", "p.y").count().filter("count > 1").select("x", "y")


def nodes(links: DataFrame) -> DataFrame:
    """(x, y): ends of links and intersections."""
    g = F.col("geometry")
    ends = links.select(F.explode(F.array(geo.first_point(g), geo.last_point(g))).alias("p")).select("p.x", "p.y")
    return ends.union(intersections(links)).distinct()


def split_links(links: DataFrame, max_length: float = 100, rounds: int = 10) -> DataFrame:
    """split() with index road_link_<parent>_<part> and a, b named by their ends' coordinates."""
    name = lambda p: F.concat(F.lit("road_node_"), F.round(p.x, 3).cast("string"), F.lit("_"), F.round(p.y, 3).cast("string"))
    g = F.col("geometry")
    s = split(links, max_length, rounds)
    return s.withColumn("index", F.concat_ws("_", F.lit("road_link"), "parent", "part")).withColumn("a", name(geo.first_point(g))).withColumn("b", name(geo.last_point(g)))


def graph(links: DataFrame, weight: str = "length") -> DataFrame:
    """(a, b, cost, link): of parallel links the shortest, of equal ones the smallest index."""
    return links.groupBy("a", "b").agg(F.min(F.struct(F.col(weight).alias("cost"), F.col("index").alias("link"))).alias("e")).select("a", "b", "e.cost", "e.link")


def road_costs(edges: DataFrame, wanted: DataFrame, limit: float | None = None, most_bytes: int = 1 << 30, paths: bool = True) -> DataFrame:
    """(origin, target, cost[, path]): shortest paths from each origin of wanted (origin[, target]) to its targets, without targets to all places reached. path: the links passed; of equally short paths that with the smallest last link, and so on backwards. limit bounds the cost. Places that can't be reached give no rows.

    The network's size is checked: where its arrays and names come to at most most_bytes it is sent to the executors, and
    each origin solved once, until its last target is reached; a larger one is relaxed by joins, as road_costs_joined().
    """
    spark = edges.sparkSession
    e = edges.select("a", "b", "cost", "link")
    text = lambda c: F.octet_length(F.col(c).cast("string")) + 60  # a Python string's own size comes on top
    size = e.agg(F.sum(text("a") + text("b") + text("link") + 24)).first()[0] or 0
    if size > most_bytes:
        return road_costs_joined(edges, wanted, limit, paths)
    e = e.toPandas().sort_values(["a", "b", "link"], kind="stable")
    names = pd.unique(pd.concat([e["a"], e["b"]])) if len(e) else np.array([], dtype=object)
    number = {n: i for i, n in enumerate(names)}
    a = e["a"].map(number).to_numpy(np.int64) if len(e) else np.array([], np.int64)
    order = np.argsort(a, kind="stable")
    start = np.searchsorted(a[order], np.arange(len(names) + 1))
    shared = spark.sparkContext.broadcast((list(names), start.tolist(), e["b"].map(number).to_numpy()[order].tolist() if len(e) else [], e["cost"].to_numpy(float)[order].tolist(), e["link"].to_numpy()[order].tolist()))
    aimed = "target" in wanted.columns

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, start, target, cost, link = shared.value
        place = {n: i for i, n in enumerate(names)}
        for f in frames:
            rows = []
            for o, ends in zip(f["origin"], f["targets"] if aimed else [None] * len(f)):
                if o not in place:
                    continue
                ends = None if ends is None else {place[t] for t in ends if t in place}
                left = None if ends is None else set(ends)
                best, by, done = {place[o]: 0.0}, {}, {}
                heap = [(0.0, place[o])]
                while heap and (left is None or left):
                    c, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done[u] = c
                    if left:
                        left.discard(u)
                    for k in range(start[u], start[u + 1]):
                        v, d = target[k], c + cost[k]
                        if v in done or limit is not None and d > limit:
                            continue
                        old = best.get(v)
                        if old is None or d < old:
                            best[v], by[v] = d, (u, link[k])
                            heapq.heappush(heap, (d, v))
                        elif d == old and link[k] < by[v][1]:
                            by[v] = (u, link[k])
                for v in done if ends is None else ends & done.keys():
                    path, u = [], v
                    while paths and u in by:
                        u, l = by[u]
                        path.append(l)
                    rows.append((o, names[v], done[v], path[::-1]) if paths else (o, names[v], done[v]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(edges.dtypes)
    columns = ["origin", "target", "cost"] + ["path"] * paths
    origins = wanted.groupBy("origin").agg(F.collect_set("target").alias("targets")) if aimed else wanted.select("origin").distinct()
    # without this, a few megabytes of origins are one task's
    origins = origins.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "origin")
    return origins.mapInPandas(solve, f"origin {kind['a']}, target {kind['a']}, cost double" + f", path array<{kind['link']}>" * paths)


def road_costs_joined(edges: DataFrame, wanted: DataFrame, limit: float | None = None, paths: bool = True) -> DataFrame:
    """road_costs() for networks of any size: rounds of a join of the places that got cheaper with edges, keeping the cheapest, until none gets cheaper. Each round is a written table."""
    from ..sources.tables import saved

    none = F.array().cast(f"array<{dict(edges.dtypes)['link']}>")
    # back: the path's links from the last to the first, so that the smallest of equal costs is the one that road_costs() takes
    best = saved(wanted.select("origin").distinct().join(edges.select(F.col("a").alias("origin")).union(edges.select("b")).distinct(), "origin").select("origin", F.col("origin").alias("target"), F.lit(0.0).alias("cost"), none.alias("back"), F.lit(True).alias("fresh")), "costs")
    while not best.filter("fresh").isEmpty():
        step = best.filter("fresh").alias("r").join(edges.alias("e"), F.col("r.target") == F.col("e.a")).select("r.origin", F.col("e.b").alias("target"), (F.col("r.cost") + F.col("e.cost")).alias("cost"), F.concat(F.array("e.link"), "r.back").alias("back"), F.lit(True).alias("fresh"))
        step = step if limit is None else step.filter(F.col("cost") <= limit)
        # of a place's rows the known one comes first among equals, so fresh means that it got cheaper or its path smaller
        new = best.withColumn("fresh", F.lit(False)).unionByName(step).groupBy("origin", "target").agg(F.min(F.struct("cost", "back", "fresh")).alias("m"))
        best = saved(new.select("origin", "target", "m.cost", "m.back", "m.fresh"), "costs")
    out = best.select("origin", "target", "cost", *([F.reverse("back").alias("path")] if paths else []))
    return out.join(wanted.select("origin", "target").distinct(), ["origin", "target"], "left_semi") if "target" in wanted.columns else out


def link_loads(paths: DataFrame, links: DataFrame | None = None, volume: str | None = None) -> DataFrame:
    """(link, load): the sum of volumes (1 without) of paths (path) over each link, every occurrence counting; with links also those not used, 0."""
    v = F.col(volume) if volume else F.lit(1)
    own = paths.select(F.explode("path").alias("link"), v.alias("v")).groupBy("link").agg(F.sum("v").alias("load"))
    return own if links is None else links.select(F.col("index").alias("link")).join(own, "link", "left").withColumn("load", F.coalesce("load", F.lit(0)))


def transit_nodes(links: DataFrame) -> DataFrame:
    """(trip_id, node, seq): node a of each trip's first link, then node b of each link; links from a node to itself are left out."""
    own = links.filter("a <> b").withColumn("_n", F.row_number().over(Window.partitionBy("trip_id").orderBy("link_sequence")))
    node = F.explode(F.when(F.col("_n") == 1, F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("node")), F.struct(F.col("_n").alias("k"), F.col("b").alias("node")))).otherwise(F.array(F.struct(F.col("_n").alias("k"), F.col("b").alias("node")))))
    return own.select("trip_id", node.alias("p")).select("trip_id", "p.node", F.col("p.k").alias("seq"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain over a studied area's corners, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])
