"""Map-matching by a hidden Markov model (Newson and Krumm, 2009)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chains, geo
from .roads import graph, road_costs

SIGMA, BETA = 4.07, 3.0


def trip_points(points: DataFrame) -> DataFrame:
    """(trip_id, seq, x, y) of tracked points, in order."""
    trip = F.concat_ws("_", "phone_id", "track_no")
    w = Window.partitionBy("phone_id", "track_no").orderBy("ts", "stop")
    return points.select(trip.alias("trip_id"), (F.row_number().over(w) - 1).alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def candidates(points: DataFrame, links: DataFrame, radius: float = 200, most: int = 10, centroid_prefilter: int | None = None) -> DataFrame:
    """(trip_id, seq, link, dist, offset, rank): for each point the at most `most` nearest links within radius.

    Links' segments meet points over grid cells of radius, a point lying in one cell; nothing is lost, so this holds all
    that a search of the nearest centroids would find within radius. Of a link's segments the nearest counts, of equally
    near ones the earliest. centroid_prefilter keeps only that many links by distance of their centroids.
    """
    seg = links.select("index", F.posexplode(geo.segments(F.col("geometry"))).alias("k", "s"))
    s = F.col("s")
    seg = seg.withColumn("l", geo.distance(s.ax, s.ay, s.bx, s.by))
    before = F.sum("l").over(Window.partitionBy("index").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    box = (F.least(s.ax, s.bx) - radius, F.least(s.ay, s.by) - radius, F.greatest(s.ax, s.bx) + radius, F.greatest(s.ay, s.by) + radius)
    grid = seg.withColumn("m", F.coalesce(before, F.lit(0.0))).withColumn("c", F.explode(geo.cells(*box, radius)))
    p = points.withColumn("c", F.struct(F.floor(F.col("x") / radius).cast("long").alias("cx"), F.floor(F.col("y") / radius).cast("long").alias("cy")))
    pairs = p.join(grid, "c").withColumn("t", geo.project(F.col("x"), F.col("y"), s))
    t = F.col("t")
    pairs = pairs.withColumn("dist", geo.distance(F.col("x"), F.col("y"), s.ax + (s.bx - s.ax) * t, s.ay + (s.by - s.ay) * t)).filter(F.col("dist") < radius)
    near = pairs.groupBy("trip_id", "seq", F.col("index").alias("link")).agg(F.min(F.struct("dist", (F.col("m") + t * F.col("l")).alias("offset"))).alias("n"), F.first("x").alias("x"), F.first("y").alias("y"))
    point = Window.partitionBy("trip_id", "seq")
    if centroid_prefilter is not None:
        middle = links.select(F.col("index").alias("link"), geo.line_centroid(F.col("geometry")).alias("c"))
        far = geo.distance(F.col("x"), F.col("y"), F.col("c.x"), F.col("c.y"))
        near = near.join(middle, "link").withColumn("_r", F.row_number().over(point.orderBy(far, "link"))).filter(F.col("_r") <= centroid_prefilter)
    near = near.select("trip_id", "seq", "link", "n.dist", "n.offset")
    return near.withColumn("rank", F.row_number().over(point.orderBy("dist", "link"))).filter(F.col("rank") <= most)


def layers(points: DataFrame, cand: DataFrame, links: DataFrame) -> DataFrame:
    """(trip_id, seq, next_seq, first_seq, last_seq, link_a, link_b, offset_a, offset_b, dist, gps, length_a, exit, entry): candidates of each point with candidates against those of the next point that has any.

    gps: the straight distance to the next raw point. first_seq, last_seq: the trip's first and last point with candidates.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    all_of = Window.partitionBy("trip_id")
    p = points.withColumn("gps", geo.distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w))).select("trip_id", "seq", "gps")
    pair = cand.select("trip_id", "seq").distinct().withColumn("next_seq", F.lead("seq").over(w)).withColumn("first_seq", F.min("seq").over(all_of)).withColumn("last_seq", F.max("seq").over(all_of))
    pair = pair.filter("next_seq is not null").join(p, ["trip_id", "seq"])
    l = links.select(F.col("index").alias("link"), "a", "b", "length")
    a = cand.join(l, "link").select("trip_id", "seq", F.col("link").alias("link_a"), F.col("offset").alias("offset_a"), "dist", F.col("length").alias("length_a"), F.col("b").alias("exit"))
    b = cand.join(l, "link").select("trip_id", F.col("seq").alias("next_seq"), F.col("link").alias("link_b"), F.col("offset").alias("offset_b"), F.col("a").alias("entry"))
    return a.join(pair, ["trip_id", "seq"]).join(b, ["trip_id", "next_seq"])


def transitions(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """layers() with route and cost, where there is a route; costs (origin, target, cost) between exits and entries.

    cost: half the squared emission distance of the source point over SIGMA, and the difference between the route and
    the straight distance to the next raw point over BETA. Pairs without a route are left out.
    """
    both = pairs.join(costs.select(F.col("origin").alias("exit"), F.col("target").alias("entry"), F.col("cost").alias("between")), ["exit", "entry"], "left")
    route = F.when(F.col("link_a") == F.col("link_b"), F.col("offset_b") - F.col("offset_a")).otherwise(F.col("between") + F.col("length_a") - F.col("offset_a") + F.col("offset_b"))
    both = both.withColumn("route", route).filter("route is not null")
    far = F.col("dist") / SIGMA
    cost = 0.5 * (far * far) + F.abs(F.col("route") - F.col("gps")) / BETA
    return both.select("trip_id", "seq", "next_seq", "first_seq", "last_seq", "link_a", "link_b", "offset_a", "offset_b", "route", cost.alias("cost"))


def cheapest_chain(seq: np.ndarray, after: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray, first: int, last: int) -> list[int]:
    """The steps, by place, of the cheapest chain from layer first to layer last, in order; none if there is no such chain. a, b: links as numbers; of equal costs the smaller number wins."""
    order = np.lexsort((a, b, seq))
    bounds = np.flatnonzero(np.diff(seq[order])) + 1
    links = int(max(a.max(), b.max())) + 1
    total, here, kept = np.zeros(links), first, []
    for own in np.split(order, bounds):
        if seq[own[0]] != here:
            return []  # no step leaves the layer that was reached
        sums = total[a[own]] + cost[own]
        own, sums = own[np.isfinite(sums)], sums[np.isfinite(sums)]
        if not len(own):
            return []
        starts = np.flatnonzero(np.append(True, np.diff(b[own]) != 0))
        least = np.minimum.reduceat(sums, starts)
        rows = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(starts, len(own)))))
        rows = rows[np.append(True, np.diff(b[own[rows]]) != 0)]  # the first of equal ones
        total = np.full(links, np.inf)
        total[b[own[rows]]] = sums[rows]
        by = np.full(links, -1)
        by[b[own[rows]]] = own[rows]
        kept.append(by)
        here = after[own[0]]
    if here != last:
        return []
    link, chain = int(np.argmin(total)), []
    for by in reversed(kept):
        chain.append(int(by[link]))
        link = int(a[chain[-1]])
    return chain[::-1]


def decode(steps: DataFrame) -> DataFrame:
    """(trip_id, seq, next_seq, link_a, link_b, offset_a, offset_b, route): the cheapest chain of steps of each trip, by Viterbi; of equal ones the smaller links.

    A chain leads from first_seq to last_seq (without these columns, from the first to the last layer of steps), layer by
    layer. Trips without a whole chain, because some layer, the first or the last included, can't be reached, give no rows.
    A trip's steps are at most the square of the candidates for each of its points.
    """
    kinds = dict(steps.dtypes)
    names = ["trip_id", "seq", "next_seq", "link_a", "link_b", "offset_a", "offset_b", "route"]
    ends = "first_seq" in steps.columns

    def best(table: pa.Table) -> pa.Table:
        seq, after = table["seq"].to_numpy(), table["next_seq"].to_numpy()
        known = pa.chunked_array([*table["link_a"].chunks, *table["link_b"].chunks]).unique()
        known = known.take(pc.sort_indices(known))
        a, b = (pc.index_in(table[c], known).to_numpy() for c in ("link_a", "link_b"))
        first, last = (table["first_seq"][0].as_py(), table["last_seq"][0].as_py()) if ends else (seq.min(), after.max())
        return table.select(names).take(pa.array(cheapest_chain(seq, after, a, b, table["cost"].to_numpy(), first, last), pa.int64()))

    return steps.groupBy("trip_id").applyInArrow(best, ", ".join(f"{n} {kinds[n]}" for n in names))


def dedup_consecutive(values):
    """An array without elements that equal the next one."""
    return F.filter(values, lambda v, i: (i == F.size(values) - 1) | ~v.eqNullSafe(F.get(values, i + 1)))


def routes(steps: DataFrame, costs: DataFrame, links: DataFrame, dedup_boundaries: bool = True) -> DataFrame:
    """(trip_id, path, geometry): links passed by each trip. dedup_boundaries takes the link that two steps share once; without, each step's links are cleaned by itself."""
    l = links.select(F.col("index").alias("l"), "a", "b")
    s = steps.join(l.select(F.col("l").alias("link_a"), F.col("b").alias("exit")), "link_a").join(l.select(F.col("l").alias("link_b"), F.col("a").alias("entry")), "link_b")
    s = s.join(costs.select(F.col("origin").alias("exit"), F.col("target").alias("entry"), F.col("path").alias("between")), ["exit", "entry"], "left")
    own = F.when(F.col("link_a") == F.col("link_b"), F.array("link_a")).otherwise(dedup_consecutive(F.concat(F.array("link_a"), F.coalesce("between", F.array().cast("array<string>")), F.array("link_b"))))
    t = s.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", own.alias("own")))).alias("o"))
    path = F.flatten(F.transform("o", lambda x: x.own))
    t = t.withColumn("path", path).withColumn("path", dedup_consecutive(F.col("path")) if dedup_boundaries else F.col("path")).drop("o")
    lines = t.select("trip_id", F.posexplode("path").alias("k", "index")).join(links.select("index", F.col("geometry").alias("g")), "index")
    lines = lines.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("gs")).select("trip_id", geo.merge_lines(F.transform("gs", lambda x: x.g)).alias("geometry"))
    return t.join(lines, "trip_id", "left")


def network(links: DataFrame, radius: float, most: int, weight: str, most_bytes: int, most_places: int) -> chains.Network | None:
    """links for chains.Network, where they, listed by cells of radius, come to at most most_bytes, have at most most_places ends and an index of their own; None otherwise."""
    each = 600  # bytes of a link, and at most of a segment, besides its cells
    sizes = links.agg(F.count("*").alias("n"), F.count_distinct("index").alias("own"), F.sum(F.greatest(F.size("geometry"), F.lit(0))).alias("s")).first()
    if sizes.n != sizes.own or (sizes.n + (sizes.s or 0)) * each > most_bytes:
        return None
    l = links.select("index", "a", "b", "length").toPandas()
    if l.isnull().any().any():
        return None
    l = l.sort_values("index", kind="stable", ignore_index=True)
    names = {n: i for i, n in enumerate(pd.unique(pd.concat([l["a"], l["b"]])))}
    if len(names) > most_places:
        return None
    g = links.select("index", F.posexplode(geo.segments(F.col("geometry"))).alias("k", "s")).select("index", "k", "s.*").toPandas()
    g["of"] = g["index"].map({n: i for i, n in enumerate(l["index"])})
    g = g.sort_values(["of", "k"], kind="stable")
    segments = g[["ax", "ay", "bx", "by"]].to_numpy(float).T
    c = chains.Network.boxes(segments, radius)
    if not np.isfinite(segments).all() or ((c[2] - c[0] + 1.0) * (c[3] - c[1] + 1)).sum() * 40 > most_bytes:
        return None
    e = graph(links, weight).toPandas()
    number = lambda v: v.map(names).to_numpy(np.int64)
    return chains.Network(l["index"].tolist(), number(l["a"]), number(l["b"]), l["length"].to_numpy(float), segments, g["of"].to_numpy(np.int64), (number(e["a"]), number(e["b"]), e["cost"].to_numpy(float)), len(names), float(radius), most)


def match_steps(points: DataFrame, links: DataFrame, radius: float = 200, most: int = 10, weight: str = "length", most_bytes: int = 256 << 20, most_places: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(steps, unmatched trip ids) of tracked points on links, see map_match().

    A network() within the bounds is sent to the executors, and each trip decoded where its points were numbered, without
    a table of candidates or transitions; a larger one is met by joins, as match_steps_joined().
    """
    from ..sources.tables import saved

    own = network(links, radius, most, weight, most_bytes, most_places)
    if own is None:
        return match_steps_joined(points, links, radius, most, weight)
    shared = points.sparkSession.sparkContext.broadcast(own)

    def solve(batches):
        for trips in chains.whole_trips(batches):
            yield from shared.value.match(trips, SIGMA, BETA).to_batches()

    index = dict(links.dtypes)["index"]
    # the window that numbers a trip's points leaves them whole in a partition and one after another
    out = trip_points(points).mapInArrow(solve, f"trip_id string, seq int, next_seq int, link_a {index}, link_b {index}, offset_a double, offset_b double, route double")
    out = saved(out, "steps")
    return out.filter("seq is not null"), out.filter("seq is null").select("trip_id")


def match_steps_joined(points: DataFrame, links: DataFrame, radius: float = 200, most: int = 10, weight: str = "length") -> tuple[DataFrame, DataFrame]:
    """match_steps() for networks of any size. Shortest paths are sought only between the ends that some transition needs, each origin once until its targets are reached."""
    from ..sources.tables import saved

    p = saved(trip_points(points), "trip-points")
    cand = saved(candidates(p, links, radius, most), "candidates")
    pairs = saved(layers(p, cand, links), "layers")
    needed = pairs.filter("link_a <> link_b").select(F.col("exit").alias("origin"), F.col("entry").alias("target")).distinct()
    costs = saved(road_costs(graph(links, weight), needed, paths=False), "road-costs")
    steps = saved(decode(transitions(pairs, costs)), "steps")
    return steps, p.select("trip_id").distinct().join(steps.select("trip_id").distinct(), "trip_id", "left_anti")


def map_match(points: DataFrame, links: DataFrame, radius: float = 200, most: int = 10, weight: str = "length", dedup_boundaries: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched trips, unmatched trip ids, steps) of tracked points on links (index, a, b, length, geometry).

    The links of shortest paths are listed only for those on decoded chains. Trips of one point, without candidates or
    without a connected chain are unmatched.
    """
    from ..sources.tables import saved

    steps, unmatched = match_steps(points, links, radius, most, weight)
    l = links.select("index", "a", "b")
    ends = steps.join(l.select(F.col("index").alias("link_a"), F.col("b").alias("exit")), "link_a").join(l.select(F.col("index").alias("link_b"), F.col("a").alias("entry")), "link_b")
    needed = ends.filter("link_a <> link_b").select(F.col("exit").alias("origin"), F.col("entry").alias("target")).distinct()
    found = routes(steps, saved(road_costs(graph(links, weight), needed), "road-paths"), links, dedup_boundaries)
    return found, unmatched, steps
