"""Hand-computed cases, and each SQL query against DuckDB at the smallest scale."""

import os
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmesh.functions import chains, geo, overlap, times
from trailmesh.operators import matching, modes, places, points, roads, stats, tracks
from trailmesh.plans import queries as Q
from trailmesh.sources import tables
from trailmesh.streaming import sessions

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def line(*xy):
    return F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in xy])


def test_lambert93(spark):
    for lon, lat, x, y in ((3.0, 46.5, 700000, 6600000), (2.3522, 48.8566, 652469.023, 6862035.259)):
        got = [one(spark, c) for c in geo.lambert93(F.lit(lon), F.lit(lat))]
        assert got == pytest.approx([x, y], abs=1e-3)
        assert [one(spark, c) for c in geo.lambert93_inverse(F.lit(got[0]), F.lit(got[1]))] == pytest.approx([lon, lat], abs=1e-9)


def test_track_numbers_of_the_worked_example(spark):
    rows = [("p", i, bool(s), False) for i, s in enumerate([1, 0, 0, 1, 1, 0, 1, 0])]
    df = points.number_tracks(spark.createDataFrame(rows, "phone_id string, ts long, stop boolean, cut boolean"))
    assert [r.track_no for r in df.orderBy("ts", "stop").collect()] == [0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4]


def test_gap_is_strict_and_first_rows_are_slow(spark):
    df = spark.createDataFrame([("p", 1, 0, 0, 0), ("p", 2, 3600, 9, 0), ("p", 3, 7201, 20, 0), ("p", 4, 7201, 21, 0)], "phone_id string, ord long, ts long, x long, y long")
    got = points.trip_groups(points.gap_cuts(points.deltas(points.clean(df)))).orderBy("ts").collect()
    assert [r.cut for r in got] == [True, False, True] and [r.d for r in got] == [0, 9, 0] and got[0].low_speed


def test_active_and_accurate(spark):
    df = spark.createDataFrame([("a", 0, 0, 49.9), ("a", 50, 0, 1.0), ("b", 0, 0, 50.0), ("b", 51, 0, 49.0)], "phone_id string, x long, y long, accuracy double")
    assert {r.phone_id for r in points.active_phones(df).collect()} == {"b"}
    assert sorted(r.accuracy for r in points.accurate(df).collect()) == [1, 49, 49]


def test_dbscan():
    assert places.dbscan(np.array([0, 60, 120, 500.0]), np.zeros(4)).tolist() == [0, 0, 0, -1]


def test_home_takes_distinct_places(spark):
    df = spark.createDataFrame([(1, i, i, x, 0) for i, x in enumerate([0, 0, 0, 60])], "phone_id long, ts long, ord long, x long, y long")
    assert places.main_place(df, "domicile").first().domicile.x == 30


def test_trapezoids_at_equal_knots(spark):
    k = dict(zip(modes.MODES, modes.KNOTS["prop2"]))["walk"]
    assert one(spark, modes.trapezoid(F.lit(0.0), k, 1e5)) == 1
    assert one(spark, modes.trapezoid(F.lit(0.0), modes.KNOTS["prop5"][0], 1e5)) == 0


@pytest.mark.parametrize(("at", "end", "want"), [([10, 30, 40, 50], 100, 30), ([10, 30, 40], 100, 60), ([7], 9, 2), ([], 9, 0)])
def test_time_above(spark, at, end, want):
    s = F.array(*[F.lit(float(x)) for x in at]).cast("array<double>")
    assert one(spark, modes.time_above(s, F.array(F.lit(0.0), F.lit(float(end))))) == want


def test_rail_overlap(spark):
    t = spark.range(1).select(F.lit(1).alias("phone_id"), F.lit(1).alias("track_no"), line((0, 0), (1000, 0)).alias("geometry"))
    r = spark.range(1).select(F.lit("train").alias("type_TC"), line((500, -500), (500, 500)).alias("geometry"))
    got = modes.rail_overlap(t, r, 200).first()
    assert (got.prop_train, got.prop_metro) == (pytest.approx(0.4), 0)


def test_near_interval_against_sampling(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(float(v) for v in rng.uniform(-10, 10, 8)) for _ in range(60)]
    df = spark.createDataFrame(rows, ["a0", "a1", "a2", "a3", "q0", "q1", "q2", "q3"])
    s = lambda k: F.struct(*[F.col(f"{k}{i}").alias(n) for i, n in enumerate(("ax", "ay", "bx", "by"))])
    got = df.select("*", geo.near_interval(s("a"), s("q"), 3.0).alias("i")).collect()
    t = np.linspace(0, 1, 4001)
    for r in got:
        px, py = r.a0 + (r.a2 - r.a0) * t, r.a1 + (r.a3 - r.a1) * t
        vx, vy = r.q2 - r.q0, r.q3 - r.q1
        u = np.clip(((px - r.q0) * vx + (py - r.q1) * vy) / (vx * vx + vy * vy), 0, 1)
        share = (np.hypot(px - r.q0 - u * vx, py - r.q1 - u * vy) <= 3).mean()
        assert abs((r.i.hi - r.i.lo if r.i else 0) - share) < 2e-3


def test_split_in_halves(spark):
    df = spark.range(1).select(F.lit("l").alias("index"), line((0, 0), (10, 0), (10, 10)).alias("geometry"))
    got = roads.split(df, 6).collect()
    assert [r.length for r in got] == [5] * 4
    assert [(p.x, p.y) for p in got[1].geometry] == [(5, 0), (10, 0)]


def test_polygons(spark):
    outer = line((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10), (0, 0))
    hole = line((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    p = F.array(outer, hole)
    at = lambda f, x, y: one(spark, f(F.lit(float(x)), F.lit(float(y)), p))
    assert at(geo.within, 8, 2) and not at(geo.within, 8, 8) and not at(geo.within, 1.5, 1.5)
    assert at(geo.intersects, 4, 6) and not at(geo.within, 4, 6)


def test_consecutive_dedup_and_loads(spark):
    assert one(spark, matching.dedup_consecutive(F.array(*[F.lit(x) for x in (1, 1, 2, 1)]))) == [1, 2, 1]
    df = spark.createDataFrame([(["a", "b"],), (["b", "b"],)], "path array<string>")
    assert {r.link: r.load for r in roads.link_loads(df).collect()} == {"a": 1, "b": 3}


def test_road_costs_two_ways(spark):
    e = roads.graph(roads.two_way(tables.grid_roads(spark, 4, 3)))
    o = e.select(F.col("a").alias("origin")).limit(3)
    got = [sorted((r.origin, r.target, r.cost) for r in f(e, o).collect()) for f in (roads.road_costs, roads.road_costs_joined)]
    assert got[0] == got[1] and got[0]


def test_road_distances_are_unbounded(spark):
    edges = {(r.a, r.b): r.cost for r in roads.graph(roads.two_way(tables.grid_roads(spark))).collect()}
    nodes = {n for e in edges for n in e}
    want = {(n, n): 0.0 for n in nodes if any(a == n for a, _ in edges)}
    for _ in nodes:  # Bellman and Ford
        for (a, b), c in edges.items():
            for n in nodes:
                if (n, a) in want:
                    want[n, b] = min(want.get((n, b), np.inf), want[n, a] + c)
    got = Q.QUERIES["road_distances"](spark, DATA).collect()
    assert {(r.origin, r.target): r.cost for r in got} == want and len(got) == len(want)
    assert max(want.values()) > 40_000


def test_sweep_removes_saved_tables(spark):
    one = tables.saved(spark.range(5), "five")
    assert one.count() == 5
    folder = tables._own(spark).removeprefix("file:")
    assert any(n.startswith("five-") for n in os.listdir(folder))
    tables.sweep(spark)
    assert not os.path.exists(folder)


def test_decode_takes_the_cheapest_chain(spark):
    rows = [("t", 0, 1, "a", "c", 0.0, 0.0, 0.0, 1.0), ("t", 0, 1, "a", "d", 0.0, 0.0, 0.0, 2.0), ("t", 0, 1, "b", "d", 0.0, 0.0, 0.0, 0.5), ("t", 1, 2, "c", "e", 0.0, 0.0, 0.0, 5.0), ("t", 1, 2, "d", "e", 0.0, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "trip_id string, seq int, next_seq int, link_a string, link_b string, offset_a double, offset_b double, route double, cost double")
    assert [(r.link_a, r.link_b) for r in matching.decode(df).orderBy("seq").collect()] == [("b", "d"), ("d", "e")]


def enumerated(rows, first, last):
    """The cheapest of all chains from layer first to layer last, of equal ones that with the smallest links from the end backwards."""
    best = None

    def walk(seq, link, cost, chain):
        nonlocal best
        if seq == last:
            key = (cost, [c[3] for c in chain[::-1]], [c[2] for c in chain[::-1]])
            best = min(best, (key, chain), key=lambda x: x[0]) if best else (key, chain)
        for r in rows:
            if r[0] == seq and (link is None or r[2] == link):
                walk(r[1], r[3], cost + r[4], [*chain, r])

    walk(first, None, 0.0, [])
    return [] if best is None else [(r[0], r[2], r[3]) for r in best[1]]


def test_decode_against_enumerated_chains(spark):
    """Whole chains, and trips without a route at the start, in the middle or at the end."""
    rng = np.random.default_rng(13)
    trips, rows = {}, []
    for n in range(60):
        layers, own = [0, 1, 3, 4, 7][: 3 + n % 3], []
        for k, (s, e) in enumerate(zip(layers, layers[1:])):
            cut = (n % 5 == 1 and k == 0) or (n % 5 == 2 and k == len(layers) - 2) or (n % 5 == 3 and k == 1)
            for a in "abc":
                for b in "abc":
                    if not cut and rng.random() < 0.7:
                        own.append((s, e, a, b, float(rng.integers(0, 4))))
        trips[f"t{n}"] = (own, layers[0], layers[-1])
        rows += [(f"t{n}", s, e, layers[0], layers[-1], a, b, 0.0, 0.0, 0.0, c) for s, e, a, b, c in own]
    df = spark.createDataFrame(rows, "trip_id string, seq int, next_seq int, first_seq int, last_seq int, link_a string, link_b string, offset_a double, offset_b double, route double, cost double")
    got = {}
    for r in matching.decode(df).orderBy("trip_id", "seq").collect():
        got.setdefault(r.trip_id, []).append((r.seq, r.link_a, r.link_b))
    cost = lambda own, chain: sum(next(c for s, _, a, b, c in own if (s, a, b) == x) for x in chain)
    for t, (own, first, last) in trips.items():
        want = enumerated(own, first, last)
        assert bool(want) == (t in got), t
        if want:
            assert cost(own, got[t]) == cost(own, want) and got[t][0][0] == first, t
    assert sum(t in got for t in trips) > 15 and any(t not in got for t in trips)


def test_a_trip_whose_end_has_no_route_is_unmatched(spark):
    links = spark.createDataFrame([("l1", "a", "b", 100.0, [(0.0, 0.0), (100.0, 0.0)]), ("l2", "b", "c", 100.0, [(100.0, 0.0), (200.0, 0.0)]), ("far", "x", "y", 100.0, [(200.0, 90.0), (300.0, 90.0)])], "index string, a string, b string, length double, geometry array<struct<x:double,y:double>>")
    rows = [("whole", 0, 10, 0), ("whole", 1, 110, 0), ("end", 0, 10, 0), ("end", 1, 110, 0), ("end", 2, 290, 90), ("start", 0, 290, 90), ("start", 1, 10, 0), ("start", 2, 110, 0), ("alone", 0, 10, 0), ("nowhere", 0, 9999, 9999), ("nowhere", 1, 9998, 9999)]
    p = spark.createDataFrame([(t, 1, k, False, x, y) for t, k, x, y in rows], "phone_id string, track_no int, ts long, stop boolean, x long, y long")
    found, unmatched, steps = matching.map_match(p, links, radius=30)
    assert [(r.trip_id, r.path) for r in found.collect()] == [("whole_1", ["l1", "l2"])]
    assert {r.trip_id for r in unmatched.collect()} == {"end_1", "start_1", "alone_1", "nowhere_1"}
    assert [(q.x, q.y) for q in found.first().geometry] == [(0, 0), (100, 0), (200, 0)]
    assert steps.first().offset_a == 10 and steps.first().route == 100
    near = matching.candidates(matching.trip_points(p), links, 150, centroid_prefilter=1)
    assert {(r.trip_id, r.seq): r.link for r in near.collect()}["whole_1", 1] == "l2"


def test_shortest_paths_to_wanted_places(spark):
    """Costs and paths, ties included, by both forms and by Bellman and Ford."""
    rng = np.random.default_rng(14)
    rows = [(f"n{rng.integers(9)}", f"n{rng.integers(9)}", float(rng.integers(1, 4)), f"e{i:03d}") for i in range(30)] + [("x", "y", 1.0, "e900")]
    raw = spark.createDataFrame([(f"{l}", a, b, c) for a, b, c, l in rows], "index string, a string, b string, length double")
    e = roads.graph(raw)
    edges = [(r.a, r.b, r.cost, r.link) for r in e.collect()]
    nodes = sorted({n for a, b, *_ in edges for n in (a, b)})
    best = {(n, n): (0.0, []) for n in nodes}
    for _ in range(2 * len(nodes)):
        for a, b, c, l in edges:
            for n in nodes:
                if (n, a) in best:
                    new = (best[n, a][0] + c, [l, *best[n, a][1]])
                    if (n, b) not in best or new < best[n, b]:
                        best[n, b] = new
    wanted = spark.createDataFrame([(a, b) for a in nodes[:5] for b in nodes[2:]] + [("n1", "x"), ("nobody", "n1")], "origin string, target string")
    want = {(a, b): best[a, b] for a in nodes[:5] for b in nodes[2:] if (a, b) in best}
    for f in (roads.road_costs, roads.road_costs_joined):
        assert {(r.origin, r.target): (r.cost, r.path[::-1]) for r in f(e, wanted).collect()} == want, f
        assert {(r.origin, r.target): r.cost for r in f(e, wanted, paths=False).collect()} == {k: v[0] for k, v in want.items()}
    assert roads.road_costs(e, wanted, most_bytes=0).count() == len(want)
    assert roads.road_costs(e.limit(0), wanted).count() == 0


def test_dbscan_against_a_loop():
    rng = np.random.default_rng(15)
    for n in range(60):
        size, least = int(rng.integers(1, 70)), 2 + n % 3
        x, y = rng.integers(0, 60, size) * 10.0, rng.integers(0, 60, size) * 10.0
        if n % 4 == 0:
            x[: size // 2], y[: size // 2] = x[0], y[0]
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 100.0**2
        core, label, k = near.sum(1) >= least, np.full(size, -1), 0
        for i in range(size):
            if core[i] and label[i] < 0:
                todo, label[i] = [i], k
                while todo:
                    j = todo.pop()
                    for m in np.flatnonzero(near[j]) if core[j] else []:
                        if label[m] < 0:
                            label[m] = k
                            todo.append(m)
                k += 1
        assert places.dbscan(x, y, 100.0, least).tolist() == label.tolist(), n
        assert places.dbscan(x, y, 100.0, least, dense=0).tolist() == label.tolist(), n


def test_dbscan_of_a_phone_at_rest():
    """Memory: forty thousand points in one place and as many spread over one cell."""
    import tracemalloc

    rng = np.random.default_rng(16)
    x, y = np.concatenate([np.zeros(40_000), rng.integers(0, 70, 40_000)]).astype(float), np.concatenate([np.zeros(40_000), rng.integers(0, 70, 40_000)]).astype(float)
    tracemalloc.start()
    assert set(places.dbscan(x, y).tolist()) == {0}
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_times_in_any_session(spark):
    texts = [("2023-03-01 08:15:00 UTC", 1677658500), ("1970-01-01 00:00:00", 0), ("2023-03-26 02:30:00 UTC", 1679797800), ("2023-03-01T08:15:00+02:00", 1677651300), (None, None)]
    for zone in ("America/New_York", "Europe/Paris", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame(texts, "t string, ts long")
            for r in df.select("*", times.parse_utc(F.col("t")).alias("got"), times.hour(F.col("ts")).alias("h"), times.day_name(F.col("ts")).alias("d"), times.text(F.col("ts")).alias("s"), times.of_local(F.to_timestamp_ntz(F.substring("t", 1, 19))).alias("n")).collect():
                assert r.got == r.ts
                if r.ts is not None:
                    want = pd.Timestamp(r.ts, unit="s")
                    assert (r.h, r.d, r.s) == (want.hour, f"{want.year}-{want.month}-{want.day}", want.strftime("%Y-%m-%d %H:%M:%S UTC")), zone
                    assert "+" in r.t or r.n == r.ts
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(one(spark, times.hours_minutes(F.lit(3599.0)))) == (0, 60) and tuple(one(spark, times.hours_minutes(F.lit(7290.0)))) == (2, 2)


def test_equal_width_against_numpy(spark):
    rng = np.random.default_rng(17)
    for v in (rng.normal(0, 5, 500), np.full(7, 3.0), np.array([1.0, 2.0])):
        n, edges = np.histogram(v, bins=30)
        got = {r.bin: (r.lo, r.n) for r in stats.equal_width(spark.createDataFrame([(float(x),) for x in v], "v double"), F.col("v"), 30).collect()}
        assert {k: got[k][1] for k in got} == {k: int(c) for k, c in enumerate(n) if c}
        assert all(lo == pytest.approx(edges[k]) for k, (lo, _) in got.items())
    assert stats.equal_width(spark.range(0).select(F.col("id").alias("v")), F.col("v"), 3).count() == 0
    for v in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, 2.0], []):
        got = stats.markers(spark.createDataFrame([(x,) for x in v], "v double"), F.col("v")).first()
        assert tuple(got) == ((round(float(np.median(v)), 1), round(float(np.mean(v)), 1)) if v else (None, None))


def test_running_sums(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.5],), ([],), (None,)], "v array<double>")
    assert [r.s for r in df.select(tracks.running_sums(F.col("v")).alias("s")).collect()] == [[1, 3, 6.5], [], None]


def test_save_clears_stale_frames(spark):
    folder = f"{tables.shared_folder(spark)}/model-test"
    tables.save_model({"points": spark.range(3), "tracks": spark.range(4), "phones": None}, folder)
    again = tables.load_model(spark, folder, ("points",))["points"].filter("id > 0")
    tables.save_model({"points": again, "zones": spark.range(2)}, folder, omitted=("zones",))
    assert os.listdir(folder.removeprefix("file://")) == ["points"] and tables.load_model(spark, folder, ("points",))["points"].count() == 2
    assert not [n for n in os.listdir(os.path.dirname(folder.removeprefix("file://"))) if n.startswith("model-test-")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(far)


def test_line_centroid_and_plottable_lines(spark):
    got = one(spark, geo.line_centroid(line((0, 0), (10, 0), (10, 30))))
    assert (got.x, got.y) == (pytest.approx(8.75), pytest.approx(11.25))
    df = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0)]), ("b", [(0.0, 0.0), (0.0, 0.0)]), ("c", [(0.0, 0.0)]), ("d", None)], "index string, geometry array<struct<x:double,y:double>>")
    assert [r["index"] for r in stats.plottable_lines(df).collect()] == ["a"]


def test_long_tracks_methods(spark):
    df = spark.createDataFrame([("p", 1, 0, 0, 0, 121.0), ("p", 1, 1, 0, 300, 0.0)], "phone_id string, track_no int, ts long, x long, y long, t double")
    assert points.long_tracks(df, method="remove").count() == points.long_tracks(df, method="delete").count() == 2
    for bad, error in (("stick", NotImplementedError), ("drop", ValueError)):
        with pytest.raises(error):
            points.long_tracks(df, method=bad)


def test_model_end_to_end(spark):
    from trailmesh.plans.model import MobilityModel

    p = tables.points(spark, DATA)
    raw = p.select("ord", F.col("phone_id").alias("sptId"), "accuracy", "os", "longitude", "latitude", times.text(F.col("ts")).alias("eventDate"))
    m = MobilityModel(raw)
    with pytest.raises(ValueError, match="filter"):
        m.build_tracks()
    with pytest.raises(ValueError, match="tracks"):
        m.get_volumes()
    m.filtering()
    m.points = m.points.withColumn("x", F.col("x") - 600_000).withColumn("y", F.col("y") - 6_750_000)
    m.build_tracks(**Q.HOW)
    own = m.copy()
    m.set_zoning(tables.zones(m.points))
    m.set_rail_network(tables.rails(spark))
    m.set_road_network(roads.two_way(tables.grid_roads(spark)))
    m.get_volumes()
    m.phones_dataset_analysis()
    m.get_home_place()
    m.get_work_place()
    m.inference_mode_logic_rules(modes.Rules(radius=2000))
    m.inference_mode_hybrid()
    m.mapmatching(radius=5000)
    m.loaded_network()
    assert own.zones is None and own.tracks is not None
    n = m.tracks.count()
    assert n == own.tracks.count() > 0 and m.volumes.agg(F.sum("counts")).first()[0] <= n
    assert {"domicile", "emploi", "nbr_points"} <= set(m.phones.columns) and {"nbr_domicile", "nbr_emploi", "repr_rate_home", "repr_rate_work"} <= set(m.zones.columns)
    assert m.tracks.filter("mode_computed_hybrid is null").count() == 0
    assert m.tracks_mapmatched.count() + m.tracks_unmatched.count() == n and m.road_links.agg(F.sum("tracks_count")).first()[0] >= m.tracks_mapmatched.count()
    text = m.describe().first()
    assert int(text.n_tracks.replace(",", "")) == n
    seen = m.analysis_tracks()
    assert sum(r.n for r in seen["minutes"].collect()) == n and seen["km_markers"].first().mean > 0 and seen["days"].count() > 0
    assert {"accuracy", "accuracy_share", "systems"} == set(m.analysis_points())
    assert m.representativity().first().n >= 0 and m.representativity(work=True).first().n >= 0
    top = m.volumes.orderBy(F.desc("counts")).first().origin
    flows = {r.zone_id: r.counts for r in m.flow_map(top).collect()}
    assert len(flows) == m.zones.count() and sum(flows.values()) == m.volumes.filter((F.col("origin") == top) & (F.col("destination") != top)).agg(F.sum("counts")).first()[0]
    folder = f"{tables.shared_folder(spark)}/whole-model"
    m.save(folder, only=("tracks", "zones"))
    back = MobilityModel.load(spark, folder, ("tracks", "zones"))
    assert back.tracks.count() == n and back.points is None


@pytest.mark.parametrize("name", ["filtering", "rail_overlap", "mode_rules", "mode_scores_all", "mode_hybrid_near_rails", "match_path", "match_unmatched", "link_loads", "road_paths", "hist_minutes", "duration_markers", "clean_points", "kept_tracks", "track_kinematics", "od_matrix", "home_places", "speed_band_shares", "road_distances"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    a, b = Q.QUERIES[name](spark, DATA).toPandas(), con.execute(Q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_mode_hybrid_reads_the_points_once(spark):
    plan = Q.QUERIES["mode_hybrid"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 2  # the points, and which phones are active; 6 when rails were joined


def test_a_step_of_just_the_gap_begins_a_session(spark):
    start = "2024-01-01 00:00:00"
    for step, want in (("3600", [1, 1]), ("3599.999999", [2]), ("3600.000001", [1, 1])):
        df = spark.range(2).select(F.lit(1).alias("phone_id"), F.col("id").alias("x"), F.col("id").alias("y"), F.expr(f"timestamp'{start}' + id * interval '{step}' second").alias("time"))
        got = sessions.gap_sessions(df, "1 hour").orderBy("start").collect()
        assert [r.n for r in got] == want, step
        assert (got[0].end - got[0].start).total_seconds() == 3600 + (float(step) if want == [2] else 0)
    data = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + id * interval 1 day as ts, 1L as user_id, 'view' as event_type, 1.0D as value, '{\"k\": 1}' as props from range(3)").write.parquet(f"{data}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{data}/events.parquet/*.parquet'")
    rows = sorted(tuple(r) for r in Q.QUERIES["gap_sessions"](spark, data).collect())
    assert rows == sorted(con.execute(Q.SQL["gap_sessions"]).fetchall()) and len(rows) == 3


def _random_trips_and_links(spark, seed):
    """Trips of points on and beside a net of one-way links in pieces, some ends of which lead nowhere."""
    rng = np.random.default_rng(seed)
    n = 5
    place = {i: rng.uniform(0, 400, 2) for i in range(n * n)}
    rows = []
    for k in range(60):
        a, b = (int(v) for v in rng.choice(n * n, 2, replace=False))
        g = [place[a], rng.uniform(0, 400, 2), place[b]] if k % 2 else [place[a], place[b]]
        rows.append((f"l{k * 7 % 60}", f"n{a}", f"n{b}", float(rng.integers(1, 5) * 50), [{"x": float(p[0]), "y": float(p[1])} for p in g]))
    links = spark.createDataFrame(rows, "index string, a string, b string, length double, geometry array<struct<x:double,y:double>>")
    pts = [(p, t % 3, t, False, int(x), int(y)) for p in range(25) for t, (x, y) in enumerate(rng.uniform(-50, 450, (int(rng.integers(1, 14)), 2)))]
    return spark.createDataFrame(pts, "phone_id long, track_no long, ts long, stop boolean, x long, y long"), links


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_the_joins(spark, seed):
    p, links = _random_trips_and_links(spark, seed)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    names = ["trip_id", "seq", "next_seq", "link_a", "link_b", "offset_a", "offset_b", "route"]
    for how in ({}, {"most": 2}):
        assert matching.network(links, 60, 10, "length", 1 << 28, 2000)
        got, want = matching.match_steps(p, links, 60, **how), matching.match_steps_joined(p, links, 60, **how)
        assert rows(got[1]) == rows(want[1]) and rows(got[1])
        a, b = rows(got[0].select(names)), rows(want[0].select(names))
        assert len(a) > 10 and [r[:5] for r in a] == [r[:5] for r in b]
        assert np.allclose([r[5:] for r in a], [r[5:] for r in b], rtol=1e-12)


def test_networks_beyond_the_bounds_are_joined(spark):
    p, links = _random_trips_and_links(spark, 1)
    assert matching.network(links, 60, 10, "length", 1 << 28, 3) is None and matching.network(links, 60, 10, "length", 1000, 2000) is None
    assert sorted(matching.match_steps(p, links, 60, most_places=3)[1].collect()) == sorted(matching.match_steps(p, links, 60)[1].collect())


def test_whole_trips_over_batches():
    t = pa.table({"trip_id": ["a", "a", "b", "b", "b", "b", "b", "c", "d", "d"], "seq": list(range(10))})
    for size in range(1, 11):
        parts = [x["trip_id"].to_pylist() for x in chains.whole_trips(iter(t.to_batches(max_chunksize=size)))]
        assert sum(parts, []) == t["trip_id"].to_pylist()
        assert all(x[-1] != y[0] for x, y in zip(parts, parts[1:]))


def test_match_unmatched_writes_no_table_of_transitions(spark, monkeypatch):
    names, old = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: names.append(name) or old(df, name))
    Q.QUERIES["match_unmatched"](spark, DATA)
    assert names == ["steps"]  # before: trip-points, candidates, layers, road-costs, steps, road-paths


def test_match_path_writes_no_table_of_transitions(spark, monkeypatch):
    names, old = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: names.append(name) or old(df, name))
    Q.QUERIES["match_path"](spark, DATA)
    assert names == ["steps"]  # before: trip-points, candidates, layers, road-costs, steps, road-paths


def test_link_loads_writes_no_table_of_transitions(spark, monkeypatch):
    names, old = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: names.append(name) or old(df, name))
    Q.QUERIES["link_loads"](spark, DATA)
    assert names == ["steps", "road-paths"]  # before: trip-points, candidates, layers, road-costs, steps, road-paths



def test_network_bandwidth_writes_no_table_of_transitions(spark, monkeypatch):
    names, old = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: names.append(name) or old(df, name))
    Q.QUERIES["network_bandwidth"](spark, DATA)
    assert names == ["steps", "road-paths"]  # before: trip-points, candidates, layers, road-costs, steps, road-paths


def _random_tracks_and_rails(spark, n_rails):
    rng = np.random.default_rng(n_rails)
    at = lambda n: [{"x": float(x), "y": float(y)} for x, y in rng.uniform(0, 1000, (n, 2))]
    t = spark.createDataFrame([(1, i, at(5) if i % 7 else None) for i in range(60)], "phone_id long, track_no long, geometry array<struct<x:double,y:double>>")
    r = spark.createDataFrame([(modes.RAILS[i % 3] if i % 5 else "tram", at(3)) for i in range(n_rails)], "type_TC string, geometry array<struct<x:double,y:double>>")
    return t, r


@pytest.mark.parametrize("n_rails", [0, 1, 60])
def test_rail_shares_equal_the_join(spark, n_rails):
    t, r = _random_tracks_and_rails(spark, n_rails)
    got, want, bounded = ([tuple(x) for x in df.orderBy("track_no").collect()] for df in (modes.rail_overlap(t, r, 20), modes.rail_overlap_joined(t, r, 20), modes.rail_overlap(t, r, 20, most_bytes=0)))
    assert len(got) == 60 and (n_rails < 2 or max(x[2] for x in got) > 0)
    assert np.allclose(got, want, atol=1e-12) and np.allclose(bounded, want, atol=1e-12)


def test_rail_grid_in_small_chunks():
    rng = np.random.default_rng(2)
    grid = overlap.Grid(rng.uniform(0, 1000, (4, 200)), rng.integers(0, 3, 200), 3, 20.0)
    own = rng.uniform(-300, 1300, (4, 300))
    assert np.array_equal(grid.near_lengths(own, most=50), grid.near_lengths(own))


def test_rail_shares_need_no_shuffle(spark):
    """All tracks near one rail lay in few cells, so in few tasks of a join."""
    t, r = _random_tracks_and_rails(spark, 4)
    plan = modes.rail_overlap(t, r, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["mode_hybrid_near_rails", "mode_rules"])
def test_modes_read_the_points_once(spark, name):
    plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 2  # the points, and which phones are active
