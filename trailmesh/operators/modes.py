"""Transport modes: shares of tracks near rail lines, rules, speed bands and scores for a classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, overlap

RAILS = ("train", "rer", "metro")
MODES = ("bike", "walk", "car", "bus")
BANDS = (5, 10, 20, 30, 40, 50)

# The inner knots of the trapezoids by feature, for bike, walk, car, bus; a trapezoid rises from the first to the second and falls from the third to the fourth.
KNOTS = {
    "vmoy": [(0.4105151041227126, 1.08700177789941, 3.0010020148977397, 3.676763741954413), (0.2799848679908142, 0.6137479298100725, 2.2943924935411273, 3.6191130058762884), (3.0998198980542875, 5.320843845080464, 9.299098830321956, 10.844131096132337), (0.686809605902677, 1.6506549219792555, 3.9107762961126458, 5.62687494119651)],
    "vmax": [(10.754348907073089, 12.88238054187735, 18.444053878802357, 23.179953871428594), (3.966656345267308, 4.800263925145154, 23.49551002742734, 37.11044663167593), (25.140868761081073, 36.0531888781126, 62.2208775038897, 67.38936552111863), (11.314426448020688, 16.82439832785701, 31.26118608952548, 46.26993253993071)],
    "vmedian": [(3.7512221349662696, 7.272781328957448, 12.443036982073512, 14.118642937949335), (1.4189429035146086, 2.835524542059395, 5.227157025962203, 11.50872300219276), (4.759093309441486, 8.842268453744229, 21.524034683334616, 29.614821050280344), (2.798782917202987, 4.405103986829141, 12.721424302728042, 16.419677652130545)],
    "v95th": [(10.364603243916969, 12.231276255122697, 16.645251869509575, 19.05927240962025), (3.79196803179575, 4.574600519266477, 19.176914188889707, 29.20767566848131), (24.124619715829983, 33.58587484772206, 55.50664873265645, 59.89945629832348), (9.98580631682779, 15.444884549017818, 26.358693070050357, 40.13670887064279)],
    "length": [(1202.1530531957007, 2001.3344584397887, 4099.803351181057, 8797.354479525084), (529.4410066754036, 743.4444911452108, 5983.928495867245, 11034.431686112946), (5729.860838691618, 10130.245444226382, 13701.275393358259, 14470.842217120684), (2275.8263342141668, 3906.6943712744946, 9507.524411255992, 13060.900134875914)],
    "prop1": [(-38.55300338653714, -23.941383582323382, 0.4000951670950543, 0.7273085991138788), (-13.835449572346946, -0.06488636556079215, 1.0, 1.0), (-18.64386556678606, -14.567283925318137, 0.06716514408244699, 0.27787040963564824), (-18.926561107950842, -9.81834485027646, 0.4875686673245967, 0.8423195489203461)],
    "prop2": [(0.038774419375185394, 0.14434043609951075, 1.7112205584820057, 29.4412739176404), (0.0, 0.0, 0.26658642512338326, 6.785856444264282), (0.033448390945042504, 0.05120049462118153, 0.16127592806759183, 7.31133591950949), (0.04015112335906942, 0.07548385843793279, 0.42110745417217144, 8.96552356130289)],
    "prop3": [(0.02780680111053917, 0.1463547730171308, 0.8442728343167547, 27.940325061995033), (0.0, 0.0, 0.20709790977476378, 0.6188848805857856), (0.06637865763403636, 0.10449213357670438, 0.4211830081595799, 12.056333331333557), (0.013153286983407739, 0.12158921749387544, 0.5831173137699325, 10.728594559000319)],
    "prop4": [(0.0, 0.0, 0.0, 0.016207726732776387), (0.0, 0.0, 0.012580200858416404, 0.11340666992621616), (0.06447190756834761, 0.11653454155321566, 0.41998931588817057, 12.733399249840005), (0.0, 0.0, 0.14344930792329944, 0.29842946197423914)],
    "prop5": [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.02743294573550256), (0.0, 0.05913627793555022, 0.19754951646714392, 10.249626042793171), (0.0, 0.0, 0.007023929398621709, 0.11532870030738979)],
}
#: Outer knots: beyond them a score is 0.
FAR = {"length": 3_000_000.0}
SOURCE = {"vmoy": "v_moy", "vmax": "v_instant_max", "vmedian": "v_median", "v95th": "v_95th_percentile", "length": "track_length"}


@dataclass(frozen=True)
class Rules:
    radius: float = 200
    p_rail: float = 0.7
    p_metro: float = 0.7
    v_max_bike: float = 30
    v_moy_bike: float = 20
    v_max_walk: float = 7
    v_moy_walk: float = 5
    motor_length: float = 15_000


HYBRID = Rules(200, 0.6, 0.7, 40, 30, 15, 7, 20_000)


def with_rail_shares(tracks: DataFrame, rails: DataFrame, radius: float = 200, most_bytes: int = 64 << 20) -> DataFrame:
    """tracks with prop_train, prop_rer, prop_metro: the share of each track's length within radius of rails of a type.

    The rails' size is checked: where their segments come to at most most_bytes they are sent to the executors, and each
    track is measured where it lies, without shuffle and whatever share of tracks is near one rail; more rails are met
    by a join, as rail_overlap_joined().
    """
    props = [f"prop_{r}" for r in RAILS]
    tracks = tracks.drop(*props)
    rails = rails.filter(F.col("type_TC").isin(*RAILS))
    bytes_each = 400  # of a segment in the grid: coordinates, boxes, cells, lists
    if (rails.agg(F.sum(F.greatest(F.size("geometry") - 1, F.lit(0)))).first()[0] or 0) * bytes_each > most_bytes:
        return tracks.join(rail_overlap_joined(tracks, rails, radius), ["phone_id", "track_no"], "left")
    rows = rails.select("type_TC", F.explode(geo.segments(F.col("geometry"))).alias("s")).select("type_TC", "s.*").toPandas()
    segments = rows[["ax", "ay", "bx", "by"]].to_numpy(float).T
    kinds = rows["type_TC"].map({r: i for i, r in enumerate(RAILS)}).to_numpy(np.int64)
    shared = tracks.sparkSession.sparkContext.broadcast(overlap.Grid(segments, kinds, len(RAILS), float(radius)))

    @F.arrow_udf(", ".join(f"{p} double" for p in props))
    def shares(lines: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v) for v in shared.value.shares(lines)], props)

    t = tracks.withColumn("_near", shares(F.col("geometry")))
    return t.withColumns({p: F.col(f"_near.{p}") for p in props}).drop("_near")


def rail_overlap(tracks: DataFrame, rails: DataFrame, radius: float = 200, most_bytes: int = 64 << 20) -> DataFrame:
    """(phone_id, track_no, prop_train, prop_rer, prop_metro), see with_rail_shares()."""
    return with_rail_shares(tracks, rails, radius, most_bytes).select("phone_id", "track_no", *[f"prop_{r}" for r in RAILS])


def rail_overlap_joined(tracks: DataFrame, rails: DataFrame, radius: float = 200, cell: float | None = None) -> DataFrame:
    """rail_overlap() for rails of any size.

    Segments meet over grid cells; each pair counts in the first cell that both boxes touch. For each pair the near
    part is one interval in closed form; intervals of a segment are merged by a running maximum.
    """
    cell = cell or max(50 * radius, 1.0)
    seg = lambda df, *keep: df.select(*keep, F.posexplode(geo.segments(F.col("geometry"))).alias("k", "s"))
    box = lambda s, r: (F.least(s.ax, s.bx) - r, F.least(s.ay, s.by) - r, F.greatest(s.ax, s.bx) + r, F.greatest(s.ay, s.by) + r)
    s = F.col("s")
    a = seg(tracks, "phone_id", "track_no").select("phone_id", "track_no", "k", "s", F.explode(geo.cells(*box(s, 0.0), cell)).alias("c"))
    q = seg(rails, "type_TC").select("type_TC", F.col("s").alias("q"), F.explode(geo.cells(*box(s, radius), cell)).alias("c"))
    both = a.join(q, "c")
    low = lambda v, w: F.floor(F.greatest(v, w) / cell).cast("long")
    qa = F.col("q")
    x0, y0 = F.least(s.ax, s.bx), F.least(s.ay, s.by)
    both = both.filter((F.col("c.cx") == low(x0, F.least(qa.ax, qa.bx) - radius)) & (F.col("c.cy") == low(y0, F.least(qa.ay, qa.by) - radius)))
    part = both.withColumn("i", geo.near_interval(s, qa, radius)).filter("i is not null")
    w = Window.partitionBy("phone_id", "track_no", "k", "type_TC").orderBy("i.lo", "i.hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("i.hi") - F.greatest(F.col("i.lo"), F.coalesce(F.max("i.hi").over(w), F.col("i.lo"))), F.lit(0.0))
    near = part.withColumn("m", fresh * geo.distance(s.ax, s.ay, s.bx, s.by))
    near = near.groupBy("phone_id", "track_no").agg(*[F.sum(F.when(F.col("type_TC") == r, F.col("m"))).alias(r) for r in RAILS])
    t = tracks.select("phone_id", "track_no", geo.line_length(F.col("geometry")).alias("l")).join(near, ["phone_id", "track_no"], "left")
    return t.select("phone_id", "track_no", *[F.coalesce(F.try_divide(r, "l"), F.lit(0.0)).alias(f"prop_{r}") for r in RAILS])


def mode_by_rules(rules: Rules) -> Column:
    """Of columns prop_*, v_instant_max, v_instant_moy, track_length; the last of the rules that holds wins, so they are asked in reverse."""
    c = F.col
    return (
        F.when(c("prop_train") > rules.p_rail, "train").when(c("prop_rer") > rules.p_rail, "rer").when(c("prop_metro") > rules.p_metro, "metro")
        .when((c("v_instant_max") > rules.v_max_bike) | (c("track_length") > rules.motor_length) | (c("v_instant_moy") > rules.v_moy_bike), "motorized")
        .when((c("v_instant_max") > rules.v_max_walk) | (c("v_instant_moy") > rules.v_moy_walk), "bike").otherwise("walk")
    )


def inference_mode_logic_rules(tracks: DataFrame, rails: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """tracks with mode_computed; null where no time passed between points."""
    t = with_rail_shares(tracks.drop("mode_computed"), rails, rules.radius)  # without that of an earlier run
    return t.withColumn("mode_computed", F.when(F.col("time_prec_max") > 0, mode_by_rules(rules)))


def speed_steps(v: Column, t: Column) -> Column:
    """array<struct<a, b>> of samples (v, t) and their next ones."""
    z = F.arrays_zip(v.alias("v"), t.alias("t"))
    return F.zip_with(F.slice(z, 1, F.greatest(F.size(z) - 1, F.lit(0))), F.slice(z, 2, F.greatest(F.size(z) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def switches_of(steps: Column, theta: float) -> Column:
    passed = F.filter(steps, lambda p: (p.a.v - theta) * (p.b.v - theta) < 0)
    return F.transform(passed, lambda p: (p.b.t - p.a.t) / (p.b.v - p.a.v) * (theta - p.a.v) + p.a.t)


def switch_points(v: Column, t: Column, theta: float) -> Column:
    """Times at which speed passes theta, by linear interpolation between samples on either side of it."""
    return switches_of(speed_steps(v, t), theta)


def time_above(switches: Column, t: Column) -> Column:
    """An even number of switches: the sum of every other gap. An odd one: the gaps without the last complete one, and from the last switch to the end; one switch: only the latter."""
    n = F.size(switches)
    gaps = F.transform(switches, lambda x, i: F.when(i % 2 == 0, F.get(switches, i + 1) - x))
    total = lambda upto: F.aggregate(F.filter(F.slice(gaps, 1, upto), lambda g: g.isNotNull()), F.lit(0.0), lambda a, g: a + g)
    return F.when(n % 2 == 0, total(n)).otherwise(total(F.greatest(n - 3, F.lit(0))) + F.element_at(t, -1) - F.element_at(switches, -1))


def speed_bands(tracks: DataFrame) -> DataFrame:
    """tracks with v_moy (m/s) and prop1 to prop7, shares of time by speed band; null where no time passed."""
    from .tracks import running_sums

    t = tracks.withColumn("v_moy", F.try_divide("track_length", "duration")).withColumn("_t", F.col("list_time_total") if "list_time_total" in tracks.columns else running_sums(F.col("list_time_elapsed")))
    t = t.withColumn("_steps", speed_steps(F.col("list_v_instant"), F.col("_t")))
    t = t.withColumns({f"_s{b}": switches_of(F.col("_steps"), float(b)) for b in BANDS})
    t = t.withColumns({f"_a{b}": F.when(F.size(f"_s{b}") >= 0, time_above(F.col(f"_s{b}"), F.col("_t"))) for b in BANDS})
    total = F.element_at("_t", -1) - F.get("_t", 0)
    above = [total] + [F.col(f"_a{b}") for b in BANDS] + [F.lit(0.0)]
    t = t.withColumns({f"prop{i + 1}": F.try_divide(above[i] - above[i + 1], total) for i in range(len(BANDS) + 1)})
    return t.drop("_t", "_steps", *[f"_{k}{b}" for b in BANDS for k in "sa"])


def trapezoid(x: Column, knots: tuple[float, float, float, float], far: float) -> Column:
    """0, rising from knot 1 to 2, 1, falling from 3 to 4, 0. At a place where knots coincide the right one's value holds. Null and what lies beyond far: 0."""
    a, b, c, d = knots
    out = F.when(x.isNull() | (x < -far) | (x > far), 0.0).when(x >= d, 0.0)
    out = out.when(x >= c, 1 - (x - c) / (d - c)) if d > c else out
    out = out.when(x >= b, 1.0)
    out = out.when(x >= a, (x - a) / (b - a)) if b > a else out
    return out.otherwise(0.0)


def mode_scores(tracks: DataFrame) -> DataFrame:
    """speed_bands() with the forty scores score_<feature>_<mode>, in the classifier's order."""
    t = speed_bands(tracks)
    return t.withColumns({f"score_{f}_{m}": trapezoid(F.col(SOURCE.get(f, f)), k, FAR.get(f, 100_000.0)) for f, knots in KNOTS.items() for m, k in zip(MODES, knots)})


def best_score(scored: DataFrame) -> Column:
    """Stands in for a trained classifier: the mode with the largest sum of scores, the first of equal ones."""
    sums = F.struct(*[sum((F.col(f"score_{f}_{m}") for f in KNOTS), F.lit(0.0)).alias(m) for m in MODES])

    def first(s: Column) -> Column:
        top = F.greatest(*[s[m] for m in MODES])
        out = F.when(s[MODES[0]] == top, MODES[0])
        for m in MODES[1:]:
            out = out.when(s[m] == top, m)
        return out

    return geo.let(sums, first)  # each sum once, not in each comparison: the plan stays small


def inference_mode_hybrid(tracks: DataFrame, rails: DataFrame, classifier=best_score, rules: Rules = HYBRID) -> DataFrame:
    """(phone_id, track_no, mode_computed_hybrid): classifier's label (a function of the scored frame giving a column: an expression, a pandas_udf or a fitted model's), then long or fast tracks and cars and buses are motorized, then long tracks on rails are trains."""
    ruled = inference_mode_logic_rules(tracks, rails, rules)
    scored = mode_scores(ruled)
    scored = scored.withColumn("_label", classifier(scored))
    label = F.col("_label")
    out = F.when((F.col("track_length") > 15_000) | (F.col("v_instant_moy") > 25) | label.isin("car", "bus"), "motorized").otherwise(label)
    out = F.when((F.col("mode_computed") == "train") & (F.col("track_length") > 10_000), "train").otherwise(out)
    return scored.select("phone_id", "track_no", out.alias("mode_computed_hybrid"))
