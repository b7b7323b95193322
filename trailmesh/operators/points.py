"""Raw points to tracked points. Every window partitions by phone, so one shuffle serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times


def by_time():
    return Window.partitionBy("phone_id").orderBy("ts")


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def parse_time(text: Column) -> Column:
    """Epoch seconds of ISO text, see times.parse_utc()."""
    return times.parse_utc(text)


def project(points: DataFrame) -> DataFrame:
    """With x, y: EPSG:2154 metres, cut to whole numbers towards zero."""
    x, y = geo.lambert93(F.col("longitude"), F.col("latitude"))
    return points.withColumn("x", x.cast("long")).withColumn("y", y.cast("long"))


def active_phones(points: DataFrame, side: float = 50) -> DataFrame:
    """Points of phones whose x or y range exceeds side."""
    extent = points.groupBy("phone_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    return points.join(extent.filter(F.col("extent") > side).select("phone_id"), "phone_id", "left_semi")


def accurate(points: DataFrame, most: float = 50) -> DataFrame:
    """Points whose accuracy, cut to a whole number, is below most."""
    return points.withColumn("accuracy", F.col("accuracy").cast("long")).filter(F.col("accuracy") < most)


def filtering(raw: DataFrame, phone_id_column: str = "phone_id", side: float = 50, most: float = 50) -> DataFrame:
    """Raw points (longitude, latitude, eventDate, accuracy) projected, of active phones only, with ts, accurate ones only."""
    points = raw.drop("speed", "eventId", "Unnamed: 0").withColumnRenamed(phone_id_column, "phone_id")
    points = active_phones(project(points), side).withColumn("ts", parse_time(F.col("eventDate")))
    return accurate(points, most)


def clean(points: DataFrame) -> DataFrame:
    """One point for each phone and ts: the first in input order, which column ord tells."""
    nth = F.row_number().over(Window.partitionBy("phone_id", "ts").orderBy("ord"))
    return points.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def deltas(points: DataFrame) -> DataFrame:
    """With d metres, t seconds, s km/h since the phone's previous point (0 at its first) and new_phone."""
    before = lambda c: F.lag(c).over(by_time())
    p = points.withColumn("new_phone", before("ts").isNull())
    p = p.withColumn("d", F.coalesce(geo.distance(F.col("x"), F.col("y"), before("x"), before("y")), F.lit(0.0)))
    p = p.withColumn("t", F.coalesce((F.col("ts") - before("ts")).cast("double"), F.lit(0.0)))
    return p.withColumn("s", F.when(F.col("t") > 0, F.col("d") / F.col("t") * 3.6).otherwise(0.0))


def gap_cuts(points: DataFrame, gap: float = 3600) -> DataFrame:
    """cut where the step took longer than gap, whose d, t, s become 0, or the phone begins."""
    over = F.col("t") > gap
    p = points.withColumn("cut", over | F.col("new_phone"))
    return p.withColumns({c: F.when(over, 0.0).otherwise(F.col(c)) for c in ("d", "t", "s")}).drop("new_phone")


def trip_groups(points: DataFrame, stop_kmh: float = 1) -> DataFrame:
    """With low_speed, and trip_group: a running count of cuts and slow points for each phone."""
    p = points.withColumn("low_speed", F.col("s") < stop_kmh)
    return p.withColumn("trip_group", F.sum((F.col("cut") | F.col("low_speed")).cast("int")).over(so_far()))


def noise_trips(points: DataFrame, idle: float = 200) -> DataFrame:
    """noise where the trip group's bounding box has a diagonal below idle."""
    w = Window.partitionBy("phone_id", "trip_group")
    dx, dy = (F.max(c).over(w) - F.min(c).over(w) for c in ("x", "y"))
    return points.withColumn("noise", F.sqrt((dx * dx + dy * dy).cast("double")) < idle)


def stop_flags(points: DataFrame, stop_seconds: float = 600) -> DataFrame:
    """stop: slow or noise, except in stops (with the moving point before them) shorter than stop_seconds."""
    p = points.withColumn("stop", F.col("low_speed") | F.col("noise"))
    p = p.withColumn("stop_group", F.sum((~F.col("stop")).cast("int")).over(so_far()))
    w = Window.partitionBy("phone_id", "stop_group")
    return p.withColumn("stop", F.col("stop") & (F.max("ts").over(w) - F.min("ts").over(w) >= stop_seconds))


def number_tracks(points: DataFrame) -> DataFrame:
    """Each stop twice, as the end of a track (stop false) and the start of the next; track_no counts them by phone."""
    twice = F.explode(F.when(F.col("stop"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    p = points.select(*[c for c in points.columns if c != "stop"], twice.alias("stop"))
    w = Window.partitionBy("phone_id").orderBy("ts", "stop").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("track_no", F.sum((F.col("stop") | F.col("cut")).cast("int")).over(w))


def long_tracks(points: DataFrame, seconds: float = 120, metres: float = 200, method: str = "delete") -> DataFrame:
    """Points of tracks that took over seconds and spread over metres in x or y. method: delete and remove mean the same."""
    if method == "stick":
        raise NotImplementedError("method 'stick'")
    if method not in ("delete", "remove"):
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("phone_id", "track_no")
    wide = [(F.max(c).over(w) - F.min(c).over(w)) > metres for c in ("x", "y")]
    return points.withColumn("_keep", (F.sum("t").over(w) > seconds) & (wide[0] | wide[1])).filter("_keep").drop("_keep")


def flagged(points: DataFrame, gap: float = 3600, stop_kmh: float = 1, idle: float = 200, stop_seconds: float = 600) -> DataFrame:
    """clean() to stop_flags()."""
    return stop_flags(noise_trips(trip_groups(gap_cuts(deltas(clean(points)), gap), stop_kmh), idle), stop_seconds)


def tracked(points: DataFrame, gap: float = 3600, stop_kmh: float = 1, idle: float = 200, stop_seconds: float = 600, min_seconds: float = 120, min_metres: float = 200) -> DataFrame:
    """Points with track_no for each phone, time and day; tracks that are too short are gone."""
    p = number_tracks(flagged(points, gap, stop_kmh, idle, stop_seconds).drop("low_speed", "noise", "trip_group", "stop_group"))
    return long_tracks(p, min_seconds, min_metres).withColumn("time", F.timestamp_seconds("ts")).withColumn("day", times.day_name(F.col("ts")))


def global_track_ids(points: DataFrame) -> DataFrame:
    """With track_id, unique over all phones: track_no plus the tracks of all phones before.

    Phones are range-partitioned and summed in each range; only the ranges' sums are put in one window.
    """
    n = points.groupBy("phone_id").agg(F.max("track_no").alias("n")).repartitionByRange("phone_id").withColumn("range", F.spark_partition_id())
    from ..sources.tables import saved

    n = saved(n, "track-ranges")
    starts = n.groupBy("range").agg(F.sum("n").alias("m"))
    starts = starts.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("start"))
    local = F.sum("n").over(Window.partitionBy("range").orderBy("phone_id")) - F.col("n")
    base = n.withColumn("local", local).join(starts, "range").select("phone_id", (F.col("local") + F.col("start")).alias("base"))
    return points.join(base, "phone_id").withColumn("track_id", F.col("base") + F.col("track_no")).drop("base")
