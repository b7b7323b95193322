"""Tracks from tracked points, and statistics of tracks. phone_id stays in the key, so the points' partitioning is reused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times

KEY = ["phone_id", "track_no"]


def distinct_places(points: DataFrame) -> DataFrame:
    """The first point of each phone at each place, over all its tracks."""
    nth = F.row_number().over(Window.partitionBy("phone_id", "x", "y").orderBy("ts", "stop"))
    return points.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def drop_incomplete(points: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without rows that lack one of columns; None: any column."""
    return points.dropna(subset=columns or points.columns)


def steps(points: DataFrame) -> DataFrame:
    """With time_elapsed, dist_from_prec (0 where a track starts), v_instant in km/h and its change acc_instant."""
    w = Window.partitionBy(*KEY).orderBy("ts", "stop")
    before = lambda c: F.lag(c).over(w)
    p = points.withColumn("time_elapsed", F.coalesce(F.greatest(F.col("ts") - before("ts"), F.lit(0)).cast("double"), F.lit(0.0)))
    p = p.withColumn("dist_from_prec", F.when(before("ts").isNull(), 0.0).otherwise(geo.distance(F.col("x"), F.col("y"), before("x"), before("y"))))
    p = p.withColumn("v_instant", F.when(F.col("time_elapsed") > 0, F.col("dist_from_prec") / F.col("time_elapsed") * 3.6).otherwise(0.0))
    change = F.col("v_instant") - F.coalesce(before("v_instant"), F.col("v_instant"))
    return p.withColumn("acc_instant", F.when(F.col("time_elapsed") > 0, change / F.col("time_elapsed") / 3.6).otherwise(0.0))


def tracks(points: DataFrame) -> DataFrame:
    """One row for each track: kinematics of the steps between its distinct places."""
    so_far = Window.partitionBy(*KEY).orderBy("ts", "stop").rowsBetween(Window.unboundedPreceding, 0)
    p = steps(distinct_places(points)).withColumn("time_total", F.sum("time_elapsed").over(so_far))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "stop", "x", "y", "v_instant", "time_elapsed", "time_total")))
    t = p.groupBy(*KEY).agg(
        F.max("accuracy").cast("double").alias("accuracy_max"), F.avg("accuracy").alias("accuracy_moy"), F.avg("time_elapsed").alias("time_prec_moy"), F.max("time_elapsed").alias("time_prec_max"),
        F.median("v_instant").alias("v_median"), F.percentile("v_instant", F.lit(0.95)).alias("v_95th_percentile"), F.max("dist_from_prec").alias("dist_from_prec_max"), F.avg("dist_from_prec").alias("dist_from_prec_moy"),
        F.max("v_instant").alias("v_instant_max"), F.avg("v_instant").alias("v_instant_moy"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("time_elapsed").alias("duration"), F.sum("dist_from_prec").alias("track_length"),
        F.count("*").alias("n_points"), ordered.alias("o"),
    )
    line = F.transform("o", lambda s: geo.point(s.x, s.y))
    t = t.withColumn("list_v_instant", F.transform("o", lambda s: s.v_instant)).withColumn("list_time_elapsed", F.transform("o", lambda s: s.time_elapsed))
    t = t.withColumn("list_time_total", F.transform("o", lambda s: s.time_total))
    t = t.withColumn("departure_point", F.get(line, 0)).withColumn("arrival_point", F.element_at(line, -1)).withColumn("geometry", F.when(F.size(line) > 1, line)).drop("o")
    t = t.withColumn("day", times.day_name(F.col("first_ts")))
    a, b = F.col("departure_point"), F.col("arrival_point")
    return t.withColumn("dist_departure_arrival", geo.distance(a.x, a.y, b.x, b.y))


def tracks_with_stops(points: DataFrame) -> DataFrame:
    """The form that keeps all points: medians, sums and average_speed in m/s."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "stop", "x", "y", "ord")))
    t = points.groupBy(*KEY).agg(F.median("accuracy").alias("accuracy_median"), F.median("t").alias("sampling_duration_median"), F.median("d").alias("sampling_distance_median"), F.sum("t").alias("duration"), F.sum("d").alias("length"), ordered.alias("o"))
    t = t.withColumn("point_ids", F.transform("o", lambda s: s.ord)).withColumn("geometry", F.when(F.size("o") > 1, F.transform("o", lambda s: geo.point(s.x, s.y)))).drop("o")
    return t.withColumn("average_speed", F.try_divide("length", "duration"))


def track_stats(points: DataFrame) -> DataFrame:
    """Sampling and speed statistics for each track, and its end points."""
    at = F.struct("ts", "stop")
    return points.groupBy(*KEY).agg(
        F.max("accuracy").cast("double").alias("accuracy_max"), F.avg("accuracy").alias("accuracy_moy"), F.max("t").alias("sampling_duration_max"), F.avg("t").alias("sampling_duration_moy"), F.max("d").alias("sampling_distance_max"), F.avg("d").alias("sampling_distance_moy"),
        F.max("s").alias("speed_max"), F.median("s").alias("speed_median"), F.percentile("s", F.lit(0.95)).alias("speed_95th"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by(geo.point(F.col("x"), F.col("y")), at).alias("departure_point"), F.max_by(geo.point(F.col("x"), F.col("y")), at).alias("end_point"),
    )


def running_sums(values):
    """Prefix sums of an array column, for frames without list_time_total; array functions would add each from the start again."""

    @F.pandas_udf("array<double>")
    def sums(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.cumsum(np.asarray(v, float)))

    return sums(values)
