"""Streams of points: the gap rule as a session window for each phone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(points: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(phone_id, start, end, n, min_x, ...) of runs of a phone's points with steps below gap; points is a stream with column time, or a table.

    The same rule as the gap cut, without the stop rules, which look back; state is kept until the watermark has passed a session's end.
    """
    # Spark merges windows that touch, and times are whole microseconds: with one less, a step of just gap begins a session
    p = points.withWatermark("time", late) if points.isStreaming else points
    s = p.groupBy("phone_id", F.session_window("time", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return s.select("phone_id", F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "n", "min_x", "max_x", "min_y", "max_y")
