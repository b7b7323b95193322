"""Descriptive statistics: the tables behind histograms, distribution curves and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def phone_stats(phones: DataFrame, points: DataFrame) -> DataFrame:
    """Phones that have points, with counts, accuracy and the mean of all points."""
    own = points.groupBy("phone_id").agg(F.count("ts").alias("nbr_points"), F.max("accuracy").alias("accuracy_max"), F.avg("accuracy").alias("accuracy_moy"), F.min("accuracy").alias("accuracy_min"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    return phones.join(own, "phone_id")


def os_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("os").agg(F.max("accuracy").alias("accuracy_max"), F.avg("accuracy").alias("accuracy_moy"), F.count("*").alias("n"))


def daily_activity(points: DataFrame) -> DataFrame:
    """Phones and tracks seen each day."""
    return points.groupBy("day").agg(F.countDistinct("phone_id").alias("n_phones"), F.countDistinct("phone_id", "track_no").alias("n_tracks"))


def describe(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Numbers of points, phones and tracks, with thousands separators."""
    a = points.agg(F.count("*").alias("p"), F.countDistinct("phone_id").alias("f"))
    b = tracks.agg(F.count("*").alias("t"))
    one = a.join(b, F.lit(True))  # one row each
    return one.select(*[F.format_number(c, 0).alias(n) for c, n in (("p", "n_points"), ("f", "n_phones"), ("t", "n_tracks"))])


def histogram(df: DataFrame, value: Column, lo: float, hi: float, step: float) -> DataFrame:
    """(bin, n): bins from lo by step to the last edge below hi; the last is closed, what lies outside is dropped."""
    edges = len(range(int(lo), int(hi), int(step)))
    last = lo + (edges - 1) * step
    own = df.select(value.alias("v")).filter((F.col("v") >= lo) & (F.col("v") <= last))
    slot = F.least(F.floor((F.col("v") - lo) / step), F.lit(edges - 2))
    return own.groupBy((F.lit(lo) + slot * step).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _running_counts(df: DataFrame, value: Column) -> DataFrame:
    """(v, n, before, all): each value's number, that of smaller ones, and of all. Counted by value first; running counts are put together from ranges of values, so no window or list spans all rows."""
    from ..sources.tables import saved

    own = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    own = saved(own.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "counts")
    ranges = own.groupBy("range").agg(F.sum("n").alias("m"))
    ranges = ranges.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("start"), F.sum("m").over(Window.partitionBy()).alias("all"))
    local = F.sum("n").over(Window.partitionBy("range").orderBy("v")) - F.col("n")
    return own.withColumn("local", local).join(ranges, "range").select("v", "n", (F.col("local") + F.col("start")).alias("before"), "all")


def cdf(df: DataFrame, value: Column, endpoint: bool = False) -> DataFrame:
    """(v, share, n): for each value the share (i - 1) / n of its first place among the sorted; endpoint: (i - 1) / (n - 1)."""
    return _running_counts(df, value).select("v", F.try_divide("before", F.col("all") - (1 if endpoint else 0)).alias("share"), "n")


def markers(df: DataFrame, value: Column) -> DataFrame:
    """Median and mean, to one decimal."""
    c = _running_counts(df, value)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2
    return c.agg(F.round(middle, 1).alias("median"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 1).alias("mean"))


def equal_width(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, lo, n): bins of equal width from the smallest to the largest value, the last closed; equal values share bins around them, half a unit to either side. Empty bins are left out. One pass finds the ends, one counts."""
    own = df.select(value.cast("double").alias("v")).filter("v is not null")
    ends = own.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    slot = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("long")
    both = own.join(F.broadcast(ends), F.lit(True)).select(slot.alias("bin"), "a", "b")  # one row
    return both.groupBy("bin", "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("lo"), "n")


def through_origin(df: DataFrame, x: str, y: str, rate: str) -> DataFrame:
    """(slope, r2, n) of y on x without intercept, over rows whose rate is above 0."""
    own = df.filter(F.col(rate) > 0).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a = own.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.avg("y").alias("mean"), F.count("*").alias("n"))
    slope = F.try_divide("xy", "xx")
    rest = F.col("yy") - 2 * slope * F.col("xy") + slope * slope * F.col("xx")
    return a.select(slope.alias("slope"), (1 - F.try_divide(rest, F.col("yy") - F.col("n") * F.col("mean") * F.col("mean"))).alias("r2"), "n")


def total_bounds(lines: DataFrame, margin: float = 0.0) -> DataFrame:
    """Bounding box of all lines' coordinates, widened by a share margin of its sides."""
    c = lines.select(F.explode("geometry").alias("p")).agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * margin, (F.col("y1") - F.col("y0")) * margin
    return c.select((F.col("x0") - dx).alias("min_x"), (F.col("y0") - dy).alias("min_y"), (F.col("x1") + dx).alias("max_x"), (F.col("y1") + dy).alias("max_y"))


def selection(tracks: DataFrame, phone_id=None, track_no=None) -> DataFrame:
    """One phone's or one track's rows."""
    out = tracks if phone_id is None else tracks.filter(F.col("phone_id") == phone_id)
    return out if track_no is None else out.filter(F.col("track_no") == track_no)


def as_text(df: DataFrame, but: tuple[str, ...] = ("geometry",)) -> DataFrame:
    """All columns as text but those named."""
    plain = lambda c, t: F.to_json(F.col(c)) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return df.select(*[F.col(c) if c in but else plain(c, t).alias(c) for c, t in df.dtypes])


def plottable_lines(lines: DataFrame) -> DataFrame:
    """Rows whose geometry is a line of two points or more and of some length."""
    return lines.filter((F.size("geometry") > 1) & (geo.line_length(F.col("geometry")) > 0))


def zone_map(zones: DataFrame, flows: DataFrame) -> DataFrame:
    """zones with the counts of zone_flows(), 0 for those without: the table behind a map of flows."""
    return zones.join(flows.select("zone_id", F.col("counts").alias("_counts")), "zone_id", "left").withColumn("counts", F.coalesce("_counts", F.lit(0))).drop("_counts")
