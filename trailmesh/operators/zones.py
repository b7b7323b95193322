"""Zones: spatial joins over a grid, flows between zones, counts by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def set_zoning(zones: DataFrame, geographic: bool = False) -> DataFrame:
    """zones with zone_id (from insee where that is its name) and metric geometry."""
    z = zones if "zone_id" in zones.columns else zones.withColumnRenamed("insee", "zone_id")
    if not geographic:
        return z
    project = lambda p: geo.point(*geo.lambert93(p.x, p.y))
    return z.withColumn("geometry", F.transform("geometry", lambda ring: F.transform(ring, project)))


def zone_join(points: DataFrame, zones: DataFrame, x: str, y: str, predicate=geo.within, cell: float = 10_000.0) -> DataFrame:
    """points' columns with zone_id of each zone that predicate puts them in; an equi-join on grid cells comes first.

    Zones are few rows for each cell that their box touches; points fall into one cell. Spark broadcasts the zones where they are small.
    """
    shell = F.flatten("geometry")
    box = [
        F.array_min(F.transform(shell, lambda p: p.x)), F.array_min(F.transform(shell, lambda p: p.y)), F.array_max(F.transform(shell, lambda p: p.x)), F.array_max(F.transform(shell, lambda p: p.y)),
    ]
    z = zones.select("zone_id", F.col("geometry").alias("_ring"), F.explode(geo.cells(*box, cell)).alias("_cell")).select("zone_id", "_ring", F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy"))
    p = points.withColumn("_px", F.floor(F.col(x) / cell).cast("long")).withColumn("_py", F.floor(F.col(y) / cell).cast("long"))
    both = p.join(z, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
    own = both.filter(predicate(F.col(x).cast("double"), F.col(y).cast("double"), F.col("_ring")))
    return own.select(*points.columns, "zone_id")


def zone_of(points: DataFrame, zones: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key, zone): for each row the smallest zone_id that it is strictly within; rows in none are left out."""
    return zone_join(points.select(*key, x, y), zones, x, y).groupBy(*key).agg(F.min("zone_id").alias("zone"))


def od_trips(tracks: DataFrame, zones: DataFrame, weight: str | None = None) -> DataFrame:
    """(key, origin, destination[, weight]) of tracks with both ends in zones."""
    key = ["phone_id", "track_no"]
    t = tracks.select(*key, F.col("departure_point.x").alias("ox"), F.col("departure_point.y").alias("oy"), F.col("arrival_point.x").alias("dx"), F.col("arrival_point.y").alias("dy"), *([weight] if weight else []))
    o = zone_join(t, zones, "ox", "oy").groupBy(*t.columns).agg(F.min("zone_id").alias("origin"))
    d = zone_join(o, zones, "dx", "dy").groupBy(*o.columns).agg(F.min("zone_id").alias("destination"))
    return d.drop("ox", "oy", "dx", "dy")


def od_matrix(tracks: DataFrame, zones: DataFrame) -> DataFrame:
    return od_trips(tracks, zones).groupBy("origin", "destination").agg(F.count("*").alias("counts"))


def od_matrix_weighted(tracks: DataFrame, zones: DataFrame, weight: str = "weight") -> DataFrame:
    return od_trips(tracks, zones, weight).groupBy("origin", "destination").agg(F.sum(weight).alias("counts_reel"))


def zone_flows(zones: DataFrame, volumes: DataFrame, zone_id, outward: bool) -> DataFrame:
    """(zone_id, counts) to (outward) or from zone_id, 0 where there are none; the zone's own trips are left out."""
    here, there = ("origin", "destination") if outward else ("destination", "origin")
    own = volumes.filter(F.col(here) == zone_id).select(F.col(there).alias("zone_id"), "counts")
    return zones.select("zone_id").filter(F.col("zone_id") != zone_id).join(own, "zone_id", "left").withColumn("counts", F.coalesce("counts", F.lit(0)))


def number_by_zone(zones: DataFrame, places: DataFrame, label: str) -> DataFrame:
    """zones with nbr_<label>, places within or on the edge of each, and the population for each of them (0 without)."""
    rate = {"domicile": "repr_rate_home", "emploi": "repr_rate_work"}[label]
    p = places.select("phone_id", F.col(f"{label}.x").alias("_x"), F.col(f"{label}.y").alias("_y"))
    n = zone_join(p, zones, "_x", "_y", geo.intersects).groupBy("zone_id").agg(F.count("*").alias("n"))
    z = zones.join(n, "zone_id", "left").withColumn(f"nbr_{label}", F.coalesce("n", F.lit(0))).drop("n")
    return z.withColumn(rate, F.when(F.col(f"nbr_{label}") != 0, F.col("population_totale") / F.col(f"nbr_{label}")).otherwise(0.0))


def bandwidths(links: DataFrame, value: str, width: float, method: str = "linear", power: float = 1.0) -> DataFrame:
    """With width: linear value / max * width, surface its square root, after raising to power."""
    if method not in ("linear", "surface"):
        raise ValueError(f"unknown method {method!r}")
    top = links.agg(F.max(F.pow(value, F.lit(power))).alias("_top"))
    share = F.pow(value, F.lit(power)) / F.col("_top")
    return links.join(top, F.lit(True)).withColumn("width", (share if method == "linear" else F.sqrt(share)) * width).drop("_top")  # one row
