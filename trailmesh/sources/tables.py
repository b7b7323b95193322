"""Frames from the driver's tables, saved models, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, times


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a temporary folder. A cluster without the setting raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailmesh-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/trailmesh-tables/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{_own(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes the tables that this application saved(); call it when every result that was derived from them has been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_model(frames: dict[str, DataFrame], folder: str, omitted: tuple[str, ...] = (), only: tuple[str, ...] | None = None, compression: str = "snappy") -> None:
    """Each frame as Parquet below folder, in place of all that was there. New frames are written beside it first, so they may be read from the old ones."""
    if not frames:
        return
    spark = next((df for df in frames.values() if df is not None), None)
    spark = spark.sparkSession if spark is not None else SparkSession.getActiveSession()
    old, new = folder.rstrip("/"), f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = paths(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(paths(new))
    for name, df in frames.items():
        if df is not None and name not in omitted and (only is None or name in only):
            df.write.option("compression", compression).parquet(f"{new}/{name}")
    files.delete(paths(old), True)
    if not files.rename(paths(new), paths(old)):
        raise OSError(f"{new} can't be renamed to {old}")


def load_model(spark: SparkSession, folder: str, names: tuple[str, ...], omitted: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names if n not in omitted and (only is None or n in only)}


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_rows(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row for each element of column; rows with none vanish unless keep_empty."""
    f = F.explode_outer if keep_empty else F.explode
    return df.select(*[f(c).alias(c) if c == column else F.col(c) for c in df.columns])


def stacked(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A matrix as (key, column, value) rows, nulls left out."""
    return df.unpivot(key, columns, "column", "value").filter("value is not null")


def points(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Points from the events table. dense: coordinates close enough for homes and work places."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    x, y = (F.floor(F.col("value") * 10), k * 10) if dense else (F.floor(F.col("value") * 1000), k * 1000)
    return e.select(
        F.col("user_id").alias("phone_id"), F.col("event_id").alias("ord"), times.of_local(F.col("ts")).alias("ts"), x.cast("long").alias("x"), y.cast("long").alias("y"), (F.col("event_id") % 60).alias("accuracy"),
        F.col("event_type").alias("os"), (2 + F.col("value") / 500).alias("longitude"), (48 + k / 100.0).alias("latitude"),
    )


def square(x0, y0, size: float):
    at = lambda dx, dy: geo.point(x0 + dx * size, y0 + dy * size)
    return F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)))


def zones(pts: DataFrame, size: int = 50_000) -> DataFrame:
    """Square zones around where points are."""
    z = pts.select(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).distinct()
    zone_id = F.col("i") * 100 + F.col("j")
    return z.select(zone_id.alias("zone_id"), square(F.col("i") * size, F.col("j") * size, size).alias("geometry"), (1000 + zone_id * 37).alias("population_totale"), (500 + zone_id * 11).alias("emplois"))


def grid_roads(spark: SparkSession, nx: int = 12, ny: int = 6, step: float = 10_000.0) -> DataFrame:
    """A road grid: links to the right and upwards with a vertex between, every second one two-way, and a longer parallel to every fifth."""
    n = spark.range(nx * ny * 2).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx % ny).alias("j"), F.floor(F.col("id") / (nx * ny)).alias("up"), "id")
    n = n.filter(((F.col("up") == 0) & (F.col("i") < nx - 1)) | ((F.col("up") == 1) & (F.col("j") < ny - 1)))
    x, y = F.col("i") * step, F.col("j") * step
    dx, dy = (1 - F.col("up")) * step, F.col("up") * step
    name = lambda i, j: F.concat(F.lit("n"), i.cast("string"), F.lit("_"), j.cast("string"))
    line = F.array(geo.point(x, y), geo.point(x + dx / 2, y + dy / 2), geo.point(x + dx, y + dy))
    links = n.select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("index"), name(F.col("i"), F.col("j")).alias("a"), name(F.col("i") + 1 - F.col("up"), F.col("j") + F.col("up")).alias("b"), F.lit(step).alias("length"), F.when(F.col("id") % 2 == 0, "0").otherwise("1").alias("oneway"), line.alias("geometry"), "id")
    return links.drop("id").union(links.filter(F.col("id") % 5 == 0).withColumn("index", F.concat("index", F.lit("p"))).withColumn("length", F.lit(step * 1.5)).drop("id"))


def rails(spark: SparkSession) -> DataFrame:
    """Three rail lines of two segments each."""
    rows = [("metro", [(0.0, 20_000.0), (60_000.0, 22_000.0), (120_000.0, 30_000.0)]), ("rer", [(10_000.0, 0.0), (12_000.0, 50_000.0), (20_000.0, 99_000.0)]), ("train", [(0.0, 60_000.0), (150_000.0, 61_000.0), (300_000.0, 40_000.0)])]
    return spark.createDataFrame([(t, [{"x": x, "y": y} for x, y in g]) for t, g in rows], "type_TC string, geometry array<struct<x:double,y:double>>")


def network_of_area(links: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """A pre-extracted road network's links that begin in the convex hull of an area's corners; stands in for a download."""
    from ..operators.roads import convex_hull

    hull = convex_hull(corners)
    ring = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in [*hull, hull[0]]])
    p = geo.first_point(F.col("geometry"))
    return links.filter(geo.intersects(p.x, p.y, F.array(ring)))
