"""A model that holds frames and runs the pipelines on them. Frames are immutable, so copies are cheap and callers' frames are never changed."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, modes, places, points, roads, stats, tracks, zones
from ..sources import tables

FRAMES = ("points", "tracks", "phones", "zones", "volumes", "road_links", "road_nodes", "rail_network", "tracks_mapmatched", "tracks_unmatched")


class MobilityModel:
    """points (phone_id or sptId, latitude, longitude, eventDate, accuracy) and what is derived from them."""

    def __init__(self, raw: DataFrame | None = None) -> None:
        for name in FRAMES:
            setattr(self, name, None)
        if raw is not None:
            self.points = raw.withColumnRenamed("sptId", "phone_id")
            self.phones = self.points.select("phone_id").distinct()

    def _need(self, *names: str) -> None:
        for n in names:
            if getattr(self, n) is None:
                raise ValueError(f"set {n} first")

    def copy(self) -> MobilityModel:
        return copy(self)

    def save(self, folder: str, **which) -> None:
        tables.save_model({n: getattr(self, n) for n in FRAMES}, folder, **which)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: tuple[str, ...], **which) -> MobilityModel:
        m = cls()
        for n, df in tables.load_model(spark, folder, names, **which).items():
            setattr(m, n, df)
        return m

    def describe(self) -> DataFrame:
        self._need("points", "tracks")
        return stats.describe(self.points, self.tracks)

    def filtering(self, **how) -> None:
        self._need("points")
        self.points = points.filtering(self.points, **how)

    def build_tracks(self, **how) -> None:
        self._need("points")
        if "ts" not in self.points.columns:
            raise ValueError("filter the points first")
        own = self.points if "ord" in self.points.columns else self.points.withColumn("ord", F.monotonically_increasing_id())
        self.points = points.tracked(own, **how)
        self.tracks = tracks.tracks(self.points)

    def phones_dataset_analysis(self) -> None:
        self._need("phones", "points")
        self.phones = stats.phone_stats(self.phones, self.points)

    def analysis_points(self) -> dict[str, DataFrame]:
        """The tables behind the plots of points: accuracy by system and its histogram and curve."""
        self._need("points")
        p = self.points
        out = {"accuracy": stats.histogram(p, F.col("accuracy"), 0, 2000, 5), "accuracy_share": stats.cdf(p, F.col("accuracy"))}
        return out | ({"systems": stats.os_stats(p)} if "os" in p.columns else {})

    def analysis_tracks(self) -> dict[str, DataFrame]:
        """The tables behind the plots of tracks: durations in minutes, lengths in km, mean speeds in km/h, each with its curve and markers, and activity by day."""
        self._need("tracks")
        t, out = self.tracks, {}
        for name, value, bins in (("minutes", F.col("duration") / 60, 30), ("km", F.col("track_length") / 1000, 50), ("kmh", F.when(F.col("v_instant_moy") < 1e9, F.col("v_instant_moy")), 75)):
            out |= {name: stats.equal_width(t, value, bins), f"{name}_share": stats.cdf(t, value), f"{name}_markers": stats.markers(t, value)}
        return out | {"days": t.groupBy("day").agg(F.countDistinct("phone_id").alias("n_phones"))}

    def representativity(self, work: bool = False) -> DataFrame:
        """Slope, r2 and n of population on homes by zone, or of jobs on work places."""
        self._need("zones")
        return stats.through_origin(self.zones, "nbr_emploi", "emplois", "repr_rate_work") if work else stats.through_origin(self.zones, "nbr_domicile", "population_totale", "repr_rate_home")

    def flow_map(self, zone_id, outward: bool = True) -> DataFrame:
        """zones with the counts of tracks from (outward) or to zone_id."""
        self._need("zones", "volumes")
        return stats.zone_map(self.zones, zones.zone_flows(self.zones, self.volumes, zone_id, outward))

    def set_zoning(self, frame: DataFrame, geographic: bool = False) -> None:
        self.zones = zones.set_zoning(frame, geographic)

    def set_rail_network(self, frame: DataFrame) -> None:
        self.rail_network = frame

    def set_road_network(self, links: DataFrame) -> None:
        self.road_links, self.road_nodes = links, roads.nodes(links)

    extract_road_network = staticmethod(tables.network_of_area)

    def get_volumes(self) -> None:
        self._need("tracks", "zones")
        self.volumes = zones.od_matrix(self.tracks, self.zones)

    def _places(self, name: str, find) -> None:
        self._need("phones", "points", "zones")
        if name in self.phones.columns:
            return
        own = find(self.points)
        self.phones = self.phones.join(own, "phone_id", "left")
        self.zones = zones.number_by_zone(self.zones, own, name)

    def get_home_place(self) -> None:
        self._places("domicile", places.home_places)

    def get_work_place(self) -> None:
        self._places("emploi", places.work_places)

    def inference_mode_logic_rules(self, rules: modes.Rules = modes.Rules()) -> None:
        self._need("tracks", "rail_network")
        self.tracks = modes.inference_mode_logic_rules(self.tracks, self.rail_network, rules)

    def inference_mode_hybrid(self, classifier=modes.best_score) -> None:
        self._need("tracks", "rail_network")
        own = modes.inference_mode_hybrid(self.tracks, self.rail_network, classifier)
        self.tracks = self.tracks.drop("mode_computed_hybrid").join(own, ["phone_id", "track_no"], "left")

    def mapmatching(self, **how) -> None:
        self._need("points", "road_links")
        self.tracks_mapmatched, self.tracks_unmatched, _ = matching.map_match(self.points, self.road_links, **how)

    def loaded_network(self) -> None:
        self._need("tracks_mapmatched", "road_links")
        loads = roads.link_loads(self.tracks_mapmatched, self.road_links).select(F.col("link").alias("index"), F.col("load").alias("tracks_count"))
        self.road_links = self.road_links.join(loads, "index", "left")
