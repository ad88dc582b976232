"""Estuary cross-sections and volumes along a channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial


def stations(waypoints: DataFrame) -> DataFrame:
    """waypoints (branch, seq, lon, lat) with s_m, dx_m (half of both neighbouring steps) and bearing along the channel."""
    w = Window.partitionBy("branch").orderBy("seq")
    lon0, lat0, lon1, lat1 = F.lag("lon").over(w), F.lag("lat").over(w), F.lead("lon").over(w), F.lead("lat").over(w)
    back = geo.haversine_m(lon0, lat0, F.col("lon"), F.col("lat"))
    on = geo.haversine_m(F.col("lon"), F.col("lat"), lon1, lat1)
    along = geo.bearing(F.coalesce(lon0, "lon"), F.coalesce(lat0, "lat"), F.coalesce(lon1, "lon"), F.coalesce(lat1, "lat"))
    out = waypoints.withColumns({"back": F.coalesce(back, F.lit(0.0)), "dx_m": (F.coalesce(back, F.lit(0.0)) + F.coalesce(on, F.lit(0.0))) / 2, "bearing": along})
    return out.withColumn("s_m", F.sum("back").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("back")


def cast_rays(points: DataFrame, cells: DataFrame, sample_m: float, max_half_width_m: float, radius_deg: float) -> DataFrame:
    """branch, seq, offset_m, depth: samples across the channel, left negative, each side until its first one on land or beyond the cells.

    Distances to cells are taken with longitudes shortened by the cosine of the mean latitude. The centre always counts,
    with depth 0 if it is dry.
    """
    n = int(max_half_width_m / sample_m) + 2
    lon_scale = cells.agg(F.cos(F.radians(F.avg("lat"))).alias("c")).first().c or 1.0
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    rays = points.select("branch", "seq", "lon", "lat", "bearing", side).select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).where("k > 0 or side = 1")
    lon, lat = geo.destination("lon", "lat", F.col("bearing") + F.col("side") * 90.0, F.col("k") * sample_m)
    at = rays.select("branch", "seq", "side", "k", lon.alias("lon"), lat.alias("lat")).withColumn("pid", F.concat_ws(":", "branch", "seq", "side", "k"))
    near = spatial.nearest_cell(at.select("pid", "lon", "lat"), cells.select("j", "i", "lon", "lat"), "pid", radius_deg, lon_scale).select("pid", "j", "i")
    depth = at.join(near, "pid", "left").join(cells.select("j", "i", "depth"), ["j", "i"], "left")
    ends = (F.col("depth").isNull() & (F.col("k") > 0)).cast("int")
    gone = F.sum(ends).over(Window.partitionBy("branch", "seq", "side").orderBy("k"))
    kept = depth.withColumn("gone", gone).where("gone = 0")
    return kept.select("branch", "seq", (F.col("side") * F.col("k") * sample_m).alias("offset_m"), F.greatest(F.coalesce("depth", F.lit(0.0)), F.lit(0.0)).alias("depth"))


def sections(samples: DataFrame) -> DataFrame:
    """branch, seq, width_m, left_m, right_m, area_m2 by the trapezoid rule."""
    w = Window.partitionBy("branch", "seq").orderBy("offset_m")
    part = (F.col("depth") + F.lag("depth").over(w)) / 2 * (F.col("offset_m") - F.lag("offset_m").over(w))
    s = samples.withColumn("part", F.coalesce(part, F.lit(0.0)))
    return s.groupBy("branch", "seq").agg((F.max("offset_m") - F.min("offset_m")).alias("width_m"), (-F.min("offset_m")).alias("left_m"), F.max("offset_m").alias("right_m"), F.sum("part").alias("area_m2"))


def compute(waypoints: DataFrame, cells: DataFrame, sample_m: float = 50.0, max_half_width_m: float = 10_000.0, radius_deg: float = 0.05) -> DataFrame:
    """One row per station: place, width, area, volume and volume from the mouth."""
    if not waypoints.groupBy("branch").count().where("count < 2").isEmpty():
        raise ValueError("a branch needs two waypoints or more")
    st = stations(waypoints)
    out = st.join(sections(cast_rays(st, cells, sample_m, max_half_width_m, radius_deg)), ["branch", "seq"], "left")
    out = out.withColumn("volume_m3", F.coalesce(F.col("area_m2") * F.col("dx_m"), F.lit(0.0)))
    w = Window.partitionBy("branch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumvol_m3", F.sum("volume_m3").over(w))


def branch_volumes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n_stations"), F.sum("volume_m3").alias("volume_m3"), F.max("s_m").alias("length_m"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The table of stations as text: kilometres, and millions of cubic metres."""
    shown = lambda form, c, by=1.0: F.format_string(form, F.col(c) / by)
    return rows.select(
        "branch", (F.row_number().over(Window.partitionBy("branch").orderBy("seq"))).alias("station"), shown("%.6f", "lon").alias("lon"), shown("%.6f", "lat").alias("lat"), shown("%.3f", "s_m", 1000.0).alias("s_km"),
        shown("%.1f", "width_m").alias("width_m"), shown("%.1f", "area_m2").alias("area_m2"), shown("%.1f", "dx_m").alias("dx_m"), shown("%.6f", "volume_m3", 1e6).alias("volume_Mm3"), shown("%.6f", "cumvol_m3", 1e6).alias("cumvol_Mm3"),
    )
