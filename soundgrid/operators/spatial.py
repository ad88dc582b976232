"""Joins in space: nearest cell, ranges by bins, points in polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points up to which the small side of a join is sent to all tasks.
SMALL_SIDE = 10_000


def _small(df: DataFrame) -> bool:
    return df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE


def nearest_cell(points: DataFrame, cells: DataFrame, key: str = "pid", max_deg: float | None = None, lon_scale: float = 1.0) -> DataFrame:
    """points with j, i and d2 of the nearest cell by squared degrees; ties go to the first in row-major order.

    With max_deg, points meet the cells of bins of that size and farther points get nulls. Without it a small set of points
    (its size is checked) meets all cells; for more points, rings of doubling bins are searched.
    """
    if max_deg is not None:
        return _nearest_in_bins(points, cells, max_deg, lon_scale)
    if not _small(points):
        return _nearest_by_rings(points, cells, key, lon_scale)
    p = points.withColumnsRenamed({"lon": "p_lon", "lat": "p_lat"})
    d2 = F.pow((F.col("lon") - F.col("p_lon")) * lon_scale, 2) + F.pow(F.col("lat") - F.col("p_lat"), 2)
    best = cells.select("j", "i", "lon", "lat").join(F.broadcast(p.select(key, "p_lon", "p_lat"))).withColumn("d2", d2)
    best = best.groupBy(key).agg(F.min(F.struct("d2", "j", "i")).alias("m")).select(key, F.col("m.j").alias("j"), F.col("m.i").alias("i"), F.col("m.d2").alias("d2"))
    return points.join(best, key, "left")


def _nearest_in_bins(points: DataFrame, cells: DataFrame, max_deg: float, lon_scale: float) -> DataFrame:
    """Each distinct place of points meets one row: the list of the cells in the bins around it, so no pairs are sorted by point."""
    bins = {"_bx": F.floor(F.col("lon") * lon_scale / max_deg), "_by": F.floor(F.col("lat") / max_deg)}
    own = cells.withColumns(bins).groupBy("_bx", "_by").agg(F.collect_list(F.struct("lon", "lat", "j", "i")).alias("c"))
    to = F.explode(F.array(*[F.struct((F.col("_bx") + a).alias("_bx"), (F.col("_by") + b).alias("_by")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = own.select("c", to.alias("t")).groupBy("t._bx", "t._by").agg(F.flatten(F.collect_list("c")).alias("_cells"))
    d2 = lambda c: F.pow((c["lon"] - F.col("lon")) * lon_scale, F.lit(2)) + F.pow(c["lat"] - F.col("lat"), F.lit(2))
    near = F.transform("_cells", lambda c: F.struct(d2(c).alias("d2"), c["j"].alias("j"), c["i"].alias("i")))
    best = F.array_min(F.filter(near, lambda x: x["d2"] <= max_deg * max_deg))
    places = points.select("lon", "lat").distinct().withColumns(bins).join(around, ["_bx", "_by"]).select("lon", "lat", best.alias("_m"))
    out = points.join(places, ["lon", "lat"], "left")
    return out.select(*points.columns, *[F.col(f"_m.{c}").alias(c) for c in ("j", "i", "d2")])


def _nearest_by_rings(points: DataFrame, cells: DataFrame, key: str, lon_scale: float) -> DataFrame:
    span = cells.agg((F.max("lat") - F.min("lat")).alias("h"), (F.max("lon") - F.min("lon")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    radius = 2 * max((span.h * span.w * lon_scale / max(span.n, 1)) ** 0.5, 1e-9)
    left, found = points, None
    while True:
        got = nearest_cell(left, cells, key, radius, lon_scale)
        hit = got.where("d2 is not null")
        found = hit if found is None else found.unionByName(hit)
        left = got.where("d2 is null").select(*points.columns)
        radius *= 4
        if _small(left):
            return found.unionByName(nearest_cell(left, cells, key, None, lon_scale))


def range_join(windows: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Pairs of windows (lon0, lon1, lat0, lat1, inclusive) and cells (lon, lat) inside them, by bins of a size."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    w = windows.withColumn("bx", bins("lon0", "lon1")).withColumn("by", bins("lat0", "lat1"))
    c = cells.withColumns({"bx": F.floor(F.col("lon") / size), "by": F.floor(F.col("lat") / size)})
    return w.join(c, ["bx", "by"]).where("lon between lon0 and lon1 and lat between lat0 and lat1").drop("bx", "by")


def in_polygons(points: DataFrame, vertices: DataFrame, key: str = "pid") -> DataFrame:
    """pid, poly: points inside polygons, given as vertices (poly, seq, vlon, vlat), by counting crossings.

    Edges are sent to all tasks only if they are few; a longer list is joined by bins of latitude.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("poly").orderBy("seq")
    whole = Window.partitionBy("poly").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = vertices.select("poly", F.col("vlon").alias("x1"), F.col("vlat").alias("y1"), F.coalesce(F.lead("vlon").over(w), F.first("vlon").over(whole)).alias("x2"), F.coalesce(F.lead("vlat").over(w), F.first("vlat").over(whole)).alias("y2"))
    p = points.select(key, "lon", "lat")
    if _small(e):
        pairs = p.join(F.broadcast(e))
    else:
        size = 0.25
        e = e.withColumn("by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))
        pairs = p.withColumn("by", F.floor(F.col("lat") / size)).join(e, "by")
    crossing = "(y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1"
    return pairs.where(F.expr(crossing)).groupBy(key, "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "poly")
