"""Fine raster to coarse cells: clipping, conservative averages, percentiles, masks, faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def clip(fine: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float, pad: float = 0.0) -> DataFrame:
    """Cells of the padded box, edges included; literal bounds reach the Parquet scan."""
    return fine.where(F.col("lon").between(lon_min - pad, lon_max + pad) & F.col("lat").between(lat_min - pad, lat_max + pad))


def from_elevation(raster: DataFrame) -> DataFrame:
    """depth (positive down, null on land) and land of an elevation raster."""
    land = F.col("elevation") >= 0
    return raster.withColumns({"land": land, "depth": F.when(~land, -F.col("elevation"))}).drop("elevation")


def area_weighted(fine: DataFrame, dlon: float, dlat: float, lon0: float, lat0: float, fine_dlon: float, fine_dlat: float) -> DataFrame:
    """j, i, wet_fraction, depth of axis-aligned coarse cells that start at lon0, lat0: first-order conservative.

    Each fine cell meets the coarse cells it overlaps by integer bins on both axes, with the weight of the overlap's
    area on the sphere over the coarse cell's area; sums are partial before the shuffle.
    """
    x0, x1 = F.col("lon") - fine_dlon / 2, F.col("lon") + fine_dlon / 2
    y0, y1 = F.col("lat") - fine_dlat / 2, F.col("lat") + fine_dlat / 2
    bins = lambda a, b, start, d: F.sequence(F.floor((a - start) / d + 1e-9).cast("int"), F.floor((b - start) / d - 1e-9).cast("int"))
    hit = fine.withColumn("i", F.explode(bins(x0, x1, lon0, dlon))).withColumn("j", F.explode(bins(y0, y1, lat0, dlat)))
    w0, w1 = lon0 + F.col("i") * dlon, lon0 + (F.col("i") + 1) * dlon
    s0, s1 = lat0 + F.col("j") * dlat, lat0 + (F.col("j") + 1) * dlat
    sin = lambda a: F.sin(F.radians(a))
    part = (F.least(x1, w1) - F.greatest(x0, w0)) * (sin(F.least(y1, s1)) - sin(F.greatest(y0, s0)))
    weight = part / (dlon * (sin(s1) - sin(s0)))
    wet = F.when(F.col("depth").isNotNull(), F.col("w")).otherwise(0.0)
    out = hit.withColumn("w", weight).groupBy("j", "i").agg(F.sum(wet).alias("wet_fraction"), F.sum(F.col("w") * F.coalesce("depth", F.lit(0.0))).alias("num"))
    return out.select("j", "i", "wet_fraction", F.try_divide("num", "wet_fraction").alias("depth"))


def blocks(fine: DataFrame, factor: int) -> DataFrame:
    """j, i, wet_fraction, depth of coarse cells of factor x factor equal fine cells."""
    keys = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in ("j", "i")]
    return fine.groupBy(*keys).agg(F.avg(F.when(F.col("depth").isNotNull(), 1.0).otherwise(0.0)).alias("wet_fraction"), F.avg("depth").alias("depth"))


def mask_and_clamp(coarse: DataFrame, min_wet_fraction: float = 0.0, min_depth: float = 0.0) -> DataFrame:
    """coarse with mask; land where too little is wet, wet depths at least min_depth."""
    wet = (F.col("wet_fraction") > 0) & (F.col("wet_fraction") >= min_wet_fraction) & F.col("depth").isNotNull()
    return coarse.withColumns({"mask": F.when(wet, 1).otherwise(0).cast("tinyint"), "depth": F.when(wet, F.greatest("depth", F.lit(float(min_depth))))})


def percentile_pass(coarse: DataFrame, fine: DataFrame, factor: int, percent: float, boxes: list[tuple[float, float, float, float]], min_wet_fraction: float = 0.0) -> DataFrame:
    """coarse with a percentile of the fine depths instead of the mean, in wet cells whose centre is in a box.

    The boxes reach the fine scan as bounds before anything is grouped.
    """
    inside = lambda lon, lat, pad: F.exists(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("wesn", b, strict=True)]) for b in boxes]), lambda b: (lon >= b["w"] - pad) & (lon <= b["e"] + pad) & (lat >= b["s"] - pad) & (lat <= b["n"] + pad))
    keys = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in ("j", "i")]
    chosen = coarse.where((F.col("mask") == 1) & (F.col("wet_fraction") >= min_wet_fraction) & inside(F.col("lon"), F.col("lat"), 0.0)).select("j", "i")
    fine_in = fine.where(F.col("depth").isNotNull() & inside(F.col("lon"), F.col("lat"), 1.0))
    p = fine_in.groupBy(*keys).agg(F.percentile("depth", percent / 100.0).alias("p")).join(chosen, ["j", "i"])
    return coarse.join(p, ["j", "i"], "left").withColumn("depth", F.coalesce("p", "depth")).drop("p")


def _next(column: str, east: bool):
    return F.lead(column).over(Window.partitionBy("j").orderBy("i") if east else Window.partitionBy("i").orderBy("j"))


def cgrid_faces(cells: DataFrame) -> DataFrame:
    """cells with depth_u and depth_v: the shallower of both sides, null next to land; the last face takes its own cell."""
    def face(east: bool):
        there, other = _next("j", east), _next("depth", east)
        return F.when(there.isNull(), F.col("depth")).when(other.isNotNull() & F.col("depth").isNotNull(), F.least("depth", other))

    return cells.withColumns({"depth_u": face(True), "depth_v": face(False)})


def rx0(cells: DataFrame) -> DataFrame:
    """cells with rx0_u, rx0_v (towards the next cell; 0 at land and edges) and rx0, the largest of a cell's four faces."""
    def slope(east: bool):
        other = _next("depth", east)
        return F.coalesce(F.try_divide(F.abs(F.col("depth") - other), F.col("depth") + other), F.lit(0.0))

    out = cells.withColumns({"rx0_u": slope(True), "rx0_v": slope(False)})
    west = F.lag("rx0_u").over(Window.partitionBy("j").orderBy("i"))
    south = F.lag("rx0_v").over(Window.partitionBy("i").orderBy("j"))
    return out.withColumn("rx0", F.greatest("rx0_u", "rx0_v", F.coalesce(west, F.lit(0.0)), F.coalesce(south, F.lit(0.0))))


def summary(cells: DataFrame) -> DataFrame:
    """One row: cells, wet cells, least, largest and mean depth, least wet fraction of wet cells."""
    wet = F.col("mask") == 1
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(wet).alias("n_wet"), F.min(F.when(wet, F.col("depth"))).alias("min_depth"), F.max(F.when(wet, F.col("depth"))).alias("max_depth"), F.avg(F.when(wet, F.col("depth"))).alias("mean_depth"), F.min(F.when(wet, F.col("wet_fraction"))).alias("min_wet_fraction"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """j, i, code (0 land, 1 both wet, 2 only a, 3 only b), difference where both are wet."""
    x, y = a.select("j", "i", F.col("mask").alias("m1"), F.col("depth").alias("d1")), b.select("j", "i", F.col("mask").alias("m2"), F.col("depth").alias("d2"))
    code = F.expr("case when m1 = 1 and m2 = 1 then 1 when m1 = 1 then 2 when m2 = 1 then 3 else 0 end")
    return x.join(y, ["j", "i"]).select("j", "i", code.alias("code"), F.when((F.col("m1") == 1) & (F.col("m2") == 1), F.col("d1") - F.col("d2")).alias("difference"))


def difference_stats(difference: DataFrame) -> DataFrame:
    d = F.col("difference")
    return difference.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.sqrt(F.avg(d * d)).alias("rmse"), F.greatest(F.percentile(F.abs(d), 0.99), F.lit(0.1)).alias("vmax"))


def sphere_cells(cells: DataFrame, lat_min: float, lat_max: float) -> DataFrame:
    return cells.where(F.col("lat").between(lat_min, lat_max)).withColumn("width_km", F.cos(F.radians("lat")) * geo.KM_PER_DEG)
