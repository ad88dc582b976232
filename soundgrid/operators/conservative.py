"""First-order conservative regridding of a regular raster onto cells of any four corners.

Overlaps are taken in the plane of longitude and sine of latitude, where areas are those of the sphere. A raster's cell is
a rectangle there, and a target cell's sides are straight lines (for cells of a few degrees, great circles within their
width). The overlap of a polygon with a rectangle is a sum over the polygon's sides: of the side's height above the
rectangle's foot, held between foot and top, over the part of the side that lies in the rectangle's width. That has a
closed form, so weights are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import shared_dir, written

#: Corners in the order in which they bound a cell.
CORNERS = ("00", "01", "11", "10")


def with_overlap(df: DataFrame, corners: list[tuple[str, str]], x0: str, x1: str, y0: str, y1: str, name: str = "overlap") -> DataFrame:
    """df with the area of a polygon without crossings in the rectangle from x0, y0 to x1, y1; all are names of columns.

    Done in three steps of columns, each of which names those before it once or few times, so that the generated code stays small.
    """
    c = F.col
    sides = list(enumerate(zip(corners, corners[1:] + corners[:1], strict=True)))
    ends = {f"_{e}{k}": F.least(F.greatest(c(x), c(x0)), c(x1)) for k, ((xa, _), (xb, _)) in sides for e, x in (("u", xa), ("v", xb))}
    slopes = {f"_m{k}": F.coalesce(F.try_divide(c(yb) - c(ya), c(xb) - c(xa)), F.lit(0.0)) for k, ((xa, ya), (xb, yb)) in sides}
    heights = {f"_{h}{k}": c(ya) + c(f"_m{k}") * (c(f"_{e}{k}") - c(xa)) - c(y0) for k, ((xa, ya), _) in sides for h, e in (("s", "u"), ("t", "v"))}
    top, total = c(y1) - c(y0), F.lit(0.0)
    filled = lambda z: F.pow(F.least(F.greatest(z, F.lit(0.0)), top), 2) / 2 + top * F.greatest(z - top, F.lit(0.0))
    for k, _ in sides:
        s, t = c(f"_s{k}"), c(f"_t{k}")
        level = F.least(F.greatest((s + t) / 2, F.lit(0.0)), top)
        total = total + F.when(F.abs(t - s) < 1e-12, level).otherwise(F.try_divide(filled(t) - filled(s), t - s)) * (c(f"_v{k}") - c(f"_u{k}"))
    return df.withColumns(ends | slopes).withColumns(heights).withColumn(name, F.abs(total)).drop(*ends, *slopes, *heights)


def area(corners: list[tuple[Column, Column]]) -> Column:
    """Area of a polygon without crossings."""
    total = F.lit(0.0)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
        total = total + xa * yb - xb * ya
    return F.abs(total) / 2


def weights(fine: DataFrame, grid: DataFrame, fine_dlon: float, fine_dlat: float, *keep: str) -> DataFrame:
    """j, i, sj, si, w: the part of each target cell that lies in each raster cell; and columns of the raster to keep.

    fine has j, i, lon, lat (centres of fine_dlon by fine_dlat degrees); grid has j, i and corners lon00 to lat11. Cells
    meet in bins of longitude and latitude about as large as a target cell: a raster cell is in the bin of its centre, a
    target cell in all that it can reach. Longitudes of a target cell follow its first corner, on the raster's turn of
    the circle. Cells with a null corner, or without area, have no weights.
    """
    sine = lambda y: F.sin(F.radians(y))
    span = fine.agg(F.min("lon").alias("lo"), F.max("lon").alias("hi")).first()
    middle = ((span.lo or 0.0) + (span.hi or 0.0)) / 2
    turn = 360.0 * F.round((F.lit(middle) - F.col("lon00")) / 360.0)
    q = grid.select("j", "i", *[(F.col("lon00") + geo.wrap_lon(F.col(f"lon{c}") - F.col("lon00")) + turn).alias(f"x{c}") for c in CORNERS], *[F.col(f"lat{c}").alias(f"y{c}") for c in CORNERS], *[sine(f"lat{c}").alias(f"s{c}") for c in CORNERS])
    q = q.withColumns({n: f(*[f"{a}{c}" for c in CORNERS]) for a in "xy" for n, f in ((f"{a}lo", F.least), (f"{a}hi", F.greatest))})
    q = q.withColumn("size", area([(F.col(f"x{c}"), F.col(f"s{c}")) for c in CORNERS]))
    q = written(q, "corners").dropna()  # the corners' expressions are long, and are used many times from here on
    size = q.agg(F.max(F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))).alias("s")).first().s
    size = max(size or 0.0, fine_dlon, fine_dlat)
    bins = lambda a, d: F.explode(F.sequence(F.floor((F.col(f"{a}lo") - d / 2) / size), F.floor((F.col(f"{a}hi") + d / 2) / size)))
    q = q.withColumn("bx", bins("x", fine_dlon)).withColumn("by", bins("y", fine_dlat))
    f = fine.select(F.col("j").alias("sj"), F.col("i").alias("si"), *keep, "lon", "lat", F.floor(F.col("lon") / size).alias("bx"), F.floor(F.col("lat") / size).alias("by"))
    lon, lat = F.col("lon"), F.col("lat")
    f = f.select("*", (lon - fine_dlon / 2).alias("x0"), (lon + fine_dlon / 2).alias("x1"), sine(lat - fine_dlat / 2).alias("s0"), sine(lat + fine_dlat / 2).alias("s1"))
    near = (F.col("x1") > F.col("xlo")) & (F.col("x0") < F.col("xhi")) & (lat + fine_dlat / 2 > F.col("ylo")) & (lat - fine_dlat / 2 < F.col("yhi"))
    corners = [(f"x{c}", f"s{c}") for c in CORNERS]
    pairs = with_overlap(q.join(f, ["bx", "by"]).where(near), corners, "x0", "x1", "s0", "s1")
    return pairs.select("j", "i", "sj", "si", *keep, F.try_divide("overlap", "size").alias("w")).where("w > 1e-12")


def _means(pairs: DataFrame, grid: DataFrame) -> DataFrame:
    wet = F.when(F.col("depth").isNotNull(), F.col("w")).otherwise(0.0)
    sums = pairs.groupBy("j", "i").agg(F.sum(wet).alias("wet_fraction"), F.sum(F.col("w") * F.coalesce("depth", F.lit(0.0))).alias("total"))
    # written, or the join's inference of filters goes through all that the overlaps are made of
    sums = written(sums.select("j", "i", "wet_fraction", F.try_divide("total", "wet_fraction").alias("depth")), "means")
    return grid.join(sums, ["j", "i"], "left")


def apply(weights: DataFrame, fine: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with wet_fraction and depth (mean of the wet part); both null where no raster cell reaches a target cell."""
    return _means(weights.join(fine.select(F.col("j").alias("sj"), F.col("i").alias("si"), "depth"), ["sj", "si"]), grid)


def regrid(fine: DataFrame, grid: DataFrame, fine_dlon: float, fine_dlat: float) -> DataFrame:
    """As apply() of weights(), in one go: depths come along with the pairs, and are summed before they are shuffled."""
    grid = written(grid, "grid")  # a generated grid's corners are long expressions, which take the optimizer long in joins
    return _means(weights(fine, grid, fine_dlon, fine_dlat, "depth"), grid)


def grid_key(cells: DataFrame) -> str:
    """A name for a table of cells: 12 digits of the md5 of its rows' number and its extents to five decimals."""
    ends = [F.format_string("%.5f", f(c)) for c in ("lon", "lat") for f in (F.min, F.max)]
    one = F.concat_ws("_", F.count(F.lit(1)).cast("string"), (F.max("j") + 1).cast("string"), (F.max("i") + 1).cast("string"), *ends)
    return cells.agg(F.substring(F.md5(one), 1, 12).alias("key")).first().key


def kept_weights(spark: SparkSession, fine: DataFrame, grid: DataFrame, fine_dlon: float, fine_dlat: float, folder: str | None = None) -> DataFrame:
    """weights() from a folder's table for the two grids if it is there; written there first if not. Depths may have changed since, centres may not."""
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/weights_conservative_{grid_key(fine)}_{grid_key(grid)}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        weights(fine, grid, fine_dlon, fine_dlat).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
