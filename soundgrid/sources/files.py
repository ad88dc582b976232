"""Rasters and point lists in files: what is read and what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The usual names of depth and coordinates in outer models' files.
DEPTH = ("depth", "H", "h", "deptho")
LON = ("lon", "longitude", "nav_lon", "x_T", "xt_ocean", "geolon_t")
LAT = ("lat", "latitude", "nav_lat", "y_T", "yt_ocean", "geolat_t")


def _one_of(df: DataFrame, names: tuple[str, ...]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)} is in {df.columns}")


def elevation(spark: SparkSession, path: str, lon: tuple[float, float], lat: tuple[float, float], pad: float = 1.0, column: str = "elevation") -> DataFrame:
    """lon, lat, depth (null on land), land of a raster of elevations, clipped to the padded bounds at the scan."""
    raw = spark.read.parquet(path)
    x, y = _one_of(raw, ("lon", "longitude", "x")), _one_of(raw, ("lat", "latitude", "y"))
    raw = raw.where(F.col(x).between(lon[0] - pad, lon[1] + pad) & F.col(y).between(lat[0] - pad, lat[1] + pad))
    depth = -F.col(column).cast("double")
    return raw.select(F.col(x).alias("lon"), F.col(y).alias("lat"), F.when(depth > 0, depth).alias("depth"), F.coalesce(depth <= 0, F.lit(True)).alias("land"))


def outer_model(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """lon, lat, depth of the wet points of another model, whichever sign its depths have; column names them if no usual name does."""
    raw = spark.read.parquet(path)
    names = (_one_of(raw, LON), _one_of(raw, LAT), _one_of(raw, (column,) if column else DEPTH))
    points = raw.select(*[F.col(name).cast("double").alias(c) for name, c in zip(names, ("lon", "lat", "depth"), strict=True)])
    middle = points.agg(F.expr("approx_percentile(depth, 0.5)").alias("m")).first().m
    sign = -1.0 if middle is not None and middle < 0 else 1.0
    return points.withColumn("depth", F.col("depth") * sign).where("depth > 0")


def boundary_points(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat of every row whose first two fields are numbers."""
    fields = F.split("value", ",")
    rows = spark.read.text(path).select(F.expr("try_cast(trim(get(split(value, ','), 0)) as double)").alias("lon"), F.expr("try_cast(trim(get(split(value, ','), 1)) as double)").alias("lat"), F.size(fields).alias("n"))
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat")


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells as Parquet, in ranges of rows, so that a box is read from few files."""
    cells.repartitionByRange("j", "i").sortWithinPartitions("j", "i").write.mode("overwrite").parquet(path)


def check_shape(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """The cells, if they are a grid of ny by nx; else ValueError."""
    got = cells.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    if (got.j, got.i) != (ny - 1, nx - 1):
        raise ValueError(f"cells of {(got.j or -1) + 1} x {(got.i or -1) + 1}, not {ny} x {nx}")
    return cells


def depth_raster(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """lon, lat, depth of a written raster: the named column, else depth, depth_fixes, depth_raw, else the first with depth in its name."""
    raw = spark.read.parquet(path)
    named = [c for c in raw.columns if "depth" in c.lower()]
    choice = column or next((c for c in ("depth", "depth_fixes", "depth_raw") if c in raw.columns), named[0] if named else None)
    if choice is None:
        raise ValueError(f"no depth column in {raw.columns}")
    keys = [c for c in ("j", "i") if c in raw.columns]
    return raw.select(*keys, F.col(_one_of(raw, LON)).alias("lon"), F.col(_one_of(raw, LAT)).alias("lat"), F.col(choice).cast("double").alias("depth"))


def write_csv(rows: DataFrame, path: str) -> bool:
    """Rows as CSV files with a header; nothing is written, and False returned, if there are none."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True
