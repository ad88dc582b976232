"""Target grids as cell tables: j, i, centre and four corners."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo


def mesh(spark: SparkSession, ny: int, nx: int, height: int = 64, rows: int = 1 << 21) -> DataFrame:
    """j, i of all cells, in strips so many rows high that are gone through column by column: coordinates repeat close together, so files are small. A task makes so many rows at most."""
    n, strip = ny * nx, height * nx
    high = f"least({height}, {ny} - id div {strip} * {height})"
    cells = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // rows)))
    return cells.select(F.expr(f"cast(id div {strip} * {height} + id % {strip} % {high} as int)").alias("j"), F.expr(f"cast(id % {strip} div {high} as int)").alias("i"))


def turned_mesh(spark: SparkSession, ny: int, nx: int, across: float, along: float, height: int = 80, strips: int = 9, width: int = 800) -> DataFrame:
    """j, i of all cells of a turned grid, a task for each block: row r and column c are moved (around the grid's edges) to j = r - along * c, i = c + across * j.

    So blocks are upright in longitude and latitude, where values come back most. Steps of 1/6000 degree and less, in six digits, fill a Parquet
    dictionary of 131,072 numbers with a block and about 15,000 with its first 20,000 cells, by which the writer decides to keep it."""
    high, block = height * strips, height * strips * width
    wide = -(-nx // width)
    blocks = wide * -(-ny // high)
    at = spark.range(0, blocks * block, 1, blocks).select(
        F.expr(f"id div {block} div {wide} * {high} + id % {block} div {height * width} * {height} + id % {height} as r"),
        F.expr(f"id div {block} % {wide} * {width} + id % {height * width} div {height} as c"),
    )
    at = at.where((F.col("r") < ny) & (F.col("c") < nx))
    j = F.pmod(F.col("r") - F.floor(F.col("c") * along), F.lit(ny))
    return at.select(j.alias("j"), "c").select(F.col("j").cast("int").alias("j"), F.pmod(F.col("c") + F.floor(F.col("j") * across), F.lit(nx)).cast("int").alias("i"))


def _with_corners(mesh: DataFrame, at) -> DataFrame:
    """at(dj, di) gives lon, lat of a cell's corner; the centre is the mean of the four."""
    cols, lons, lats = {}, [], []
    for dj, di in ((0, 0), (0, 1), (1, 0), (1, 1)):
        lon, lat = at(F.col("j") + dj, F.col("i") + di)
        cols |= {f"lon{dj}{di}": lon, f"lat{dj}{di}": lat}
        lons.append(F.col(f"lon{dj}{di}"))
        lats.append(F.col(f"lat{dj}{di}"))
    mean = lambda c: (c[0] + c[1] + c[2] + c[3]) / 4.0
    return mesh.withColumns(cols).withColumns({"lon": mean(lons), "lat": mean(lats)})


def _sizes(lo: float, hi: float, d: float, interfaces: bool) -> tuple[int, float]:
    """Cells, and where their corners start."""
    n = round((hi - lo) / d)
    return (n, lo) if interfaces else (n + 1, lo - d / 2)


def spherical(spark: SparkSession, lon_min: float, lon_max: float, lat_min: float, lat_max: float, dlon: float, dlat: float, rotation: float = 0.0, interfaces: bool = False) -> DataFrame:
    (nx, x0), (ny, y0) = _sizes(lon_min, lon_max, dlon, interfaces), _sizes(lat_min, lat_max, dlat, interfaces)
    lon0, lat0 = (lon_min + lon_max) / 2, (lat_min + lat_max) / 2

    def at(j: Column, i: Column) -> tuple[Column, Column]:
        lon, lat = x0 + i * dlon, y0 + j * dlat
        return geo.rotate_plane(lon, lat, lon0, lat0, rotation) if rotation else (lon, lat)

    a, k = math.radians(rotation), math.cos(math.radians(lat0)) * dlon / dlat
    cells = turned_mesh(spark, ny, nx, math.tan(a) / k, k * math.sin(a) * math.cos(a)) if rotation and abs(math.sin(a)) < 0.71 else mesh(spark, ny, nx)
    return _with_corners(cells, at)


def cartesian(spark: SparkSession, x_min: float, x_max: float, y_min: float, y_max: float, dx: float, dy: float, rotation: float = 0.0, crs: str | None = None) -> DataFrame:
    """A planar grid; crs EPSG:326zz or EPSG:327zz (UTM) turns metres into degrees, None keeps the plane."""
    nx, ny, xc, yc, a = round((x_max - x_min) / dx), round((y_max - y_min) / dy), (x_min + x_max) / 2, (y_min + y_max) / 2, math.radians(rotation)

    def at(j: Column, i: Column) -> tuple[Column, Column]:
        u, v = x_min + i * dx - xc, y_min + j * dy - yc
        x, y = F.lit(xc) + u * math.cos(a) - v * math.sin(a), F.lit(yc) + u * math.sin(a) + v * math.cos(a)
        return utm_inverse(x, y, crs) if crs else (x, y)

    return _with_corners(mesh(spark, ny, nx), at)


def utm_inverse(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Geographic degrees of UTM metres on WGS84 (series in the third flattening)."""
    code = crs.upper().removeprefix("EPSG:")
    if not (len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60):
        raise ValueError(f"unsupported CRS {crs}: only UTM zones EPSG:326zz and EPSG:327zz")
    n = 1 / (2 * 298.257223563 - 1)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (y - (10_000_000.0 if code[:3] == "327" else 0.0)) / (0.9996 * radius)
    eta = (x - 500_000.0) / (0.9996 * radius)
    xi1, eta1 = xi, eta
    for k, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(geo.clamp(F.sin(xi1) / F.cosh(eta1), -1.0, 1.0))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (int(code[3:]) * 6 - 183.0), F.degrees(lat)


def rotated_pole(spark: SparkSession, pole_lon: float, pole_lat: float, rlon_min: float, rlon_max: float, rlat_min: float, rlat_max: float, drot: float, axis_rotation: float = 0.0) -> DataFrame:
    nx, ny = round((rlon_max - rlon_min) / drot), round((rlat_max - rlat_min) / drot)
    xc, yc, a = (rlon_min + rlon_max) / 2, (rlat_min + rlat_max) / 2, math.radians(axis_rotation)

    def at(j: Column, i: Column) -> tuple[Column, Column]:
        u, v = rlon_min + i * drot - xc, rlat_min + j * drot - yc
        if not a:  # sines of a row's or column's angle serve several corners
            return geo.unrotate_pole(F.lit(xc) + u, F.lit(yc) + v, pole_lon, pole_lat)
        return geo.unrotate_pole(F.lit(xc) + u * math.cos(a) - v * math.sin(a), F.lit(yc) + u * math.sin(a) + v * math.cos(a), pole_lon, pole_lat)

    return _with_corners(mesh(spark, ny, nx, height=24), at)


def supergrid(points: DataFrame) -> DataFrame:
    """j, i, kind (T, U, V or Q), lon, lat of supergrid points (sj, si, lon, lat); both dimensions must be odd."""
    top = points.agg(F.max("sj").alias("j"), F.max("si").alias("i")).first()
    if top.j is None or top.j % 2 or top.i % 2:
        raise ValueError("a supergrid has odd dimensions, (2 ny + 1) x (2 nx + 1)")
    kind = F.expr("case when sj % 2 = 1 and si % 2 = 1 then 'T' when sj % 2 = 1 then 'U' when si % 2 = 1 then 'V' else 'Q' end")
    return points.select(F.expr("cast(sj div 2 as int)").alias("j"), F.expr("cast(si div 2 as int)").alias("i"), kind.alias("kind"), "lon", "lat")


def curvilinear(points: DataFrame) -> DataFrame:
    """The cells of a supergrid's points (sj, si, lon, lat): j, i, centre (its T point) and four corners (its Q points)."""
    split = supergrid(points)
    out = split.where("kind = 'T'").select("j", "i", "lon", "lat")
    q = split.where("kind = 'Q'")
    for dj, di in ((0, 0), (0, 1), (1, 0), (1, 1)):
        corner = q.select((F.col("j") - dj).alias("j"), (F.col("i") - di).alias("i"), F.col("lon").alias(f"lon{dj}{di}"), F.col("lat").alias(f"lat{dj}{di}"))
        out = out.join(corner, ["j", "i"])
    return out


def axis_angle(grid: DataFrame) -> DataFrame:
    """grid with the local angle of its i axis."""
    dlat = F.col("lat01") - F.col("lat00")
    dlon = geo.wrap_lon(F.col("lon01") - F.col("lon00"))
    return grid.withColumn("angle", F.degrees(F.atan2(dlat, dlon * F.cos(F.radians("lat")))))


def cell_sizes(cells: DataFrame) -> DataFrame:
    """cells with dlon and dlat: central differences of centres inside, one-sided at edges."""
    def step(column: str, across: str, along: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        before, after = F.lag(column).over(w), F.lead(column).over(w)
        return F.abs(F.when(before.isNull(), after - F.col(column)).when(after.isNull(), F.col(column) - before).otherwise((after - before) / 2.0))

    return cells.withColumns({"dlon": step("lon", "j", "i"), "dlat": step("lat", "i", "j")})


def equidistant(lat_min: float, lat_max: float, dlon: float | None, dlat: float | None) -> tuple[float, float]:
    """dlon, dlat: a missing one is set so that cells are square at the middle latitude."""
    k = math.cos(math.radians((lat_min + lat_max) / 2))
    if dlon is None and dlat is None:
        raise ValueError("one of dlon and dlat is needed")
    return (dlon if dlon is not None else round(dlat / k, 6)), (dlat if dlat is not None else round(dlon * k, 6))


def perimeter(grid: DataFrame) -> DataFrame:
    """seq, lon, lat of the edge cells' centres, around the grid from its first cell."""
    top = grid.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    ny, nx = top.j, top.i
    seq = F.when(F.col("j") == 0, F.col("i")).when(F.col("i") == nx, nx + F.col("j")).when(F.col("j") == ny, 2 * nx + ny - F.col("i")).otherwise(2 * (nx + ny) - F.col("j"))
    return grid.where((F.col("j") == 0) | (F.col("j") == ny) | (F.col("i") == 0) | (F.col("i") == nx)).select(seq.alias("seq"), "lon", "lat")


def resolution(cells: DataFrame) -> DataFrame:
    """degrees: the smaller of the mean steps along the middle row and the middle column."""
    top = cells.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    ends = lambda c, n: F.abs(F.max_by(c, n) - F.min_by(c, n)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    row = cells.where(F.col("j") == (top.j + 1) // 2).agg(ends("lon", "i").alias("x"))
    column = cells.where(F.col("i") == (top.i + 1) // 2).agg(ends("lat", "j").alias("y"))
    return row.crossJoin(column).select(F.least("x", "y").alias("degrees"))  # one row each


def summary(cells: DataFrame) -> DataFrame:
    """nx, ny, bounds, and the cell size in km along both axes at the middle latitude."""
    one = cells.agg((F.max("i") + 1).alias("nx"), (F.max("j") + 1).alias("ny"), *[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    km = lambda c, n: (F.col(f"{c}_max") - F.col(f"{c}_min")) / F.nullif(F.col(n) - 1, F.lit(0)) * geo.KM_PER_DEG
    middle = F.cos(F.radians((F.col("lat_min") + F.col("lat_max")) / 2))
    return one.withColumns({"dx_km": km("lon", "nx") * middle, "dy_km": km("lat", "ny")}).withColumn("square", F.abs(F.col("dx_km") - F.col("dy_km")) < 0.05 * F.col("dy_km"))


def extents(x: float, y: float, width_km: float, height_km: float) -> dict:
    """x_min, x_max, y_min, y_max in metres around a projected centre."""
    return {"x_min": x - width_km * 500, "x_max": x + width_km * 500, "y_min": y - height_km * 500, "y_max": y + height_km * 500}


def build(spark: SparkSession, grid: dict) -> DataFrame:
    """The grid of a configuration's grid section."""
    kind = grid.get("type", "spherical")
    need = lambda *names: [grid[n] if n in grid else _missing(n) for n in names]
    if kind == "spherical":
        lon_min, lon_max, lat_min, lat_max = need("lon_min", "lon_max", "lat_min", "lat_max")
        dlon, dlat = grid.get("dlon"), grid.get("dlat")
        dlon, dlat = equidistant(lat_min, lat_max, dlon, dlat) if grid.get("equidistant", True) or None in (dlon, dlat) else (dlon, dlat)
        return spherical(spark, lon_min, lon_max, lat_min, lat_max, dlon, dlat, grid.get("rotation", 0.0), grid.get("interfaces", False))
    if kind == "cartesian":
        return cartesian(spark, *need("x_min", "x_max", "y_min", "y_max", "dx", "dy"), grid.get("rotation", 0.0), grid.get("crs"))
    if kind == "rotated_pole":
        pole = geo.pole_from_center(grid["lon_center"], grid["lat_center"]) if "lon_center" in grid else tuple(need("pole_lon", "pole_lat"))
        return rotated_pole(spark, *pole, *need("rlon_min", "rlon_max", "rlat_min", "rlat_max", "drot"), grid.get("axis_rotation", 0.0))
    if kind in ("supergrid", "curvilinear"):
        points = spark.read.parquet(need("file")[0])
        return curvilinear(points.withColumnsRenamed({grid.get("x_var", "lon"): "lon", grid.get("y_var", "lat"): "lat"}))
    raise ValueError(f"unknown grid type {kind}")


def _missing(name: str):
    raise ValueError(f"grid: {name} is needed")
