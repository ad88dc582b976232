"""The grid operators' queries on the raster derived from the driver's tables, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import basins, boundary, cuts, fixes, graph, grids, morphology, regrid, smooth, spatial, straits, thalweg
from ..sources import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KM = geo.KM_PER_DEG
POLYGON = [(0.31, 50.22), (1.73, 50.41), (1.52, 51.63), (0.87, 51.17), (0.44, 51.91)]
REGIONS = [{"type": "rectangle", "lon_min": 0.2, "lon_max": 0.6, "lat_min": 50.3, "lat_max": 50.7}, {"type": "polygon", "vertices": POLYGON}, {"type": "point", "lon": 2.013, "lat": 52.017}, {"type": "ij_rectangle", "i_min": 20, "j_max": 3}, {"type": "ij_point", "i": 0, "j": 23}]


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a query; sql follows the raster's tables f (fine), k, c (coarse) in a WITH."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{fixture.SQL}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql}"
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c).cast("double"), 6) + 0.0 for c in columns})  # no negative zero


def g6(df: DataFrame, *columns: str) -> DataFrame:
    """r6 for generated grids, whose rows grow with the square of the customers."""
    return df.withColumns({c: geo.round_even(c, 6) + 0.0 for c in columns})


def e6(expr: str, name: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE), 6) + 0::DOUBLE AS {name}"


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """pid, lon, lat: the suppliers strewn over the raster."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("pid"), ((F.col("s_suppkey") * 37 % 240) / 100.0 + 0.0031).alias("lon"), (F.lit(50.0) + (F.col("s_suppkey") * 53 % 240) / 100.0 + 0.0017).alias("lat"))


PTS = "p AS (SELECT s_suppkey AS pid, CAST(s_suppkey * 37 % 240 AS DOUBLE) / 100 + 0.0031::DOUBLE AS lon, 50::DOUBLE + CAST(s_suppkey * 53 % 240 AS DOUBLE) / 100 + 0.0017::DOUBLE AS lat FROM supplier)"
D2 = "(c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat)"


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """name, seq, lon, lat, depth: four paths of suppliers."""
    return suppliers(spark, sf).select(F.concat(F.lit("p"), (F.col("pid") % 4).cast("string")).alias("name"), F.expr("cast(pid div 4 as int)").alias("seq"), "lon", "lat", (5.0 + F.col("pid") * 7 % 30).alias("depth"), F.when(F.col("pid") % 4 == 1, 100.0).otherwise(75.0).alias("pct"))


PATHS = PTS + ", path AS (SELECT 'p' || (pid % 4) AS name, CAST(pid // 4 AS INT) AS seq, lon, lat, 5.0::DOUBLE + pid * 7 % 30 AS depth, CASE WHEN pid % 4 = 1 THEN 100.0::DOUBLE ELSE 75 END AS pct FROM p)"
PROFILE = PATHS + f""", h AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM path WINDOW w AS (PARTITION BY name ORDER BY seq)),
prof AS (SELECT name, seq, lon, lat, depth, pct, sum(coalesce(sqrt(pow((lon - lon0) * cos(radians((lat + lat0) / 2)), 2) + pow(lat - lat0, 2)) * {KM}, 0)) OVER (PARTITION BY name ORDER BY seq) AS dist_km FROM h)"""


# --- sources and regridding


@query("source_clip", "SELECT j, i, depth FROM f WHERE lon BETWEEN 0.4 AND 1.6 AND lat BETWEEN 50.4 AND 51.3")
def source_clip(s, d):
    return regrid.clip(fixture.fine(s, d), 0.5, 1.5, 50.5, 51.2, 0.1).select("j", "i", "depth")


@query("source_elevation", "SELECT j, i, depth IS NULL AS land, depth FROM f")
def source_elevation(s, d):
    raster = fixture.fine(s, d).select("j", "i", F.coalesce(-F.col("depth"), F.lit(3.0)).alias("elevation"))
    return regrid.from_elevation(raster).select("j", "i", "land", "depth")


@query("source_summary", f"SELECT count(*) AS n, count(depth) AS n_ocean, min(depth) AS min_depth, max(depth) AS max_depth, {e6('avg(depth)', 'mean_depth')} FROM f")
def source_summary(s, d):
    return r6(fixture.fine(s, d).agg(F.count(F.lit(1)).alias("n"), F.count("depth").alias("n_ocean"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth")), "mean_depth")


@query("regrid_coarse", f"SELECT j, i, {e6('wet_fraction', 'wet_fraction')}, {e6('depth', 'depth')} FROM k")
def regrid_coarse(s, d):
    return r6(regrid.blocks(fixture.fine(s, d), fixture.FACTOR), "wet_fraction", "depth")


@query("regrid_clamped", f"SELECT j, i, mask, {e6('CASE WHEN mask = 1 THEN greatest(depth, 15) END', 'depth')} FROM c")
def regrid_clamped(s, d):
    k = regrid.blocks(fixture.fine(s, d), fixture.FACTOR)
    return r6(regrid.mask_and_clamp(k, 0.3, 15.0), "depth").select("j", "i", F.col("mask").cast("int").alias("mask"), "depth")


@query("regrid_summary", f"SELECT count(*) AS n_cells, count_if(mask = 1) AS n_wet, {e6('min(depth)', 'min_depth')}, {e6('max(depth)', 'max_depth')}, {e6('avg(depth)', 'mean_depth')}, {e6('min(wet_fraction) FILTER (WHERE mask = 1)', 'min_wet_fraction')} FROM c")
def regrid_summary(s, d):
    return r6(regrid.summary(fixture.coarse(s, d)), "min_depth", "max_depth", "mean_depth", "min_wet_fraction")


def _overlap_sql(d: float, x0: float, y0: float) -> str:
    return f"""o AS (SELECT CAST(y.j AS INT) AS j, CAST(x.i AS INT) AS i, f.depth,
  (least(f.lon + 0.0125::DOUBLE, {x0}::DOUBLE + (x.i + 1) * {d}::DOUBLE) - greatest(f.lon - 0.0125::DOUBLE, {x0}::DOUBLE + x.i * {d}::DOUBLE))
  * (sin(radians(least(f.lat + 0.0125::DOUBLE, {y0}::DOUBLE + (y.j + 1) * {d}::DOUBLE))) - sin(radians(greatest(f.lat - 0.0125::DOUBLE, {y0}::DOUBLE + y.j * {d}::DOUBLE))))
  / ({d}::DOUBLE * (sin(radians({y0}::DOUBLE + (y.j + 1) * {d}::DOUBLE)) - sin(radians({y0}::DOUBLE + y.j * {d}::DOUBLE)))) AS w
 FROM f JOIN (SELECT range AS i FROM range(-2, 30)) x ON f.lon + 0.0125::DOUBLE - 1e-9 > {x0}::DOUBLE + x.i * {d}::DOUBLE AND f.lon - 0.0125::DOUBLE + 1e-9 < {x0}::DOUBLE + (x.i + 1) * {d}::DOUBLE
 JOIN (SELECT range AS j FROM range(-2, 30)) y ON f.lat + 0.0125::DOUBLE - 1e-9 > {y0}::DOUBLE + y.j * {d}::DOUBLE AND f.lat - 0.0125::DOUBLE + 1e-9 < {y0}::DOUBLE + (y.j + 1) * {d}::DOUBLE)
SELECT j, i, {e6('sum(CASE WHEN depth IS NOT NULL THEN w ELSE 0 END)', 'wet_fraction')}, {e6('sum(w * coalesce(depth, 0)) / nullif(sum(CASE WHEN depth IS NOT NULL THEN w ELSE 0 END), 0)', 'depth')} FROM o GROUP BY j, i"""


@query("regrid_area_weighted", _overlap_sql(0.1, 0.0, 50.0))
def regrid_area_weighted(s, d):
    return r6(regrid.area_weighted(fixture.fine(s, d), 0.1, 0.1, 0.0, 50.0, 0.025, 0.025), "wet_fraction", "depth")


@query("regrid_unaligned", _overlap_sql(0.16, 0.013, 50.007))
def regrid_unaligned(s, d):
    return r6(regrid.area_weighted(fixture.fine(s, d), 0.16, 0.16, 0.013, 50.007, 0.025, 0.025), "wet_fraction", "depth")


@query("bbox_percentile", f"q AS (SELECT j // 4 AS j, i // 4 AS i, quantile_cont(depth, 0.75) AS p FROM f WHERE depth IS NOT NULL GROUP BY 1, 2) SELECT c.j, c.i, {e6('CASE WHEN mask = 1 AND lon BETWEEN 0.5 AND 1.5 AND lat BETWEEN 50.5 AND 51.5 THEN p ELSE depth END', 'depth')} FROM c LEFT JOIN q ON c.j = q.j AND c.i = q.i")
def bbox_percentile(s, d):
    out = regrid.percentile_pass(fixture.coarse(s, d), fixture.fine(s, d), fixture.FACTOR, 75, [(0.5, 1.5, 50.5, 51.5)])
    return r6(out, "depth").select("j", "i", "depth")


_FACE = "CASE WHEN {n}j IS NULL THEN depth WHEN {n}d IS NOT NULL AND depth IS NOT NULL THEN least(depth, {n}d) END"


@query("cgrid_faces", f"l AS (SELECT *, lead(j) OVER a AS ej, lead(depth) OVER a AS ed, lead(j) OVER b AS nj, lead(depth) OVER b AS nd FROM c WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)) SELECT j, i, {e6(_FACE.format(n='e'), 'depth_u')}, {e6(_FACE.format(n='n'), 'depth_v')} FROM l")
def cgrid_faces(s, d):
    return r6(regrid.cgrid_faces(fixture.coarse(s, d)), "depth_u", "depth_v").select("j", "i", "depth_u", "depth_v")


# --- grids

GRID_COLUMNS = ["lon", "lat", "lon00", "lat00", "lon11", "lat11"]


#: Generated grids get finer with the customers: k doublings of nothing, but k times as many cells along each side.
KK = "kk AS (SELECT greatest(1, count(*) // 375) AS k FROM customer)"


def finer(s: SparkSession, d: str) -> int:
    return max(1, s.read.parquet(f"{d}/customer.parquet").count() // 375)


def _grid_sql(nx: str, ny: str, lon: str, lat: str) -> str:
    """nx, ny: expressions of k; lon, lat: expressions of the corner's column x and row y, and k."""
    at = lambda e, a, b: "(" + e.replace("{x}", f"(i + {b})").replace("{y}", f"(j + {a})") + ")"
    mean = lambda e: " + ".join(at(e, a, b) for a in (0, 1) for b in (0, 1))
    return (
        f"{KK} SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, {e6(f'({mean(lon)}) / 4', 'lon')}, {e6(f'({mean(lat)}) / 4', 'lat')}, {e6(at(lon, 0, 0), 'lon00')}, {e6(at(lat, 0, 0), 'lat00')}, {e6(at(lon, 1, 1), 'lon11')}, {e6(at(lat, 1, 1), 'lat11')} "
        f"FROM (SELECT unnest(range(CAST({nx} AS BIGINT))) AS i, k FROM kk) CROSS JOIN (SELECT unnest(range(CAST({ny} AS BIGINT))) AS j FROM kk)"
    )


def _grid(df: DataFrame) -> DataFrame:
    return g6(df, *GRID_COLUMNS).select("j", "i", *GRID_COLUMNS)


@query("grid_spherical_t", _grid_sql("5 * k + 1", "4 * k + 1", "-1 + ({x} - 0.5::DOUBLE) * (0.4::DOUBLE / k)", "50 + ({y} - 0.5::DOUBLE) * (0.4::DOUBLE / k)"))
def grid_spherical_t(s, d):
    return _grid(grids.spherical(s, -1, 1, 50, 51.6, 0.4 / finer(s, d), 0.4 / finer(s, d)))


@query("grid_spherical_interfaces", _grid_sql("5 * k", "4 * k", "-1 + {x} * (0.4::DOUBLE / k)", "50 + {y} * (0.4::DOUBLE / k)"))
def grid_spherical_interfaces(s, d):
    return _grid(grids.spherical(s, -1, 1, 50, 51.6, 0.4 / finer(s, d), 0.4 / finer(s, d), interfaces=True))


_RX, _RY = "((-1 + ({x} - 0.5::DOUBLE) * (0.4::DOUBLE / k)) * cos(radians(50.8::DOUBLE)))", "((50 + ({y} - 0.5::DOUBLE) * (0.4::DOUBLE / k)) - 50.8::DOUBLE)"


@query("grid_rotated", _grid_sql("5 * k + 1", "4 * k + 1", f"({_RX} * cos(radians(20::DOUBLE)) - {_RY} * sin(radians(20::DOUBLE))) / cos(radians(50.8::DOUBLE))", f"50.8::DOUBLE + {_RX} * sin(radians(20::DOUBLE)) + {_RY} * cos(radians(20::DOUBLE))"))
def grid_rotated(s, d):
    return _grid(grids.spherical(s, -1, 1, 50, 51.6, 0.4 / finer(s, d), 0.4 / finer(s, d), rotation=20))


@query("grid_cartesian", _grid_sql("2 * k", "2 * k", "500::DOUBLE + ({x} * 500.0::DOUBLE / k - 500) * cos(radians(30::DOUBLE)) - ({y} * 200.0::DOUBLE / k - 200) * sin(radians(30::DOUBLE))", "200::DOUBLE + ({x} * 500.0::DOUBLE / k - 500) * sin(radians(30::DOUBLE)) + ({y} * 200.0::DOUBLE / k - 200) * cos(radians(30::DOUBLE))"))
def grid_cartesian(s, d):
    return _grid(grids.cartesian(s, 0, 1000, 0, 400, 500 / finer(s, d), 200 / finer(s, d), rotation=30))


_T, _P = "radians(-2 + {x} * 1.0::DOUBLE / k)", "radians(-1.5::DOUBLE + {y} * 1.0::DOUBLE / k)"
_PL = "radians(35::DOUBLE)"
_PLAT = f"degrees(asin(greatest(-1, least(1, sin({_P}) * sin({_PL}) + cos({_P}) * cos({_T}) * cos({_PL})))))"
_PLON = f"degrees(atan2(cos({_P}) * sin({_T}), sin({_PL}) * cos({_P}) * cos({_T}) - cos({_PL}) * sin({_P}))) - 178 + 180"


@query("grid_rotated_pole", _grid_sql("4 * k", "3 * k", _PLON, _PLAT))
def grid_rotated_pole(s, d):
    return _grid(grids.rotated_pole(s, *geo.pole_from_center(2, 55), -2, 2, -1.5, 1.5, 1.0 / finer(s, d)))


@query("axis_angle", f"{KK} SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, {e6('degrees(atan2((0.4::DOUBLE / k) * cos(radians(50.8::DOUBLE)) * sin(radians(20::DOUBLE)), (0.4::DOUBLE / k) * cos(radians(20::DOUBLE)) * cos(radians(50.8::DOUBLE + (-1 + i * (0.4::DOUBLE / k)) * cos(radians(50.8::DOUBLE)) * sin(radians(20::DOUBLE)) + (j * (0.4::DOUBLE / k) - 0.8::DOUBLE) * cos(radians(20::DOUBLE))))))', 'angle')} FROM (SELECT unnest(range(5 * k + 1)) AS i, k FROM kk) CROSS JOIN (SELECT unnest(range(4 * k + 1)) AS j FROM kk)")
def axis_angle(s, d):
    return g6(grids.axis_angle(grids.spherical(s, -1, 1, 50, 51.6, 0.4 / finer(s, d), 0.4 / finer(s, d), rotation=20)), "angle").select("j", "i", "angle")


@query("cell_sizes", f"l AS (SELECT j, i, lon, lat, lag(lon) OVER a AS lw, lead(lon) OVER a AS le, lag(lat) OVER b AS ls, lead(lat) OVER b AS ln FROM c WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)) SELECT j, i, {e6('abs(CASE WHEN lw IS NULL THEN le - lon WHEN le IS NULL THEN lon - lw ELSE (le - lw) / 2 END)', 'dlon')}, {e6('abs(CASE WHEN ls IS NULL THEN ln - lat WHEN ln IS NULL THEN lat - ls ELSE (ln - ls) / 2 END)', 'dlat')} FROM l")
def cell_sizes(s, d):
    return r6(grids.cell_sizes(fixture.coarse(s, d)), "dlon", "dlat").select("j", "i", "dlon", "dlat")


@query("supergrid_split", f"{KK} SELECT CAST(sj // 2 AS INT) AS j, CAST(si // 2 AS INT) AS i, CASE WHEN sj % 2 = 1 AND si % 2 = 1 THEN 'T' WHEN sj % 2 = 1 THEN 'U' WHEN si % 2 = 1 THEN 'V' ELSE 'Q' END AS kind, {e6('0.2::DOUBLE / k * si', 'lon')}, {e6('50 + 0.2::DOUBLE / k * sj', 'lat')} FROM (SELECT unnest(range(12 * k + 1)) AS sj, k FROM kk) CROSS JOIN (SELECT unnest(range(8 * k + 1)) AS si FROM kk)")
def supergrid_split(s, d):
    k = finer(s, d)
    pts = grids.mesh(s, 12 * k + 1, 8 * k + 1).withColumnsRenamed({"j": "sj", "i": "si"})
    return g6(grids.supergrid(pts.withColumns({"lon": F.col("si") * (0.2 / k), "lat": 50 + F.col("sj") * (0.2 / k)})), "lon", "lat")


# --- joins in space


@query("nearest_cell", f"{PTS} SELECT pid, min_by(c.j, ({D2}, c.j, c.i)) AS j, min_by(c.i, ({D2}, c.j, c.i)) AS i, round_even(min({D2}), 6) AS d2 FROM p CROSS JOIN c GROUP BY pid")
def nearest_cell(s, d):
    return r6(spatial.nearest_cell(suppliers(s, d), fixture.coarse(s, d)), "d2").select("pid", "j", "i", "d2")


@query("nearest_within", f"{PTS}, n AS (SELECT pid, min_by(c.j, ({D2}, c.j, c.i)) AS j, min_by(c.i, ({D2}, c.j, c.i)) AS i FROM p JOIN c ON mask = 1 AND {D2} <= 0.0016 GROUP BY pid) SELECT p.pid, n.j, n.i FROM p LEFT JOIN n ON p.pid = n.pid")
def nearest_within(s, d):
    return spatial.nearest_cell(suppliers(s, d), fixture.coarse(s, d).where("mask = 1"), max_deg=0.04).select("pid", "j", "i")


@query("range_windows", f"{PTS} SELECT pid, count(f.j) AS n, count(depth) AS n_wet, max(depth) AS deepest FROM p JOIN f ON f.lon BETWEEN p.lon - 0.1 AND p.lon + 0.1 AND f.lat BETWEEN p.lat - 0.05 AND p.lat + 0.05 GROUP BY pid")
def range_windows(s, d):
    w = suppliers(s, d).select("pid", (F.col("lon") - 0.1).alias("lon0"), (F.col("lon") + 0.1).alias("lon1"), (F.col("lat") - 0.05).alias("lat0"), (F.col("lat") + 0.05).alias("lat1"))
    return spatial.range_join(w, fixture.fine(s, d), 0.2).groupBy("pid").agg(F.count("j").alias("n"), F.count("depth").alias("n_wet"), F.max("depth").alias("deepest"))


def _crossings(lon: str, lat: str) -> str:
    edges = list(zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))
    return " + ".join(f"CASE WHEN ({y1}::DOUBLE > {lat}) <> ({y2}::DOUBLE > {lat}) AND {lon} < ({x2}::DOUBLE - {x1}::DOUBLE) * ({lat} - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges)


@query("coastline_mask", f"SELECT j, i, CASE WHEN ({_crossings('lon', 'lat')}) % 2 = 0 THEN depth END AS depth FROM f")
def coastline_mask(s, d):
    f = fixture.fine(s, d).withColumn("pid", F.col("j") * fixture.N + F.col("i"))
    v = s.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(POLYGON)], "poly int, seq int, vlon double, vlat double")
    land = spatial.in_polygons(f, v).select("pid", F.lit(True).alias("land"))
    return f.join(land, "pid", "left").select("j", "i", F.when(F.col("land").isNull(), F.col("depth")).alias("depth"))


_NEAR = "c.j * 24 + c.i = (SELECT min_by(z.id, ((z.lon - 2.013) * (z.lon - 2.013) + (z.lat - 52.017) * (z.lat - 52.017), z.id)) FROM c z)"


@query("mask_regions", f"SELECT j, i, CASE WHEN lon BETWEEN 0.2 AND 0.6 AND lat BETWEEN 50.3 AND 50.7 THEN 0 WHEN ({_crossings('lon', 'lat')}) % 2 = 1 THEN 1 WHEN {_NEAR} THEN 2 WHEN i >= 20 AND j <= 3 THEN 3 WHEN i = 0 AND j = 23 THEN 4 END AS ord FROM c WHERE mask = 1 AND (lon BETWEEN 0.2 AND 0.6 AND lat BETWEEN 50.3 AND 50.7 OR ({_crossings('lon', 'lat')}) % 2 = 1 OR {_NEAR} OR i >= 20 AND j <= 3 OR i = 0 AND j = 23)")
def mask_regions(s, d):
    return basins.region_cells(fixture.coarse(s, d), REGIONS)


# --- basins


def comp_sql(least: float, table: str = "c", nx: int = 24) -> str:
    return f"""w AS MATERIALIZED (SELECT id, j, i FROM {table} WHERE wet_fraction >= {least} AND depth IS NOT NULL),
e AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM w a JOIN w b ON (a.j = b.j AND abs(a.i - b.i) = 1) OR (a.i = b.i AND abs(a.j - b.j) = 1)),
lab(id, l) AS (SELECT id, id FROM w UNION SELECT e.t, lab.l FROM lab JOIN e ON e.s = lab.id WHERE lab.l < e.t),
comp AS MATERIALIZED (SELECT id, min(l) AS label FROM lab GROUP BY id)"""


@query("components", f"{comp_sql(0.3)} SELECT id, CAST(label AS BIGINT) AS label FROM comp", True)
def components(s, d):
    return graph.label_cells(fixture.coarse(s, d).where("mask = 1").select("j", "i", "id")).select(F.col("id").cast("int").alias("id"), "label")


@query("components_runs", f"{comp_sql(0.5)} SELECT id, CAST(label AS BIGINT) AS label FROM comp", True)
def components_runs(s, d):
    return graph.label_runs(fixture.coarse(s, d, 0.5).where("mask = 1").select("j", "i", "id")).select("id", "label")


_RANKS = ", r AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS basin_rank FROM comp GROUP BY label)"


@query("basin_sizes", f"{comp_sql(0.5)}{_RANKS} SELECT CAST(label AS BIGINT) AS label, n, basin_rank FROM r", True)
def basin_sizes(s, d):
    return basins.basin_sizes(basins.labelled(fixture.coarse(s, d, 0.5)))


def _kept(where: str) -> str:
    return f"{comp_sql(0.5)}{_RANKS} SELECT c.j, c.i, CASE WHEN r.label IS NOT NULL THEN 1 ELSE 0 END AS mask, {e6('CASE WHEN r.label IS NOT NULL THEN depth END', 'depth')} FROM c LEFT JOIN comp ON c.id = comp.id LEFT JOIN r ON comp.label = r.label AND {where}"


@query("mask_isolated", _kept("basin_rank <= 1"), True)
def mask_isolated(s, d):
    return r6(basins.mask_isolated(fixture.coarse(s, d, 0.5), 1), "depth").select("j", "i", F.col("mask").cast("int").alias("mask"), "depth")


@query("keep_basins", _kept("basin_rank IN (2, 3, 99)"), True)
def keep_basins(s, d):
    return r6(basins.mask_isolated(fixture.coarse(s, d, 0.5), keep=[2, 3, 99]), "depth").select("j", "i", F.col("mask").cast("int").alias("mask"), "depth")


@query("isolation_summary", f"{comp_sql(0.5)}{_RANKS} SELECT (SELECT count(*) FROM w) AS wet_before, (SELECT n FROM r WHERE basin_rank = 1) AS wet_after, (SELECT count(*) FROM w) - (SELECT n FROM r WHERE basin_rank = 1) AS masked", True)
def isolation_summary(s, d):
    c = fixture.coarse(s, d, 0.5)
    return basins.isolation_summary(c, basins.mask_isolated(c, 1))


@query("land_bridges", f"{comp_sql(0.5)} SELECT a.j, a.i, CAST(count(DISTINCT label) AS INT) AS n_components, coalesce(round_even(avg(b.depth), 1), 5.0) AS estimated_depth FROM c a JOIN c b ON abs(a.j - b.j) + abs(a.i - b.i) = 1 JOIN comp ON comp.id = b.id WHERE NOT (a.wet_fraction >= 0.5) GROUP BY a.j, a.i HAVING count(DISTINCT label) >= 2", True)
def land_bridges(s, d):
    return basins.land_bridges(fixture.coarse(s, d, 0.5)).drop("labels")


@query("dilate", "SELECT DISTINCT CAST(a.j + y.range AS INT) AS j, CAST(a.i + x.range AS INT) AS i FROM c a CROSS JOIN range(-2, 3) x CROSS JOIN range(-2, 3) y WHERE a.mask = 0 AND abs(x.range) + abs(y.range) <= 2")
def dilate(s, d):
    return basins.dilate(fixture.coarse(s, d).where("mask = 0").select("j", "i"), 2)


@query("phantom_fallback", f"SELECT j, i, {e6('wet_fraction', 'wet_fraction')} FROM c a WHERE mask = 1 AND wet_fraction < 0.7 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.mask = 0 AND abs(a.j - b.j) <= 2 AND abs(a.i - b.i) <= 2)")
def phantom_fallback(s, d):
    return r6(basins.phantom_fallback(fixture.coarse(s, d), 0.7, 2), "wet_fraction").select("j", "i", "wet_fraction")


# flooding from runs of land instead of labels; a component is named by its least run
_PHANTOM = """rs AS (SELECT j, i, i - row_number() OVER (PARTITION BY j ORDER BY i) AS run FROM f WHERE depth IS NULL),
rr AS MATERIALIZED (SELECT j, run, min(i) AS i0, max(i) AS i1, j * 96 + min(i) AS id FROM rs GROUP BY j, run),
ed AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM rr a JOIN rr b ON abs(a.j - b.j) = 1 AND a.i0 <= b.i1 AND b.i0 <= a.i1),
fl AS (SELECT id AS root, id FROM rr UNION SELECT fl.root, ed.y FROM fl JOIN ed ON fl.id = ed.x),
lb AS (SELECT id, min(root) AS label FROM fl GROUP BY id),
ln AS (SELECT rr.j, rr.run, lb.label, sum(i1 - i0 + 1) OVER (PARTITION BY lb.label) AS n FROM rr JOIN lb ON rr.id = lb.id),
hit AS (SELECT c.id, c.j, c.i, ln.label, ln.n FROM c JOIN rs ON rs.j // 4 = c.j AND rs.i // 4 = c.i JOIN ln ON ln.j = rs.j AND ln.run = rs.run WHERE c.mask = 1 AND c.wet_fraction < 0.8),
cd AS (SELECT id, j, i, count(*) AS n_fine FROM hit GROUP BY ALL HAVING max(n) < 50),
tw AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y FROM hit a JOIN hit b ON a.label = b.label JOIN cd p ON p.id = a.id JOIN cd q ON q.id = b.id),
cl AS (SELECT id AS root, id FROM cd UNION SELECT cl.root, tw.y FROM cl JOIN tw ON cl.id = tw.x),
cm AS (SELECT cd.*, (SELECT min(root) FROM cl WHERE cl.id = cd.id) AS cluster FROM cd),
cs AS (SELECT j, i, n_fine, cluster, count(*) OVER w AS cluster_size, CAST(sum(n_fine) OVER w AS BIGINT) AS cluster_fine FROM cm WINDOW w AS (PARTITION BY cluster))
SELECT * FROM cs WHERE cluster_size <= 5"""


@query("phantom_islands", _PHANTOM, True)
def phantom_islands(s, d):
    return basins.phantom_islands(fixture.coarse(s, d), fixture.fine(s, d), 0.05, 0.8, 50, 5)


# --- straits


_U = "SELECT 'U' AS direction, a.j, a.i, (a.lon + b.lon) / 2 AS x, (a.lat + b.lat) / 2 AS y FROM c a JOIN c b ON a.j = b.j AND b.i = a.i + 1 WHERE a.mask = 1 AND b.mask = 1 AND (a.wet_fraction < 0.6 OR b.wet_fraction < 0.6)"
_V = _U.replace("'U'", "'V'").replace("a.j = b.j AND b.i = a.i + 1", "a.i = b.i AND b.j = a.j + 1")


@query("strait_sections", f"""x AS ({_U} UNION ALL {_V}),
h AS (SELECT x.*, f.depth, CASE WHEN direction = 'U' THEN f.i ELSE f.j END AS line, round(CASE WHEN direction = 'U' THEN abs(f.lon - x.x) ELSE abs(f.lat - x.y) END, 9) AS off FROM x JOIN f
 ON f.lon BETWEEN x.x - CASE WHEN direction = 'U' THEN 0.1 ELSE 0.05 END - 1e-9 AND x.x + CASE WHEN direction = 'U' THEN 0.1 ELSE 0.05 END + 1e-9 AND f.lat BETWEEN x.y - CASE WHEN direction = 'U' THEN 0.05 ELSE 0.1 END - 1e-9 AND x.y + CASE WHEN direction = 'U' THEN 0.05 ELSE 0.1 END + 1e-9),
m AS (SELECT direction, j, i, min_by(line, (off, line)) AS line FROM h GROUP BY ALL),
z AS (SELECT h.direction, h.j, h.i, count(depth) AS n, max(depth) AS sill, sum(depth) AS total, any_value(y) AS y FROM h JOIN m ON h.direction = m.direction AND h.j = m.j AND h.i = m.i AND h.line = m.line GROUP BY ALL)
SELECT direction, j, i, {e6(f"n * 0.025 * {KM} * CASE WHEN direction = 'U' THEN 1 ELSE cos(radians(y)) END", 'width_km')}, coalesce(sill, 0) AS sill_fine, {e6(f"coalesce(total, 0) * 25 * {KM} * CASE WHEN direction = 'U' THEN 1 ELSE cos(radians(y)) END", 'area_fine')} FROM z""")
def strait_sections(s, d):
    out = straits.sections(straits.interfaces(fixture.coarse(s, d), 0.6), fixture.fine(s, d), 0.1, 0.1, 0.025, 0.025)
    return r6(out, "width_km", "area_fine").select("direction", "j", "i", "width_km", "sill_fine", "area_fine")


_UD = _U.replace("AS y FROM", "AS y, (a.depth + b.depth) / 2 AS sill_coarse FROM")
_VD = _V.replace("AS y FROM", "AS y, (a.depth + b.depth) / 2 AS sill_coarse FROM")
# across: the line that a cell is on, along: its place on the way from one coarse cell to the other
_STRAITS = f"""x AS ({_UD} UNION ALL {_VD}),
w AS MATERIALIZED (SELECT x.*, f.depth, CASE WHEN direction = 'U' THEN f.i ELSE f.j END AS along, CASE WHEN direction = 'U' THEN f.j ELSE f.i END AS across, round(CASE WHEN direction = 'U' THEN abs(f.lon - x.x) ELSE abs(f.lat - x.y) END, 9) AS off FROM x JOIN f
 ON abs(f.lon - x.x) <= CASE WHEN direction = 'U' THEN 0.1 ELSE 0.05 END + 1e-9 AND abs(f.lat - x.y) <= CASE WHEN direction = 'U' THEN 0.05 ELSE 0.1 END + 1e-9),
mid AS MATERIALIZED (SELECT direction, j, i, min(along) + count(DISTINCT along) // 2 AS m, min_by(along, (off, along)) AS line FROM w GROUP BY ALL),
fl AS (SELECT w.direction, w.j, w.i, along, across FROM w JOIN mid USING (direction, j, i) WHERE depth IS NOT NULL AND along = m - 1
 UNION SELECT w.direction, w.j, w.i, w.along, w.across FROM fl JOIN w ON w.direction = fl.direction AND w.j = fl.j AND w.i = fl.i AND abs(w.along - fl.along) + abs(w.across - fl.across) = 1 WHERE w.depth IS NOT NULL),
cn AS (SELECT DISTINCT direction, j, i FROM fl JOIN mid USING (direction, j, i) WHERE along = m),
z AS (SELECT w.direction, w.j, w.i, w.x AS lon, w.y AS lat, sill_coarse, count(depth) AS n, coalesce(max(depth), 0) AS sill, coalesce(sum(depth), 0) AS total FROM w JOIN mid ON w.direction = mid.direction AND w.j = mid.j AND w.i = mid.i AND w.along = mid.line GROUP BY ALL),
y AS (SELECT z.*, cn.j IS NOT NULL AS connected, {KM} * CASE WHEN z.direction = 'U' THEN 1 ELSE cos(radians(lat)) END AS km, {KM} * CASE WHEN z.direction = 'U' THEN cos(radians(lat)) ELSE 1 END AS km_along FROM z LEFT JOIN cn ON z.direction = cn.direction AND z.j = cn.j AND z.i = cn.i),
v AS (SELECT *, n * 0.025 * km AS width, total * 25 * km AS fine_area, sill_coarse * 100 * km AS coarse_area, sill / sill_coarse AS sr FROM y),
u AS (SELECT *, fine_area / coarse_area AS ar, CASE WHEN NOT connected THEN 'BLOCKED' WHEN sr < 0.7 THEN 'SILL_DEFICIT' WHEN fine_area / coarse_area < 0.5 THEN 'AREA_DEFICIT' ELSE 'OK' END AS category FROM v),
st AS (SELECT direction, j, i, lon, lat, round_even(width, 2) AS width_km, round_even(sill, 1) AS sill_fine, round_even(fine_area, 0) AS area_fine, connected, round_even(sill_coarse, 1) AS sill_coarse, round_even(coarse_area, 0) AS area_coarse, round_even(sr, 3) AS sill_ratio, round_even(ar, 3) AS area_ratio, category
 FROM u WHERE category <> 'OK' OR width < 0.2 * km_along)"""


def _straits(s, d):
    return straits.find(fixture.coarse(s, d), fixture.fine(s, d), 0.1, 0.1, 0.025, 0.025, 0.6)


@query("straits", f"{_STRAITS} SELECT * FROM st", True)
def find_straits(s, d):
    return _straits(s, d)


@query("straits_topn", f"""{_STRAITS}, rk AS (SELECT *, CAST(list_position(['BLOCKED', 'SILL_DEFICIT', 'AREA_DEFICIT', 'OK'], category) AS BIGINT) AS rank, round_even(sill_coarse * (1 - sill_ratio), 6) AS sill_deficit FROM st)
SELECT * FROM rk ORDER BY rank, sill_deficit DESC, area_ratio, direction, j, i LIMIT 10""", True)
def straits_topn(s, d):
    return straits.ranked(_straits(s, d), 10)


@query("strait_summary", f"{_STRAITS} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (category = '{x}') AS n_{x.lower()}" for x in straits.RANK) + " FROM st", True)
def strait_summary(s, d):
    return straits.summary(_straits(s, d))


# --- fixes


def _fixes(s: SparkSession, d: str, *actions: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in actions]), (F.col("pid") % len(actions) + 1).cast("int"))
    return suppliers(s, d).select(F.col("pid").cast("int").alias("ord"), "lon", "lat", action.alias("action"), (F.col("pid") % 40 + 1.5).alias("value"))


@query("blend_cell", f"SELECT CAST(a.j + y.range AS INT) AS j, CAST(a.i + x.range AS INT) AS i, {e6('avg(a.depth)', 'blend')} FROM c a CROSS JOIN range(-1, 2) x CROSS JOIN range(-1, 2) y WHERE a.mask = 1 AND (x.range <> 0 OR y.range <> 0) GROUP BY 1, 2")
def blend_cell(s, d):
    return r6(fixes.neighbour_mean(fixture.coarse(s, d)), "blend")


@query("fix_keys", f"{PTS}, q AS (SELECT pid AS ord, ['BLOCKED', 'SILL_DEFICIT', 'AREA_DEFICIT', 'LAND_BRIDGE'][pid % 4 + 1] AS category, ['b', 's', 'a', 'lb'][pid % 4 + 1] AS x FROM p) SELECT ord, category, x || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY ord) AS VARCHAR), 3, '0') AS key FROM q")
def fix_keys(s, d):
    category = F.element_at(F.array(*[F.lit(c) for c in ("BLOCKED", "SILL_DEFICIT", "AREA_DEFICIT", "LAND_BRIDGE")]), (F.col("pid") % 4 + 1).cast("int"))
    return fixes.number_keys(suppliers(s, d).select(F.col("pid").alias("ord"), category.alias("category")))


# --- slopes


_RX0 = """l AS (SELECT j, i, depth, lead(depth) OVER a AS e, lead(depth) OVER b AS n FROM c WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)),
x AS (SELECT j, i, coalesce(abs(depth - e) / nullif(depth + e, 0), 0) AS u, coalesce(abs(depth - n) / nullif(depth + n, 0), 0) AS v FROM l)"""


@query("rx0_uv", f"{_RX0} SELECT j, i, {e6('u', 'rx0_u')}, {e6('v', 'rx0_v')} FROM x")
def rx0_uv(s, d):
    return r6(regrid.rx0(fixture.coarse(s, d)), "rx0_u", "rx0_v").select("j", "i", "rx0_u", "rx0_v")


@query("rx0_max", f"{_RX0} SELECT x.j, x.i, {e6('greatest(u, v, coalesce(lag(u) OVER (PARTITION BY j ORDER BY i), 0), coalesce(lag(v) OVER (PARTITION BY i ORDER BY j), 0))', 'rx0')} FROM x")
def rx0_max(s, d):
    return r6(regrid.rx0(fixture.coarse(s, d)), "rx0").select("j", "i", "rx0")


@query("rx0_histogram", f"{_RX0}, y AS (SELECT unnest([u, v]) AS x FROM x), t AS (SELECT max(x) * 1.05::DOUBLE AS top FROM y) SELECT CAST(least(floor(x / (top / 59)), 58) AS INT) AS bin, count(*) AS n FROM y, t WHERE x > 0 GROUP BY 1")
def rx0_histogram(s, d):
    return smooth.histogram(fixture.coarse(s, d))


@query("rx0_envelope", f"""w AS MATERIALIZED (SELECT id, j, i, depth FROM c WHERE mask = 1),
e AS MATERIALIZED (SELECT a.id AS s, b.id AS t, b.depth AS h FROM w a JOIN w b ON (a.j = b.j AND abs(a.i - b.i) = 1) OR (a.i = b.i AND abs(a.j - b.j) = 1)),
lab(id, v) AS (SELECT id, depth FROM w UNION SELECT e.t, lab.v / 1.5::DOUBLE FROM lab JOIN e ON e.s = lab.id WHERE lab.v / 1.5::DOUBLE > e.h)
SELECT c.j, c.i, {e6('max(v)', 'depth')} FROM c LEFT JOIN lab ON c.id = lab.id GROUP BY c.j, c.i""", True)
def rx0_envelope(s, d):
    return r6(smooth.envelope(fixture.coarse(s, d), 0.2), "depth").select("j", "i", "depth")


@query("smooth_lp")
def smooth_lp(s, d):
    return r6(smooth.smooth(fixture.coarse(s, d), 0.2), "depth").select("j", "i", "depth")


# --- boundaries


_EDGE = "edge AS (SELECT CASE WHEN i = 0 THEN 'W' WHEN i = 23 THEN 'E' WHEN j = 0 THEN 'S' WHEN j = 23 THEN 'N' END AS side, CASE WHEN i IN (0, 23) THEN j ELSE i END AS seq, j, i, lon, lat, depth FROM c WHERE mask = 1 AND (i IN (0, 23) OR j IN (0, 23)))"


@query("boundary_cells", f"{_EDGE} SELECT side, seq, j, i FROM edge")
def boundary_cells(s, d):
    return boundary.boundary_cells(fixture.coarse(s, d)).select("side", "seq", "j", "i")


@query("boundary_segments", f"{_EDGE}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY side ORDER BY seq) AS run FROM edge), sg AS (SELECT side, run, min(seq) AS a, min_by(i, seq) AS i_start, min_by(j, seq) AS j_start, max_by(i, seq) AS i_end, max_by(j, seq) AS j_end, count(*) AS n_cells FROM r GROUP BY side, run) SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY a) AS INT) AS segment, i_start, j_start, i_end, j_end, n_cells FROM sg")
def boundary_segments(s, d):
    return boundary.segments(boundary.boundary_cells(fixture.coarse(s, d)))


@query("boundary_csv", f"{_EDGE} SELECT CASE side WHEN 'W' THEN 0 WHEN 'N' THEN 1 WHEN 'E' THEN 2 ELSE 3 END AS side_rank, seq, printf('%.5f,%.5f', lon, lat) AS line FROM edge")
def boundary_csv(s, d):
    return boundary.csv_rows(boundary.boundary_cells(fixture.coarse(s, d)))


@query("bfs_distance", "w AS MATERIALIZED (SELECT id, j, i FROM c WHERE mask = 1), b(id, j, i, d) AS (SELECT id, j, i, 0 FROM w WHERE i = 0 UNION SELECT w.id, w.j, w.i, b.d + 1 FROM b JOIN w ON (w.j = b.j AND abs(w.i - b.i) = 1) OR (w.i = b.i AND abs(w.j - b.j) = 1) WHERE b.d < 6) SELECT j, i, min(d) AS dist FROM b GROUP BY j, i", True)
def bfs_distance(s, d):
    c = fixture.coarse(s, d)
    return boundary.bfs(c, c.where("i = 0").select("j", "i", F.col("j").alias("pos"), F.lit(1.0).alias("scale")), 6).select("j", "i", "dist")


@query("csv_segments", f"{PTS}, t AS (SELECT pid AS seq, lon, lat, sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS step FROM p WINDOW w AS (ORDER BY pid)), m AS (SELECT median(step) AS m FROM t) SELECT seq, CAST(sum(CASE WHEN step > CASE WHEN m > 0 THEN m * 1.5::DOUBLE ELSE 1e-3 END THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS segment FROM t, m")
def csv_segments(s, d):
    return boundary.csv_segments(suppliers(s, d).withColumnRenamed("pid", "seq"), 1.5).select("seq", "segment")


@query("boundary_starts", """u AS (SELECT 'W' AS edge, j AS along, i AS perp, j, i, depth FROM c WHERE mask = 1 UNION ALL SELECT 'E', j, 23 - i, j, i, depth FROM c WHERE mask = 1
 UNION ALL SELECT 'S', i, j, j, i, depth FROM c WHERE mask = 1 UNION ALL SELECT 'N', i, 23 - j, j, i, depth FROM c WHERE mask = 1),
ft AS (SELECT * FROM u WHERE perp <= 20 QUALIFY row_number() OVER (PARTITION BY edge, along ORDER BY perp) = 1),
br AS (SELECT *, along - lag(along) OVER (PARTITION BY edge, perp ORDER BY along) IS DISTINCT FROM 1 AS fresh, count(*) OVER (PARTITION BY edge, perp) AS hits FROM ft),
rn AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY edge, perp ORDER BY along) AS run FROM br WHERE hits >= 3),
dp AS (SELECT edge, perp, run, count(*) AS n_cells, arg_max((j, i, depth), (depth, -along)) AS d FROM rn GROUP BY edge, perp, run HAVING count(*) >= 3)
SELECT edge, perp, CAST(row_number() OVER (PARTITION BY edge, perp ORDER BY run) AS INT) AS segment, n_cells, d[1] AS j, d[2] AS i, d[3] AS depth FROM dp""")
def boundary_starts(s, d):
    return boundary.boundary_starts(fixture.coarse(s, d), 20, 3)


_OUT = "o AS (SELECT CAST(j // 3 AS INT) AS j, CAST(i // 3 AS INT) AS i, avg(lon) AS lon, avg(lat) + 0.0111::DOUBLE AS lat, avg(depth) AS depth FROM c GROUP BY 1, 2 HAVING avg(depth) IS NOT NULL)"


def _outer(s: SparkSession, d: str) -> DataFrame:
    keys = [F.expr(f"cast({c} div 3 as int)").alias(c) for c in ("j", "i")]
    return fixture.coarse(s, d).groupBy(*keys).agg(F.avg("lon").alias("lon"), (F.avg("lat") + 0.0111).alias("lat"), F.avg("depth").alias("depth")).where("depth is not null")


@query("nudge_scale", f"""{_EDGE}, {_OUT}, n AS (SELECT side, e.j, e.i, e.lat, e.depth, min_by(o.j * 8 + o.i, ((o.lon - e.lon) * (o.lon - e.lon) + (o.lat - e.lat) * (o.lat - e.lat), o.j, o.i)) AS oid FROM edge e CROSS JOIN o GROUP BY ALL),
gr AS (SELECT side, oid, avg(lat) AS lat, sum(depth * CASE WHEN side IN ('N', 'S') THEN 0.1 * abs(cos(radians(lat))) ELSE 0.1 END) AS inner_area FROM n GROUP BY side, oid)
SELECT n.side, n.j, n.i, {e6("greatest(1.0 / 3, least(3, o.depth * CASE WHEN n.side IN ('N', 'S') THEN 0.1 * abs(cos(radians(gr.lat))) ELSE 0.1 END / inner_area))", 'scale')} FROM n JOIN gr ON n.side = gr.side AND n.oid = gr.oid JOIN o ON o.j * 8 + o.i = n.oid""")
def nudge_scale(s, d):
    c = fixture.coarse(s, d)
    edge = boundary.boundary_cells(c).join(c.select("j", "i", "depth"), ["j", "i"])
    return r6(boundary.match_scale(edge, _outer(s, d), 0.1, 0.1), "scale").select("side", "j", "i", "scale")


# the queue's order as text: the seed's place, then a digit for each look
@query("nudge_apply", f"""{_EDGE}, {_OUT}, n AS (SELECT side, e.seq, e.j, e.i, e.lat, e.depth, min_by(o.j * 8 + o.i, ((o.lon - e.lon) * (o.lon - e.lon) + (o.lat - e.lat) * (o.lat - e.lat), o.j, o.i)) AS oid FROM edge e CROSS JOIN o GROUP BY ALL),
gr AS (SELECT side, oid, avg(lat) AS lat, sum(depth * CASE WHEN side IN ('N', 'S') THEN 0.1 * abs(cos(radians(lat))) ELSE 0.1 END) AS inner_area FROM n GROUP BY side, oid),
sc AS (SELECT n.side, n.seq, n.j, n.i, n.depth, greatest(1.0 / 3, least(3, o.depth * CASE WHEN n.side IN ('N', 'S') THEN 0.1 * abs(cos(radians(gr.lat))) ELSE 0.1 END / inner_area)) AS scale FROM n JOIN gr ON n.side = gr.side AND n.oid = gr.oid JOIN o ON o.j * 8 + o.i = n.oid),
sd AS MATERIALIZED (SELECT j * 24 + i AS id, lpad(CAST(CASE side WHEN 'W' THEN 0 WHEN 'E' THEN 1 WHEN 'S' THEN 2 ELSE 3 END * 1000000 + seq AS VARCHAR), 9, '0') AS pos, greatest(2.0::DOUBLE, depth * scale) / depth AS scale FROM sc WHERE depth > 0),
w AS MATERIALIZED (SELECT id, j, i FROM c WHERE mask = 1),
nb AS MATERIALIZED (SELECT a.id AS x, b.id AS y, CASE WHEN b.j < a.j THEN '0' WHEN b.j > a.j THEN '1' WHEN b.i < a.i THEN '2' ELSE '3' END AS look FROM w a JOIN w b ON (a.j = b.j AND abs(a.i - b.i) = 1) OR (a.i = b.i AND abs(a.j - b.j) = 1)),
bf(id, d) AS (SELECT id, 0 FROM sd UNION SELECT y, d + 1 FROM bf JOIN nb ON x = id WHERE d < 5),
ds AS MATERIALIZED (SELECT id, min(d) AS d FROM bf GROUP BY id),
lv(d, id, pos, scale) AS (SELECT 0, id, pos, scale FROM sd UNION ALL SELECT lv.d + 1, y, min(pos || look), arg_min(scale, pos || look) FROM lv JOIN nb ON nb.x = lv.id JOIN ds ON ds.id = nb.y AND ds.d = lv.d + 1 GROUP BY lv.d, y),
tg AS (SELECT c.j, c.i, c.depth, CASE WHEN scale IS NOT NULL THEN greatest(2.0::DOUBLE, c.depth * ((1 + cos(pi() * d / 5)) / 2 * scale + 1 - (1 + cos(pi() * d / 5)) / 2)) END AS target FROM c LEFT JOIN lv ON lv.id = c.id)
SELECT j, i, {e6('CASE WHEN abs(target - depth) >= 1e-6 THEN target ELSE depth END', 'depth')}, coalesce(target - depth >= 1e-6, false) AS pinned FROM tg""", True)
def nudge_apply(s, d):
    return r6(boundary.nudge(fixture.coarse(s, d), _outer(s, d), 0.1, 0.1, 5), "depth").select("j", "i", "depth", "pinned")


# --- thalwegs


@query("path_profile", f"{PROFILE} SELECT name, seq, {e6('dist_km', 'dist_km')} FROM prof")
def path_profile(s, d):
    return r6(thalweg.profile(paths(s, d)), "dist_km").select("name", "seq", "dist_km")


@query("sill", f"{PROFILE} SELECT name, min(depth) AS sill_depth, {e6('min_by(dist_km, (depth, seq))', 'sill_dist_km')} FROM prof GROUP BY name")
def sill(s, d):
    return r6(thalweg.sill(thalweg.profile(paths(s, d))), "sill_dist_km")


@query("clip_longest_run", f"""{PROFILE}, a AS (SELECT *, lon BETWEEN 0.3 AND 2.1 AS inside FROM prof), b AS (SELECT *, row_number() OVER w - sum(CAST(inside AS INT)) OVER w AS run FROM a WINDOW w AS (PARTITION BY name ORDER BY seq)),
gr AS (SELECT name, run, count(*) AS n, min(seq) AS s0, min(dist_km) AS start FROM b WHERE inside GROUP BY name, run), t AS (SELECT name, arg_max(run, (n, -s0)) AS run, arg_max(start, (n, -s0)) AS start FROM gr GROUP BY name)
SELECT b.name, b.seq, {e6('b.dist_km - start', 'dist_km')} FROM b JOIN t ON b.name = t.name AND b.run = t.run WHERE inside""")
def clip_longest_run(s, d):
    p = thalweg.profile(paths(s, d)).withColumn("inside", F.col("lon").between(0.3, 2.1))
    return r6(thalweg.clip_longest_run(p), "dist_km").select("name", "seq", "dist_km")


_SAMPLE = f"{PATHS}, n AS (SELECT name, seq, min_by(c.id, ({D2.replace('p.', 'path.')}, c.id)) AS id FROM path JOIN c ON mask = 1 AND {D2.replace('p.', 'path.')} <= 0.0049 GROUP BY name, seq), smp AS (SELECT path.*, c.depth AS coarse_depth FROM path LEFT JOIN n ON path.name = n.name AND path.seq = n.seq LEFT JOIN c ON n.id = c.id)"


@query("sample_coarse", f"{_SAMPLE} SELECT name, seq, {e6('coarse_depth', 'coarse_depth')} FROM smp")
def sample_coarse(s, d):
    return r6(thalweg.sample(paths(s, d), fixture.coarse(s, d), 0.07), "coarse_depth").select("name", "seq", "coarse_depth")


@query("path_error", f"{_SAMPLE} SELECT name, count(coarse_depth) AS n, {e6('avg(abs(coarse_depth - depth))', 'mae')}, {e6('sqrt(avg((coarse_depth - depth) * (coarse_depth - depth)))', 'rmse')} FROM smp WHERE coarse_depth IS NOT NULL GROUP BY name")
def path_error(s, d):
    return r6(thalweg.errors(thalweg.sample(paths(s, d), fixture.coarse(s, d), 0.07)), "mae", "rmse")


@query("suggest_fixes", f"""{PATHS}, n AS (SELECT name, seq, any_value(path.depth) AS depth, any_value(pct) AS pct, min_by(c.id, ({D2.replace('p.', 'path.')}, c.id)) AS id FROM path CROSS JOIN c GROUP BY name, seq),
gr AS (SELECT id, min(pct) AS pct, quantile_cont(depth, 0.75) AS q, max(depth) AS m, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM n GROUP BY id), v AS (SELECT *, CASE WHEN pct >= 100 THEN m ELSE q END AS value FROM gr)
SELECT c.j, c.i, {e6('lon', 'lon')}, {e6('lat', 'lat')}, round_even(value, 1) AS value, names FROM v JOIN c ON v.id = c.id WHERE mask = 0 OR (value - depth >= 2 AND (value - depth) / nullif(value, 0) >= 0.05)""")
def suggest_fixes(s, d):
    return thalweg.suggest_fixes(paths(s, d), fixture.coarse(s, d))


# each cell is left out in turn: is a neighbour out of reach of its first one?
@query("articulation", f"""{comp_sql(0.3).rsplit("lab(id", 1)[0]}fl(v, id) AS (SELECT s, min(t) FROM e GROUP BY s UNION SELECT fl.v, e.t FROM fl JOIN e ON e.s = fl.id WHERE e.t <> fl.v)
SELECT j, i FROM w WHERE id IN (SELECT e.s FROM e LEFT JOIN fl ON fl.v = e.s AND fl.id = e.t WHERE fl.id IS NULL)""", True)
def articulation(s, d):
    return cuts.choke_points(fixture.coarse(s, d).where("mask = 1").select("j", "i", "id"))


def _stops(s: SparkSession) -> DataFrame:
    rows = [("north", 0, 0.11, 50.2), ("north", 1, 1.02, 51.9), ("via", 0, 0.2, 50.1), ("via", 1, 0.5, 50.9), ("via", 2, 0.61, 50.3)]
    return s.createDataFrame(rows, "name string, seq int, lon double, lat double")


@query("thalweg_waypoint")
def thalweg_waypoint(s, d):
    fine = fixture.fine(s, d).withColumn("id", (F.col("j") * fixture.N + F.col("i")).cast("long"))
    return r6(thalweg.profile(thalweg.waypoint_paths(fine, _stops(s), 0.5)), "dist_km", "lon", "lat")


@query("auto_corridors")
def auto_corridors(s, d):
    return thalweg.auto_corridors(fixture.coarse(s, d))


# --- morphology


_HAV = "2 * 6371000 * asin(sqrt((pow(sin(radians({lat1} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat1})) * pow(sin(radians({lon1} - {lon0}) / 2), 2))))"


@query("haversine", f"{PTS} SELECT pid, {e6(_HAV.format(lat0='51.2::DOUBLE', lon0='1.3::DOUBLE', lat1='lat', lon1='lon'), 'metres')} FROM p")
def haversine(s, d):
    return r6(suppliers(s, d).withColumn("metres", geo.haversine_m(1.3, 51.2, "lon", "lat")), "metres").select("pid", "metres")


@query("bearing", f"{PTS} SELECT pid, {e6('fmod(degrees(atan2(sin(radians(lon - 1.3::DOUBLE)) * cos(radians(lat)), cos(radians(51.2::DOUBLE)) * sin(radians(lat)) - sin(radians(51.2::DOUBLE)) * cos(radians(lat)) * cos(radians(lon - 1.3::DOUBLE)))) + 360, 360)', 'azimuth')} FROM p")
def bearing(s, d):
    return r6(suppliers(s, d).withColumn("azimuth", geo.bearing(1.3, 51.2, "lon", "lat")), "azimuth").select("pid", "azimuth")


@query("destination", f"{PTS}, q AS (SELECT pid, lon, lat, asin(sin(radians(lat)) * cos(1000.0 * pid / 6371000) + cos(radians(lat)) * sin(1000.0 * pid / 6371000) * cos(radians(pid * 7.0))) AS t FROM p) SELECT pid, {e6('lon + degrees(atan2(sin(radians(pid * 7.0)) * sin(1000.0 * pid / 6371000) * cos(radians(lat)), cos(1000.0 * pid / 6371000) - sin(radians(lat)) * sin(t)))', 'lon')}, {e6('degrees(t)', 'lat')} FROM q")
def destination(s, d):
    p = suppliers(s, d)
    lon, lat = geo.destination("lon", "lat", F.col("pid") * 7.0, F.col("pid") * 1000.0)
    return r6(p.select("pid", lon.alias("lon"), lat.alias("lat")), "lon", "lat")


@query("taper", f"{PTS} SELECT pid, {e6('(1 + cos(pi() * (pid % 11) / 10)) / 2', 'cosine')}, {e6('1 - (pid % 11) / 10.0', 'linear')}, {e6('exp(-3.0 * (pid % 11) / 10)', 'exponential')} FROM p")
def taper(s, d):
    x = F.col("pid") % 11
    return r6(suppliers(s, d).select("pid", *[geo.taper(x, 10.0, k).alias(k) for k in ("cosine", "linear", "exponential")]), "cosine", "linear", "exponential")


def _channel(s: SparkSession, d: str) -> DataFrame:
    n = 14 + s.read.parquet(f"{d}/supplier.parquet").count() // 100
    return s.range(n).select(F.when(F.col("id") < 8, "main").otherwise("side").alias("branch"), F.col("id").cast("int").alias("seq"), (0.15 + F.col("id") * 0.031).alias("lon"), (50.2 + F.col("id") * 0.043).alias("lat"))


@query("stations", f"""w AS (SELECT CASE WHEN range < 8 THEN 'main' ELSE 'side' END AS branch, CAST(range AS INT) AS seq, 0.15::DOUBLE + range * 0.031::DOUBLE AS lon, 50.2::DOUBLE + range * 0.043::DOUBLE AS lat FROM (SELECT unnest(range(14 + count(*) // 100)) AS range FROM supplier)),
l AS (SELECT *, lag(lon) OVER q AS lon0, lag(lat) OVER q AS lat0 FROM w WINDOW q AS (PARTITION BY branch ORDER BY seq)), h AS (SELECT branch, seq, coalesce({_HAV.format(lat0='lat0', lon0='lon0', lat1='lat', lon1='lon')}, 0) AS back FROM l)
SELECT branch, seq, {e6('sum(back) OVER q', 's_m')}, {e6('(back + coalesce(lead(back) OVER q, 0)) / 2', 'dx_m')} FROM h WINDOW q AS (PARTITION BY branch ORDER BY seq)""")
def stations(s, d):
    return r6(morphology.stations(_channel(s, d)), "s_m", "dx_m").select("branch", "seq", "s_m", "dx_m")


@query("cross_sections", f"s2 AS (SELECT i // 12 AS seq, i * 25.0::DOUBLE AS x, depth FROM f WHERE j = 20 AND depth IS NOT NULL), l AS (SELECT *, lag(x) OVER w AS x0, lag(depth) OVER w AS d0 FROM s2 WINDOW w AS (PARTITION BY seq ORDER BY x)) SELECT seq, {e6('max(x) - min(x)', 'width_m')}, {e6('sum(coalesce((depth + d0) / 2 * (x - x0), 0))', 'area_m2')} FROM l GROUP BY seq")
def cross_sections(s, d):
    smp = fixture.fine(s, d).where("j = 20 and depth is not null").select(F.lit("b").alias("branch"), F.expr("cast(i div 12 as int)").alias("seq"), (F.col("i") * 25.0).alias("offset_m"), "depth")
    return r6(morphology.sections(smp), "width_m", "area_m2").select("seq", "width_m", "area_m2")


_RAYS = f"""w AS (SELECT CASE WHEN range < 8 THEN 'main' ELSE 'side' END AS branch, CAST(range AS INT) AS seq, 0.15::DOUBLE + range * 0.031::DOUBLE AS lon, 50.2::DOUBLE + range * 0.043::DOUBLE AS lat FROM (SELECT unnest(range(14 + count(*) // 100)) AS range FROM supplier)),
l AS (SELECT *, lag(lon) OVER q AS lon0, lag(lat) OVER q AS lat0, lead(lon) OVER q AS lon1, lead(lat) OVER q AS lat1 FROM w WINDOW q AS (PARTITION BY branch ORDER BY seq)),
az AS (SELECT *, coalesce(lon0, lon) AS xa, coalesce(lat0, lat) AS ya, coalesce(lon1, lon) AS xb, coalesce(lat1, lat) AS yb, coalesce({_HAV.format(lat0='lat0', lon0='lon0', lat1='lat', lon1='lon')}, 0) AS back, coalesce({_HAV.format(lat0='lat', lon0='lon', lat1='lat1', lon1='lon1')}, 0) AS onward FROM l),
sta AS (SELECT branch, seq, radians(lon) AS x, radians(lat) AS y, (back + onward) / 2 AS dx_m, sum(back) OVER (PARTITION BY branch ORDER BY seq) AS s_m, atan2(sin(radians(xb - xa)) * cos(radians(yb)), cos(radians(ya)) * sin(radians(yb)) - sin(radians(ya)) * cos(radians(yb)) * cos(radians(xb - xa))) AS azimuth FROM az),
ry AS (SELECT branch, seq, side, k, x, y, azimuth + side * radians(90::DOUBLE) AS b, k * 500.0::DOUBLE / 6371000 AS a, asin(least(1, greatest(-1, sin(y) * cos(k * 500.0::DOUBLE / 6371000) + cos(y) * sin(k * 500.0::DOUBLE / 6371000) * cos(azimuth + side * radians(90::DOUBLE))))) AS t
 FROM sta, (SELECT unnest([-1, 1]) AS side), (SELECT range AS k FROM range(15)) WHERE k > 0 OR side = 1),
pt AS MATERIALIZED (SELECT branch, seq, side, k, degrees(t) AS lat, degrees(x + atan2(sin(b) * sin(a) * cos(y), cos(a) - sin(y) * sin(t))) AS lon FROM ry),
sc AS (SELECT cos(radians(avg(lat))) AS s FROM f),
nf AS (SELECT branch, seq, side, k, min_by(f.j * 96 + f.i, (pow((f.lon - pt.lon) * s, 2) + pow(f.lat - pt.lat, 2), f.j, f.i)) AS id FROM pt JOIN f ON abs(f.lat - pt.lat) <= 0.03 AND abs(f.lon - pt.lon) <= 0.06 JOIN sc ON pow((f.lon - pt.lon) * s, 2) + pow(f.lat - pt.lat, 2) <= 0.0009 GROUP BY ALL),
dp AS (SELECT pt.*, f.depth FROM pt LEFT JOIN nf USING (branch, seq, side, k) LEFT JOIN f ON f.j * 96 + f.i = nf.id),
kp AS (SELECT branch, seq, side * k * 500.0::DOUBLE AS offs, greatest(coalesce(depth, 0), 0) AS depth FROM dp QUALIFY sum(CASE WHEN depth IS NULL AND k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY branch, seq, side ORDER BY k) = 0),
tz AS (SELECT *, (depth + lag(depth) OVER o) / 2 * (offs - lag(offs) OVER o) AS part FROM kp WINDOW o AS (PARTITION BY branch, seq ORDER BY offs)),
ar AS (SELECT branch, seq, sum(coalesce(part, 0)) AS area_m2 FROM tz GROUP BY branch, seq),
vo AS (SELECT sta.branch, sta.seq, s_m, area_m2, coalesce(area_m2 * dx_m, 0) AS volume_m3 FROM sta LEFT JOIN ar USING (branch, seq))"""


@query("morphology", f"{_RAYS} SELECT branch, seq, {e6('s_m', 's_m')}, {e6('area_m2', 'area_m2')}, round_even(volume_m3, 0) AS volume_m3, round_even(sum(volume_m3) OVER (PARTITION BY branch ORDER BY seq), 0) AS cumvol_m3 FROM vo")
def compute_morphology(s, d):
    out = r6(morphology.compute(_channel(s, d), fixture.fine(s, d), 500.0, 6000.0, 0.03), "area_m2", "s_m")
    return out.select("branch", "seq", "s_m", "area_m2", F.bround("volume_m3", 0).alias("volume_m3"), F.bround("cumvol_m3", 0).alias("cumvol_m3"))


@query("branch_volumes", f"{_RAYS} SELECT branch, count(*) AS n_stations, round_even(sum(volume_m3), 0) AS volume_m3, {e6('max(s_m)', 'length_m')} FROM vo GROUP BY branch")
def branch_volumes(s, d):
    out = morphology.branch_volumes(morphology.compute(_channel(s, d), fixture.fine(s, d), 500.0, 6000.0, 0.03))
    return r6(out, "length_m").withColumn("volume_m3", F.bround("volume_m3", 0))


# --- comparison and output


_CMP = "b AS (SELECT j, i, CASE WHEN wet_fraction >= 0.5 AND depth IS NOT NULL THEN depth + i % 3 END AS depth, CASE WHEN wet_fraction >= 0.5 AND depth IS NOT NULL THEN 1 ELSE 0 END AS mask FROM k), x AS (SELECT c.j, c.i, CASE WHEN c.mask = 1 AND b.mask = 1 THEN 1 WHEN c.mask = 1 THEN 2 WHEN b.mask = 1 THEN 3 ELSE 0 END AS code, CASE WHEN c.mask = 1 AND b.mask = 1 THEN c.depth - b.depth END AS difference FROM c JOIN b ON c.j = b.j AND c.i = b.i)"


def _compared(s: SparkSession, d: str) -> DataFrame:
    other = fixture.coarse(s, d, 0.5).withColumn("depth", F.col("depth") + F.col("i") % 3)
    return regrid.compare(fixture.coarse(s, d), other)


@query("source_comparison", f"{_CMP} SELECT j, i, code, {e6('difference', 'difference')} FROM x")
def source_comparison(s, d):
    return r6(_compared(s, d), "difference")


@query("depth_diff_stats", f"{_CMP} SELECT count(difference) AS n, {e6('avg(difference)', 'mean')}, {e6('stddev_pop(difference)', 'std')}, {e6('sqrt(avg(difference * difference))', 'rmse')}, {e6('greatest(quantile_cont(abs(difference), 0.99), 0.1)', 'vmax')} FROM x")
def depth_diff_stats(s, d):
    return r6(regrid.difference_stats(_compared(s, d)), "mean", "std", "rmse", "vmax")


@query("mask_counts", f"{_CMP} SELECT code, count(*) AS n FROM x GROUP BY code")
def mask_counts(s, d):
    return _compared(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("final_dataset", f"""{PTS}, n AS (SELECT pid, min_by(c.id, ({D2}, c.id)) AS id FROM p CROSS JOIN c GROUP BY pid), fx AS (SELECT id, max(pid) AS pid FROM n GROUP BY id),
w AS MATERIALIZED (SELECT c.id, j, i, CASE WHEN pid IS NULL THEN depth ELSE pid % 40 + 1.5::DOUBLE END AS depth FROM c LEFT JOIN fx ON c.id = fx.id WHERE CASE WHEN pid IS NULL THEN mask = 1 ELSE pid % 2 = 0 END),
e AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM w a JOIN w b ON (a.j = b.j AND abs(a.i - b.i) = 1) OR (a.i = b.i AND abs(a.j - b.j) = 1)),
lab(id, l) AS (SELECT id, id FROM w UNION SELECT e.t, lab.l FROM lab JOIN e ON e.s = lab.id WHERE lab.l < e.t),
comp AS MATERIALIZED (SELECT id, min(l) AS label FROM lab GROUP BY id){_RANKS},
x AS MATERIALIZED (SELECT w.id, w.depth FROM w JOIN comp ON w.id = comp.id JOIN r ON r.label = comp.label WHERE basin_rank = 1),
en(id, v) AS (SELECT id, depth FROM x UNION SELECT e.t, en.v / 1.5::DOUBLE FROM en JOIN e ON e.s = en.id JOIN x ON x.id = e.t WHERE en.v / 1.5::DOUBLE > x.depth),
sm AS (SELECT c.j, c.i, c.depth AS raw, c.wet_fraction, x.depth AS fixed, comp.label, (SELECT max(v) FROM en WHERE en.id = c.id) AS depth FROM c LEFT JOIN x ON c.id = x.id LEFT JOIN comp ON c.id = comp.id),
l AS (SELECT *, lead(j) OVER a AS ej, lead(depth) OVER a AS ed, lead(j) OVER b AS nj, lead(depth) OVER b AS nd FROM sm WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))
SELECT j, i, CASE WHEN fixed IS NULL THEN 0 ELSE 1 END AS mask, CAST(label AS BIGINT) AS label, {e6('depth', 'depth_rx0_0p20')}, {e6(_FACE.format(n='e'), 'depth_u')}, {e6(_FACE.format(n='n'), 'depth_v')}, {e6('raw', 'depth_raw')}, {e6('wet_fraction', 'wet_fraction')}, {e6('fixed', 'depth_fixes')} FROM l""", True)
def final_dataset(s, d):
    raw = fixture.coarse(s, d)
    fixed = basins.mask_isolated(fixes.apply_absolute(raw, _fixes(s, d, "set_depth", "mask_cell")), 1)
    out = regrid.cgrid_faces(smooth.envelope(fixed, 0.2)).select("j", "i", "mask", "label", F.col("depth").alias("depth_rx0_0p20"), "depth_u", "depth_v")
    out = out.join(raw.select("j", "i", F.col("depth").alias("depth_raw"), "wet_fraction"), ["j", "i"]).join(fixed.select("j", "i", F.col("depth").alias("depth_fixes")), ["j", "i"])
    return r6(out, "depth_rx0_0p20", "depth_u", "depth_v", "depth_raw", "depth_fixes", "wet_fraction").withColumn("mask", F.col("mask").cast("int"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return regrid_clamped(s, d)
