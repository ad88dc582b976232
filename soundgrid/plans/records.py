"""Queries of corrections in order, routes' rules, names, summaries and tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import basins, boundary, fixes, grids, morphology, smooth, thalweg
from ..sources import fixture
from ..tables import numbered
from .queries import D2, KK, PATHS, POLYGON, PROFILE, PTS, REGIONS, _fixes, e6, finer, paths, query, r6, suppliers

# --- corrections

_NEAREST = f"{PTS}, n AS (SELECT pid, min_by(c.id, ({D2}, c.id)) AS id, sqrt(min({D2})) AS dist FROM p CROSS JOIN c GROUP BY pid)"

@query(
    "apply_fixes_absolute",
    f"""{_NEAREST}, l AS (SELECT id, max(pid) AS pid, list(CAST(pid AS DOUBLE) ORDER BY pid) AS ps FROM n GROUP BY id)
SELECT c.j, c.i, {e6('CASE WHEN pid % 3 = 2 THEN NULL WHEN pid IS NOT NULL THEN pid % 40 + 1.5::DOUBLE ELSE depth END', 'depth')}, CASE WHEN pid % 3 = 2 THEN 0 WHEN pid IS NOT NULL THEN 1 ELSE mask END AS mask,
  {e6('CASE WHEN pid IS NULL THEN wet_fraction ELSE list_reduce(list_prepend(CAST(wet_fraction AS DOUBLE), ps), lambda a, x: CASE WHEN x % 3 = 2 THEN 0.0 ELSE greatest(a, 0.01) END) END', 'wet_fraction')}
FROM c LEFT JOIN l ON c.id = l.id""",
)
def apply_fixes_absolute(s, d):
    out = fixes.apply_absolute(fixture.coarse(s, d), _fixes(s, d, "set_depth", "open_cell", "close_cell"))
    return r6(out, "depth", "wet_fraction").select("j", "i", "depth", F.col("mask").cast("int").alias("mask"), "wet_fraction")


_ROUND = "['set_depth', 'deepen_by', 'mask_cell', 'blend_cell']"


@query(
    "apply_fixes_sequential",
    f"""{_NEAREST}, fx AS (SELECT row_number() OVER (ORDER BY pid) AS k, id + 1 AS cell, {_ROUND}[pid % 4 + 1] AS act, pid % 40 + 1.5::DOUBLE AS v FROM n),
st AS (SELECT 0::BIGINT AS k, list(CAST(depth AS DOUBLE) ORDER BY id) AS d, list(mask ORDER BY id) AS m, list(CAST(wet_fraction AS DOUBLE) ORDER BY id) AS w FROM c
 UNION ALL SELECT st.k + 1,
  list_transform(d, lambda x, q: CASE WHEN q <> cell THEN x WHEN act = 'set_depth' THEN v WHEN act = 'mask_cell' THEN NULL WHEN act = 'deepen_by' THEN CASE WHEN x IS NOT NULL THEN greatest(x + v, 0) END
    ELSE coalesce(list_avg(list_transform(list_filter(range(1, 577), lambda y: y <> cell AND abs((y - 1) // 24 - (cell - 1) // 24) <= 1 AND abs((y - 1) % 24 - (cell - 1) % 24) <= 1 AND m[y] = 1 AND d[y] IS NOT NULL), lambda y: d[y])), x) END),
  list_transform(m, lambda x, q: CASE WHEN q <> cell OR act = 'blend_cell' THEN x WHEN act = 'mask_cell' THEN 0 ELSE 1 END),
  list_transform(w, lambda x, q: CASE WHEN q <> cell OR act = 'blend_cell' THEN x WHEN act = 'mask_cell' THEN 0 ELSE greatest(x, 0.01) END)
 FROM st JOIN fx ON fx.k = st.k + 1),
o AS (SELECT unnest(range(0, 576)) AS id, unnest(d) AS depth, unnest(m) AS mask, unnest(w) AS wet_fraction FROM st WHERE k = (SELECT max(k) FROM fx))
SELECT CAST(id // 24 AS INT) AS j, CAST(id % 24 AS INT) AS i, {e6('depth', 'depth')}, mask, {e6('wet_fraction', 'wet_fraction')} FROM o""",
    recursive=True,
)
def apply_fixes_sequential(s, d):
    out = fixes.apply(fixture.coarse(s, d), _fixes(s, d, "set_depth", "deepen_by", "mask_cell", "blend_cell"))
    return r6(out, "depth", "wet_fraction").select("j", "i", "depth", F.col("mask").cast("int").alias("mask"), "wet_fraction")


@query("applied_log", f"{_NEAREST} SELECT CAST(pid AS INT) AS ord, {_ROUND}[pid % 4 + 1] AS action, CAST(id // 24 AS INT) AS row, CAST(id % 24 AS INT) AS col, {e6('dist', 'distance_deg')}, CASE WHEN pid % 4 = 0 THEN pid % 40 + 1.5::DOUBLE END AS value FROM n")
def applied_log(s, d):
    out = fixes.applied_log(_fixes(s, d, "set_depth", "deepen_by", "mask_cell", "blend_cell"), fixture.coarse(s, d))
    return r6(out, "distance_deg").select("ord", "action", "row", "col", "distance_deg", "value")


@query("fix_table", f"""{PTS}, q AS (SELECT *, CASE WHEN pid % 4 < 2 THEN 0 ELSE pid % 4 - 1 END AS part FROM p), n AS (SELECT *, CAST(row_number() OVER (ORDER BY part, pid) - 1 AS INT) AS ord FROM q)
SELECT ord, lon, lat, CASE part WHEN 0 THEN 'set_depth' WHEN 1 THEN 'open_cell' ELSE 'blend_cell' END AS action, CASE part WHEN 0 THEN pid % 40 + 1.5::DOUBLE WHEN 1 THEN CAST(pid % 9 AS DOUBLE) END AS value FROM n WHERE part > 0 OR pid % 3 = 0""")
def fix_table(s, d):
    """A list of all three forms: single fixes, a route's group and phantom islands."""
    rows = suppliers(s, d).orderBy("pid").collect()  # a list that people edit
    spec = {f"b{r.pid}": {"lon": r.lon, "lat": r.lat, "value": r.pid % 40 + 1.5, "applied": r.pid % 3 == 0, "_note": "seen"} for r in rows if r.pid % 4 < 2}
    spec["tw_sound"] = {"applied": True} | {f"{r.pid:06d}": {"lon": r.lon, "lat": r.lat, "action": "open_cell", "depth": r.pid % 9} for r in rows if r.pid % 4 == 2}
    spec["phantom_islands"] = {"applied": True} | {f"{r.pid:06d}": {"lon": r.lon, "lat": r.lat, "action": "blend_cell"} for r in rows if r.pid % 4 == 3}
    listed = fixes.load(spec)
    return fixes.table(s, fixes.resolve([f["key"] for f in listed], listed), applied_only=True)


# --- regions and basins

_POLY = ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(POLYGON))
_HIT = f"""v AS (SELECT * FROM (VALUES {_POLY}) AS t(n, x, y)), ed AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.n = (a.n + 1) % {len(POLYGON)}),
ins AS (SELECT c.id FROM c CROSS JOIN ed WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY c.id HAVING count(*) % 2 = 1),
hit AS (SELECT j, i, id, CASE WHEN lon BETWEEN 0.2 AND 0.6 AND lat BETWEEN 50.3 AND 50.7 THEN 0 WHEN id IN (SELECT id FROM ins) THEN 1
  WHEN id = (SELECT min_by(id, (pow(lon - 2.013, 2) + pow(lat - 52.017, 2), id)) FROM c) THEN 2 WHEN i >= 20 AND j <= 3 THEN 3 WHEN i = 0 AND j = 23 THEN 4 END AS ord FROM c WHERE mask = 1)"""


@query("apply_regions", f"{_HIT} SELECT c.j, c.i, CASE WHEN ord IS NOT NULL THEN 0 ELSE mask END AS mask, {e6('CASE WHEN ord IS NULL THEN depth END', 'depth')}, {e6('CASE WHEN ord IS NOT NULL THEN 0 ELSE wet_fraction END', 'wet_fraction')} FROM c LEFT JOIN hit ON c.id = hit.id")
def apply_regions(s, d):
    return r6(basins.apply_regions(fixture.coarse(s, d), REGIONS), "depth", "wet_fraction").select("j", "i", F.col("mask").cast("int").alias("mask"), "depth", "wet_fraction")


@query("region_summary", f"{_HIT} SELECT CAST(r.range AS INT) AS ord, count(hit.id) AS n_masked FROM range(0, 5) r LEFT JOIN hit ON hit.ord = r.range GROUP BY 1")
def region_summary(s, d):
    return basins.region_summary(fixture.coarse(s, d), REGIONS)


@query("regions_short_polygon", f"t AS (SELECT * FROM (VALUES (0.55::DOUBLE, 50.34::DOUBLE), (1.21::DOUBLE, 51.07::DOUBLE)) AS t(x, y)) SELECT DISTINCT j, i FROM c WHERE mask = 1 AND id IN (SELECT min_by(c.id, (pow(c.lon - x, 2) + pow(c.lat - y, 2), c.id)) FROM t CROSS JOIN c GROUP BY x, y)")
def regions_short_polygon(s, d):
    return basins.region_cells(fixture.coarse(s, d), [{"type": "polygon", "vertices": [(0.55, 50.34), (1.21, 51.07)]}]).select("j", "i")


# --- grids and names


@query("vector_rotation", f"SELECT pid, {e6('lon * cos(radians(pid % 90)) + lat * sin(radians(pid % 90))', 'u')}, {e6('lat * cos(radians(pid % 90)) - lon * sin(radians(pid % 90))', 'v')} FROM (SELECT s_suppkey AS pid, CAST(s_suppkey * 37 % 240 AS DOUBLE) / 100 + 0.0031::DOUBLE AS lon, 50::DOUBLE + CAST(s_suppkey * 53 % 240 AS DOUBLE) / 100 + 0.0017::DOUBLE AS lat FROM supplier)")
def vector_rotation(s, d):
    u, v = geo.rotate_vector("lon", "lat", F.col("pid") % 90)
    return r6(suppliers(s, d).select("pid", u.alias("u"), v.alias("v")), "u", "v")


@query("grid_built", f"{KK}, g0 AS (SELECT k, 2.0::DOUBLE / k AS dlat, round(2.0::DOUBLE / k / cos(radians(52.0)), 6) AS dlon FROM kk), n AS (SELECT k, dlat, dlon, CAST(round(4.0 / dlon) AS INT) + 1 AS nx FROM g0), x AS (SELECT unnest(range(nx)) AS i, dlon FROM n), y AS (SELECT unnest(range(2 * k + 1)) AS j, dlat FROM n) SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, {e6('i * dlon', 'lon')}, {e6('50 + j * dlat', 'lat')} FROM x CROSS JOIN y")
def grid_built(s, d):
    grid = grids.build(s, {"type": "spherical", "lon_min": 0.0, "lon_max": 4.0, "lat_min": 50.0, "lat_max": 54.0, "dlat": 2.0 / finer(s, d)})
    return r6(grid.select("j", "i", "lon", "lat"), "lon", "lat")


@query("grid_perimeter", f"SELECT CASE WHEN j = 0 THEN i WHEN i = 23 THEN 23 + j WHEN j = 23 THEN 69 - i ELSE 92 - j END AS seq, {e6('lon', 'lon')}, {e6('lat', 'lat')} FROM c WHERE j IN (0, 23) OR i IN (0, 23)")
def grid_perimeter(s, d):
    return r6(grids.perimeter(fixture.coarse(s, d)), "lon", "lat").select(F.col("seq").cast("int").alias("seq"), "lon", "lat")


@query("grid_resolution", f"SELECT {e6('least((SELECT avg(x) FROM (SELECT lead(lon) OVER (ORDER BY i) - lon AS x FROM f WHERE j = 48)), (SELECT avg(y) FROM (SELECT lead(lat) OVER (ORDER BY j) - lat AS y FROM f WHERE i = 48)))', 'degrees')}")
def grid_resolution(s, d):
    return r6(grids.resolution(fixture.fine(s, d)), "degrees")


@query("grid_summary", f"q AS (SELECT max(i) + 1 AS nx, max(j) + 1 AS ny, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM c) SELECT nx, ny, {e6('x0', 'lon_min')}, {e6('x1', 'lon_max')}, {e6('y0', 'lat_min')}, {e6('y1', 'lat_max')}, {e6(f'(x1 - x0) / (nx - 1) * {geo.KM_PER_DEG} * cos(radians((y0 + y1) / 2))', 'dx_km')}, {e6(f'(y1 - y0) / (ny - 1) * {geo.KM_PER_DEG}', 'dy_km')}, FALSE AS square FROM q")
def grid_summary(s, d):
    return r6(grids.summary(fixture.coarse(s, d)), "lon_min", "lon_max", "lat_min", "lat_max", "dx_km", "dy_km")


@query(
    "names",
    r"""SELECT s_suppkey AS pid, trim(regexp_replace(lower(h), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(replace(replace(replace(h, ' ', '_'), '→', '-'), '[', ''), ']', '') AS safe_name,
  '#' || replace(regexp_replace(lower(h), '[^\w\- ]', '', 'g'), ' ', '-') AS anchor, 'auto_' || printf('%.2f', abs(x)) || CASE WHEN x >= 0 THEN 'E' ELSE 'W' END || '_' || printf('%.2f', y) || 'N' AS corridor,
  'depth_rx0_' || replace(printf('%.2f', s_suppkey % 7 / 10.0), '.', 'p') AS smooth,
  CASE s_suppkey % 5 WHEN 0 THEN 'boundary' WHEN 1 THEN 'waypoint' WHEN 2 THEN 'strait' WHEN 3 THEN 'ok' ELSE '?' END AS mode
FROM (SELECT s_suppkey, s_name || ' → [' || n_name || '], No. ' || s_nationkey AS h, s_suppkey * 37 % 24 - 11.7 AS x, 50.03 + s_suppkey * 53 % 24 AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
)
def names(s, d):
    pid = F.col("s_suppkey")
    both = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    h = both.select(pid.alias("pid"), F.concat("s_name", F.lit(" → ["), "n_name", F.lit("], No. "), F.col("s_nationkey").cast("string")).alias("h"), (pid * 37 % 24 - 11.7).alias("x"), (pid * 53 % 24 + 50.03).alias("y"))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("pid") % 5 + 1).cast("int"))
    return h.select("pid", geo.slug("h").alias("slug"), geo.safe_name("h").alias("safe_name"), geo.anchor("h").alias("anchor"), geo.corridor_name("x", "y").alias("corridor"), geo.smooth_name(F.col("pid") % 7 / 10.0).alias("smooth"), geo.mode_label(pick("AUTO", "WAYPOINT", "OK", "OK", ""), pick("", "", "U", "", "")).alias("mode"))


@query("log_depth", f"SELECT j, i, {e6('CASE WHEN depth - 5 > 0 THEN log10(depth - 5) END', 'log_depth')} FROM f")
def log_depth(s, d):
    return r6(fixture.fine(s, d).select("j", "i", geo.log_depth(F.col("depth") - 5).alias("log_depth")), "log_depth")


# --- slopes


@query("rx0_verdict", "l AS (SELECT depth, lead(depth) OVER a AS e, lead(depth) OVER b AS n FROM c WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)), x AS (SELECT round_even(greatest(coalesce(max(abs(depth - e) / (depth + e)), 0), coalesce(max(abs(depth - n) / (depth + n)), 0)), 6) AS r FROM l) SELECT t AS target, r + 0::DOUBLE AS max_rx0, CASE WHEN r <= t + 1e-6 THEN 'OK' ELSE 'VIOLATED' END AS status FROM x CROSS JOIN (SELECT unnest([0.95::DOUBLE, 0.4, 0.2]) AS t)")
def rx0_verdict(s, d):
    return r6(smooth.verdict(fixture.coarse(s, d), [0.2, 0.4, 0.95, 0.4]), "max_rx0")


# --- routes


@query("start_cells_on_axes", "SELECT s_suppkey AS pid, CAST(least(95, greatest(0, round((50::DOUBLE + CAST(s_suppkey * 53 % 240 AS DOUBLE) / 100 + 0.0017 - 50.0125) / 0.025))) AS INT) AS j, CAST(least(95, greatest(0, round((CAST(s_suppkey * 37 % 240 AS DOUBLE) / 100 + 0.0031 - 0.0125) / 0.025))) AS INT) AS i FROM supplier")
def start_cells_on_axes(s, d):
    return thalweg.on_axes(suppliers(s, d), fixture.fine(s, d)).select("pid", "j", "i")


_ALONG = "b AS (SELECT 0 AS e, j * 1000 + i AS seq, j, i, depth FROM f WHERE i = 2 AND j < 60 UNION ALL SELECT 1, i, j, i, depth FROM f WHERE j = 40 AND i BETWEEN 4 AND 26)"


@query(
    "wet_starts",
    f"""{_ALONG}, wr AS (SELECT *, sum(CASE WHEN depth IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY seq) AS run FROM b),
r AS (SELECT e, run, max(depth) AS depth, min_by([j, i], (-depth, seq)) AS pl FROM wr WHERE depth IS NOT NULL GROUP BY e, run),
n AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY run) - 1 AS segment, count(*) OVER (PARTITION BY e) AS k FROM r)
SELECT 'bdy' || e || CASE WHEN k > 1 THEN '_' || segment ELSE '' END AS edge, segment, pl[1] AS j, pl[2] AS i, depth FROM n""",
)
def wet_starts(s, d):
    f = fixture.fine(s, d)
    west = f.where("i = 2 and j < 60").select(F.lit(0).alias("edge_no"), (F.col("j") * 1000 + F.col("i")).alias("seq"), "lon", "lat")
    row = f.where("j = 40 and i between 4 and 26").select(F.lit(1).alias("edge_no"), F.col("i").alias("seq"), "lon", "lat")
    return thalweg.wet_starts(west.unionByName(row), f)


@query("deepest_in_box", "o AS (SELECT s_suppkey AS pid, CAST(s_suppkey * 29 % 96 AS INT) AS cj, CAST(s_suppkey * 41 % 96 AS INT) AS ci FROM supplier) SELECT pid, min_by(j, k) AS j, min_by(i, k) AS i, min_by(depth, k) AS depth FROM (SELECT pid, j, i, depth, (NOT (lon BETWEEN 0.3 AND 2.0 AND lat BETWEEN 50.2 AND 52.0), -depth, j, i) AS k FROM o JOIN f ON abs(j - cj) <= 20 AND abs(i - ci) <= 20 WHERE depth IS NOT NULL) GROUP BY pid")
def deepest_in_box(s, d):
    f = fixture.fine(s, d)
    at = suppliers(s, d).select("pid", F.expr("cast(pid * 29 % 96 as int)").alias("j"), F.expr("cast(pid * 41 % 96 as int)").alias("i")).join(f.select("j", "i", "lon", "lat"), ["j", "i"]).select("pid", "lon", "lat")
    return thalweg.deepest_in_box(at, f, (0.3, 2.0, 50.2, 52.0))


_ROUTES = "rt AS (SELECT l_orderkey % 50 AS g, 'e' || (l_partkey % 3) AS edge_a, 'e' || (l_suppkey % 3) AS edge_b, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, l_quantity AS sill_depth, l_linenumber * 2 AS n, l_partkey % 4 AS n_inside, l_quantity * 3 AS length_km, l_suppkey % 30 AS direct_km FROM lineitem)"


def _routes(lines):
    edge = lambda c: F.concat(F.lit("e"), (F.col(c) % 3).cast("string"))
    return lines.withColumns({"edge_a": edge("l_partkey"), "edge_b": edge("l_suppkey"), "sill_depth": F.col("l_quantity"), "n": F.col("l_linenumber") * 2, "n_inside": F.col("l_partkey") % 4, "length_km": F.col("l_quantity") * 3, "direct_km": F.col("l_suppkey") % 30})


def _lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("crossing_routes", f"{_ROUTES} SELECT edge_a, edge_b, count(*) AS n, sum(sill_depth) AS depths FROM rt WHERE n >= 5 AND sill_depth >= 10 AND n_inside >= 2 AND (direct_km = 0 OR length_km <= 3 * direct_km) GROUP BY ALL")
def crossing_routes(s, d):
    return thalweg.crossing(_routes(_lines(s, d)), 10.0, 3.0).groupBy("edge_a", "edge_b").agg(F.count(F.lit(1)).alias("n"), F.sum("sill_depth").alias("depths"))


@query("distinct_sills", f"{_ROUTES}, pr AS (SELECT least(edge_a, edge_b) AS lo, greatest(edge_a, edge_b) AS hi, list([CAST(ord AS DOUBLE), CAST(sill_depth AS DOUBLE)] ORDER BY ord) AS a FROM rt GROUP BY 1, 2), kp AS (SELECT unnest(list_reduce(list_prepend(CAST([] AS DOUBLE[][]), list_transform(a, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k[2] - x[1][2]) < 2)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM pr) SELECT CAST(k[1] AS INT) AS ord, k[2] AS sill_depth FROM kp")
def distinct_sills(s, d):
    lines = numbered(_lines(s, d), "ord", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return thalweg.distinct_sills(_routes(lines)).select(F.col("ord").cast("int").alias("ord"), "sill_depth")


@query("corridors_not_manual", "q AS (SELECT CAST(j // 6 * 4 + i // 6 AS INT) AS corridor, lon, lat FROM c), m AS (SELECT corridor, avg(lon) AS lon, avg(lat) AS lat FROM q GROUP BY corridor) SELECT corridor FROM m WHERE NOT (abs(lon - 2.1) < 0.35 AND abs(lat - 52.1) < 0.35) AND NOT (abs(lon - 0.3) < 0.35 AND abs(lat - 51.9) < 0.35) AND corridor NOT IN (SELECT corridor FROM q WHERE lon BETWEEN 0.5 AND 1.0 AND lat BETWEEN 50.2 AND 50.4)")
def corridors_not_manual(s, d):
    q = fixture.coarse(s, d).select(F.expr("cast(j div 6 * 4 + i div 6 as int)").alias("corridor"), "lon", "lat")
    m = q.groupBy("corridor").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return thalweg.without_manual(m, q, [{"bbox": [0.5, 1.0, 50.2, 50.4]}, {"begin": [2.1, 52.1], "via": [[0.3, 51.9]]}], 0.35).select("corridor")


_SAMPLED = PROFILE + ", cs AS (SELECT *, CASE WHEN seq % 5 <> 3 THEN depth - 4 + seq % 7 END AS coarse_depth FROM prof), sl AS (SELECT name, min(depth) AS s, min_by(dist_km, (depth, seq)) AS sill_km FROM prof WHERE depth > 0 GROUP BY name)"


def _sampled(s, d):
    return thalweg.profile(paths(s, d)).withColumn("coarse_depth", F.when(F.col("seq") % 5 != 3, F.col("depth") - 4 + F.col("seq") % 7))


@query("compare_sills", f"{_SAMPLED}, cl AS (SELECT name, min(coarse_depth) AS cs FROM cs WHERE coarse_depth > 0 GROUP BY name) SELECT sl.name, s AS fine_sill, cs AS coarse_sill, s - cs AS sill_deficit_m, CASE WHEN cs / s IS NULL THEN 'WAYPOINT' WHEN cs / s < 0.7 THEN 'SILL_DEFICIT' ELSE 'OK' END AS category FROM sl LEFT JOIN cl ON sl.name = cl.name")
def compare_sills(s, d):
    return thalweg.compare_sills(_sampled(s, d))


@query("route_summary", f"{_SAMPLED}, r AS (SELECT s - seq % 9 AS x, seq % 6 = 1 AS failed FROM cs JOIN sl USING (name)) SELECT count_if(NOT failed) AS n_paths, count_if(failed) AS n_failed, max(x) FILTER (WHERE NOT failed) AS max_deficit, {e6('avg(x) FILTER (WHERE NOT failed)', 'mean_deficit')}, count_if(NOT failed AND x < 0) AS n_coarse_deeper FROM r")
def route_summary(s, d):
    p = _sampled(s, d)
    r = p.join(thalweg.sill(p), "name").select((F.col("sill_depth") - F.col("seq") % 9).alias("sill_deficit_m"), (F.col("seq") % 6 == 1).alias("failed"))
    return r6(thalweg.summary(r), "mean_deficit")


@query("sill_point", f"{_SAMPLED}, at0 AS (SELECT name, min_by(seq, (abs(dist_km - sill_km), seq)) AS q FROM prof JOIN sl USING (name) GROUP BY name) SELECT name, seq, CASE WHEN seq = q THEN 1 ELSE 0 END AS is_sill FROM prof JOIN at0 USING (name)")
def sill_point(s, d):
    p = thalweg.profile(paths(s, d))
    return thalweg.sill_point(p, thalweg.sill(p)).select("name", "seq", "is_sill")


@query("route_csv", f"{_SAMPLED}, at0 AS (SELECT name, min_by(seq, (abs(dist_km - sill_km), seq)) AS q FROM prof JOIN sl USING (name) GROUP BY name) SELECT name, row_number() OVER (PARTITION BY name ORDER BY seq) - 1 AS index, printf('%.6f', lon) AS lon, printf('%.6f', lat) AS lat, printf('%.2f', depth) AS fine_depth, coalesce(printf('%.2f', CAST(coarse_depth AS DOUBLE)), '') AS coarse_depth, CASE WHEN seq = q THEN 1 ELSE 0 END AS is_sill FROM cs JOIN at0 USING (name)")
def route_csv(s, d):
    p = _sampled(s, d)
    return thalweg.csv_rows(p, thalweg.sill(p)).drop("dist_km")


@query("boundary_csv_cells", f"{_NEAREST} SELECT DISTINCT j, i, {e6('depth', 'depth')} FROM c JOIN n ON c.id = n.id WHERE mask = 1")
def boundary_csv_cells(s, d):
    return r6(boundary.csv_cells(suppliers(s, d).withColumnRenamed("pid", "seq"), fixture.coarse(s, d)), "depth")


@query("stations_csv", f"{PATHS} SELECT name AS branch, row_number() OVER (PARTITION BY name ORDER BY seq) AS station, printf('%.6f', lon) AS lon, printf('%.6f', lat) AS lat, printf('%.3f', seq * 1250 / 1000.0) AS s_km, printf('%.1f', depth * 10) AS width_m, printf('%.1f', depth * depth) AS area_m2, printf('%.1f', 1250.0) AS dx_m, printf('%.6f', depth * depth * 1250 / 1e6) AS \"volume_Mm3\", printf('%.6f', depth * 250 / 1e6) AS \"cumvol_Mm3\" FROM path")
def stations_csv(s, d):
    p = paths(s, d)
    return morphology.csv_rows(p.select(F.col("name").alias("branch"), "seq", "lon", "lat", (F.col("seq") * 1250.0).alias("s_m"), (F.col("depth") * 10).alias("width_m"), (F.col("depth") * F.col("depth")).alias("area_m2"), F.lit(1250.0).alias("dx_m"), (F.col("depth") * F.col("depth") * 1250).alias("volume_m3"), (F.col("depth") * 250).alias("cumvol_m3")))
