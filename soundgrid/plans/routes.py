"""Queries of routes along straits, between boundaries and by waypoints, of their sills, and of volumes along channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import boundary, morphology, regrid, routes, straits, thalweg
from ..sources import fixture
from .queries import _HAV, _STRAITS, KM, PATHS, _channel, _stops, _straits, e6, paths, query, r6


def _fine(s, d: str) -> DataFrame:
    return fixture.fine(s, d).withColumn("id", (F.col("j") * fixture.N + F.col("i")).cast("long"))


# --- along straits

_ALONG = f"""{_STRAITS}, rk AS (SELECT *, CAST(list_position(['BLOCKED', 'SILL_DEFICIT', 'AREA_DEFICIT', 'OK'], category) AS BIGINT) AS rank, round_even(sill_coarse * (1 - sill_ratio), 6) AS sill_deficit FROM st),
tp AS MATERIALIZED (SELECT direction || '_' || j || '_' || i AS name, direction, lon AS x, lat AS y FROM rk ORDER BY rank, sill_deficit DESC, area_ratio, direction, j, i LIMIT 10),
ht AS (SELECT name, direction, x, y, CASE WHEN direction = 'U' THEN f.i ELSE f.j END AS seq, CASE WHEN direction = 'U' THEN f.j ELSE f.i END AS across, f.lon, f.lat, f.depth FROM tp JOIN f
 ON abs(f.lon - x) <= CASE WHEN direction = 'U' THEN 0.875 ELSE 1.0 END + 1e-9 AND abs(f.lat - y) <= CASE WHEN direction = 'U' THEN 1.0 ELSE 0.875 END + 1e-9),
lm AS (SELECT name, direction, x, y, seq, max(depth) AS deep, min(lon) AS lon0, min(lat) AS lat0, min_by(lon, (-depth, across)) FILTER (WHERE depth IS NOT NULL) AS lon1, min_by(lat, (-depth, across)) FILTER (WHERE depth IS NOT NULL) AS lat1 FROM ht GROUP BY name, direction, x, y, seq),
ln AS (SELECT name, direction, x, y, seq, deep AS depth, CASE WHEN direction = 'U' THEN lon0 ELSE coalesce(lon1, x) END AS lon, CASE WHEN direction = 'V' THEN lat0 ELSE coalesce(lat1, y) END AS lat FROM lm),
rt AS MATERIALIZED (SELECT *, CASE WHEN direction = 'U' THEN (lon - x) * cos(radians(y)) ELSE lat - y END * {KM} AS dist_km FROM ln QUALIFY count(*) OVER (PARTITION BY name) >= 3 AND count(depth) OVER (PARTITION BY name) >= 3)"""


def _along(s, d: str) -> DataFrame:
    top = straits.ranked(_straits(s, d), 10)
    return routes.along_straits(top, fixture.fine(s, d), fixture.STEP, fixture.STEP, 0.1, 0.1)


@query("strait_routes", f"{_ALONG} SELECT name, CAST(seq AS INT) AS seq, {e6('lon', 'lon')}, {e6('lat', 'lat')}, {e6('dist_km', 'dist_km')}, depth FROM rt", True)
def strait_routes(s, d):
    return r6(_along(s, d), "lon", "lat", "dist_km")


@query(
    "strait_route_records",
    f"""{_ALONG}, nr AS (SELECT name, seq, min_by(c.depth, ((c.lon - rt.lon) * (c.lon - rt.lon) + (c.lat - rt.lat) * (c.lat - rt.lat), c.j, c.i)) AS cd FROM rt JOIN c ON mask = 1 AND (c.lon - rt.lon) * (c.lon - rt.lon) + (c.lat - rt.lat) * (c.lat - rt.lat) <= 0.25 GROUP BY name, seq)
SELECT name, count(*) AS n, {e6('min(depth)', 'fine_sill')}, {e6('min_by(dist_km, (depth, seq)) FILTER (WHERE depth IS NOT NULL)', 'fine_sill_km')}, {e6('min(cd)', 'coarse_sill')}, {e6('min_by(dist_km, (cd, seq)) FILTER (WHERE cd IS NOT NULL)', 'coarse_sill_km')}, {e6('min(depth) - min(cd)', 'sill_deficit_m')},
 {e6('avg(abs(depth - cd))', 'mae')}, {e6('sqrt(avg((depth - cd) * (depth - cd)))', 'rmse')} FROM rt LEFT JOIN nr USING (name, seq) GROUP BY name""",
    True,
)
def strait_route_records(s, d):
    points = thalweg.sample(_along(s, d), fixture.coarse(s, d), 0.5)
    return r6(routes.records(points, positive=False).drop("length_km", "category"), "fine_sill", "fine_sill_km", "coarse_sill", "coarse_sill_km", "sill_deficit_m", "mae", "rmse")


# --- between boundaries: a flood carries the depth of the shallowest cell so far, so the largest at a cell is that of its deepest route

_STARTS = """u AS (SELECT 'W' AS edge, 1 AS en, j AS along, i AS perp, j, i, depth, lon, lat FROM c WHERE mask = 1 UNION ALL SELECT 'E', 2, j, 23 - i, j, i, depth, lon, lat FROM c WHERE mask = 1
 UNION ALL SELECT 'S', 3, i, j, j, i, depth, lon, lat FROM c WHERE mask = 1 UNION ALL SELECT 'N', 4, i, 23 - j, j, i, depth, lon, lat FROM c WHERE mask = 1),
ft AS (SELECT * FROM u WHERE perp <= 20 QUALIFY row_number() OVER (PARTITION BY edge, along ORDER BY perp) = 1),
br AS (SELECT *, along - lag(along) OVER (PARTITION BY edge, perp ORDER BY along) IS DISTINCT FROM 1 AS fresh, count(*) OVER (PARTITION BY edge, perp) AS hits FROM ft),
rn AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY edge, perp ORDER BY along) AS run FROM br WHERE hits >= 3),
dp AS (SELECT edge, en, perp, run, arg_max((lon, lat), (depth, -along)) AS d FROM rn GROUP BY edge, en, perp, run HAVING count(*) >= 3),
bs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY en, perp, run) AS ord, edge, d[1] AS lon, d[2] AS lat FROM dp),
cl AS (SELECT ord, edge, lon, lat, CAST(least(greatest(floor((lon + 0.001) / 0.025), 0), 95) AS INT) AS ci, CAST(least(greatest(floor((lat + 0.001 - 50) / 0.025), 0), 95) AS INT) AS cj FROM bs),
bx AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM c),
sn AS MATERIALIZED (SELECT ord, edge, max_by(f.j * 96 + f.i, (f.lon BETWEEN x0 AND x1 AND f.lat BETWEEN y0 AND y1, depth, -f.j, -f.i)) AS id FROM cl JOIN f ON depth IS NOT NULL AND f.j BETWEEN cj - 20 AND cj + 20 AND f.i BETWEEN ci - 20 AND ci + 20, bx GROUP BY ord, edge),
wt AS MATERIALIZED (SELECT f.j * 96 + f.i AS id, f.j, f.i, depth FROM f, bx WHERE depth IS NOT NULL AND f.lon BETWEEN x0 AND x1 AND f.lat BETWEEN y0 AND y1),
eg AS MATERIALIZED (SELECT a.id AS x, b.id AS y, b.depth FROM wt a JOIN wt b ON b.j BETWEEN a.j - 1 AND a.j + 1 AND b.i BETWEEN a.i - 1 AND a.i + 1 AND a.id <> b.id),
fl AS (SELECT ord, id, depth AS low FROM sn JOIN wt USING (id) UNION SELECT ord, eg.y, least(low, eg.depth) FROM fl JOIN eg ON fl.id = eg.x),
lo AS MATERIALIZED (SELECT ord, id, max(low) AS low FROM fl GROUP BY ord, id)"""


def _starts(s, d: str) -> DataFrame:
    found = boundary.boundary_starts(fixture.coarse(s, d), 20, 3).join(fixture.coarse(s, d).select("j", "i", "lon", "lat"), ["j", "i"])
    order = F.array_position(F.array(*[F.lit(e) for e in "WESN"]), F.col("edge"))
    from pyspark.sql import Window

    # off the middle between two raster cells, where the nearest would be a matter of rounding
    return found.select(F.row_number().over(Window.orderBy(order, "perp", "segment")).alias("ord"), "edge", "segment", (F.col("lon") + 0.001).alias("lon"), (F.col("lat") + 0.001).alias("lat"))


@query("boundary_route_sills", f"{_STARTS} SELECT CAST(a.ord AS INT) AS a, CAST(b.ord AS INT) AS b, lo.low AS sill FROM sn a JOIN sn b ON a.ord < b.ord JOIN lo ON lo.ord = a.ord AND lo.id = b.id WHERE a.id <> b.id", True)
def boundary_route_sills(s, d):
    """The sill of the deepest route between every two starts that are joined."""
    from ..operators import deepest

    fine, cells, starts = _fine(s, d), fixture.coarse(s, d), _starts(s, d)
    b = cells.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).first()
    at = thalweg.deepest_in_box(starts, fine, tuple(b), key="ord").join(fine.select("j", "i", "id"), ["j", "i"]).select("ord", "id")
    legs = at.select(F.col("ord").alias("p"), F.col("id").alias("a")).join(at.select(F.col("ord").alias("q"), F.col("id").alias("b")), F.expr("p < q and a <> b"))
    wet = fine.where("depth is not null").where(F.col("lon").between(b.x0, b.x1) & F.col("lat").between(b.y0, b.y1)).withColumn("graph", F.lit(0))
    found = deepest.paths(wet, legs.select(F.concat_ws("-", "p", "q").alias("leg"), F.lit(0).alias("graph"), "a", "b"), tile=32)
    out = found.join(fine.select("id", "depth"), "id").groupBy("leg").agg(F.min("depth").alias("sill"))
    return out.select(F.split("leg", "-")[0].cast("int").alias("a"), F.split("leg", "-")[1].cast("int").alias("b"), "sill")


@query("boundary_routes")
def boundary_routes(s, d):
    """Records of the routes that are kept."""
    _, kept = routes.between_boundaries(_fine(s, d), fixture.coarse(s, d), _starts(s, d), 0.625, min_sill=1.0)
    return r6(kept, "length_km", "fine_sill_km", "coarse_sill", "coarse_sill_km", "sill_deficit_m", "mae", "rmse", "direct_km")


@query("across_edges", f"{_STARTS.split('wt AS MATERIALIZED')[0].rstrip().rstrip(',')} SELECT a.id AS a, b.id AS b FROM sn a JOIN sn b ON a.ord < b.ord AND a.edge <> b.edge ORDER BY a.ord, b.ord LIMIT 1", True)
def across_edges(s, d):
    fine, cells, starts = _fine(s, d), fixture.coarse(s, d), _starts(s, d)
    b = cells.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).first()
    at = thalweg.deepest_in_box(starts, fine, tuple(b), key="ord").join(fine.select("j", "i", F.col("id").cast("int").alias("id")), ["j", "i"])
    return routes.across_edges(starts.select("ord", "edge").join(at.select("ord", "id"), "ord"))


# --- by waypoints


@query("waypoint_records")
def waypoint_records(s, d):
    more = s.createDataFrame([("one", 0, 1.0, 51.0), ("same", 0, 0.3, 50.3), ("same", 1, 0.3, 50.3)], "name string, seq int, lon double, lat double")
    _, out = routes.by_waypoints(_fine(s, d), fixture.coarse(s, d), _stops(s).unionByName(more), 0.5, 0.625)
    return r6(out, "length_km", "fine_sill_km", "coarse_sill", "coarse_sill_km", "sill_deficit_m", "mae", "rmse")


_NR = "nr{v} AS (SELECT name, seq, min_by({d}, ((c.lon - path.lon) * (c.lon - path.lon) + (c.lat - path.lat) * (c.lat - path.lat), c.id)) AS cd FROM path JOIN c ON mask = 1 AND (c.lon - path.lon) * (c.lon - path.lon) + (c.lat - path.lat) * (c.lat - path.lat) <= 0.0049 GROUP BY name, seq)"
_VR = "SELECT '{n}' AS variant, name, count(*) AS n, {s}, {m}, {r} FROM path LEFT JOIN nr{v} AS z USING (name, seq) GROUP BY name"


def _variant(v: int, n: str) -> str:
    return _VR.format(v=v, n=n, s=e6("min(cd)", "coarse_sill"), m=e6("avg(abs(depth - cd))", "mae"), r=e6("sqrt(avg((depth - cd) * (depth - cd)))", "rmse"))


@query("route_variants", f"{PATHS}, {_NR.format(v=1, d='c.depth')}, {_NR.format(v=2, d='greatest(c.depth, 18)')} {_variant(1, 'raw')} UNION ALL {_variant(2, 'clamped')}")
def route_variants(s, d):
    raw = fixture.coarse(s, d)
    clamped = regrid.mask_and_clamp(raw, 0.3, 18.0)
    points = paths(s, d).withColumn("dist_km", F.col("seq").cast("double"))
    return r6(routes.by_variant(points, {"raw": raw, "clamped": clamped}, 0.07), "coarse_sill", "mae", "rmse")


@query("route_modes", f"{_STRAITS}, md AS (SELECT unnest([direction, category]) AS category FROM st) SELECT category, CASE WHEN category IN ('U', 'V') THEN 'strait' ELSE lower(category) END AS mode, count(*) AS n FROM md GROUP BY category", True)
def route_modes(s, d):
    found = _straits(s, d).select(F.explode(F.array("direction", "category")).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", routes.mode(F.col("category")).alias("mode"), "n")
