"""Queries of regridding onto rotated, rotated-pole and curvilinear grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import conservative, grids, regrid
from ..sources import fixture
from ..tables import written
from .queries import e6, query, r6


def _onto_sql(nx: int, ny: int, lon: str, lat: str) -> str:
    """Regridding onto cells whose corner in row {y} and column {x} is at lon, lat: area of the raster's cell under each side."""
    at = lambda e, a, b: e.replace("{x}", f"(i + {b})").replace("{y}", f"(j + {a})")
    corner = lambda k: ((0, 0), (0, 1), (1, 1), (1, 0))[k % 4]
    xs = ", ".join(at(lon, *corner(k)) for k in range(4))
    ys = ", ".join(at(lat, *corner(k)) for k in range(4))
    return f"""q AS MATERIALIZED (SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, [{xs}] AS xs, [{ys}] AS ys FROM (SELECT b.range AS j, a.range AS i FROM range({nx}) a CROSS JOIN range({ny}) b)),
ed AS (SELECT j, i, k, xs[k] AS xa, xs[k % 4 + 1] AS xb, sin(radians(ys[k])) AS ya, sin(radians(ys[k % 4 + 1])) AS yb FROM q, (SELECT range AS k FROM range(1, 5))),
sz AS (SELECT j, i, abs(sum(xa * yb - xb * ya)) / 2 AS size FROM ed GROUP BY ALL),
pr AS (SELECT q.j, q.i, f.j AS sj, f.i AS si, f.depth, f.lon - 0.0125::DOUBLE AS x0, f.lon + 0.0125::DOUBLE AS x1, sin(radians(f.lat - 0.0125::DOUBLE)) AS y0, sin(radians(f.lat + 0.0125::DOUBLE)) AS y1
 FROM q JOIN f ON f.lon + 0.0125 > list_min(xs) AND f.lon - 0.0125 < list_max(xs) AND f.lat + 0.0125 > list_min(ys) AND f.lat - 0.0125 < list_max(ys)),
uv AS (SELECT pr.*, y1 - y0 AS h, xa, ya, least(greatest(xa, x0), x1) AS u, least(greatest(xb, x0), x1) AS v, coalesce((yb - ya) / nullif(xb - xa, 0), 0) AS slope FROM pr JOIN ed ON ed.j = pr.j AND ed.i = pr.i),
st AS (SELECT *, ya + slope * (u - xa) - y0 AS s, ya + slope * (v - xa) - y0 AS t FROM uv),
ov AS (SELECT j, i, sj, si, any_value(depth) AS depth, abs(sum((v - u) * CASE WHEN abs(t - s) < 1e-12 THEN least(greatest((s + t) / 2, 0), h)
  ELSE (pow(least(greatest(t, 0), h), 2) / 2 + h * greatest(t - h, 0) - pow(least(greatest(s, 0), h), 2) / 2 - h * greatest(s - h, 0)) / (t - s) END)) AS overlap FROM st GROUP BY j, i, sj, si),
wt AS (SELECT ov.*, overlap / size AS w FROM ov JOIN sz ON sz.j = ov.j AND sz.i = ov.i WHERE overlap / size > 1e-12),
rg AS (SELECT j, i, sum(CASE WHEN depth IS NOT NULL THEN w ELSE 0 END) AS wet_fraction, sum(w * coalesce(depth, 0)) AS total FROM wt GROUP BY j, i)
SELECT q.j, q.i, {e6('wet_fraction', 'wet_fraction')}, {e6('total / nullif(wet_fraction, 0)', 'depth')} FROM q LEFT JOIN rg ON rg.j = q.j AND rg.i = q.i"""


def _regridded(s, d: str, grid: DataFrame) -> DataFrame:
    out = conservative.regrid(fixture.fine(s, d).select("j", "i", "lon", "lat", "depth"), grid, fixture.STEP, fixture.STEP)
    return r6(out, "wet_fraction", "depth").select("j", "i", "wet_fraction", "depth")


_X, _Y = "((0.5::DOUBLE + {x} * 0.1::DOUBLE - 1.3) * cos(radians(51.2::DOUBLE)))", "(50.45::DOUBLE + {y} * 0.1::DOUBLE - 51.2)"
_ROTATED = f"1.3::DOUBLE + ({_X} * cos(radians(25::DOUBLE)) - {_Y} * sin(radians(25::DOUBLE))) / cos(radians(51.2::DOUBLE))", f"51.2::DOUBLE + {_X} * sin(radians(25::DOUBLE)) + {_Y} * cos(radians(25::DOUBLE))"


def _rotated(s) -> DataFrame:
    return grids.spherical(s, 0.55, 2.05, 50.5, 51.9, 0.1, 0.1, rotation=25)


@query("regrid_rotated", _onto_sql(16, 15, *_ROTATED))
def regrid_rotated(s, d):
    return _regridded(s, d, _rotated(s))


_T, _P, _PL = "radians(-0.8::DOUBLE + {x} * 0.1::DOUBLE)", "radians(-0.9::DOUBLE + {y} * 0.1::DOUBLE)", "radians(38.8::DOUBLE)"
_POLE = f"degrees(atan2(cos({_P}) * sin({_T}), sin({_PL}) * cos({_P}) * cos({_T}) - cos({_PL}) * sin({_P}))) + 1.2::DOUBLE", f"degrees(asin(greatest(-1, least(1, sin({_P}) * sin({_PL}) + cos({_P}) * cos({_T}) * cos({_PL})))))"


@query("regrid_rotated_pole", _onto_sql(16, 18, *_POLE))
def regrid_rotated_pole(s, d):
    return _regridded(s, d, grids.rotated_pole(s, *geo.pole_from_center(1.2, 51.2), -0.8, 0.8, -0.9, 0.9, 0.1))


_BENT = "0.2::DOUBLE + 0.07::DOUBLE * 2 * {x} + 0.03::DOUBLE * sin(0.6::DOUBLE * {y})", "50.2::DOUBLE + 0.06::DOUBLE * 2 * {y} + 0.03::DOUBLE * cos(0.4::DOUBLE * {x})"


def _bent(s) -> DataFrame:
    """A supergrid of bent lines."""
    pts = s.range(33 * 29).select(F.expr("cast(id div 29 as int)").alias("sj"), F.expr("cast(id % 29 as int)").alias("si"))
    return grids.curvilinear(pts.withColumns({"lon": 0.2 + 0.07 * F.col("si") + 0.03 * F.sin(0.3 * F.col("sj")), "lat": 50.2 + 0.06 * F.col("sj") + 0.03 * F.cos(0.2 * F.col("si"))}))


@query("regrid_curvilinear", _onto_sql(14, 16, *_BENT))
def regrid_curvilinear(s, d):
    return _regridded(s, d, _bent(s))


@query("regrid_kept_weights", _onto_sql(16, 15, *_ROTATED).rsplit("SELECT q.j", 1)[0] + f", mw AS (SELECT q.j, q.i, wet_fraction, total / nullif(wet_fraction, 0) AS depth FROM q LEFT JOIN rg ON rg.j = q.j AND rg.i = q.i) SELECT j, i, CASE WHEN wet_fraction >= 0.5 THEN 1 ELSE 0 END AS mask, {e6('CASE WHEN wet_fraction >= 0.5 THEN greatest(depth, 12) END', 'depth')} FROM mw")
def regrid_kept_weights(s, d):
    """The second use of the weights reads them."""
    fine, grid = fixture.fine(s, d).select("j", "i", "lon", "lat", "depth"), written(_rotated(s), "grid")
    conservative.kept_weights(s, fine, grid, fixture.STEP, fixture.STEP)
    w = conservative.kept_weights(s, fine, grid, fixture.STEP, fixture.STEP)
    return r6(regrid.mask_and_clamp(conservative.apply(w, fine, grid), 0.5, 12.0), "depth").select("j", "i", F.col("mask").cast("int").alias("mask"), "depth")


@query("grid_key", "SELECT substr(md5(concat_ws('_', count(*), max(j) + 1, max(i) + 1, printf('%.5f', min(lon)), printf('%.5f', max(lon)), printf('%.5f', min(lat)), printf('%.5f', max(lat)))), 1, 12) AS key FROM f")
def grid_key(s, d):
    return s.createDataFrame([(conservative.grid_key(fixture.fine(s, d)),)], "key string")
