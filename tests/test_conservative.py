"""Overlaps against clipping, and regridding against sums over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F
from soundgrid.operators import conservative, grids

CORNERS = conservative.CORNERS


def clipped(poly, box):
    """Sutherland and Hodgman's clipping of a polygon by a rectangle; its area."""
    x0, x1, y0, y1 = box
    for inside, cut in ((lambda p: p[0] >= x0, ("x", x0)), (lambda p: p[0] <= x1, ("x", x1)), (lambda p: p[1] >= y0, ("y", y0)), (lambda p: p[1] <= y1, ("y", y1))):
        out = []
        for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
            t = None
            if inside(a) != inside(b):
                k = 0 if cut[0] == "x" else 1
                t = (cut[1] - a[k]) / (b[k] - a[k])
            if inside(a):
                out.append(a)
            if t is not None:
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        poly = out
        if not poly:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1], strict=True))) / 2


def test_overlap_is_the_clipped_area(spark):
    rnd, rows = random.Random(5), []
    for k in range(400):
        cx, cy, a = rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(0, 6.3)
        w, h = rnd.uniform(0.05, 1.5), rnd.uniform(0.05, 1.5)
        a = 0.0 if k % 5 == 0 else a
        quad = [(cx + u * math.cos(a) - v * math.sin(a), cy + u * math.sin(a) + v * math.cos(a)) for u, v in ((-w, -h), (w, -h * 0.8), (w * 0.9, h), (-w, h))]
        quad = quad[::-1] if k % 2 else quad
        rows.append((k, *[c for p in quad for c in p], *sorted((rnd.uniform(-1, 1), rnd.uniform(-1, 1))), *sorted((rnd.uniform(-1, 1), rnd.uniform(-1, 1)))))
    names = ["k", *[f"{a}{n}" for n in range(4) for a in "xy"], "l", "r", "b", "t"]
    df = spark.createDataFrame(rows, names)
    got = {r.k: (r.o, r.s) for r in conservative.with_overlap(df, [(f"x{n}", f"y{n}") for n in range(4)], "l", "r", "b", "t", "o").select("k", "o", conservative.area([(F.col(f"x{n}"), F.col(f"y{n}")) for n in range(4)]).alias("s")).collect()}
    for k, *c in rows:
        quad = [(c[2 * n], c[2 * n + 1]) for n in range(4)]
        assert got[k][0] == pytest.approx(clipped(quad, c[8:]), abs=1e-12)
        assert got[k][1] == pytest.approx(clipped(quad, (-9, 9, -9, 9)), abs=1e-12)


def raster(spark, n=12, step=0.1, lon0=0.0):
    rows = [(j, i, lon0 + step * (i + 0.5), 50 + step * (j + 0.5), None if (j * i) % 5 == 1 else float(j + 2 * i + 1)) for j in range(n) for i in range(n)]
    return rows, spark.createDataFrame(rows, "j int, i int, lon double, lat double, depth double")


@pytest.mark.parametrize("turn", [0, 360])
def test_rotated_target_against_all_pairs(spark, turn):
    rows, fine = raster(spark)
    grid = grids.spherical(spark, 0.1 + turn, 1.3 + turn, 50.1, 51.3, 0.2, 0.2, rotation=30)
    got = {(r.j, r.i): r for r in conservative.regrid(fine, grid, 0.1, 0.1).collect()}
    cells = grid.collect()
    assert len(got) == len(cells) and any(r.depth is None for r in got.values())
    for c in cells:
        quad = [(c[f"lon{k}"] - turn, math.sin(math.radians(c[f"lat{k}"]))) for k in CORNERS]
        size = clipped(quad, (-99, 99, -9, 9))
        w = [(clipped(quad, (x - 0.05, x + 0.05, math.sin(math.radians(y - 0.05)), math.sin(math.radians(y + 0.05)))) / size, d) for _, _, x, y, d in rows]
        wet = sum(a for a, d in w if d is not None)
        r = got[c.j, c.i]
        assert (r.wet_fraction or 0.0) == pytest.approx(wet, abs=1e-9)
        if wet > 1e-9:
            assert r.depth == pytest.approx(sum(a * d for a, d in w if d is not None) / wet, rel=1e-6)


def test_aligned_target_is_the_area_weighted_mean(spark):
    from soundgrid.operators import regrid

    _, fine = raster(spark)
    grid = grids.spherical(spark, 0.0, 1.2, 50.0, 51.2, 0.3, 0.3, interfaces=True)
    got = {(r.j, r.i): (r.wet_fraction, r.depth) for r in conservative.regrid(fine, grid, 0.1, 0.1).collect()}
    want = {(r.j, r.i): (r.wet_fraction, r.depth) for r in regrid.area_weighted(fine, 0.3, 0.3, 0.0, 50.0, 0.1, 0.1).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_across_the_date_line(spark):
    """A target cell over the line has corners on both sides of it."""
    _, fine = raster(spark, lon0=179.4)
    grid = spark.createDataFrame([(0, 0, 179.8, 50.2, -179.8, 50.2, 179.8, 50.6, -179.8, 50.6), (0, 1, None, 50.2, 1.0, 50.2, 0.0, 50.6, 1.0, 50.6)], "j int, i int, lon00 double, lat00 double, lon01 double, lat01 double, lon10 double, lat10 double, lon11 double, lat11 double")
    one, none = sorted(conservative.regrid(fine, grid, 0.1, 0.1).collect(), key=lambda r: r.i)
    assert 0.5 < one.wet_fraction < 1 and none.wet_fraction is None
    assert sum(r.w for r in conservative.weights(fine, grid, 0.1, 0.1).collect()) == pytest.approx(1.0)


def test_weights_are_kept(spark, tmp_path):
    _, fine = raster(spark)
    grid = grids.spherical(spark, 0.2, 1.0, 50.2, 51.0, 0.2, 0.2, rotation=10)
    first = sorted(map(tuple, conservative.kept_weights(spark, fine, grid, 0.1, 0.1, f"file://{tmp_path}").collect()))
    again = sorted(map(tuple, conservative.kept_weights(spark, fine.withColumn("depth", F.lit(1.0)), grid, 0.1, 0.1, f"file://{tmp_path}").collect()))
    assert first == again and len(list(tmp_path.glob("weights_conservative_*.parquet"))) == 1


def test_nothing(spark):
    _, fine = raster(spark)
    grid = grids.spherical(spark, 5, 6, 50, 51, 0.5, 0.5)
    assert all(r.depth is None and r.wet_fraction is None for r in conservative.regrid(fine, grid, 0.1, 0.1).collect())
    assert conservative.regrid(fine.limit(0), grid, 0.1, 0.1).where("depth is not null").count() == 0
    assert conservative.regrid(fine, grid.limit(0), 0.1, 0.1).count() == 0
