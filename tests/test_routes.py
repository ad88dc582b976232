"""Routes on small random rasters against loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from soundgrid.operators import deepest, routes

KM = math.pi / 180 * 6371


def raster(seed, n=24, step=0.1, dry=0.2):
    rnd = random.Random(seed)
    return {(j, i): float(rnd.randint(3, 30)) if rnd.random() > dry else None for j in range(n) for i in range(n)}, step


def frame(spark, depth, step):
    rows = [(j, i, step * (i + 0.5), 50 + step * (j + 0.5), d, j * 1000 + i) for (j, i), d in depth.items()]
    return spark.createDataFrame(rows, "j int, i int, lon double, lat double, depth double, id long")


def coarse(spark, depth, step, k=4):
    cells = {}
    for (j, i), d in depth.items():
        cells.setdefault((j // k, i // k), []).append(d)
    rows = [(j, i, step * k * (i + 0.5), 50 + step * k * (j + 0.5), *((sum(w) / len(w), 1) if (w := [d for d in ds if d is not None]) and len(w) > len(ds) / 2 else (None, 0))) for (j, i), ds in cells.items()]
    return spark.createDataFrame(rows, "j int, i int, lon double, lat double, depth double, mask int"), rows


def widest(depth, a, b, inside=lambda c: True):
    """The largest of the least depths on ways from a to b, None if there is none."""
    for low in sorted({d for d in depth.values() if d is not None}, reverse=True):
        wet = {c for c, d in depth.items() if d is not None and d >= low and inside(c)}
        if a not in wet or b not in wet:
            continue
        seen, stack = {a}, [a]
        while stack:
            j, i = stack.pop()
            for c in ((j + x, i + y) for x in (-1, 0, 1) for y in (-1, 0, 1)):
                if c in wet and c not in seen:
                    seen.add(c)
                    stack.append(c)
        if b in seen:
            return low
    return None


@pytest.mark.parametrize("direction", ["U", "V"])
def test_along_a_strait(spark, direction):
    depth, step = raster(1)
    for k in range(24):
        depth[(k, 3) if direction == "U" else (3, k)] = None  # a line on land
    x, y = 1.2, 51.2
    strait = spark.createDataFrame([(direction, 2, 2, x, y), (direction, 9, 9, 90.0, 0.0)], "direction string, j int, i int, lon double, lat double")
    got = {r.seq: r for r in routes.along_straits(strait, frame(spark, depth, step), step, step, 0.2, 0.2, 4, 1).collect()}
    reach = 4 * 3 * step  # four times a window of four cells
    lines = [k for k in range(24) if abs(step * (k + 0.5) - 1.2) <= reach + 1e-9]
    assert sorted(got) == lines and all(r.name == f"{direction}_2_2" for r in got.values())
    for k in lines:
        column = [(depth[(m, k) if direction == "U" else (k, m)], -m) for m in range(24) if abs(step * (m + 0.5) - 1.2) <= 2.0]
        best = max((c for c in column if c[0] is not None), default=None)
        here = step * (k + 0.5)
        across = 1.2 if best is None else step * (0.5 - best[1])
        want = (here, 50 + across) if direction == "U" else (across, 50 + here)
        r = got[k]
        assert r.depth == (best and best[0]) and (r.lon, r.lat) == pytest.approx(want)
        assert r.dist_km == pytest.approx((here - 1.2) * KM * (math.cos(math.radians(y)) if direction == "U" else 1.0), abs=1e-9)


def test_too_few_lines(spark):
    strait = spark.createDataFrame([("U", 0, 0, 0.1, 50.1)], "direction string, j int, i int, lon double, lat double")
    fine = frame(spark, {(0, 0): 4.0, (0, 1): 5.0}, 0.1)
    assert routes.along_straits(strait, fine, 0.1, 0.1, 0.2, 0.2).collect() == []


def test_between_boundaries(spark):
    """Every two starts in turn: the sill of the deepest route, too shallow ones and repeated sills left out."""
    depth, step = raster(3, 64, dry=0.3)
    cells, _ = coarse(spark, depth, step)
    lo, hi = 0.2, 6.2  # the coarse centres' box
    inside = lambda c: lo <= step * (c[1] + 0.5) <= hi and lo <= step * (c[0] + 0.5) <= hi
    starts = [(1, "W", 1, 0.21, 50.6), (2, "W", 2, 0.21, 55.9), (3, "E", 1, 6.11, 51.0), (4, "N", 1, 3.3, 56.15)]
    points, kept = routes.between_boundaries(frame(spark, depth, step), cells, spark.createDataFrame(starts, "ord int, edge string, segment int, lon double, lat double"), 1.0, min_sill=4.0, tile=7)
    at = {}
    for k, _, _, x, y in starts:
        ci, cj = round(x / step - 0.5), round((y - 50) / step - 0.5)
        near = [c for c in depth if abs(c[0] - cj) <= 20 and abs(c[1] - ci) <= 20 and depth[c] is not None and inside(c)]
        at[k] = max(near, key=lambda c: (depth[c], -c[0], -c[1]))
    want, seen = {}, {}
    for n, a in enumerate(starts):
        for b in starts[n + 1 :]:
            sill = widest(depth, at[a[0]], at[b[0]], inside)
            if at[a[0]] == at[b[0]] or sill is None or sill < 4:
                continue
            name = f"{a[1]}[{a[2]}]→{b[1]}[{b[2]}]"
            want[name] = (frozenset((a[1], b[1])), sill)
    got = {r.name: r for r in kept.collect()}
    path = {n: [r for r in points.collect() if r.name == n] for n in got}
    for name, r in got.items():
        assert r.fine_sill == want[name][1] == min(p.depth for p in path[name]) and r.n == len(path[name]) >= 5 and r.category == "AUTO"
        assert r.length_km <= 20 * r.direct_km and r.sill_deficit_m == pytest.approx(r.fine_sill - r.coarse_sill)
        seen.setdefault(want[name][0], []).append(r.fine_sill)
    assert got and all(abs(a - b) >= 2 for s in seen.values() for n, a in enumerate(s) for b in s[n + 1 :])
    for name, (edges, sill) in want.items():  # what is left out is short, or like one that is kept
        assert name in got or any(abs(sill - s) < 2 for s in seen.get(edges, [])) or sill is not None and name not in path


def test_waypoints_and_failures(spark):
    depth = {(j, i): 9.0 if i != 5 else None for j in range(6) for i in range(11)}
    depth[2, 5] = 4.0
    fine = frame(spark, depth, 0.1)
    cells, _ = coarse(spark, depth, 0.1, 2)
    stops = [("ok", 0, 0.05, 50.05), ("ok", 1, 0.95, 50.45), ("lone", 0, 0.05, 50.05), ("same", 0, 0.05, 50.05), ("same", 1, 0.05, 50.05)]
    points, got = routes.by_waypoints(fine, cells, spark.createDataFrame(stops, "name string, seq int, lon double, lat double"), 2.0, 1.0)
    got = {r.name: r for r in got.collect()}
    assert {n: r.failed_reason for n, r in got.items()} == {"ok": None, "lone": "fewer than two stops", "same": "fewer than three cells"}
    assert got["ok"].fine_sill == 4.0 and not got["ok"].failed and got["lone"].failed and got["same"].n is None
    assert {r.name for r in points.collect()} == {"ok"}
    depth[2, 5] = None
    _, got = routes.by_waypoints(frame(spark, depth, 0.1), cells, spark.createDataFrame(stops[:2], "name string, seq int, lon double, lat double"), 2.0, 1.0)
    assert [r.failed_reason for r in got.collect()] == ["stops are not joined"]


def test_across_edges(spark):
    kind = "ord int, edge string, id long"
    pick = lambda rows: [tuple(r) for r in routes.across_edges(spark.createDataFrame(rows, kind)).collect()]
    assert pick([(1, "W", 10), (2, "W", 11), (3, "N", 12), (4, "E", 13)]) == [(10, 12)]
    assert pick([(1, "W", 10), (2, "W", 11), (3, "W", 12)]) == [(10, 12)]
    assert pick([(1, "W", 10)]) == [] and pick([]) == []


def test_records_without_coarse(spark):
    rows = [("a", k, float(k), d, None) for k, d in enumerate([3.0, None, 2.0, 2.0])]
    r = routes.records(spark.createDataFrame(rows, "name string, seq int, dist_km double, depth double, coarse_depth double")).first()
    assert (r.n, r.fine_sill, r.fine_sill_km, r.coarse_sill, r.mae, r.category) == (4, 2.0, 2.0, None, None, "WAYPOINT")
    assert [r.m for r in spark.createDataFrame([("AUTO",), ("OK",), ("U",)], "c string").select(routes.mode(F.col("c")).alias("m")).collect()] == ["boundary", "ok", "strait"]
    assert deepest.TILE == 256


def test_routes_are_numbered_side_by_side(spark):
    """distinct_sills has no window over all routes, and a pair's list has each depth once."""
    from soundgrid.plans import queries, records  # noqa: F401
    from soundgrid.tables import numbered

    got = numbered(spark.range(1000, 0, -1, 7).withColumn("x", F.expr("id div 3")), "n", "x", "id").orderBy("n").collect()
    assert [(r.n, r.id) for r in got] == [(k, k) for k in range(1, 1001)]
    plan = queries.QUERIES["distinct_sills"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_nearest_within_sorts_no_pairs(spark):
    """Cells of a bin come as one list; ties, points of one place and points out of reach are as in a loop."""
    from soundgrid.operators import spatial

    rnd = random.Random(3)
    cells = [(j, i, i * 0.5, j * 0.5) for j in range(8) for i in range(8) if rnd.random() < 0.6]
    points = [(k, rnd.randint(-8, 24) * 0.25, rnd.randint(-8, 24) * 0.25) for k in range(300)]
    out = spatial.nearest_cell(spark.createDataFrame(points, "pid int, lon double, lat double"), spark.createDataFrame(cells, "j int, i int, lon double, lat double"), max_deg=1.0)
    assert "min(struct(" not in out._jdf.queryExecution().toString()
    near = {k: min(((x - c[2]) ** 2 + (y - c[3]) ** 2, c[0], c[1]) for c in cells) for k, x, y in points}
    assert {r.pid: (r.j, r.i) for r in out.collect()} == {k: m[1:] if m[0] <= 1 else (None, None) for k, m in near.items()}


def test_boxes_of_one_cell_are_searched_once(spark):
    from soundgrid.operators import thalweg

    fine = spark.createDataFrame([(j, i, float(i), float(j), float((j * 7 + i * 3) % 11)) for j in range(6) for i in range(6)], "j int, i int, lon double, lat double, depth double")
    points = spark.createDataFrame([(k, 2.1, 3.1) for k in range(20)], "pid int, lon double, lat double")
    out = thalweg.deepest_in_box(points, fine, (0.0, 9.0, 0.0, 9.0), 1)
    assert "max(struct(" in (plan := out._jdf.queryExecution().toString()) and "Aggregate [pid" not in plan
    best = max((float((j * 7 + i * 3) % 11), -j, -i) for j in (2, 3, 4) for i in (1, 2, 3))
    assert sorted(map(tuple, out.collect())) == [(k, -best[1], -best[2], best[0]) for k in range(20)]
