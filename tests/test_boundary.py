from collections import deque

from soundgrid.operators import boundary, morphology


def nudged(depth, seeds, width, min_depth):
    """depth [j][i] (None on land) after the ratios of seeds [(j, i, scale)] have gone inland, cell by cell from a queue."""
    scale, dist, queue = {}, {}, deque()
    for j, i, s in seeds:
        scale[j, i], dist[j, i] = max(min_depth, depth[j][i] * s) / depth[j][i], 0
        queue.append((j, i))
    while queue:
        j, i = queue.popleft()
        if dist[j, i] < width:
            for a, b in ((j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)):
                if 0 <= a < len(depth) and 0 <= b < len(depth[0]) and depth[a][b] is not None and (a, b) not in dist:
                    dist[a, b], scale[a, b] = dist[j, i] + 1, scale[j, i]
                    queue.append((a, b))
    w = lambda d: 1 - d / width
    return {k: max(min_depth, depth[k[0]][k[1]] * (w(dist[k]) * scale[k] + 1 - w(dist[k]))) for k in dist}


def test_nudge_against_a_queue(spark):
    depth = [[3.0 + (7 * j + 5 * i) % 11 if (j * 3 + i) % 7 or i < 1 else None for i in range(30)] for j in range(6)]
    rows = [(j, i, float(i), float(j), d, int(d is not None)) for j, r in enumerate(depth) for i, d in enumerate(r)]
    cells = spark.createDataFrame(rows, "j int, i int, lon double, lat double, depth double, mask int")
    outer = spark.createDataFrame([(0, 0, 0.0, 2.0, 1.0), (0, 1, 29.0, 2.0, 40.0)], "j int, i int, lon double, lat double, depth double")
    edge = boundary.boundary_cells(cells).join(cells.select("j", "i", "depth"), ["j", "i"])
    order = {"W": 0, "E": 1, "S": 2, "N": 3}
    seeds = sorted((order[r.side], r.seq, r.j, r.i, r.scale) for r in boundary.match_scale(edge, outer, 1.0, 1.0).collect())
    want = nudged(depth, [x[2:] for x in seeds], 25, 2.0)
    got = {(r.j, r.i): r.depth for r in boundary.nudge(cells, outer, 1.0, 1.0, 25, "linear").collect() if r.depth is not None}
    for k, d in got.items():
        assert abs(d - want.get(k, depth[k[0]][k[1]])) < 1e-5


def test_rays_stop_at_land_and_keep_a_dry_centre(spark):
    wet = {-2: 2.0, -1: 4.0, 0: None, 1: 6.0, 2: None, 3: 8.0}
    cells = spark.createDataFrame([(0, k + 2, k * 0.01, 0.0, d) for k, d in wet.items()], "j int, i int, lon double, lat double, depth double")
    at = spark.createDataFrame([("b", 0, 0.0, 0.0, 0.0)], "branch string, seq int, lon double, lat double, bearing double")
    step = 0.01 * 111194.9266
    got = sorted((round(r.offset_m / step), r.depth) for r in morphology.cast_rays(at, cells, step, 5 * step, 0.006).collect())
    assert got == [(-2, 2.0), (-1, 4.0), (0, 0.0), (1, 6.0)]
