"""The solver of the linear programme against all corners of its polytope, on small grids."""

import itertools
import random

import numpy as np

from soundgrid.operators import smooth


def corners_best(h, pairs, pinned, k):
    """The least sum of changes: an optimum lies where as many limits hold as there are cells."""
    n = len(h)
    rows = [(np.eye(n)[a] - k * np.eye(n)[b], 0.0) for x, y in pairs for a, b in ((x, y), (y, x))]  # at most 0
    planes = rows + [(np.eye(n)[c], h[c]) for c in range(n)]
    best = np.inf
    for some in itertools.combinations(planes, n):
        a, b = np.array([p[0] for p in some]), np.array([p[1] for p in some])
        if abs(np.linalg.det(a)) > 1e-9:
            x = np.linalg.solve(a, b)
            if all(r @ x <= 1e-9 for r, _ in rows) and all(x[c] >= h[c] - 1e-9 for c in pinned):
                best = min(best, np.abs(x - h).sum())
    return best


def solve(depth, wet, r, pinned, rounds=4000):
    patch = smooth.Patch(depth, wet, pinned, r)
    patch.steps(rounds)
    x = np.where(pinned & wet, np.maximum(patch.x, patch.h0), patch.x)
    return smooth.lifted(x, wet, patch.k, 10_000)


def test_tiles_give_what_one_grid_gives(spark):
    rnd = random.Random(7)
    n = 17
    rows = [(j, i, rnd.uniform(2, 60) if wet else None, int(wet), wet and rnd.random() < 0.1, "x") for j in range(n) for i in range(n + 3) for wet in [rnd.random() < 0.85]]
    df = spark.createDataFrame(rows, "j int, i int, depth double, mask int, pinned boolean, h0 string")
    got = {(r.j, r.i): r.depth for r in smooth.smooth(df, 0.2, tile=6, halo=5, rounds=30).collect()}
    depth, wet, pinned = np.zeros((n, n + 3)), np.zeros((n, n + 3), bool), np.zeros((n, n + 3), bool)
    for j, i, d, m, p, _ in rows:
        depth[j, i], wet[j, i], pinned[j, i] = d or 0, m == 1, p
    want = solve(depth, wet, 0.2, pinned, 30)
    assert len(got) == len(rows)
    for (j, i), d in got.items():
        assert (d is None) == (not wet[j, i]) and (d is None or abs(d - want[j, i]) < 1e-9)
    one = {(r.j, r.i): r.depth for r in smooth.smooth(df, 0.2, rounds=30).collect()}
    assert all(d is None or abs(d - one[c]) < 1e-9 for c, d in got.items())


def test_nothing_to_smooth(spark):
    df = spark.createDataFrame([], "j int, i int, depth double, mask int")
    assert smooth.smooth(df, 0.2).collect() == []
    flat = spark.createDataFrame([(0, 0, 10.0, 1), (0, 1, 10.5, 1), (0, 2, None, 0)], "j int, i int, depth double, mask int")
    assert sorted(tuple(r) for r in smooth.smooth(flat, 0.2).select("i", "depth").collect()) == [(0, 10.0), (1, 10.5), (2, None)]


def test_solve_is_feasible_and_no_worse_than_any_corner():
    rnd = random.Random(4)
    for _ in range(12):
        ny, nx = rnd.choice([(1, 2), (1, 4), (2, 2), (2, 2)])
        r = rnd.choice([0.1, 0.2, 0.3])
        k = (1 + r) / (1 - r)
        depth = np.array([[rnd.uniform(2, 60) for _ in range(nx)] for _ in range(ny)])
        wet = np.array([[rnd.random() < 0.9 for _ in range(nx)] for _ in range(ny)])
        pinned = wet & np.array([[rnd.random() < 0.2 for _ in range(nx)] for _ in range(ny)])
        at = {c: n for n, c in enumerate(zip(*map(list, np.nonzero(wet)), strict=True))}
        pairs = [(at[j, i], at[b]) for j, i in at for b in ((j + 1, i), (j, i + 1)) if b in at]
        got = solve(depth, wet, r, pinned)
        x, h = got[wet], depth[wet]
        assert all(x[a] <= k * x[b] + 1e-6 and x[b] <= k * x[a] + 1e-6 for a, b in pairs)
        assert (got[pinned] >= depth[pinned] - 1e-9).all()
        want = corners_best(h, pairs, [at[c] for c in at if pinned[c]], k)
        assert np.abs(x - h).sum() <= want + 0.01 * max(1.0, want)
