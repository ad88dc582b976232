"""Choke points, deepest routes and split windows against brute force on small random grids."""

import random

import numpy as np
import pandas as pd
import pytest

from soundgrid.operators import cuts, deepest, straits, thalweg

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def reached(cells, start):
    seen, stack = {start}, [start]
    while stack:
        j, i = stack.pop()
        for c in ((j + a, i + b) for a, b in FOUR):
            if c in cells and c not in seen:
                seen.add(c)
                stack.append(c)
    return seen


def n_parts(cells):
    left, n = set(cells), 0
    while left:
        left -= reached(left, next(iter(left)))
        n += 1
    return n


@pytest.mark.parametrize("tile", [2, 256])
def test_choke_points_are_what_splits_a_component(spark, tile):
    """Many levels of tiles or a single one; several grids far from each other in one go."""
    rnd, cells, want = random.Random(1), set(), []
    for k in range(40):
        own = {(j, i + 20 * k) for j in range(rnd.randint(1, 9)) for i in range(rnd.randint(1, 9)) if rnd.random() < 0.7}
        whole = n_parts(own)
        want += [c for c in own if n_parts(own - {c}) > whole]
        cells |= own
    got = cuts.choke_points(spark.createDataFrame(sorted(cells) + sorted(cells)[:3], "j int, i int"), tile=tile).collect()
    assert sorted((r.j, r.i) for r in got) == sorted(want) and len(want) > 100


def test_no_choke_points(spark):
    assert cuts.choke_points(spark.createDataFrame([], "j int, i int")).collect() == []
    assert cuts.choke_points(spark.createDataFrame([(5, 5), (5, 6), (9, 9)], "j int, i int")).collect() == []


def corridors(cells, least, margin, merge):
    """Group by group: what is left without it, and the deepest cells of its two largest parts near it."""
    wet = set(cells)
    points = {c for c in wet if n_parts(wet - {c}) > n_parts(wet)}
    wide = {(j + a, i + b) for j, i in points for a in range(-merge, merge + 1) for b in range(-merge, merge + 1) if abs(a) + abs(b) <= merge}
    out, left = [], set(points)
    while left:
        start = min(left, key=lambda c: min(reached(wide, c)))
        own = points & reached(wide, start)
        left -= own
        rest, parts = wet - own, []
        while rest:
            parts.append(reached(rest, next(iter(rest))))
            rest -= parts[-1]
        parts.sort(key=lambda p: (-len(p), min(p)))
        if len(parts) < 2 or min(map(len, parts)) < least:
            continue
        js, is_ = [c[0] for c in own], [c[1] for c in own]
        near = [[c for c in p if min(js) - margin <= c[0] <= max(js) + margin and min(is_) - margin <= c[1] <= max(is_) + margin] for p in parts[:2]]
        if all(near):
            out.append((len(own), *[x for p in near for x in min(p, key=lambda c: (-cells[c], c))]))
    return sorted(out)


def test_corridors(spark):
    rnd, n = random.Random(8), 0
    for _ in range(3):
        cells = {(j, i): float(rnd.randint(1, 40)) for j in range(16) for i in range(22) if i % 7 != 6 and rnd.random() < 0.97}
        for k in (6, 13, 20):
            cells[rnd.randint(2, 13), k] = 3.0
        rows = [(j, i, 100 * j + i, float(i), float(j), d, 1) for (j, i), d in cells.items()]
        df = spark.createDataFrame(rows, "j int, i int, id int, lon double, lat double, depth double, mask int")
        got = sorted((r.n_cells, r.begin_j, r.begin_i, r.end_j, r.end_i) for r in thalweg.auto_corridors(df, min_basin_cells=3, margin=3, merge=1).collect())
        want = corridors(cells, 3, 3, 1)
        assert got == want
        n += len(want)
    assert n > 2


def test_tree_path_is_as_deep_as_any():
    rnd = random.Random(2)
    for _ in range(150):
        n = rnd.randint(2, 12)
        rows = [(a, b, float(rnd.randint(1, 6))) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.3]
        weight = {frozenset(r[:2]): r[2] for r in rows}
        best = np.zeros((n, n))  # the widest bottleneck between two nodes
        for a, b, w in rows:
            best[a, b] = best[b, a] = w
        for k in range(n):
            best = np.maximum(best, np.minimum(best[:, k : k + 1], best[k : k + 1]))
        _, tree = deepest.forest(pd.DataFrame([(*r, *r[:2]) for r in rows], columns=["u", "v", "w", "ka", "kb"]))
        path = deepest.walk(tree, 0, n - 1)
        assert bool(path) == bool(best[0, n - 1])
        if path:
            assert path[0] == 0 and path[-1] == n - 1
            assert min(weight[frozenset(e)] for e in zip(path, path[1:], strict=False)) == best[0, n - 1]


def test_split_windows_with_holes():
    rnd = random.Random(3)
    for _ in range(200):
        ny, nx = rnd.randint(2, 5), rnd.randint(2, 6)
        at = [(j, i) for j in range(ny) for i in range(nx) if rnd.random() < 0.9 or i == 0 or j == 0]  # the rest is not in the raster
        wet = {c for c in at if rnd.random() < 0.6}
        pdf = pd.DataFrame([(j, i, (j, i) in wet) for j, i in at], columns=["fj", "fi", "wet"])
        for axis, k, n in (("U", 1, nx), ("V", 0, ny)):
            cut = n // 2
            starts = [c for c in wet if c[k] == cut - 1]
            want = any(x[k] == cut for s in starts for x in reached(wet, s))
            assert straits.split_connected(pdf, axis) == want


@pytest.mark.parametrize("tile", [3, 256])
def test_paths_by_tiles_are_those_of_the_whole_forest(spark, tile):
    """Many levels of tiles or a single one; several legs of a graph, and two graphs of the same ids."""
    rnd = random.Random(6)
    cells, legs, want = [], [], {}
    for name in ("a", "b"):
        ny, nx = rnd.randint(9, 14), rnd.randint(9, 14)
        at = {(j, i): (j * 100 + i, float(rnd.randint(1, 5))) for j in range(3, 3 + ny) for i in range(5, 5 + nx) if rnd.random() < 0.75}
        cells += [(name, j, i, k, d) for (j, i), (k, d) in at.items()]
        steps = [(k, at[j + a, i + b][0], min(d, at[j + a, i + b][1])) for (j, i), (k, d) in at.items() for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)) if (j + a, i + b) in at]
        _, tree = deepest.forest(pd.DataFrame([(u, v, w, u, v) for u, v, w in steps], columns=["u", "v", "w", "ka", "kb"]))
        ids = [k for k, _ in at.values()]
        for n in range(8):
            a, b = rnd.choice(ids), rnd.choice(ids)
            b = a if n == 7 else b
            legs.append((f"{name}{n}", name, a, b))
            want[f"{name}{n}"] = deepest.walk(tree, a, b)
    cells.append(cells[0])
    df = spark.createDataFrame(cells, "graph string, j int, i int, id long, depth double")
    got = deepest.paths(df, spark.createDataFrame(legs, "leg string, graph string, a long, b long"), tile=tile).collect()
    found = {k: [r.id for r in sorted((r for r in got if r.leg == k), key=lambda r: r.seq)] for k in want}
    assert found == want and sum(len(p) > 3 for p in want.values()) > 5
    assert all(sorted(r.seq for r in got if r.leg == k) == list(range(len(p))) for k, p in want.items())
