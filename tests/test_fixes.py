import random

import pytest
from soundgrid.operators import fixes
from soundgrid.plans import queries, records  # noqa: F401


def one_by_one(cells, listed):
    """cells {(j, i): [depth, mask, wet_fraction]} on whole degrees, after the fixes one at a time."""
    for _, lon, lat, action, value in sorted(listed):
        j, i = round(lat), round(lon)
        c = cells[j, i]
        if action in ("set_depth", "open_cell"):
            c[:] = [10.0 if value is None else value, 1, max(c[2], 0.01)]
        elif action in ("close_cell", "mask_cell"):
            c[:] = [None, 0, 0.0]
        elif action == "deepen_by":
            c[:] = [None if c[0] is None else max(c[0] + value, 0.0), 1, max(c[2], 0.01)]
        else:
            near = [cells[j + a, i + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (j + a, i + b) in cells]
            wet = [n[0] for n in near if n[1] == 1 and n[0] is not None]
            c[0] = sum(wet) / len(wet) if wet else c[0]
    return {k: tuple(None if x is None else round(x, 6) for x in c) for k, c in cells.items()}


def test_all_fixes_in_order(spark):
    rnd = random.Random(1)
    cells = [(j, i, float(i), float(j), rnd.uniform(1, 90) if wet else None, wet, rnd.random()) for j in range(6) for i in range(7) for wet in [rnd.randint(0, 1)]]
    listed = [(k, rnd.randint(0, 6) + 0.1, rnd.randint(0, 5) - 0.1, rnd.choice(fixes.ACTIONS), rnd.uniform(-20, 50)) for k in range(60)]
    df = spark.createDataFrame(cells, "j int, i int, lon double, lat double, depth double, mask tinyint, wet_fraction double")
    got = fixes.apply(df, spark.createDataFrame(listed, "ord int, lon double, lat double, action string, value double")).collect()
    want = one_by_one({(c[0], c[1]): [c[4], c[5], c[6]] for c in cells}, listed)
    assert {(r.j, r.i): (None if r.depth is None else round(r.depth, 6), r["mask"], round(r.wet_fraction, 6)) for r in got} == want


def test_jobs_do_not_grow_with_fixes_on_a_cell(spark):
    cells = spark.createDataFrame([(0, i, float(i), 0.0, 5.0, 1, 0.9) for i in range(3)], "j int, i int, lon double, lat double, depth double, mask tinyint, wet_fraction double")
    jobs = []
    for times in (2, 20):
        listed = [(k, float(k % 2), 0.0, ("deepen_by", "blend_cell")[k % 2], 1.0) for k in range(2 * times)]
        spark.sparkContext.setJobGroup(f"chain-{times}", "")
        got = {r.i: r.depth for r in fixes.apply(cells, spark.createDataFrame(listed, "ord int, lon double, lat double, action string, value double")).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{times}")))
        assert got == {0: 5.0 + times, 1: (10.0 + times) / 2, 2: 5.0}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 2 * jobs[0]


def test_query_takes_every_fix(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(fixes, "apply", lambda cells, listed: taken.append(listed.count()) or cells)
    queries.QUERIES["apply_fixes_sequential"](spark, "/root/testdata/sf0.01")
    assert taken == [queries.suppliers(spark, "/root/testdata/sf0.01").count()] and taken[0] > 12


def test_close_then_open_and_deepen_on_land(spark):
    cells = spark.createDataFrame([(0, i, float(i), 0.0, 5.0 if i else None, int(i > 0), 0.9) for i in range(4)], "j int, i int, lon double, lat double, depth double, mask tinyint, wet_fraction double")
    listed = [{"lon": 1, "lat": 0, "action": "close_cell"}, {"lon": 1, "lat": 0, "action": "open_cell", "depth": 7}, {"lon": 0, "lat": 0, "action": "deepen_by", "value": 3}, {"lon": 2, "lat": 0, "action": "deepen_by", "value": 3}, {"lon": 3, "lat": 0, "action": "blend_cell"}]
    got = {r.i: (r.depth, r["mask"], r.wet_fraction) for r in fixes.apply(cells, fixes.table(spark, listed)).collect()}
    assert got == {0: (None, 1, 0.9), 1: (7.0, 1, 0.01), 2: (8.0, 1, 0.9), 3: (8.0, 1, 0.9)}
    got = {r.i: (r.depth, r.wet_fraction) for r in fixes.apply_absolute(cells, fixes.table(spark, listed[:2])).collect()}
    assert got[1] == (7.0, 0.01)
    with pytest.raises(ValueError):
        fixes.apply(cells, fixes.table(spark, [{"lon": 0, "lat": 0, "action": "dig"}]))
