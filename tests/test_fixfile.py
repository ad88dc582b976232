"""Merging lists of corrections against a loop, and the file's round trip."""

import random

import pytest
from soundgrid.operators import fixes
from soundgrid.sources import fixfile

OLD = "key string, ord int, lon double, lat double, action string, value double, applied boolean, comment string"
NEW = "key string, ord int, lon double, lat double, action string, value double, comment string"


def one_by_one(old, new, tolerance):
    """Each old place in turn takes the nearest new one that is left."""
    used, out = set(), []
    for o in sorted(old):
        near = sorted((abs(o[1] - n[1]) + abs(o[2] - n[2]), n[0]) for n in new if n[0] not in used)
        if near and near[0][0] < tolerance:
            used.add(near[0][1])
            out.append((o[0], near[0][1]))
    return out


@pytest.mark.parametrize("spread", [0.1, 2.0, 20.0])
def test_matches_are_those_of_the_loop(spark, spread):
    rnd = random.Random(9)
    old, new = ([(k, rnd.uniform(-spread, spread), rnd.uniform(-spread, spread)) for k in range(n)] for n in (40, 50))
    new += [(50 + k, o[1], o[2]) for k, o in enumerate(old[:5])] + [(60, *old[0][1:])]  # ties at no distance
    kind = "ord int, lon double, lat double"
    got = fixes.matched(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), 0.4).collect()
    assert sorted(map(tuple, got)) == one_by_one(old, new, 0.4) != []


def test_matches_of_crowded_places_take_few_jobs(spark):
    """Fixes at the same few places wait for each other; jobs don't grow with how many they are."""
    rnd, kind = random.Random(4), "ord int, lon double, lat double"
    jobs = []
    for times in (8, 40):
        old, new = ([(k, rnd.randint(0, 3) * 0.25, rnd.randint(0, 2) * 0.25) for k in range(times * n)] for n in (4, 5))
        spark.sparkContext.setJobGroup(f"crowd-{times}", "")
        got = fixes.matched(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), 0.4).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"crowd-{times}")))
        assert sorted(map(tuple, got)) == one_by_one(old, new, 0.4) != []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 2 * jobs[0]


def test_merge(spark):
    old = [("b001", 0, 1.0, 50.0, "open_cell", 5.0, True, "a"), ("b002", 1, 2.0, 50.0, "open_cell", 6.0, False, "b"), ("s007", 2, 3.0, 50.0, "set_depth", 7.0, True, "c"), ("x", 3, 9.0, 50.0, "close_cell", None, False, "d")]
    new = [("b001", 0, 5.0, 50.0, "open_cell", 1.0, "n0"), ("b002", 1, 2.01, 50.01, "open_cell", 2.0, "n1"), ("s001", 2, 3.0, 50.06, "set_depth", 3.0, "n2"), ("s007", 3, 7.0, 50.0, "set_depth", 4.0, "n3")]
    got = [tuple(r) for r in fixes.merge(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)).orderBy("ord").collect()]
    assert got == [
        ("b001", 1.0, 50.0, "open_cell", 5.0, True, "a", 0),  # not found again, but applied
        ("b002", 2.01, 50.01, "open_cell", 2.0, False, "n1", 1),  # found again
        ("s007", 3.0, 50.0, "set_depth", 7.0, True, "c", 2),
        ("b003", 5.0, 50.0, "open_cell", 1.0, False, "n0", 3),  # its key is taken
        ("s001", 3.0, 50.06, "set_depth", 3.0, False, "n2", 4),
        ("s008", 7.0, 50.0, "set_depth", 4.0, False, "n3", 5),
    ]
    none = spark.createDataFrame([], OLD)
    assert fixes.merge(none, spark.createDataFrame([], NEW)).collect() == []
    assert [r.key for r in fixes.merge(none, spark.createDataFrame(new, NEW)).orderBy("ord").collect()] == ["b001", "b002", "s001", "s007"]


def test_merged_keys_beyond_three_digits_stay_whole(spark):
    old = spark.createDataFrame([("b1998", 0, 1.0, 50.0, "open_cell", 5.0, True, "a"), ("b998", 1, 2.0, 50.0, "open_cell", 5.0, True, "a")], OLD)
    new = spark.createDataFrame([("b1998", 0, 5.0, 50.0, "open_cell", 1.0, "n0"), ("b998", 1, 6.0, 50.0, "open_cell", 1.0, "n1")], NEW)
    assert [r.key for r in fixes.merge(old, new).orderBy("ord").collect()] == ["b1998", "b998", "b1999", "b2000"]


def test_file_there_and_back(spark, tmp_path):
    path = f"file://{tmp_path}/fixes.yaml"
    assert fixfile.read(spark, path).collect() == [] and fixfile.mark_all_applied(spark, path) == 0
    single = spark.createDataFrame([("b001", 0, 1.0, 50.0, "open_cell", 5.0, 'with "quotes": and é')], NEW[: NEW.index(", comment")] + ", comment string")
    groups = "grp string, ord int, lon double, lat double, action string, value double, comment string"
    routes = [(fixfile.group_name("Öresund – North"), 0, 2.0, 51.0, "set_depth", 9.5, "t"), ("tw_b", 0, 2.5, 51.0, "set_depth", 8.0, "u"), ("phantom_islands", 0, 3.0, 52.0, "mask_cell", None, "p"), ("phantom_islands", 1, 4.0, 52.0, "mask_cell", None, "q")]
    assert routes[0][0] == "tw_oresund_north"
    first = fixfile.update(spark, path, single, spark.createDataFrame(routes, groups)).collect()
    assert [(r.grp, r.key, r.applied) for r in first] == [(None, "b001", False), ("tw_b", "001", False), ("tw_oresund_north", "001", False), ("phantom_islands", "001", False), ("phantom_islands", "002", False)]
    assert first[0].comment == 'with "quotes": and é' and first[0].value == 5.0 and first[3].value is None
    assert fixfile.mark_all_applied(spark, path) == 4
    edited = fixfile._raw(spark, path)
    edited["phantom_islands"]["002"]["action"] = "blend_cell"
    fixfile._put(spark, path, edited)
    again = [("tw_b", 0, 2.6, 51.0, "set_depth", 1.0, "new"), ("phantom_islands", 0, 4.01, 52.0, "mask_cell", None, "q2"), ("phantom_islands", 1, 6.0, 52.0, "mask_cell", None, "r")]
    got = [(r.grp, r.key, r.lon, r.action, r.value, r.applied) for r in fixfile.update(spark, path, spark.createDataFrame([], NEW), spark.createDataFrame(again, groups)).collect()]
    assert got == [
        (None, "b001", 1.0, "open_cell", 5.0, True),
        ("tw_b", "001", 2.6, "set_depth", 1.0, True),  # found anew, keeps its flag
        ("tw_oresund_north", "001", 2.0, "set_depth", 9.5, True),  # not found again, stays
        ("phantom_islands", "001", 4.01, "blend_cell", None, True),  # keeps the edited action
        ("phantom_islands", "002", 6.0, "mask_cell", None, True),
    ]
    applied = fixes.table(spark, fixes.load(fixfile._raw(spark, path)), applied_only=True).count()
    assert applied == 5
