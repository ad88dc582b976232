"""Every grid query against its SQL on DuckDB, at the smallest scale."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from soundgrid.operators import straits
from soundgrid.plans import queries as grid
from soundgrid.plans import fixfile, model_grids, records, routes, wide  # noqa: F401  (they register more of them)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if isinstance(x, (date, datetime, bool)) or x is None else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(grid.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = grid.QUERIES[name](spark, SF)
    want = duck.execute(grid.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(grid.QUERIES) - set(grid.ORACLES)))
def test_runs(spark, name):
    """What has no SQL gives rows with numbers in them; auto_corridors finds none on this raster."""
    got = grid.QUERIES[name](spark, SF).collect()
    assert (len(got) > 0) == (name != "auto_corridors")
    assert all(any(v is not None for v in r) for r in got)


@pytest.mark.parametrize("total, depth, want", [(7.0, 140 / 9, 0.112), (9.0, 18.0, 0.125), (39.0, 12.0, 0.812), (5.0, 20.0, 0.062)])
def test_area_ratios_halfway_round_as_in_sql(spark, total, depth, want):
    """One wet fine cell in the face's line: the ratio is total / (4 * depth), most of them halfway between three digits."""
    fine = spark.createDataFrame([(j, i, 0.0125 + 0.025 * i, 50.0125 + 0.025 * j, total if (j, i) == (1, 3) else None) for j in range(4) for i in range(8)], "j int, i int, lon double, lat double, depth double")
    face = spark.createDataFrame([("U", 0, 0, 0.1, 50.05, depth, depth)], "direction string, j int, i int, lon double, lat double, d1 double, d2 double")
    found = straits.sections(face, fine, 0.1, 0.1, 0.025, 0.025).selectExpr("*", "false as connected")
    assert [r.area_ratio for r in straits.classify(found, 0.1, 0.1).collect()] == [want]
