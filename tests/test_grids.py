"""Generated grids: rounding and the order of cells."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from soundgrid.functions import geo
from soundgrid.operators import grids
from soundgrid.plans import queries as grid

SF = "/root/testdata/sf0.001"


def test_rounds_as_sql(spark):
    """Halves on either side, what is next to them, and values of no size."""
    r = random.Random(3)
    xs = [(2 * n + 1) / 2e6 * s for n in range(300) for s in (1, -1, 1 + 2**-52, 1 - 2**-53)] + [r.uniform(-180, 180) for _ in range(2000)] + [k * 0.2 / 2400 for k in range(2000)] + [0.0, -0.0, 1e13, -1e17, 1e300, float("inf")]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").select("k", geo.round_even("x", 6)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(xs)))
    assert sorted(map(tuple, got)) == con.execute("SELECT k, round_even(x, 6) FROM t ORDER BY k").fetchall()


@pytest.mark.parametrize("name", ["supergrid_split", "grid_spherical_t", "grid_spherical_interfaces", "grid_rotated", "grid_rotated_pole", "grid_cartesian", "axis_angle"])
def test_no_value_is_rounded_as_text(spark, name):
    assert "bround" not in grid.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ny, nx", [(1, 1), (7, 5), (64, 3), (130, 9)])
def test_strips_have_every_cell_once(spark, ny, nx):
    cells = [(r.j, r.i) for r in grids.mesh(spark, ny, nx, rows=100).collect()]
    assert sorted(cells) == [(j, i) for j in range(ny) for i in range(nx)]
    assert cells[:min(ny, 64)] == [(j, 0) for j in range(min(ny, 64))]  # column by column


@pytest.mark.parametrize("ny, nx, across, along", [(1, 1, 0.5, 0.2), (163, 205, 0.576, 0.203), (90, 1700, -0.4, -0.3), (800, 30, 0.9, 0.5)])
def test_blocks_have_every_cell_once(spark, ny, nx, across, along):
    cells = [(r.j, r.i) for r in grids.turned_mesh(spark, ny, nx, across, along).collect()]
    assert sorted(cells) == [(j, i) for j in range(ny) for i in range(nx)]


def test_values_of_a_turned_grid_come_back(spark):
    """A Parquet writer gives up a dictionary if the first 20,000 values take less room without it."""
    whole = grids.spherical(spark, -1, 1, 50, 51.6, 0.4 / 2400, 0.4 / 2400, rotation=20).where(F.spark_partition_id() == 18)  # a block that meets no edge
    first = grid._grid(whole).limit(20000).toPandas()
    assert len(first) == 20000 and all(first[c].nunique() * 8 + 20000 * 14 / 8 < 160000 for c in grid.GRID_COLUMNS)
