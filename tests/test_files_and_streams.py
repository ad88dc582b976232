import pytest

from soundgrid.sources import files
from soundgrid.streaming import soundings


def test_elevation(spark, tmp_path):
    spark.createDataFrame([(0.5, 50.5, -7.0), (0.5, 50.6, 3.0), (9.0, 50.5, -1.0), (0.6, 50.5, None)], "longitude double, latitude double, elevation double").write.parquet(f"{tmp_path}/e")
    got = files.elevation(spark, f"{tmp_path}/e", (0.0, 1.0), (50.0, 51.0))
    assert sorted(map(tuple, got.collect())) == [(0.5, 50.5, 7.0, False), (0.5, 50.6, None, True), (0.6, 50.5, None, True)]


def test_outer_model_and_names(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, -5.0), (1.0, 3.0, -9.0), (1.0, 4.0, 2.0)], "nav_lon double, nav_lat double, deptho double").write.parquet(f"{tmp_path}/o")
    assert sorted(r.depth for r in files.outer_model(spark, f"{tmp_path}/o").collect()) == [5.0, 9.0]
    spark.createDataFrame([(1.0, 2.0, 4.0)], "lon double, lat double, topo double").write.parquet(f"{tmp_path}/t")
    assert [r.depth for r in files.outer_model(spark, f"{tmp_path}/t", "topo").collect()] == [4.0]
    spark.range(1).write.parquet(f"{tmp_path}/x")
    with pytest.raises(ValueError):
        files.outer_model(spark, f"{tmp_path}/x")


def test_boundary_points(spark, tmp_path):
    (tmp_path / "b.csv").write_text("T-grid\nlon,lat\n1.00000,50.00000\nnot,a number\n2.5, 51\n3\n")
    assert sorted(map(tuple, files.boundary_points(spark, f"{tmp_path}/b.csv").collect())) == [(1.0, 50.0), (2.5, 51.0)]


def test_cells_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, None)], "j int, i int, depth double")
    files.write_cells(cells, f"{tmp_path}/c")
    back = files.check_shape(spark.read.parquet(f"{tmp_path}/c"), 2, 2)
    assert sorted(map(tuple, back.collect())) == [(0, 0, 1.0), (1, 1, None)]
    with pytest.raises(ValueError):
        files.check_shape(back, 3, 2)


def test_soundings_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 0.01, 50.01, 4.0), ("2024-01-01 00:20:00", 0.02, 50.02, None), ("2024-01-01 01:10:00", 0.01, 50.01, 8.0), (None, 0.01, 50.01, 1.0)]
    data = spark.createDataFrame(rows, "ts string, lon double, lat double, depth double").selectExpr("cast(ts as timestamp) ts", "lon", "lat", "depth")
    data.write.parquet(f"{tmp_path}/s")
    stream = soundings.cell_means(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/s"), 0.1, 0.1)
    run = stream.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted((r.n, r.wet_fraction, r.depth) for r in spark.table("cells").collect())
    assert got == [(1, 1.0, 8.0), (2, 0.5, 4.0)]
    assert sorted((r.n, r.wet_fraction, r.depth) for r in soundings.cell_means(data, 0.1, 0.1).collect()) == got
