import pytest

from soundgrid.operators import smooth
from soundgrid.sources import config, files

TEXT = """
name: sound
grid: {type: spherical, lon_min: 0, lon_max: 1, lat_min: 50, lat_max: 51, dlon: 0.5, dlat: 0.5, equidistant: false}
rx0_target: [0.2, 0.3]
fixes: [{key: b001}, {lon: 1.0, lat: 50.5, action: close_cell}]
waypoints: [{name: w, begin: [0, 50], via: [[0.5, 50.5]], end: {lon: 1, lat: 51}}]
morphology: {waypoints: [[0, 50], {lon: 1, lat: 51}]}
"""
FILE = {"fixes": {"b001": {"lon": 0.5, "lat": 50.5, "action": "set_depth", "value": 9, "applied": False}, "s001": {"lon": 0.0, "lat": 50.0, "action": "deepen_by", "value": 2, "applied": True}}}


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(TEXT)
    c = config.read(spark, f"file://{tmp_path}/c.yaml")
    assert config.grid(spark, c).count() == 9
    assert config.slope_limits(c, (0.25, 0.2)) == [0.3, 0.25, 0.2]
    assert [tuple(r) for r in config.corrections(spark, c, FILE).orderBy("ord").collect()] == [(0, 0.5, 50.5, "set_depth", 9.0), (1, 1.0, 50.5, "close_cell", None), (2, 0.0, 50.0, "deepen_by", 2.0)]
    assert config.corrections(spark, c, FILE, everything=True).count() == 4
    with pytest.raises(KeyError):
        config.corrections(spark, c)
    assert [tuple(r) for r in config.stops(spark, c).orderBy("seq").collect()] == [("w", 0, 0.0, 50.0), ("w", 1, 0.5, 50.5), ("w", 2, 1.0, 51.0)]
    assert [tuple(r) for r in config.branches(spark, c).orderBy("seq").collect()] == [("sound", 0, 0.0, 50.0), ("sound", 1, 1.0, 51.0)]
    with pytest.raises(ValueError):
        config.waypoints(["here"])


def test_columns_by_limit(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 50.0, 10.0, 1), (0, 1, 0.1, 50.0, 100.0, 1)], "j int, i int, lon double, lat double, depth double, mask int")
    got = config.smoothed(cells, [0.5, 0.2]).orderBy("i").collect()
    assert [(round(r.depth_rx0_0p50, 4), round(r.depth_rx0_0p20, 4)) for r in got] == [(33.3333, 66.6667), (100.0, 100.0)]
    assert [r.status for r in smooth.verdict(cells, [0.9, 0.2]).collect()] == ["OK", "VIOLATED"]


def test_written_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0, 5.0, 6.0)], "j int, i int, lon double, lat double, depth_raw double, other_depth double")
    rows.write.parquet(f"{tmp_path}/r")
    assert files.depth_raster(spark, f"{tmp_path}/r").collect()[0].depth == 5.0
    assert files.depth_raster(spark, f"{tmp_path}/r", "other_depth").collect()[0].depth == 6.0
    assert files.write_csv(rows, f"{tmp_path}/csv") and not files.write_csv(rows.limit(0), f"{tmp_path}/none")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == rows.columns
    assert not (tmp_path / "none").exists()
