"""Configurations: small dictionaries that say what a run does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fixes, grids, smooth


def read(spark: SparkSession, path: str) -> dict:
    """The configuration in a YAML file, wherever Spark can read it; an empty file is an empty configuration."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading configurations needs the yaml module; give a dictionary instead") from e
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return yaml.safe_load(rows[0].value if rows else "") or {}


def waypoints(raw: list) -> list[tuple[float, float]]:
    """(lon, lat) of waypoints given as pairs or as mappings with lon and lat."""
    out = []
    for item in raw:
        if isinstance(item, (list, tuple)) and len(item) >= 2:
            out.append((float(item[0]), float(item[1])))
        elif isinstance(item, dict) and {"lon", "lat"} <= item.keys():
            out.append((float(item["lon"]), float(item["lat"])))
        else:
            raise ValueError(f"not a waypoint: {item!r}")
    return out


def branches(spark: SparkSession, config: dict) -> DataFrame:
    """branch, seq, lon, lat of a configuration's branches; a plain list of waypoints is one branch named after the run."""
    section = config.get("morphology", {})
    listed = section.get("branches") or [{"name": config.get("name", "main"), "waypoints": section.get("waypoints", [])}]
    rows = [(b["name"], n, x, y) for b in listed for n, (x, y) in enumerate(waypoints(b["waypoints"]))]
    return spark.createDataFrame(rows, "branch string, seq int, lon double, lat double")


def stops(spark: SparkSession, config: dict) -> DataFrame:
    """name, seq, lon, lat of the routes' stops: begin, those between, end."""
    rows = []
    for w in config.get("waypoints", []):
        rows += [(w["name"], n, x, y) for n, (x, y) in enumerate(waypoints([w["begin"], *(w.get("via") or []), w["end"]]))]
    return spark.createDataFrame(rows, "name string, seq int, lon double, lat double")


def corrections(spark: SparkSession, config: dict, file: dict | None = None, everything: bool = False) -> DataFrame:
    """ord, lon, lat, action, value: the configuration's fixes, keys looked up in the file's, then the file's that are applied (or all)."""
    known = fixes.load((file or {}).get("fixes") or {})
    own = fixes.load(config.get("fixes") or [])
    by_key = {f["key"]: f for f in known}
    missing = [f["key"] for f in own if "lon" not in f and f["key"] not in by_key]
    if missing:
        raise KeyError(f"unknown fixes: {', '.join(missing)}")
    own = [{**by_key[f["key"]], "applied": True} if "lon" not in f else {**f, "applied": f.get("applied", True)} for f in own]
    return fixes.table(spark, own + [f for f in known if everything or f.get("applied", False)])


def slope_limits(config: dict, more: tuple[float, ...] = ()) -> list[float]:
    """The configuration's limits and those given besides, each once, the largest first."""
    listed = config.get("rx0_target", [])
    return sorted({float(t) for t in [*(listed if isinstance(listed, list) else [listed]), *more]}, reverse=True)


def smoothed(cells: DataFrame, limits: list[float]) -> DataFrame:
    """cells with one more column for each limit, such as depth_rx0_0p20, of the depth that is deepened to keep to it."""
    for limit in limits:
        name = f"depth_rx0_{limit:.2f}".replace(".", "p")
        cells = cells.join(smooth.envelope(cells.select("j", "i", "lon", "lat", "mask", "depth"), limit).select("j", "i", F.col("depth").alias(name)), ["j", "i"])
    return cells


def grid(spark: SparkSession, config: dict) -> DataFrame:
    return grids.build(spark, config["grid"])
