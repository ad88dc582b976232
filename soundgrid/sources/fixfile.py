"""The file of corrections: YAML that is edited by hand, read as a table and written back."""

from __future__ import annotations

import unicodedata
from re import sub

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fixes
from . import config

SCHEMA = "grp string, key string, ord int, lon double, lat double, action string, value double, applied boolean, comment string"
ISLANDS = "phantom_islands"


def group_name(route: str) -> str:
    """The group of a route's corrections: tw_ and its name in plain small letters, digits and underscores."""
    plain = unicodedata.normalize("NFKD", route).encode("ascii", "ignore").decode().lower()
    return f"tw_{sub('[^a-z0-9]+', '_', plain).strip('_')}"


def _row(grp: str | None, key: str, n: int, f: dict, applied: bool) -> tuple:
    value = f.get("value", f.get("depth"))
    return (grp, key, n, float(f["lon"]), float(f["lat"]), f.get("action", "set_depth"), None if value is None else float(value), applied, f.get("comment") or "")


def _raw(spark: SparkSession, path: str) -> dict:
    """The file's fixes; none if there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    listed = config.read(spark, path).get("fixes") or {}
    return listed if isinstance(listed, dict) else {f["key"]: f for f in fixes.load(listed)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """grp (null for single fixes), key, ord (in the group), lon, lat, action, value, applied, comment."""
    rows, n = [], 0
    for key, f in _raw(spark, path).items():
        if not isinstance(f, dict):
            continue
        if "lon" in f and "lat" in f:
            rows.append(_row(None, str(key), n, f, bool(f.get("applied", False))))
            n += 1
        elif key == ISLANDS or str(key).startswith("tw_"):
            own = [(sub_, g) for sub_, g in f.items() if isinstance(g, dict) and "lon" in g and "lat" in g]
            rows += [_row(str(key), str(sub_), k, g, bool(f.get("applied", False))) for k, (sub_, g) in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


def _put(spark: SparkSession, path: str, listed: dict) -> None:
    import yaml

    text = "# Set applied to true or false, here or for a whole group, and run again with the fixes that are applied.\n" + yaml.safe_dump({"fixes": listed}, sort_keys=False, allow_unicode=True)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write(table: DataFrame, path: str) -> None:
    """The table as the file at path; single fixes first, then routes' groups by name, phantom islands last. A group's fixes are numbered anew."""
    rows = table.orderBy(F.col("grp").isNotNull(), F.col("grp") == ISLANDS, "grp", "ord", "key").collect()  # a list that people edit
    listed: dict = {}
    for r in rows:
        own = {"lon": r.lon, "lat": r.lat, "action": r.action} | ({} if r.value is None else {"value": r.value})
        if r.grp is None:
            listed[r.key] = own | {"applied": bool(r.applied), "comment": r.comment or ""}
        else:
            group = listed.setdefault(r.grp, {"applied": bool(r.applied)})
            group[f"{len(group):03d}"] = own | {"comment": r.comment or ""}
    _put(table.sparkSession, path, listed)


def update(spark: SparkSession, path: str, single: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The file brought up to date with single fixes (key, ord, lon, lat, action, value, comment) and groups (grp, ord, lon, lat, action, value, comment); the table that was written."""
    old = read(spark, path)
    flat = fixes.merge(old.where("grp is null"), single).withColumn("grp", F.lit(None).cast("string"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    fresh = groups if groups is not None else spark.createDataFrame([], "grp string, ord int, lon double, lat double, action string, value double, comment string")
    grouped = fixes.merge_groups(old.where("grp is not null"), fresh).withColumn("key", F.lpad((F.col("ord") + 1).cast("string"), 3, "0"))
    out = flat.select(names).unionByName(grouped.select(names))
    write(out, path)
    return read(spark, path)


def mark_all_applied(spark: SparkSession, path: str) -> int:
    """Sets every applied flag of the file to true; how many there are."""
    listed = _raw(spark, path)
    flagged = [f for f in listed.values() if isinstance(f, dict) and "applied" in f]
    for f in flagged:
        f["applied"] = True
    if flagged:
        _put(spark, path, listed)
    return len(flagged)
