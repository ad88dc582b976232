"""Narrow straits: interfaces between wet cells, measured on the fine raster around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

# Categories, worst first.
RANK = ("BLOCKED", "SILL_DEFICIT", "AREA_DEFICIT", "OK")


def interfaces(cells: DataFrame, wet_fraction: float = 0.3) -> DataFrame:
    """direction, j, i, lon, lat and both depths of interfaces between wet cells of which one has little wet fraction."""
    parts = []
    for direction, part, along in (("U", "j", "i"), ("V", "i", "j")):
        w = Window.partitionBy(part).orderBy(along)
        nxt = {c: F.lead(c).over(w).alias(f"{c}2") for c in ("lon", "lat", "depth", "mask", "wet_fraction")}
        two = cells.select("j", "i", "lon", "lat", "depth", "mask", "wet_fraction", *nxt.values())
        two = two.where("mask = 1 and mask2 = 1").where((F.col("wet_fraction") < wet_fraction) | (F.col("wet_fraction2") < wet_fraction))
        parts.append(two.select(F.lit(direction).alias("direction"), "j", "i", ((F.col("lon") + F.col("lon2")) / 2).alias("lon"), ((F.col("lat") + F.col("lat2")) / 2).alias("lat"), F.col("depth").alias("d1"), F.col("depth2").alias("d2")))
    return parts[0].unionByName(parts[1])


def windows(faces: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """faces with the inclusive fine window: two cells along the direction, one across."""
    u = F.col("direction") == "U"
    wx, wy = F.when(u, dlon).otherwise(dlon / 2) + 1e-9, F.when(u, dlat / 2).otherwise(dlat) + 1e-9
    return faces.withColumns({"lon0": F.col("lon") - wx, "lon1": F.col("lon") + wx, "lat0": F.col("lat") - wy, "lat1": F.col("lat") + wy})


def _km(lat: str) -> Column:
    """Kilometres of a degree across the direction. Areas of both rasters are multiplied in one order, so that equal ratios round alike."""
    return F.lit(geo.KM_PER_DEG) * F.when(F.col("direction") == "U", 1.0).otherwise(F.cos(F.radians(lat)))


def sections(faces: DataFrame, fine: DataFrame, dlon: float, dlat: float, fine_dlon: float, fine_dlat: float) -> DataFrame:
    """faces with width_km, sill_fine, area_fine of the fine line nearest to the interface (the first on ties)."""
    f = fine.select("lon", "lat", "depth", F.col("j").alias("fj"), F.col("i").alias("fi"))
    w = windows(faces, dlon, dlat).withColumnsRenamed({"lon": "x", "lat": "y"})
    hit = spatial.range_join(w, f, max(dlon, dlat))
    off = F.round(F.when(F.col("direction") == "U", F.abs(F.col("lon") - F.col("x"))).otherwise(F.abs(F.col("lat") - F.col("y"))), 9)
    line = F.when(F.col("direction") == "U", F.col("fi")).otherwise(F.col("fj"))
    hit = hit.withColumns({"off": off, "line": line})
    keys = ["direction", "j", "i"]
    best = hit.groupBy(*keys).agg(F.min(F.struct("off", "line")).alias("m")).select(*keys, F.col("m.line").alias("line"))
    u = F.col("direction") == "U"
    fine_deg, km = F.when(u, fine_dlat).otherwise(fine_dlon), _km("y")
    out = hit.join(best, [*keys, "line"]).groupBy(*keys, "x", "y", "d1", "d2").agg(F.count_if(F.col("depth").isNotNull()).alias("n_wet"), F.coalesce(F.max("depth"), F.lit(0.0)).alias("sill_fine"), F.sum(F.coalesce("depth", F.lit(0.0))).alias("sum_depth"))
    return out.withColumns({"width_km": F.col("n_wet") * fine_deg * km, "area_fine": F.col("sum_depth") * (fine_deg * 1000.0) * km}).drop("n_wet", "sum_depth").withColumnsRenamed({"x": "lon", "y": "lat"})


def split_connected(pdf: pd.DataFrame, axis: str) -> bool:
    """Whether a window's halves, split across the axis, share a four-neighbour component at the split; holes in the raster are dry."""
    g = pdf.pivot(index="fj", columns="fi", values="wet").eq(True).to_numpy(dtype=bool)
    g = g if axis == "U" else g.T
    at = g.shape[1] // 2
    if at == 0 or not g[:, :at].any() or not g[:, at:].any():
        return False
    seen = np.zeros_like(g)
    stack = [(r, at - 1) for r in np.flatnonzero(g[:, at - 1])]
    for r, c in stack:
        seen[r, c] = True
    while stack:
        r, c = stack.pop()
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < g.shape[0] and 0 <= x < g.shape[1] and g[y, x] and not seen[y, x]:
                seen[y, x] = True
                stack.append((y, x))
    return bool(seen[:, at].any())


def connected(faces: DataFrame, fine: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """direction, j, i, connected: a window is as small as two coarse cells, so each is one group."""
    f = fine.select("lon", "lat", F.col("depth").isNotNull().alias("wet"), F.col("j").alias("fj"), F.col("i").alias("fi"))
    w = windows(faces, dlon, dlat).select("direction", "j", "i", "lon0", "lon1", "lat0", "lat1")
    hit = spatial.range_join(w, f, max(dlon, dlat)).select("direction", "j", "i", "fj", "fi", "wet")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("direction", "j", "i")} | {"connected": [split_connected(pdf, pdf["direction"].iloc[0])]})

    return hit.groupBy("direction", "j", "i").applyInPandas(test, "direction string, j int, i int, connected boolean")


def classify(records: DataFrame, dlon: float, dlat: float, sill_ratio: float = 0.7, area_ratio: float = 0.5) -> DataFrame:
    """records with coarse section, ratios and category; interfaces that are wide and OK are dropped."""
    u = F.col("direction") == "U"
    r = records.withColumn("sill_coarse", (F.col("d1") + F.col("d2")) / 2).withColumn("area_coarse", F.col("sill_coarse") * (F.when(u, dlat).otherwise(dlon) * 1000.0) * _km("lat"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    r = r.withColumns({"sill_ratio": ratio("sill_fine", "sill_coarse"), "area_ratio": ratio("area_fine", "area_coarse")})
    category = F.when(~F.col("connected"), "BLOCKED").when(F.col("sill_ratio") < sill_ratio, "SILL_DEFICIT").when(F.col("area_ratio") < area_ratio, "AREA_DEFICIT").otherwise("OK")
    limit = F.when(u, F.lit(2 * dlon * geo.KM_PER_DEG) * F.cos(F.radians("lat"))).otherwise(F.lit(2 * dlat * geo.KM_PER_DEG))
    r = r.withColumn("category", category).where((F.col("category") != "OK") | (F.col("width_km") < limit))
    return r.withColumns({"width_km": geo.half_even("width_km", 2), "sill_fine": geo.half_even("sill_fine", 1), "sill_coarse": geo.half_even("sill_coarse", 1), "sill_ratio": geo.half_even("sill_ratio", 3), "area_ratio": geo.half_even("area_ratio", 3), "area_fine": geo.half_even("area_fine", 0), "area_coarse": geo.half_even("area_coarse", 0)}).drop("d1", "d2")


def find(cells: DataFrame, fine: DataFrame, dlon: float, dlat: float, fine_dlon: float, fine_dlat: float, wet_fraction: float = 0.3, **limits: float) -> DataFrame:
    faces = interfaces(cells, wet_fraction)
    both = sections(faces, fine, dlon, dlat, fine_dlon, fine_dlat).join(connected(faces, fine, dlon, dlat), ["direction", "j", "i"])
    return classify(both, dlon, dlat, **limits)


def ranked(records: DataFrame, top: int | None = None) -> DataFrame:
    """records, worst first: category, sill deficit (largest), area ratio, place."""
    rank = F.array_position(F.array(*[F.lit(c) for c in RANK]), F.col("category"))
    deficit = geo.half_even(F.col("sill_coarse") * (1 - F.col("sill_ratio")), 6)
    out = records.withColumns({"rank": rank, "sill_deficit": deficit}).orderBy("rank", F.desc("sill_deficit"), "area_ratio", "direction", "j", "i")
    return out.limit(top) if top else out


def summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in RANK])
