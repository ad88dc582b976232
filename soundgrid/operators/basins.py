"""Connectivity of the coarse mask: basins, isolation, land bridges, phantom islands, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, spatial

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def _around(cells: DataFrame, steps: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Each cell's neighbours (j, i) with the cell's own columns keep."""
    to = F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a, b in steps]))
    return cells.select(*keep, to.alias("t")).select(*keep, "t.j", "t.i")


def labelled(cells: DataFrame) -> DataFrame:
    """cells with label: the smallest id of a wet cell's basin, null on land; an earlier label goes."""
    cells = cells.drop("label")
    wet = graph.label_cells(cells.where("mask = 1").select("j", "i", "id")).select("j", "i", "label")
    return cells.join(wet, ["j", "i"], "left")


def basin_sizes(labels: DataFrame) -> DataFrame:
    """label, n, basin_rank (1 is largest; ties by label)."""
    n = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("basin_rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # one row a basin


def mask_isolated(cells: DataFrame, nkeep: int = 1, keep: list[int] | None = None) -> DataFrame:
    """cells with land in all but the largest basins (or those of the ranks in keep; unknown ranks count for nothing)."""
    labels = labelled(cells)
    ranks = basin_sizes(labels)
    kept = ranks.where(F.col("basin_rank").isin(keep) if keep else F.col("basin_rank") <= nkeep).select("label", F.lit(True).alias("kept"))
    out = labels.join(kept, "label", "left")
    dry = F.col("kept").isNull()
    return out.withColumns({"mask": F.when(dry, 0).otherwise(F.col("mask")).cast("tinyint"), "depth": F.when(~dry, F.col("depth")), "wet_fraction": F.when(dry, 0.0).otherwise(F.col("wet_fraction"))}).drop("kept")


def isolation_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    x = before.select("j", "i", F.col("mask").alias("m0")).join(after.select("j", "i", F.col("mask").alias("m1")), ["j", "i"])
    return x.agg(F.sum("m0").alias("wet_before"), F.sum("m1").alias("wet_after"), F.count_if((F.col("m0") == 1) & (F.col("m1") == 0)).alias("masked"))


def land_bridges(cells: DataFrame) -> DataFrame:
    """j, i, n_components, labels, estimated_depth of land cells between two or more basins; each neighbour counts for the depth."""
    labels = labelled(cells)
    land = labels.where("mask = 0").select("j", "i")
    near = _around(labels.where("mask = 1"), FOUR, "label", "depth").join(land, ["j", "i"])
    out = near.groupBy("j", "i").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.coalesce(F.bround(F.avg("depth"), 1), F.lit(5.0)).alias("estimated_depth"))
    return out.where(F.size("labels") >= 2).select("j", "i", F.size("labels").alias("n_components"), "labels", "estimated_depth")


def dilate(cells: DataFrame, times: int) -> DataFrame:
    """j, i within that many steps of four neighbours."""
    reach = [(a, b) for a in range(-times, times + 1) for b in range(-times, times + 1) if abs(a) + abs(b) <= times]
    return _around(cells, reach).distinct()


def phantom_fallback(cells: DataFrame, max_wet_fraction: float = 0.5, radius: int = 2) -> DataFrame:
    """Wet cells of little wet fraction with no land within a box of the radius."""
    box = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    return cells.where((F.col("mask") == 1) & (F.col("wet_fraction") < max_wet_fraction)).join(_around(cells.where("mask = 0"), box).distinct(), ["j", "i"], "left_anti")


def phantom_islands(cells: DataFrame, fine: DataFrame, half: float, max_wet_fraction: float = 0.5, max_fine_cells: int = 1000, max_cluster_size: int = 1) -> DataFrame:
    """j, i, n_fine, cluster, cluster_size, cluster_fine: wet coarse cells whose land is only small islands.

    A candidate's box holds fine land; none of it may belong to a component of max_fine_cells or more. Candidates that
    share a component are one cluster; larger clusters than max_cluster_size are dropped.
    """
    top = fine.agg((F.max("i") + 1).alias("nx")).first().nx or 1
    land = graph.label_runs(fine.where("depth is null").select("j", "i", "lon", "lat", (F.col("j") * top + F.col("i")).alias("id")))
    size = land.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    land = land.join(size, "label").select("lon", "lat", "label", "n")
    box = cells.where((F.col("mask") == 1) & (F.col("wet_fraction") < max_wet_fraction)).select("id", "j", "i", *[F.expr(e).alias(n) for n, e in (("lon0", f"lon - {half} - 1e-9"), ("lon1", f"lon + {half} + 1e-9"), ("lat0", f"lat - {half} - 1e-9"), ("lat1", f"lat + {half} + 1e-9"))])
    hits = spatial.range_join(box, land, 2 * half)
    fine_n = hits.groupBy("id", "j", "i").agg(F.count(F.lit(1)).alias("n_fine"), F.max("n").alias("largest")).where(F.col("largest") < max_fine_cells).drop("largest")
    parts = hits.join(fine_n.select("id"), "id").select(F.col("id").cast("long").alias("a"), (-1 - F.col("label")).alias("b")).distinct()
    labels = graph.components(parts).withColumnsRenamed({"node": "id", "label": "cluster"})
    out = fine_n.join(labels, "id")
    first = out.groupBy("cluster").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("cluster_size"), F.sum("n_fine").alias("cluster_fine"))
    return out.join(first, "cluster").where(F.col("cluster_size") <= max_cluster_size).select("j", "i", "n_fine", F.col("first").alias("cluster"), "cluster_size", "cluster_fine")


def region_cells(cells: DataFrame, regions: list[dict]) -> DataFrame:
    """j, i, ord: wet cells of each mask region; a cell belongs to the first region that holds it."""
    spark, found = cells.sparkSession, None
    wet = cells.where("mask = 1")
    for k, r in enumerate(regions):
        kind = r["type"]
        if kind in ("rectangle", "rect", "box"):
            hit = wet.where(F.col("lon").between(r["lon_min"], r["lon_max"]) & F.col("lat").between(r["lat_min"], r["lat_max"]))
        elif kind == "polygon" and len(r["vertices"]) >= 3:
            v = spark.createDataFrame([(0, n, float(x), float(y)) for n, (x, y) in enumerate(r["vertices"])], "poly int, seq int, vlon double, vlat double")
            hit = wet.join(spatial.in_polygons(wet, v, "id").select("id"), "id", "left_semi")
        elif kind in ("point", "polygon"):
            at = r["vertices"] if kind == "polygon" else [(r["lon"], r["lat"])]
            p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(at)], "pid int, lon double, lat double")
            hit = wet.join(spatial.nearest_cell(p, cells).select("j", "i"), ["j", "i"], "left_semi")
        elif kind in ("ij_rectangle", "ij_rect", "ij_box"):
            hit = wet.where(F.col("i").between(r.get("i_min", 0), r.get("i_max", 1 << 30)) & F.col("j").between(r.get("j_min", 0), r.get("j_max", 1 << 30)))
        elif kind in ("ij_point", "index_point"):
            hit = wet.where((F.col("i") == r["i"]) & (F.col("j") == r["j"]))
        else:
            raise ValueError(f"unknown mask region type {kind}")
        hit = hit.select("j", "i", F.lit(k).alias("ord"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("j", "i").agg(F.min("ord").alias("ord"))


def apply_regions(cells: DataFrame, regions: list[dict]) -> DataFrame:
    """cells with land in all regions."""
    out = cells.join(region_cells(cells, regions), ["j", "i"], "left")
    dry = F.col("ord").isNotNull()
    return out.withColumns({"mask": F.when(dry, 0).otherwise(F.col("mask")).cast("tinyint"), "depth": F.when(~dry, F.col("depth")), "wet_fraction": F.when(dry, 0.0).otherwise(F.col("wet_fraction"))}).drop("ord")


def bridge_summary(bridges: DataFrame) -> DataFrame:
    """n_bridges, n_three_or_more: land bridges, and those between three components or more."""
    return bridges.agg(F.count(F.lit(1)).alias("n_bridges"), F.count_if(F.col("n_components") >= 3).alias("n_three_or_more"))


def region_summary(cells: DataFrame, regions: list[dict]) -> DataFrame:
    """ord, n_masked: the cells that each region makes land; a cell that an earlier region took is not counted again."""
    spark = cells.sparkSession
    every = spark.createDataFrame([(k,) for k in range(len(regions))], "ord int")
    return every.join(region_cells(cells, regions).groupBy("ord").agg(F.count(F.lit(1)).alias("n")), "ord", "left").select("ord", F.coalesce("n", F.lit(0)).alias("n_masked"))
