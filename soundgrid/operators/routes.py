"""Routes as records: along straits, between open boundaries and by waypoints, each with what the coarse grid makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import written
from . import deepest, spatial, thalweg


def along_straits(straits: DataFrame, fine: DataFrame, fine_dlon: float, fine_dlat: float, dlon: float, dlat: float, cells_along: int = 5, cells_across: int = 2) -> DataFrame:
    """name, seq, lon, lat, dist_km, depth: the deepest cell of each line across a strait (direction, j, i, lon, lat), along its window.

    The window is cells_along times as far to each side as the raster's window of the interface is long, and reaches
    cells_across times 20 raster cells across. Of equal depths the first line is taken; a line on land has a null depth
    and the strait's own place across. Distances are from the interface, in the direction of the line's number. Straits
    with fewer than three lines, or three wet ones, have no route.
    """
    u = F.col("direction") == "U"
    pick = lambda a, b: F.when(u, a).otherwise(b)
    long = lambda d, step: cells_along * (round(2 * d / step) - 1) * step + 1e-9
    wx, wy = pick(F.lit(long(dlon, fine_dlon)), F.lit(20 * cells_across * fine_dlon + 1e-9)), pick(F.lit(20 * cells_across * fine_dlat + 1e-9), F.lit(long(dlat, fine_dlat)))
    name = F.concat_ws("_", "direction", "j", "i")
    w = straits.select(name.alias("name"), "direction", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("lon") - wx).alias("lon0"), (F.col("lon") + wx).alias("lon1"), (F.col("lat") - wy).alias("lat0"), (F.col("lat") + wy).alias("lat1"))
    hit = spatial.range_join(w, fine.select("j", "i", "lon", "lat", "depth"), max(dlon, dlat) * cells_along)
    hit = hit.withColumns({"seq": pick(F.col("i"), F.col("j")), "across": pick(F.col("j"), F.col("i"))})
    deepest_ = F.max(F.when(F.col("depth").isNotNull(), F.struct("depth", (-F.col("across")).alias("o"), "lon", "lat"))).alias("m")
    lines = hit.groupBy("name", "direction", "x", "y", "seq").agg(deepest_, F.min(pick(F.col("lon"), F.col("lat"))).alias("place"))
    lines = lines.withColumns({"lon": pick(F.col("place"), F.coalesce("m.lon", "x")), "lat": pick(F.coalesce("m.lat", "y"), F.col("place")), "depth": F.col("m.depth")})
    km = pick((F.col("lon") - F.col("x")) * F.cos(F.radians("y")), F.col("lat") - F.col("y")) * geo.KM_PER_DEG
    one = Window.partitionBy("name")
    lines = lines.withColumns({"dist_km": km, "n": F.count(F.lit(1)).over(one), "wet": F.count("depth").over(one)})
    return lines.where("n >= 3 and wet >= 3").select("name", "seq", "lon", "lat", "dist_km", "depth")


def _sill(depth: str, positive: bool) -> Column:
    """The shallowest depth and where it is, the first of equal ones."""
    valid = F.col(depth).isNotNull() & ((F.col(depth) > 0) if positive else F.lit(True))
    return F.min(F.when(valid, F.struct(F.col(depth).alias("depth"), "seq", "dist_km")))


def records(points: DataFrame, sill_ratio: float = 0.7, positive: bool = True) -> DataFrame:
    """name, n, length_km, fine_sill, fine_sill_km, coarse_sill, coarse_sill_km, sill_deficit_m, mae, rmse, category of routes' points (with coarse_depth)."""
    d = F.col("depth") - F.col("coarse_depth")
    out = points.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("dist_km").alias("length_km"), _sill("depth", positive).alias("f"), _sill("coarse_depth", False).alias("c"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    ratio = F.try_divide(F.col("c.depth"), F.col("f.depth"))
    category = F.when(ratio.isNull(), "WAYPOINT").when(ratio < sill_ratio, "SILL_DEFICIT").otherwise("OK")
    return out.select("name", "n", "length_km", F.col("f.depth").alias("fine_sill"), F.col("f.dist_km").alias("fine_sill_km"), F.col("c.depth").alias("coarse_sill"), F.col("c.dist_km").alias("coarse_sill_km"), (F.col("f.depth") - F.col("c.depth")).alias("sill_deficit_m"), "mae", "rmse", category.alias("category"))


def start_pairs(starts: DataFrame) -> DataFrame:
    """leg, edge_a, edge_b, a, b: each pair of starts (ord, edge, segment, id), the first by ord before the other; leg counts them."""
    a, b = (starts.select(*[F.col(c).alias(f"{c}_{n}") for c in ("ord", "edge", "segment", "id")]) for n in "ab")
    # starts are few: the deepest cells of runs along the grid's edges, of at least some cells each
    pairs = a.join(b, F.col("ord_a") < F.col("ord_b"))
    name = F.format_string("%s[%d]→%s[%d]", "edge_a", "segment_a", "edge_b", "segment_b")
    leg = F.row_number().over(Window.orderBy("ord_a", "ord_b"))
    return pairs.select(leg.alias("leg"), name.alias("name"), "edge_a", "edge_b", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def across_edges(starts: DataFrame) -> DataFrame:
    """a, b: the first pair of starts (ord, edge, id) on different edges; the first and the last start where all are on one; nothing for fewer than two."""
    first = starts.agg(F.min(F.struct("ord", "edge", "id")).alias("s"), F.max(F.struct("ord", "id")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # the first start with any on another edge is the first of all, unless all are on one edge
    other = starts.join(F.broadcast(first), F.col("edge") != F.col("s.edge")).agg(F.min(F.struct("ord", "id")).alias("o"))  # one row
    both = first.join(F.broadcast(other))
    return both.select(F.col("s.id").alias("a"), F.coalesce("o.id", "last.id").alias("b"))


def between_boundaries(fine: DataFrame, cells: DataFrame, starts: DataFrame, max_deg: float, min_sill: float = 5.0, max_detour: float = 20.0, tolerance: float = 2.0, tile: int = deepest.TILE) -> tuple[DataFrame, DataFrame]:
    """Points and records of the deepest routes between starts (ord, edge, segment, lon, lat) on the coarse grid's edges.

    Starts go to the deepest wet raster cell near them, in the coarse centres' box if it has one. Routes keep to that
    box. They count if they have five cells or more, are deep enough and don't wander, and if no earlier one between the
    same edges has nearly the same sill. One spanning forest serves all pairs.
    """
    box = cells.agg(*[f(c).alias(f"{c}{n}") for c in ("lon", "lat") for n, f in ((0, F.min), (1, F.max))]).first()
    domain = (box.lon0, box.lon1, box.lat0, box.lat1)
    at = thalweg.deepest_in_box(starts, fine, domain, key="ord")
    snapped = written(starts.select("ord", "edge", "segment").join(at, "ord").join(fine.select("j", "i", "id"), ["j", "i"]).select("ord", "edge", "segment", "id"), "starts")
    pairs = written(start_pairs(snapped), "start-pairs")
    inside = F.col("lon").between(*domain[:2]) & F.col("lat").between(*domain[2:])
    wet = fine.where("depth is not null").where(inside).select(F.lit("all").alias("graph"), "j", "i", "id", "depth")
    found = deepest.paths(wet, pairs.select("leg", F.lit("all").alias("graph"), "a", "b"), tile=tile)
    path = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("leg"))).where("n >= 5").join(fine.select("id", "lon", "lat", "depth"), "id")
    points = thalweg.profile(path.select(F.col("leg").alias("name"), "seq", "id", "lon", "lat", "depth"))
    points = written(thalweg.sample(points, cells, max_deg), "route-points")
    ends = points.groupBy("name").agg(F.min(F.struct("seq", "lon", "lat")).alias("p"), F.max(F.struct("seq", "lon", "lat")).alias("q"), F.count(F.lit(1)).alias("n_inside"))
    direct = ends.select("name", "n_inside", geo.great_circle_km("p.lon", "p.lat", "q.lon", "q.lat").alias("direct_km"))
    own = records(points).join(direct, "name").withColumnsRenamed({"name": "leg"}).join(pairs.select("leg", "name", "edge_a", "edge_b"), "leg")
    own = own.withColumns({"sill_depth": F.col("fine_sill"), "ord": F.col("leg")})
    kept = written(thalweg.distinct_sills(thalweg.crossing(own, min_sill, max_detour), tolerance).drop("sill_depth", "ord").withColumn("category", F.lit("AUTO")), "routes")
    points = points.withColumnRenamed("name", "leg").join(kept.select("leg", "name"), "leg").drop("leg")
    return points, kept.drop("leg")


def by_waypoints(fine: DataFrame, cells: DataFrame, stops: DataFrame, margin: float, max_deg: float, sill_ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Points and records of the deepest routes through stops (name, seq, lon, lat); a route that fails has failed and failed_reason instead of numbers.

    A route fails with fewer than two stops, if two stops aren't joined in the box around all, or with fewer than three cells.
    """
    path = written(thalweg.waypoint_paths(fine, stops, margin), "waypoint-path")
    legs = stops.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("legs"))
    w = Window.partitionBy("name").orderBy("seq")
    snapped = thalweg.snap(stops, fine)
    ends = snapped.withColumn("b", F.lead("id").over(w)).where("b is not null").select("name", F.col("seq").alias("leg_seq"), F.col("id").alias("a"), "b")
    # a joined leg ends on its own stop, so a path has all its stops if every leg's end is on it
    on = ends.join(path.select("name", F.col("id").alias("b")).distinct(), ["name", "b"], "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("joined"))
    size = path.groupBy("name").agg(F.count(F.lit(1)).alias("cells"))
    state = legs.join(on, "name", "left").join(size, "name", "left").na.fill(0, ["joined", "cells"])
    reason = F.when(F.col("legs") < 1, "fewer than two stops").when(F.col("joined") < F.col("legs"), "stops are not joined").when(F.col("cells") < 3, "fewer than three cells")
    state = written(state.select("name", reason.alias("failed_reason")), "route-state")
    good = path.join(state.where("failed_reason is null").select("name"), "name")
    points = written(thalweg.sample(thalweg.profile(good), cells, max_deg), "waypoint-points")
    return points, state.join(records(points, sill_ratio), "name", "left").withColumn("failed", F.col("failed_reason").isNotNull())


def by_variant(points: DataFrame, variants: dict[str, DataFrame], max_deg: float) -> DataFrame:
    """variant, name, n, coarse_sill, mae, rmse: routes' points against several coarse grids, such as before fixes or after smoothing."""
    out = None
    for variant, cells in variants.items():
        r = records(thalweg.sample(points.drop("coarse_depth"), cells, max_deg)).select(F.lit(variant).alias("variant"), "name", "n", "coarse_sill", "mae", "rmse")
        out = r if out is None else out.unionByName(r)
    return out


def mode(category: Column) -> Column:
    """What a record's category says of how its route came about."""
    return F.when(category == "AUTO", "boundary").when(category == "WAYPOINT", "waypoint").when(category.isin("U", "V"), "strait").otherwise(F.lower(category))
