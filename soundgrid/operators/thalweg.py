"""Deepest routes: paths, profiles, comparison of fine and coarse, suggested corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import written
from . import basins, cuts, deepest, graph, spatial


def snap(stops: DataFrame, fine: DataFrame) -> DataFrame:
    """name, seq, id: the nearest wet fine cell of each stop (name, seq, lon, lat)."""
    wet = fine.where("depth is not null")
    s = stops.withColumn("pid", F.concat_ws(":", "name", "seq"))
    near = spatial.nearest_cell(s, wet.select("j", "i", "lon", "lat"), "pid").select("name", "seq", "j", "i")
    return near.join(wet.select("j", "i", "id"), ["j", "i"]).select("name", "seq", "id")


def waypoint_paths(fine: DataFrame, stops: DataFrame, margin: float = 1.0) -> DataFrame:
    """name, seq, id, lon, lat, depth: the deepest path through each waypoint's stops, in the box around them."""
    box = stops.groupBy("name").agg((F.min("lon") - margin).alias("lon0"), (F.max("lon") + margin).alias("lon1"), (F.min("lat") - margin).alias("lat0"), (F.max("lat") + margin).alias("lat1"))
    wet = fine.where("depth is not null")
    w = Window.partitionBy("name").orderBy("seq")
    legs = written(snap(stops, fine).withColumn("b", F.lead("id").over(w)).where("b is not null").select(F.concat_ws("#", "name", "seq").alias("leg"), "name", "seq", F.col("id").alias("a"), "b"), "route-legs")
    cells = spatial.range_join(box, wet, max(margin, 0.1)).select("name", "j", "i", "id", "depth")
    first_leg = F.min("leg_seq").over(Window.partitionBy("name"))
    paths = deepest.paths(cells, legs, "name", "leg").join(legs.select("leg", "name", F.col("seq").alias("leg_seq")), "leg")
    paths = paths.withColumn("first", first_leg).where("seq > 0 or leg_seq = first")  # a leg's first cell ends the leg before
    order = F.row_number().over(Window.partitionBy("name").orderBy("leg_seq", "seq"))
    return paths.select("name", (order - 1).alias("seq"), "id").join(wet.select("id", "lon", "lat", "depth"), "id").select("name", "seq", "id", "lon", "lat", "depth")


def profile(path: DataFrame) -> DataFrame:
    """path (name, seq, lon, lat, depth) with dist_km from its start."""
    w = Window.partitionBy("name").orderBy("seq")
    lat0, lon0 = F.lag("lat").over(w), F.lag("lon").over(w)
    hop = F.coalesce(geo.hop_km(F.col("lon") - lon0, F.col("lat") - lat0, (F.col("lat") + lat0) / 2), F.lit(0.0))
    return path.withColumn("hop", hop).withColumn("dist_km", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("hop")


def sill(points: DataFrame, depth: str = "depth") -> DataFrame:
    """name, sill_depth, sill_dist_km: the shallowest positive depth of a path, the first on ties."""
    return points.where(F.col(depth) > 0).groupBy("name").agg(F.min(F.struct(depth, "seq", "dist_km")).alias("m")).select("name", F.col(f"m.{depth}").alias("sill_depth"), F.col("m.dist_km").alias("sill_dist_km"))


def clip_longest_run(points: DataFrame, inside: str = "inside") -> DataFrame:
    """The longest run of points inside the domain (the first on ties), distance from its start; all if none is inside."""
    w = Window.partitionBy("name").orderBy("seq")
    runs = points.withColumn("run", F.row_number().over(w) - F.sum(F.col(inside).cast("int")).over(w))
    best = runs.where(inside).groupBy("name", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"), F.min("dist_km").alias("start"))
    best = best.groupBy("name").agg(F.max(F.struct("n", (-F.col("s")).alias("o"), "run", "start")).alias("b")).select("name", F.col("b.run").alias("best"), F.col("b.start").alias("start"))
    out = runs.join(best, "name", "left").where(F.col("best").isNull() | (F.col(inside) & (F.col("run") == F.col("best"))))
    return out.withColumn("dist_km", F.col("dist_km") - F.coalesce("start", F.lit(0.0))).drop("run", "best", "start")


def sample(points: DataFrame, cells: DataFrame, max_deg: float) -> DataFrame:
    """points with coarse_depth of the nearest wet cell within a distance."""
    p = points.withColumn("pid", F.concat_ws(":", "name", "seq"))
    wet = cells.where("mask = 1").select("j", "i", "lon", "lat")
    near = spatial.nearest_cell(p.select("pid", "lon", "lat"), wet, "pid", max_deg).select("pid", "j", "i")
    return p.join(near, "pid", "left").join(cells.select("j", "i", F.col("depth").alias("coarse_depth")), ["j", "i"], "left").drop("pid", "j", "i")


def errors(points: DataFrame) -> DataFrame:
    """name, n, mae, rmse of coarse against fine depth where both are known."""
    d = F.col("coarse_depth") - F.col("depth")
    return points.where(d.isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def compare_sills(points: DataFrame, sill_ratio: float = 0.7) -> DataFrame:
    """name, fine_sill, coarse_sill, sill_deficit_m, direction-free category."""
    f, c = (sill(points, d).select("name", F.col("sill_depth").alias(n)) for d, n in (("depth", "fine_sill"), ("coarse_depth", "coarse_sill")))
    out = f.join(c, "name", "left").withColumn("sill_deficit_m", F.col("fine_sill") - F.col("coarse_sill"))
    ratio = F.try_divide("coarse_sill", "fine_sill")
    return out.withColumn("category", F.when(ratio.isNull(), "WAYPOINT").when(ratio < sill_ratio, "SILL_DEFICIT").otherwise("OK"))


def suggest_fixes(points: DataFrame, cells: DataFrame, min_deficit: float = 2.0, min_relative: float = 0.05) -> DataFrame:
    """j, i, lon, lat, value, names: coarse cells on paths (name, seq, lon, lat, depth, pct) that are too shallow or land.

    A cell pools the fine depths of all paths; its percentile is the least of theirs, 100 is the largest depth. A land
    cell is always given. Depths of a cell are as many as a path has points in it.
    """
    p = points.withColumn("pid", F.concat_ws(":", "name", "seq"))
    near = spatial.nearest_cell(p, cells.select("j", "i", "lon", "lat"), "pid", 1.0)
    g = near.where("d2 is not null").groupBy("j", "i").agg(F.sort_array(F.collect_list("depth")).alias("d"), F.min("pct").alias("pct"), F.max("depth").alias("deepest"), F.array_sort(F.collect_set("name")).alias("names"))
    pos = (F.size("d") - 1) * F.col("pct") / 100.0
    lo = F.floor(pos).cast("int")
    a, b = F.get("d", lo), F.get("d", F.least(lo + 1, F.size("d") - 1))
    value = F.when(F.col("pct") >= 100, F.col("deepest")).otherwise(a + (b - a) * (pos - lo))
    out = g.withColumn("value", value).join(cells.select("j", "i", "lon", "lat", F.col("depth").alias("coarse"), "mask"), ["j", "i"])
    deficit = F.col("value") - F.col("coarse")
    keep = (F.col("mask") == 0) | ((deficit >= min_deficit) & (F.try_divide(deficit, F.col("value")) >= min_relative))
    return out.where(keep).select("j", "i", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), F.bround("value", 1).alias("value"), F.concat_ws(",", "names").alias("names"))


def auto_corridors(cells: DataFrame, min_basin_cells: int = 20, min_length: int = 1, margin: int = 3, merge: int = 2) -> DataFrame:
    """corridor, n_cells, lon, lat, begin_j, begin_i, end_j, end_i: choke points between two basins of enough cells.

    Articulation cells within merge steps of each other make a group; without a group the wet cells must fall into two
    or more components, all of min_basin_cells. The ends are the deepest cells of the two largest in the padded box.
    """
    wet = cells.where("mask = 1").select("j", "i", "id", "lon", "lat", "depth")
    points = cuts.choke_points(wet)
    near = basins.dilate(points, merge).withColumn("id", F.col("j").cast("long") * 1_000_000 + F.col("i"))
    groups = written(points.join(graph.label_cells(near).select("j", "i", F.col("label").alias("g")), ["j", "i"]), "choke-groups")
    number = F.row_number().over(Window.orderBy("g")) - 1
    own = groups.join(wet, ["j", "i"]).groupBy("g").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).withColumn("corridor", number)
    found = own.join(cuts.around(wet, groups, margin), "g").where((F.col("n_cells") >= min_length) & (F.col("n_parts") >= 2) & (F.col("least") >= min_basin_cells) & F.col("begin.j").isNotNull() & F.col("end.j").isNotNull())
    return found.select(F.col("corridor").cast("int").alias("corridor"), F.col("n_cells").cast("int").alias("n_cells"), F.bround("lon", 4).alias("lon"), F.bround("lat", 4).alias("lat"), *[F.col(f"{e}.{c}").cast("int").alias(f"{e}_{c}") for e in ("begin", "end") for c in "ji"])


def nearest_on_axis(points: DataFrame, axis: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """points with the index (name) of the nearest value of an axis (value, index), the first on ties.

    Values beyond the ends meet the end; then no value is farther than the axis' largest step, which sets the bins.
    """
    span = axis.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(axis.select((F.lead("value").over(Window.orderBy("value")) - F.col("value")).alias("d")).agg(F.max("d").alias("d"))).first()
    size = span.d or 1.0
    at = geo.clamp(F.col(column), span.lo, span.hi)
    near = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    p = points.select(key, at.alias("x"), near.alias("b")).select(key, "x", (F.floor(F.col("x") / size) + F.col("b")).alias("bin"))
    a = axis.withColumn("bin", F.floor(F.col("value") / size))
    best = p.join(a, "bin").groupBy(key).agg(F.min(F.struct(F.abs(F.col("value") - F.col("x")).alias("d"), "index")).alias("m"))
    return points.join(best.select(key, F.col("m.index").alias(name)), key, "left")


def on_axes(points: DataFrame, fine: DataFrame, key: str = "pid") -> DataFrame:
    """points with j and i of the nearest row and the nearest column of a regular raster, each by itself."""
    for column, name in (("lat", "j"), ("lon", "i")):
        axis = fine.groupBy(F.col(name).alias("index")).agg(F.min(column).alias("value"))
        points = nearest_on_axis(points, axis, column, key, name)
    return points


def wet_starts(points: DataFrame, fine: DataFrame, reach: int = 2) -> DataFrame:
    """edge, segment, j, i, depth: the deepest cell of each wet run of the points (edge_no, seq, lon, lat) of a boundary.

    A run ends at a dry cell or where the next cell is more than reach rows or columns away. Runs are numbered in a
    boundary segment; a segment with one run lends it its own name.
    """
    p = on_axes(points.withColumn("pid", F.concat_ws(":", "edge_no", "seq")), fine)
    p = p.join(fine.select("j", "i", "depth"), ["j", "i"])
    w = Window.partitionBy("edge_no").orderBy("seq")
    apart = F.lag("depth").over(w).isNull() | (F.abs(F.col("j") - F.lag("j").over(w)) > reach) | (F.abs(F.col("i") - F.lag("i").over(w)) > reach)
    runs = p.withColumn("new", apart.cast("int")).where("depth is not null").withColumn("run", F.sum("new").over(w))
    best = runs.groupBy("edge_no", "run").agg(F.max(F.struct("depth", (-F.col("seq")).alias("o"), "j", "i")).alias("m"))
    n = F.row_number().over(Window.partitionBy("edge_no").orderBy("run")) - 1
    several = F.count(F.lit(1)).over(Window.partitionBy("edge_no")) > 1
    best = best.withColumns({"segment": n, "several": several})
    edge = F.concat(F.lit("bdy"), F.col("edge_no").cast("string"), F.when(F.col("several"), F.concat(F.lit("_"), F.col("segment").cast("string"))).otherwise(""))
    return best.select(edge.alias("edge"), "segment", F.col("m.j").alias("j"), F.col("m.i").alias("i"), F.col("m.depth").alias("depth"))


def deepest_in_box(points: DataFrame, fine: DataFrame, domain: tuple[float, float, float, float], radius: int = 20, key: str = "pid") -> DataFrame:
    """key, j, i, depth: the deepest wet cell within radius rows and columns of each point's, those in the domain (lon0, lon1, lat0, lat1) first. Points of one cell share its box."""
    at = written(on_axes(points, fine, key).select(key, F.col("j").alias("cj"), F.col("i").alias("ci")), "box-centres")
    size = 2 * radius + 1
    bins = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / size), F.floor((F.col(c) + radius) / size)))
    boxes = at.select("cj", "ci").distinct().withColumn("bj", bins("cj")).withColumn("bi", bins("ci"))
    wet = fine.where("depth is not null").withColumns({"bj": F.floor(F.col("j") / size), "bi": F.floor(F.col("i") / size)})
    pairs = boxes.join(wet, ["bj", "bi"]).where((F.abs(F.col("j") - F.col("cj")) <= radius) & (F.abs(F.col("i") - F.col("ci")) <= radius))
    inside = F.col("lon").between(domain[0], domain[1]) & F.col("lat").between(domain[2], domain[3])
    best = pairs.groupBy("cj", "ci").agg(F.max(F.struct(inside.alias("inside"), "depth", (-F.col("j")).alias("oj"), (-F.col("i")).alias("oi"))).alias("m"))
    return at.join(best, ["cj", "ci"]).select(key, (-F.col("m.oj")).alias("j"), (-F.col("m.oi")).alias("i"), F.col("m.depth").alias("depth"))


def crossing(routes: DataFrame, min_sill: float, max_detour: float) -> DataFrame:
    """routes (n, sill_depth, n_inside, length_km, direct_km) that cross the domain: long and deep enough, without a detour."""
    return routes.where((F.col("n") >= 5) & (F.col("sill_depth") >= min_sill) & (F.col("n_inside") >= 2) & ((F.col("direct_km") <= 0) | (F.col("length_km") <= max_detour * F.col("direct_km"))))


def distinct_sills(routes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """routes (edge_a, edge_b, ord, sill_depth) in order, without those whose sill is within the tolerance of one kept for the same two edges.

    Only the first route of each depth can be kept. Which one is depends on the order, so the depths of a pair of edges are folded.
    """
    pair = routes.withColumns({"lo": F.least("edge_a", "edge_b"), "hi": F.greatest("edge_a", "edge_b")})
    first = pair.groupBy("lo", "hi", "sill_depth").agg(F.min("ord").alias("ord"))
    listed = first.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct("ord", "sill_depth"))).alias("all"))
    far = lambda kept, x: ~F.exists(kept, lambda k: F.abs(k.sill_depth - x.sill_depth) < tolerance)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    stay = written(listed.select("lo", "hi", F.explode(F.transform(kept, lambda x: x.ord)).alias("ord")), "kept-sills")
    return pair.join(stay, ["lo", "hi", "ord"], "left_semi").drop("lo", "hi")


def without_manual(corridors: DataFrame, cells: DataFrame, waypoints: list[dict], near: float) -> DataFrame:
    """corridors (corridor, lon, lat) of which no cell (corridor, lon, lat) lies in a waypoint's bbox, nor, of waypoints without one, the centre near a stop."""
    boxes = [w["bbox"] for w in waypoints if w.get("bbox")]
    stops = [p for w in waypoints if not w.get("bbox") for p in [w.get("begin"), w.get("end"), *(w.get("via") or [])] if p]
    hit = F.lit(False)
    for x0, x1, y0, y1 in boxes:
        hit = hit | (F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    close = F.lit(False)
    for x, y in stops:
        close = close | ((F.abs(F.col("lon") - x) < near) & (F.abs(F.col("lat") - y) < near))
    return corridors.where(~close).join(cells.where(hit).select("corridor").distinct(), "corridor", "left_anti")


def sill_point(points: DataFrame, sills: DataFrame) -> DataFrame:
    """points with is_sill: 1 at the first point nearest in distance to its path's sill, else 0."""
    both = points.join(sills.select("name", "sill_dist_km"), "name", "left")
    best = both.where("sill_dist_km is not null").groupBy("name").agg(F.min(F.struct(F.abs(F.col("dist_km") - F.col("sill_dist_km")).alias("d"), "seq")).alias("m")).select("name", F.col("m.seq").alias("at"))
    return points.join(best, "name", "left").withColumn("is_sill", F.coalesce((F.col("seq") == F.col("at")).cast("int"), F.lit(0))).drop("at")


def csv_rows(points: DataFrame, sills: DataFrame) -> DataFrame:
    """The table of a path's points (name, seq, lon, lat, dist_km, depth, coarse_depth) as text."""
    shown = lambda form, c: F.format_string(form, c)
    n = F.row_number().over(Window.partitionBy("name").orderBy("seq")) - 1
    return sill_point(points, sills).select("name", n.alias("index"), shown("%.6f", "lon").alias("lon"), shown("%.6f", "lat").alias("lat"), shown("%.3f", "dist_km").alias("dist_km"), shown("%.2f", "depth").alias("fine_depth"), F.when(F.col("coarse_depth").isNull(), "").otherwise(shown("%.2f", "coarse_depth")).alias("coarse_depth"), "is_sill")


def summary(records: DataFrame) -> DataFrame:
    """n_paths, n_failed, max_deficit, mean_deficit, n_coarse_deeper of records (sill_deficit_m, failed)."""
    ok, d = ~F.col("failed"), F.col("sill_deficit_m")
    return records.agg(F.count_if(ok).alias("n_paths"), F.count_if(~ok).alias("n_failed"), F.max(F.when(ok, d)).alias("max_deficit"), F.avg(F.when(ok, d)).alias("mean_deficit"), F.count_if(ok & (d < 0)).alias("n_coarse_deeper"))
