"""Open boundaries: segments along the edges, distances from them, and matching to an outer model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import written
from . import spatial


def boundary_cells(cells: DataFrame) -> DataFrame:
    """side (W, E, S, N), seq, j, i, lon, lat of wet edge cells; corners belong to W and E."""
    top = cells.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    inner = F.col("i").between(1, top.i - 1)
    side = F.when(F.col("i") == 0, "W").when(F.col("i") == top.i, "E").when((F.col("j") == 0) & inner, "S").when((F.col("j") == top.j) & inner, "N")
    wet = cells.where("mask = 1").withColumn("side", side).where("side is not null")
    return wet.select("side", F.when(F.col("side").isin("W", "E"), F.col("j")).otherwise(F.col("i")).alias("seq"), "j", "i", "lon", "lat")


def segments(edge: DataFrame) -> DataFrame:
    """side, segment, i_start, j_start, i_end, j_end, n_cells of contiguous wet runs."""
    run = F.col("seq") - F.row_number().over(Window.partitionBy("side").orderBy("seq"))
    ends = edge.withColumn("run", run).groupBy("side", "run").agg(F.min(F.struct("seq", "i", "j")).alias("a"), F.max(F.struct("seq", "i", "j")).alias("b"), F.count(F.lit(1)).alias("n_cells"))
    n = F.row_number().over(Window.partitionBy("side").orderBy("a.seq"))
    return ends.select("side", n.alias("segment"), F.col("a.i").alias("i_start"), F.col("a.j").alias("j_start"), F.col("b.i").alias("i_end"), F.col("b.j").alias("j_end"), "n_cells")


def csv_rows(edge: DataFrame) -> DataFrame:
    """side_rank, seq, line: the coordinate file's lines W (S to N), N (W to E), E, S."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("W", 0), ("N", 1), ("E", 2), ("S", 3)) for x in kv]), F.col("side"))
    return edge.select(rank.alias("side_rank"), "seq", F.format_string("%.5f,%.5f", "lon", "lat").alias("line"))


def csv_segments(points: DataFrame, factor: float = 5.0) -> DataFrame:
    """points (seq, lon, lat) with gap-separated segments: a step over factor times the median begins a new one."""
    w = Window.orderBy("seq")  # one coordinate file
    step = F.hypot(F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w))
    stepped = points.withColumn("step", step)
    median = stepped.agg(F.median("step").alias("m"))
    limit = F.when(F.col("m") > 0, F.col("m") * factor).otherwise(1e-3)
    return stepped.crossJoin(F.broadcast(median)).withColumn("segment", F.sum(F.coalesce((F.col("step") > limit).cast("int"), F.lit(0))).over(w)).drop("m", "step")


def boundary_starts(cells: DataFrame, max_inward: int = 20, min_cells: int = 10) -> DataFrame:
    """edge, perp, segment, j, i, depth: the deepest cell of each run of first wet cells from an edge.

    Rays go inward from every edge; hits at one distance (perp) from the edge that touch make a run; both the distance
    and the run need min_cells.
    """
    top = cells.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    wet, parts = cells.where("mask = 1"), None
    for edge, along, depth_in in (("W", "j", F.col("i")), ("E", "j", F.lit(top.i) - F.col("i")), ("S", "i", F.col("j")), ("N", "i", F.lit(top.j) - F.col("j"))):
        hit = wet.withColumn("perp", depth_in).where(F.col("perp") <= max_inward).groupBy(F.col(along).alias("along")).agg(F.min(F.struct("perp", "j", "i", "depth")).alias("h"))
        hit = hit.select(F.lit(edge).alias("edge"), "along", "h.perp", "h.j", "h.i", "h.depth")
        parts = hit if parts is None else parts.unionByName(hit)
    w = Window.partitionBy("edge", "perp").orderBy("along")
    runs = parts.withColumn("run", F.col("along") - F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("edge", "perp"))).where(F.col("n") >= min_cells)
    best = runs.groupBy("edge", "perp", "run").agg(F.count(F.lit(1)).alias("n_cells"), F.max(F.struct("depth", (-F.col("along")).alias("o"), "j", "i")).alias("d")).where(F.col("n_cells") >= min_cells)
    seg = F.row_number().over(Window.partitionBy("edge", "perp").orderBy("run"))
    return best.select("edge", "perp", seg.alias("segment"), "n_cells", F.col("d.j").alias("j"), F.col("d.i").alias("i"), F.col("d.depth").alias("depth"))


def bfs(cells: DataFrame, seeds: DataFrame, width: int) -> DataFrame:
    """j, i, dist, scale: steps over wet cells from the seeds (j, i, pos, scale), up to width.

    A cell takes the scale of the neighbour that is first in the queue; queue order is seeds by pos, then the order in
    which cells were found, looking at -j, +j, -i, +i. So a cell's place in the queue is the seed's pos and the looks
    that led to it, one after the other.
    """
    wet = cells.where("mask = 1").select("j", "i")
    front = written(seeds.join(wet, ["j", "i"]).groupBy("j", "i").agg(F.min(F.array(F.col("pos").cast("int"))).alias("pos"), F.max(F.struct("pos", "scale")).alias("s")).select("j", "i", "pos", F.col("s.scale").alias("scale"), F.lit(0).alias("dist")), "bfs")
    found = front
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))]))
    for dist in range(1, width + 1):
        to = front.select("pos", "scale", steps.alias("t"), "j", "i").select(F.struct("pos", "t.d").alias("o"), "scale", (F.col("j") + F.col("t.a")).alias("j"), (F.col("i") + F.col("t.b")).alias("i"))
        new = to.join(wet, ["j", "i"]).join(found.select("j", "i"), ["j", "i"], "left_anti").groupBy("j", "i").agg(F.min(F.struct("o", "scale")).alias("m"))
        front = written(new.select("j", "i", F.concat("m.o.pos", F.array("m.o.d")).alias("pos"), F.col("m.scale").alias("scale"), F.lit(dist).alias("dist")), "bfs")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.select("j", "i", "dist", "scale")


def match_scale(edge: DataFrame, outer: DataFrame, dlon: float, dlat: float, max_scale: float = 3.0, outer_width: bool = False) -> DataFrame:
    """edge (with depth) and scale: per side and nearest outer wet cell, outer section over inner section, clipped.

    The outer section's width is that of one inner cell; outer_width takes the group's whole width instead.
    """
    e = edge.withColumn("pid", F.concat_ws(":", "side", "j", "i"))
    o = outer.select(F.col("j").alias("oj"), F.col("i").alias("oi"), F.col("depth").alias("h_outer"))
    hit = spatial.nearest_cell(e.select("pid", "lon", "lat"), outer.select("j", "i", "lon", "lat"), "pid").select("pid", F.col("j").alias("oj"), F.col("i").alias("oi"))
    e = e.join(hit, "pid").join(o, ["oj", "oi"])
    width = lambda lat: F.when(F.col("side").isin("N", "S"), dlon * F.abs(F.cos(F.radians(lat)))).otherwise(F.lit(dlat))
    group = e.groupBy("side", "oj", "oi").agg(F.first("h_outer").alias("h"), F.avg("lat").alias("lat"), F.sum(F.col("depth") * width(F.col("lat"))).alias("inner"), F.count(F.lit(1)).alias("n"))
    outer_area = F.col("h") * width(F.col("lat")) * (F.col("n") if outer_width else F.lit(1))
    group = group.select("side", "oj", "oi", geo.clamp(F.try_divide(outer_area, F.col("inner")), 1.0 / max_scale, max_scale).alias("scale"))
    return e.join(group, ["side", "oj", "oi"]).drop("pid", "oj", "oi")


def nudge(cells: DataFrame, outer: DataFrame, dlon: float, dlat: float, width: int = 10, shape: str = "cosine", min_depth: float = 2.0, max_scale: float = 3.0) -> DataFrame:
    """cells with depth drawn to the outer model's near the open edges, and pinned where it became deeper."""
    edge = boundary_cells(cells).join(cells.select("j", "i", "depth"), ["j", "i"])
    scaled = match_scale(edge, outer, dlon, dlat, max_scale).where("depth > 0 and scale is not null")
    # what goes inland is the ratio that the edge cell itself is given, so no less than min_depth allows
    scaled = scaled.withColumn("scale", F.greatest(F.lit(min_depth), F.col("depth") * F.col("scale")) / F.col("depth"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in (("W", 0), ("E", 1), ("S", 2), ("N", 3)) for x in kv]), F.col("side")) * 1_000_000 + F.col("seq")
    found = bfs(cells, scaled.select("j", "i", order.alias("pos"), "scale"), width)
    out = cells.join(found, ["j", "i"], "left")
    w = geo.taper(F.col("dist"), width, shape)
    target = F.greatest(F.lit(min_depth), F.col("depth") * (w * F.col("scale") + 1.0 - w))
    changed = F.col("dist").isNotNull() & (F.abs(target - F.col("depth")) >= 1e-6)
    return out.withColumns({"pinned": F.coalesce(changed & (target > F.col("depth")), F.lit(False)), "depth": F.when(changed, target).otherwise(F.col("depth"))}).drop("dist", "scale")


def csv_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """j, i, depth: the wet cells that are nearest to points (seq, lon, lat) among all cells, each once."""
    near = spatial.nearest_cell(points.select("seq", "lon", "lat"), cells.select("j", "i", "lon", "lat"), "seq").select("j", "i").distinct()
    return cells.where("mask = 1").join(near, ["j", "i"]).select("j", "i", "depth")
