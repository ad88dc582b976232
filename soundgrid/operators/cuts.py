"""Choke points of a raster: cells without which their four-neighbour component falls apart, found tile by tile.

A tile's cells are cut down to what matters outside it. Its blocks (parts that no single cell splits) and the cells
where blocks meet form trees. A block at the end of a branch without a portal, that is without a cell that touches
another tile, goes; the cell that it hung on is a choke point for sure. Of any other block only its portals and the cells
where it meets others are kept, as a ring, which is as hard to split. Cells in a row that part the same portals from
each other share their fate, so one stands for all. Four tiles then make a larger one, of what is left in them and the
steps between them, until there is no portal left. What a task takes is as long as a tile's edge, not as large as its
area; a cell within a block, as all of them in open water, never leaves its tile.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

TILE = 256


def blocks(near: dict[int, set[int]]) -> list[set[int]]:
    """The sets of nodes that no single node splits, of two nodes at least; by a depth-first search without recursion."""
    order, low, found = {}, {}, []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, open_ = [(root, None, iter(sorted(near[root])))], [root]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    open_.append(other)
                    stack.append((other, node, iter(sorted(near[other]))))
                    break
                if other != parent:
                    low[node] = min(low[node], order[other])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] >= order[parent]:
                        block = {parent}
                        while (x := open_.pop()) != node:
                            block.add(x)
                        found.append(block | {node})
    return found


def contracted(near: dict[int, set[int]], portals: set[int]) -> tuple[set[tuple[int, int]], set[int], dict[int, int]]:
    """Edges that are left, nodes that are choke points for sure, and nodes (each with the one that stands for it)."""
    own = dict(enumerate(blocks(near)))
    of = defaultdict(set)
    for k, block in own.items():
        for x in block:
            of[x].add(k)
    at = {k: {x for x in block if len(of[x]) > 1 or x in portals} for k, block in own.items()}
    cuts, edges = set(), set()

    def dead_end(k: int) -> bool:
        """Whether a block hangs on one node at most, which has more to it."""
        return len(at[k]) < 2 and all(x not in portals or len(of[x]) > 1 for x in at[k])

    ends = [k for k in at if dead_end(k)]
    while ends:
        k = ends.pop()
        if k not in at or not dead_end(k):
            continue
        for x in at.pop(k):
            cuts.add(x)
            of[x].discard(k)
            for left in of[x] if len(of[x]) == 1 else ():
                if x not in portals:
                    at[left].discard(x)  # a node like others of the block, whatever hung on it
                ends.append(left)
    for k, held in at.items():
        if len(held) == 1:  # something hangs on a portal, which may have more to it outside
            (x,) = held
            edges.add((x, min(own[k] - held)))
    thin = {x for held in at.values() for x in held if x not in portals and len(of[x]) == 2}
    top: dict[int, int] = {}

    def first(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            x = up
        return x

    for held in at.values():
        if len(held) == 2 and held <= thin:
            a, b = sorted(first(x) for x in held)
            top[b] = a
    for held in at.values():
        ring = sorted(held)
        for a, b in zip(ring, ring[1:] + ring[:1] if len(ring) > 2 else ring[1:], strict=False):
            a, b = sorted((first(a), first(b)))
            if a != b:
                edges.add((a, b))
    return edges, cuts, {x: first(x) for x in list(top) if first(x) != x}


def choke_points(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """j, i of the cells (j, i, each once) without which a component of at least three cells falls apart."""
    own = written(cells.select("j", "i").distinct(), "choke-cells")
    span = own.agg(*[f(c).alias(n + c) for c in "ji" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    loj, loi, width = span.loj or 0, span.loi or 0, (span.hii or 0) - (span.loi or 0) + 1
    top = 0
    while span.loj is not None and max(span.hij - loj, span.hii - loi) >= tile << top:
        top += 1
    number = f"(cast(j as long) - {loj}) * {width} + (i - {loi})"
    to = F.explode(F.array(F.struct((F.col("j") + 1).alias("j"), F.col("i").alias("i")), F.struct(F.col("j").alias("j"), (F.col("i") + 1).alias("i"))))
    steps = own.select(F.expr(number).alias("u"), to.alias("t")).select("u", "t.j", "t.i").join(own, ["j", "i"]).select("u", F.expr(number).alias("v"))
    part = lambda e, level: f"struct({e} div {width} div {tile << level} as j, {e} % {width} div {tile << level} as i)"
    level = F.coalesce(*[F.when(F.expr(f"{part('u', n)} = {part('v', n)}"), n) for n in range(top + 1)])
    plain = written(steps.withColumn("level", level), "choke-steps")

    def contract(n: int):
        size, last = tile << n, n == top

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            near = defaultdict(set)
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                near[a].add(b)
                near[b].add(a)
            edge = lambda x: (x // width) % size in (0, size - 1) or (x % width) % size in (0, size - 1)
            edges, cuts, same = contracted(near, set() if last else {x for x in near if edge(x)})
            rows = [("edge", a, b) for a, b in edges] + [("cut", x, x) for x in cuts] + [("same", up, x) for x, up in same.items()]
            return pd.DataFrame(rows, columns=["kind", "u", "v"])

        return run

    left, found, same = None, None, []
    for n in range(top + 1):
        here = plain.where(F.col("level") == n).select("u", "v")
        here = here if left is None else here.unionByName(left)
        made = here.withColumn("t", F.expr(part("u", n))).groupBy("t").applyInPandas(contract(n), "kind string, u long, v long")
        made = written(made, "choke-level")
        left, cuts = made.where("kind = 'edge'").select("u", "v"), made.where("kind = 'cut'").select("u")
        found = cuts if found is None else found.unionByName(cuts)
        same.append(made.where("kind = 'same'").select("u", "v"))
    for pairs in reversed(same):
        found = written(found.unionByName(pairs.join(found.distinct(), "u").select(F.col("v").alias("u"))).distinct(), "choke-found")
    return found.select(F.expr(f"cast(u div {width} + {loj} as int)").alias("j"), F.expr(f"cast(u % {width} + {loi} as int)").alias("i"))


def around(cells: DataFrame, groups: DataFrame, margin: int) -> DataFrame:
    """g, n_parts, least, and begin and end (label, size, j, i): for each group of cells (g, j, i), what its absence leaves of the four-neighbour components, and the deepest cells of the two largest in the group's padded box (of the earlier id on ties; null where the box has none).

    cells have j, i, id, depth. What is left without any group is labelled once; these parts and the groups' own pieces
    are the nodes of a small graph, and each group's components are those of that graph without its pieces.
    """
    from . import graph

    wet = cells.select("j", "i", F.col("id").cast("long").alias("id"), "depth")
    grouped = written(wet.join(groups.select("g", "j", "i"), ["j", "i"]), "groups")
    rest = graph.label_cells(wet.join(grouped.select("j", "i"), ["j", "i"], "left_anti")).withColumn("g", F.lit(None).cast(grouped.schema["g"].dataType))
    pieces = graph.label_cells(grouped.select("j", "i", "id", "depth")).join(grouped.select("id", "g"), "id")
    nodes = written(rest.select("j", "i", "id", "depth", "label", "g").unionByName(pieces.select("j", "i", "id", "depth", "label", "g")), "nodes")
    size = nodes.groupBy("label", "g").agg(F.count(F.lit(1)).alias("size"))
    touch = graph.neighbour_edges(nodes).join(nodes.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("g").alias("ga")), "a").join(nodes.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("g").alias("gb")), "b")
    touch = written(touch.where("la <> lb").select("la", "lb", "ga", "gb").distinct(), "touching")
    # one graph for each group: as many as there are groups, of as many nodes and edges as there are pieces and parts
    names = groups.select("g").distinct()
    from pyspark.sql import Window

    numbered = written(names.select("g", (F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("n")), "group-numbers")
    top = nodes.agg((F.max("id") + 1).alias("m")).first().m or 1
    other = lambda c: F.col(c).isNull() | (F.col(c) != F.col("without"))
    each = numbered.select(F.col("g").alias("without"), "n")
    in_each = size.join(each, other("g")).select("without", "n", "label", "size")
    edges = touch.join(each, other("ga") & other("gb")).select((F.col("n") * top + F.col("la")).alias("a"), (F.col("n") * top + F.col("lb")).alias("b"))
    comps = graph.components(edges)
    in_each = in_each.withColumn("node", F.col("n") * top + F.col("label")).join(comps.withColumnRenamed("label", "c"), "node", "left").withColumn("part", F.coalesce("c", "node") - F.col("n") * top)
    in_each = written(in_each.select("without", "label", "size", "part"), "parts")
    parts = in_each.groupBy("without", "part").agg(F.sum("size").alias("size"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("without").orderBy(F.desc("size"), "part")))
    box = groups.groupBy("g").agg(*[f(c).alias(f"{c}{k}") for c in "ji" for k, f in ((0, F.min), (1, F.max))])
    cells_of = box.select("g", F.explode(F.sequence(F.col("j0") - margin, F.col("j1") + margin)).alias("j"), "i0", "i1").select("g", "j", F.explode(F.sequence(F.col("i0") - margin, F.col("i1") + margin)).alias("i"))
    inside = cells_of.withColumnRenamed("g", "without").join(nodes.select("j", "i", "depth", "label"), ["j", "i"]).join(in_each.select("without", "label", "part"), ["without", "label"])
    deepest = inside.groupBy("without", "part").agg(F.max(F.struct("depth", (-F.col("j")).alias("j"), (-F.col("i")).alias("i"))).alias("d"))
    both = ranked.where("rank <= 2").join(deepest, ["without", "part"], "left")
    end = lambda k: F.max(F.when(F.col("rank") == k, F.struct("part", "size", (-F.col("d.j")).alias("j"), (-F.col("d.i")).alias("i"))))
    ends = both.groupBy("without").agg(end(1).alias("begin"), end(2).alias("end"))
    sums = parts.groupBy("without").agg(F.count(F.lit(1)).alias("n_parts"), F.min("size").alias("least"))
    return sums.join(ends, "without").withColumnRenamed("without", "g")
