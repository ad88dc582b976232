"""Deepest routes over a raster: paths of the maximum spanning forest, found tile by tile.

The path between two cells whose shallowest step is deepest runs in the maximum spanning forest of the cells' eight-
neighbour graph, a step being as deep as the shallower of its cells. The forest is never in one place. A tile's own
forest is cut down to what joins its portals, the cells that a stop stands on or that have neighbours in other tiles:
branches without a portal go, and a chain of cells between two portals or forks becomes one step, as deep as its
shallowest. Four tiles then make a larger one, of the steps left in them and those between them. What a task takes is as
long as a tile's edge, not as large as its area, until only the stops are portals; their paths are then unfolded, level
by level, by joins. An edge that is not in a tile's forest, nor a branch that is cut, can't be on such a path, so the
result is that of the whole forest. Ties between steps go to the smaller ids, so it is one forest.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

TILE = 256
_STEP = "u long, uj int, ui int, us boolean, v long, vj int, vi int, vs boolean, w double, ka long, kb long, eid string"


class _Forest(dict):
    def top(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self.setdefault(up, up)
            x = up
        return x


def forest(steps: pd.DataFrame) -> tuple[pd.DataFrame, dict[int, dict[int, int]]]:
    """Steps from the deepest to the shallowest, and those of the maximum spanning forest by both ends: their places in that order."""
    ordered = steps.sort_values(["w", "ka", "kb"], ascending=[False, True, True], ignore_index=True)
    known, tree = _Forest(), defaultdict(dict)
    for k, (a, b) in enumerate(zip(ordered["u"], ordered["v"], strict=True)):
        x, y = known.top(a), known.top(b)
        if x != y:
            known[x] = y
            tree[a][b] = tree[b][a] = k
    return ordered, tree


def walk(tree: dict[int, dict[int, int]], start: int, end: int) -> list[int]:
    """The nodes of the only path of a forest, or none."""
    before, queue = {start: None}, [start]
    for x in queue:
        if x == end:
            out = []
            while x is not None:
                out.append(x)
                x = before[x]
            return out[::-1]
        for y in tree.get(x, ()):
            if y not in before:
                before[y] = x
                queue.append(y)
    return []


def contracted(steps: pd.DataFrame, portals: set[int], name: str) -> pd.DataFrame:
    """The steps left between portals and forks; of a chain, the cells and steps it was made of. name begins their names."""
    ordered, tree = forest(steps)
    bare = [x for x, near in tree.items() if len(near) == 1 and x not in portals]
    while bare:
        x = bare.pop()
        for y in tree.pop(x):
            del tree[y][x]
            if not tree[y]:
                tree.pop(y)
                bare = [z for z in bare if z != y]
            elif len(tree[y]) == 1 and y not in portals:
                bare.append(y)
    place = {}
    for side in "uv":
        place.update({x: (j, i, s) for x, j, i, s in zip(ordered[side], ordered[f"{side}j"], ordered[f"{side}i"], ordered[f"{side}s"], strict=True)})
    ends, out = {x for x, near in tree.items() if x in portals or len(near) > 2}, []
    w, ka, kb, eid = (ordered[c].tolist() for c in ("w", "ka", "kb", "eid"))
    for x in sorted(ends):
        for first in tree[x]:
            nodes, kids = [x, first], [tree[x][first]]
            while nodes[-1] not in ends:
                nodes.append(next(y for y in tree[nodes[-1]] if y != nodes[-2]))
                kids.append(tree[nodes[-2]][nodes[-1]])
            if nodes[-1] < x:
                continue  # walked from there
            k = max(kids)  # the shallowest
            chain = len(kids) > 1
            out.append((x, *place[x], nodes[-1], *place[nodes[-1]], w[k], ka[k], kb[k], f"{name}:{len(out)}" if chain else eid[kids[0]], nodes if chain else None, [eid[n] for n in kids] if chain else None))
    return pd.DataFrame(out, columns=[*(c.split()[0] for c in _STEP.split(", ")), "nodes", "kids"])


def paths(cells: DataFrame, stops: DataFrame, by: str = "graph", leg: str = "leg", tile: int = TILE) -> DataFrame:
    """leg, seq, id: for every leg (stops: leg, by, a, b) the deepest path from a to b over the cells (by, j, i, id, depth) of its graph.

    A leg whose ends aren't joined has no rows, one from a cell to itself that cell alone. All cells are wet, and ids
    are their own in a graph. Rows of cells that repeat count once.
    """
    kind = cells.schema[by].dataType.simpleString()
    legs = written(stops.select(leg, by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "legs")
    at = legs.select(by, F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("s", F.lit(True))
    own = cells.select(by, "j", "i", F.col("id").cast("long").alias("id"), "depth").dropDuplicates([by, "id"])
    own = written(own.join(at, [by, "id"], "left").select(by, "j", "i", "id", "depth", F.coalesce("s", F.lit(False)).alias("s")), "route-cells")
    span = own.agg(*[f(c).alias(n + c) for c in "ji" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = 0
    while span.loj is not None and max(span.hij - span.loj, span.hii - span.loi) >= tile << top:
        top += 1
    of = lambda j, i, level: [F.expr(f"({c} - {lo}) div {tile << level}") for c, lo in ((j, span.loj or 0), (i, span.loi or 0))]

    ends = own.select(by, *[F.col(c).alias(f"u{c}") for c in "jis"], F.col("id").alias("u"), F.col("depth").alias("d"), F.explode(F.array(*[F.struct((F.col("j") + a).alias("vj"), (F.col("i") + b).alias("vi")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))])).alias("t"))
    plain = ends.select(by, "u", "uj", "ui", "us", "d", "t.vj", "t.vi").join(own.select(by, F.col("j").alias("vj"), F.col("i").alias("vi"), F.col("id").alias("v"), F.col("s").alias("vs"), F.col("depth").alias("e")), [by, "vj", "vi"])
    same = lambda level: F.expr(" and ".join(f"(u{c} - {lo}) div {tile << level} = (v{c} - {lo}) div {tile << level}" for c, lo in (("j", span.loj or 0), ("i", span.loi or 0))))
    level = F.coalesce(*[F.when(same(n), n) for n in range(top + 1)])
    plain = written(plain.select(by, "u", "uj", "ui", "us", "v", "vj", "vi", "vs", F.least("d", "e").alias("w"), F.col("u").alias("ka"), F.col("v").alias("kb"), F.lit(None).cast("string").alias("eid"), level.alias("level")), "steps")

    def contract(n: int):
        size, loj, loi, last = tile << n, span.loj or 0, span.loi or 0, n == top

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            portals = set()
            for e in "uv":
                dj, di = (pdf[f"{e}j"] - loj) % size, (pdf[f"{e}i"] - loi) % size
                edge = False if last else (dj == 0) | (dj == size - 1) | (di == 0) | (di == size - 1)
                portals |= set(pdf[e][pdf[f"{e}s"] | edge])
            out = contracted(pdf, portals, f"{n}:{pdf.tj.iloc[0]}:{pdf.ti.iloc[0]}")
            out.insert(0, by, pdf[by].iloc[0])
            return out

        return run

    names = [c.split()[0] for c in _STEP.split(", ")]
    left, chains = None, []
    for n in range(top + 1):
        steps = plain.where(F.col("level") == n).select(by, *names)
        steps = steps if left is None else steps.unionByName(left)
        tj, ti = of("uj", "ui", n)
        made = steps.withColumns({"tj": tj, "ti": ti}).groupBy(by, "tj", "ti").applyInPandas(contract(n), f"{by} {kind}, {_STEP}, nodes array<long>, kids array<string>")
        made = written(made, "contracted")
        chains.append(made.where("nodes is not null").select(by, "eid", F.col("u").alias("chain_u"), "nodes", "kids"))
        left = made.select(by, *names)

    def between(stops: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        ordered, tree = forest(steps)
        out = []
        for name, a, b in zip(stops[leg], stops["a"], stops["b"], strict=True):
            nodes = walk(tree, a, b)
            out += [(name, stops[by].iloc[0], [k], x, y, ordered["eid"].iloc[tree[x][y]]) for k, (x, y) in enumerate(zip(nodes, nodes[1:], strict=False))]
        return pd.DataFrame(out, columns=[leg, by, "pos", "x", "y", "eid"])

    # what is left joins the stops of a graph: of the order of their number
    pieces = legs.where("a <> b").groupBy(by).cogroup(left.groupBy(by)).applyInPandas(between, f"{leg} {legs.schema[leg].dataType.simpleString()}, {by} {kind}, pos array<int>, x long, y long, eid string")
    for n in range(top, -1, -1):
        open_ = pieces.join(chains[n], [by, "eid"], "left")
        ahead = F.col("chain_u") == F.col("x")
        nodes, kids = F.when(ahead, F.col("nodes")).otherwise(F.reverse("nodes")), F.when(ahead, F.col("kids")).otherwise(F.reverse("kids"))
        part = F.when(F.col("nodes").isNull(), F.array(F.struct(F.col("pos").alias("pos"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("eid").alias("eid")))).otherwise(
            F.transform(kids, lambda kid, k: F.struct(F.concat("pos", F.array(k)).alias("pos"), F.get(nodes, k).alias("x"), F.get(nodes, k + 1).alias("y"), kid.alias("eid")))
        )
        pieces = written(open_.select(leg, by, F.explode(part).alias("p")).select(leg, by, "p.*"), "pieces")
    seq = F.row_number().over(Window.partitionBy(leg).orderBy("pos"))
    steps = pieces.select(leg, seq.alias("seq"), "x", F.col("y").alias("id"))
    starts = steps.where("seq = 1").select(leg, F.lit(0).alias("seq"), F.col("x").alias("id"))
    alone = legs.where("a = b").join(own.select(by, F.col("id").alias("a")), [by, "a"]).select(leg, F.lit(0).alias("seq"), F.col("a").alias("id"))
    return starts.unionByName(steps.select(leg, "seq", "id")).unionByName(alone)
