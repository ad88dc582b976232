"""Components of graphs over cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import remove, written


def neighbour_edges(cells: DataFrame, diagonal: bool = False, id_col: str = "id") -> DataFrame:
    """a, b of touching cells, each pair once; cells have j, i and an id."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    to = F.explode(F.array(*[F.struct((F.col("j") + dj).alias("j"), (F.col("i") + di).alias("i")) for dj, di in steps]))
    ends = cells.select(F.col(id_col).alias("a"), to.alias("t")).select("a", "t.j", "t.i")
    return ends.join(cells.select("j", "i", F.col(id_col).alias("b")), ["j", "i"]).select("a", "b")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges a and b (long): label is the smallest node that it can reach.

    Alternates large-star and small-star steps until the edges no longer change; each round is written to the shared
    folder, so a lost executor costs that round at most. Nodes without an edge to another node don't appear.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mine = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mine, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mine.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        seen, mark = mark, _mark(after)
        remove(now)
        now = after
        if mark == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def label_cells(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """cells (with id) and label: the smallest id of each cell's component; a lone cell is its own."""
    cells = cells.withColumn("id", F.col("id").cast("long"))
    labels = components(neighbour_edges(cells, diagonal))
    return cells.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def label_runs(cells: DataFrame) -> DataFrame:
    """As label_cells with four neighbours, for large rasters: runs of a row are the nodes, so far fewer meet in a shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("j").orderBy("i")
    cells = cells.withColumn("run", F.col("i") - F.row_number().over(w))
    runs = cells.groupBy("j", "run").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("id").cast("long").alias("id"))
    below = runs.select((F.col("j") - 1).alias("j"), F.col("i0").alias("k0"), F.col("i1").alias("k1"), F.col("id").alias("b"))
    edges = runs.join(below, "j").where("i0 <= k1 and k0 <= i1").select(F.col("id").alias("a"), "b")
    labels = runs.select("j", "run", "id").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("j", "run", F.coalesce("label", "id").alias("label"))
    return cells.join(labels, ["j", "run"]).drop("run")
