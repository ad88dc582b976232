"""Queries on a raster as wide as there are orders, so that their work grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, regrid, spatial
from .queries import ORACLES, QUERIES, e6, r6

ROWS, FACTOR = 96, 4


def width(s: SparkSession, d: str) -> int:
    return 32 * (s.read.parquet(f"{d}/orders.parquet").count() // 1000 + 1)


def fine(s: SparkSession, d: str) -> DataFrame:
    """j, i, lon, lat, depth: ROWS by width() cells."""
    w = width(s, d)
    mesh = s.range(ROWS * w).select(F.expr(f"cast(id div {w} as int)").alias("j"), F.expr(f"cast(id % {w} as int)").alias("i"))
    line = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    sums = line.groupBy(F.expr(f"cast(l_partkey % {ROWS} as int)").alias("j"), F.expr(f"cast((l_orderkey * 7 + l_linenumber) % {w} as int)").alias("i")).agg(F.expr("cast(sum(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 13 + l_linenumber) % 50 as int) + 1").alias("q"))
    ridge = (F.col("i") % 32).between(28, 31) | (F.col("j") % 48).between(44, 47)
    out = mesh.join(sums, ["j", "i"], "left").withColumn("h", F.coalesce("q", F.lit(25)) - F.when(ridge, 40).otherwise(14))
    return out.select("j", "i", (F.col("i") * 0.025 + 0.0125).alias("lon"), (50.0 + F.col("j") * 0.025 + 0.0125).alias("lat"), F.when(F.col("h") > 0, F.col("h").cast("double")).alias("depth"))


def coarse(s: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    k = regrid.mask_and_clamp(regrid.blocks(fine(s, d), FACTOR), least)
    return k.select("j", "i", (F.col("i") * 0.1 + 0.05).alias("lon"), (50.0 + F.col("j") * 0.1 + 0.05).alias("lat"), "wet_fraction", "depth", "mask", (F.col("i").cast("long") * (ROWS // FACTOR) + F.col("j")).alias("id"))


SQL = """wd AS (SELECT 32 * (count(*) // 1000 + 1) AS w FROM orders),
g AS (SELECT j, i, w FROM (SELECT unnest(range(96)) AS j) CROSS JOIN (SELECT unnest(range(w)) AS i, w FROM wd)),
s AS (SELECT l_partkey % 96 AS j, (l_orderkey * 7 + l_linenumber) % w AS i, CAST(sum(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 13 + l_linenumber) % 50 AS INT) + 1 AS q FROM lineitem, wd GROUP BY 1, 2),
h AS (SELECT CAST(g.j AS INT) AS j, CAST(g.i AS INT) AS i, coalesce(s.q, 25) - CASE WHEN g.i % 32 BETWEEN 28 AND 31 OR g.j % 48 BETWEEN 44 AND 47 THEN 40 ELSE 14 END AS h FROM g LEFT JOIN s ON g.j = s.j AND g.i = s.i),
f AS (SELECT j, i, 0.025::DOUBLE * i + 0.0125::DOUBLE AS lon, 50::DOUBLE + 0.025::DOUBLE * j + 0.0125::DOUBLE AS lat, CASE WHEN h > 0 THEN CAST(h AS DOUBLE) END AS depth FROM h),
k AS (SELECT CAST(j // 4 AS INT) AS j, CAST(i // 4 AS INT) AS i, avg(CASE WHEN depth IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS wet_fraction, avg(depth) AS depth FROM f GROUP BY 1, 2),
c AS MATERIALIZED (SELECT j, i, i * 24 + j AS id, 0.1::DOUBLE * i + 0.05::DOUBLE AS lon, 50::DOUBLE + 0.1::DOUBLE * j + 0.05::DOUBLE AS lat, wet_fraction, CASE WHEN wet_fraction >= 0.3 THEN depth END AS depth, CASE WHEN wet_fraction >= 0.3 AND depth IS NOT NULL THEN 1 ELSE 0 END AS mask FROM k)"""


def wide(name: str, sql: str, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{'' if sql.startswith('SELECT') else ','} {sql}"
        return f

    return add


@wide("wide_regrid", f"SELECT j, i, mask, {e6('wet_fraction', 'wet_fraction')}, {e6('depth', 'depth')} FROM c")
def wide_regrid(s, d):
    return r6(coarse(s, d), "wet_fraction", "depth").select("j", "i", F.col("mask").cast("int").alias("mask"), "wet_fraction", "depth")


@wide("wide_slopes", f"""l AS (SELECT j, i, depth, lead(depth) OVER a AS e, lead(depth) OVER b AS n FROM c WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)),
x AS (SELECT j, i, coalesce(abs(depth - e) / nullif(depth + e, 0), 0) AS u, coalesce(abs(depth - n) / nullif(depth + n, 0), 0) AS v FROM l) SELECT j, i, {e6('u', 'rx0_u')}, {e6('v', 'rx0_v')} FROM x""")
def wide_slopes(s, d):
    return r6(regrid.rx0(coarse(s, d)), "rx0_u", "rx0_v").select("j", "i", "rx0_u", "rx0_v")


@wide("wide_basins", """rs AS (SELECT j, i, id, j - row_number() OVER (PARTITION BY i ORDER BY j) AS run FROM c WHERE wet_fraction >= 0.5 AND depth IS NOT NULL),
rr AS MATERIALIZED (SELECT i, run, min(j) AS j0, max(j) AS j1, count(*) AS n, min(id) AS id FROM rs GROUP BY i, run),
ed AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM rr a JOIN rr b ON abs(a.i - b.i) = 1 AND a.j0 <= b.j1 AND b.j0 <= a.j1),
lb(id, l) AS (SELECT id, id FROM rr UNION SELECT ed.y, lb.l FROM lb JOIN ed ON ed.x = lb.id WHERE lb.l < ed.y)
SELECT CAST(l AS BIGINT) AS label, CAST(sum(n) AS BIGINT) AS n FROM rr JOIN (SELECT id, min(l) AS l FROM lb GROUP BY id) USING (id) GROUP BY l""", True)
def wide_basins(s, d):
    """Cells of each basin, by its smallest id; runs of cells are what is joined."""
    wet = coarse(s, d, 0.5).where("mask = 1").select("j", "i", "id")
    return graph.label_runs(wet).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@wide("wide_nearest", f"""p AS (SELECT c_custkey AS pid, (c_custkey * 7919 % (w * 25)) / 1000.0::DOUBLE + 0.0003::DOUBLE AS lon, 50::DOUBLE + (c_custkey * 104729 % 2400) / 1000.0::DOUBLE + 0.0007::DOUBLE AS lat FROM customer, wd),
n AS (SELECT pid, min_by((c.j, c.i), ((c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat), c.j, c.i)) AS place FROM p JOIN c ON mask = 1 AND abs(c.lon - p.lon) <= 0.3 AND abs(c.lat - p.lat) <= 0.3 AND (c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat) <= 0.09 GROUP BY pid)
SELECT p.pid, place[1] AS j, place[2] AS i FROM p LEFT JOIN n USING (pid)""")
def wide_nearest(s, d):
    k = F.col("c_custkey")
    p = s.read.parquet(f"{d}/customer.parquet").select(k.alias("pid"), (k * 7919 % (width(s, d) * 25) / 1000.0 + 0.0003).alias("lon"), (50.0 + k * 104729 % 2400 / 1000.0 + 0.0007).alias("lat"))
    return spatial.nearest_cell(p, coarse(s, d).where("mask = 1"), max_deg=0.3).select("pid", "j", "i")
