"""The raster that queries run on: derived from lineitem, 96 x 96 fine and 24 x 24 coarse cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regrid

N, FACTOR = 96, 4
LAT0, STEP = 50.0, 0.025

#: The same tables in SQL (fine: f, coarse: k, coarse with mask: c), for the oracles.
SQL = """g AS (SELECT a.range AS j, b.range AS i FROM range(96) a CROSS JOIN range(96) b),
s AS (SELECT l_partkey % 96 AS j, (l_orderkey * 7 + l_linenumber) % 96 AS i,
        CAST(SUM(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 13 + l_linenumber) % 50 AS INT) + 1 AS q FROM lineitem GROUP BY 1, 2),
f AS (SELECT CAST(g.j AS INT) AS j, CAST(g.i AS INT) AS i, 0.025::DOUBLE * g.i + 0.0125::DOUBLE AS lon, 50::DOUBLE + 0.025::DOUBLE * g.j + 0.0125::DOUBLE AS lat,
        CASE WHEN COALESCE(s.q, 25) - CASE WHEN g.i % 32 BETWEEN 28 AND 31 OR g.j % 48 BETWEEN 44 AND 47 THEN 40 ELSE 14 END > 0
             THEN CAST(COALESCE(s.q, 25) - CASE WHEN g.i % 32 BETWEEN 28 AND 31 OR g.j % 48 BETWEEN 44 AND 47 THEN 40 ELSE 14 END AS DOUBLE) END AS depth
      FROM g LEFT JOIN s ON g.j = s.j AND g.i = s.i),
k AS (SELECT CAST(j // 4 AS INT) AS j, CAST(i // 4 AS INT) AS i, AVG(CASE WHEN depth IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS wet_fraction, AVG(depth) AS depth FROM f GROUP BY 1, 2),
c AS (SELECT j, i, 0.1::DOUBLE * i + 0.05::DOUBLE AS lon, 50::DOUBLE + 0.1::DOUBLE * j + 0.05::DOUBLE AS lat, wet_fraction,
        CASE WHEN wet_fraction >= 0.3 AND depth IS NOT NULL THEN depth END AS depth, CASE WHEN wet_fraction >= 0.3 AND depth IS NOT NULL THEN 1 ELSE 0 END AS mask, j * 24 + i AS id FROM k)"""


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j, i, lon, lat, depth (null on land)."""
    mesh = spark.range(N * N).select(F.expr(f"cast(id div {N} as int)").alias("j"), F.expr(f"cast(id % {N} as int)").alias("i"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    sums = line.groupBy(F.expr(f"cast(l_partkey % {N} as int)").alias("j"), F.expr(f"cast((l_orderkey * 7 + l_linenumber) % {N} as int)").alias("i")).agg(F.expr("cast(sum(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 13 + l_linenumber) % 50 as int) + 1").alias("q"))
    ridge = (F.col("i") % 32).between(28, 31) | (F.col("j") % 48).between(44, 47)
    h = F.coalesce("q", F.lit(25)) - F.when(ridge, 40).otherwise(14)
    out = mesh.join(sums, ["j", "i"], "left").withColumn("h", h)
    return out.select("j", "i", (F.col("i") * STEP + STEP / 2).alias("lon"), (F.lit(LAT0) + F.col("j") * STEP + STEP / 2).alias("lat"), F.when(F.col("h") > 0, F.col("h").cast("double")).alias("depth"))


def coarse(spark: SparkSession, sf_dir: str, min_wet_fraction: float = 0.3) -> DataFrame:
    """j, i, lon, lat, wet_fraction, depth, mask, id."""
    k = regrid.mask_and_clamp(regrid.blocks(fine(spark, sf_dir), FACTOR), min_wet_fraction)
    d = STEP * FACTOR
    return k.select("j", "i", (F.col("i") * d + d / 2).alias("lon"), (F.lit(LAT0) + F.col("j") * d + d / 2).alias("lat"), "wet_fraction", "depth", "mask", (F.col("j") * (N // FACTOR) + F.col("i")).alias("id"))
