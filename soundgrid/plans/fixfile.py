"""Queries of what becomes of a list of corrections when it is found anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import basins, fixes, straits
from ..sources import fixture
from .queries import _STRAITS, PTS, _straits, e6, query, r6, suppliers

_OLD = f"""{PTS}, od AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS ord, 'b' || lpad(CAST(pid AS VARCHAR), 3, '0') AS key, lon, lat, 'open_cell' AS action, 5.0::DOUBLE + pid % 9 AS value, pid % 3 = 0 AS applied FROM p WHERE pid % 5 < 4),
nw AS (SELECT row_number() OVER (ORDER BY pid DESC) - 1 AS ord, 'b' || lpad(CAST(pid * 2 AS VARCHAR), 3, '0') AS key, lon + (pid % 7) * 0.031::DOUBLE AS lon, lat - (pid % 4) * 0.043::DOUBLE AS lat, 'set_depth' AS action, 20.0::DOUBLE + pid % 11 AS value FROM p WHERE pid % 5 > 0),
cn AS MATERIALIZED (SELECT od.ord AS o, nw.ord AS n, abs(od.lon - nw.lon) + abs(od.lat - nw.lat) AS d FROM od JOIN nw ON abs(od.lon - nw.lon) + abs(od.lat - nw.lat) < 0.3),
gm AS (SELECT -1::BIGINT AS o, []::BIGINT[] AS used, NULL::BIGINT AS n UNION ALL
 SELECT gm.o + 1, CASE WHEN min(cn.n) IS NULL THEN gm.used ELSE list_append(gm.used, arg_min(cn.n, (cn.d, cn.n))) END, arg_min(cn.n, (cn.d, cn.n)) FROM gm LEFT JOIN cn ON cn.o = gm.o + 1 AND NOT list_contains(gm.used, cn.n) WHERE gm.o + 1 < (SELECT count(*) FROM od) GROUP BY gm.o, gm.used),
mt AS MATERIALIZED (SELECT o, n FROM gm WHERE n IS NOT NULL)"""


def _lists(s, d: str) -> tuple[DataFrame, DataFrame]:
    p, pid = suppliers(s, d), F.col("pid")
    at = lambda order: (F.row_number().over(Window.orderBy(order)) - 1).alias("ord")
    key = lambda k: F.concat(F.lit("b"), F.when(F.length(k.cast("string")) < 3, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))).alias("key")
    old = p.where("pid % 5 < 4").select(at(pid), key(pid), "lon", "lat", F.lit("open_cell").alias("action"), (5.0 + pid % 9).alias("value"), (pid % 3 == 0).alias("applied"), F.lit("old").alias("comment"))
    new = p.where("pid % 5 > 0").select(at(F.desc("pid")), key(pid * 2), (F.col("lon") + (pid % 7) * 0.031).alias("lon"), (F.col("lat") - (pid % 4) * 0.043).alias("lat"), F.lit("set_depth").alias("action"), (20.0 + pid % 11).alias("value"), F.lit("new").alias("comment"))
    return old, new


@query("fix_matches", f"{_OLD} SELECT CAST(o AS INT) AS o, CAST(n AS INT) AS n FROM mt", True)
def fix_matches(s, d):
    return fixes.matched(*_lists(s, d), 0.3)


_LPAD = _OLD.replace("lpad(CAST(pid AS VARCHAR), 3, '0')", "CASE WHEN pid < 100 THEN lpad(CAST(pid AS VARCHAR), 3, '0') ELSE CAST(pid AS VARCHAR) END").replace("lpad(CAST(pid * 2 AS VARCHAR), 3, '0')", "CASE WHEN pid * 2 < 100 THEN lpad(CAST(pid * 2 AS VARCHAR), 3, '0') ELSE CAST(pid * 2 AS VARCHAR) END")


@query(
    "fix_merge",
    f"""{_LPAD}, kp AS (SELECT od.key, od.ord AS place, 0 AS late, nw.lon, nw.lat, nw.action, nw.value, od.applied, 'new' AS comment FROM mt JOIN od ON od.ord = mt.o JOIN nw ON nw.ord = mt.n
 UNION ALL SELECT key, ord, 0, lon, lat, action, value, applied, 'old' FROM od WHERE applied AND ord NOT IN (SELECT o FROM mt)),
un AS (SELECT *, key IN (SELECT key FROM kp) AS taken FROM nw WHERE ord NOT IN (SELECT n FROM mt)),
tp AS (SELECT max(CAST(substr(key, 2) AS BIGINT)) AS top FROM (SELECT key FROM kp UNION ALL SELECT key FROM un)),
nn AS (SELECT *, top + row_number() OVER (PARTITION BY taken ORDER BY ord) AS nr FROM un, tp),
al AS (SELECT * FROM kp UNION ALL SELECT CASE WHEN taken THEN 'b' || CASE WHEN nr < 100 THEN lpad(CAST(nr AS VARCHAR), 3, '0') ELSE CAST(nr AS VARCHAR) END ELSE key END, ord, 1, lon, lat, action, value, false, 'new' FROM nn)
SELECT key, {e6('lon', 'lon')}, {e6('lat', 'lat')}, action, value, applied, comment, CAST(row_number() OVER (ORDER BY late, place) - 1 AS INT) AS ord FROM al""",
    True,
)
def fix_merge(s, d):
    return r6(fixes.merge(*_lists(s, d), 0.3), "lon", "lat")


@query(
    "fix_suggestions",
    f"""{_STRAITS}, sg AS (SELECT category, row_number() OVER (ORDER BY direction, j, i) AS ord, lon, lat, CASE WHEN category = 'BLOCKED' THEN 'open_cell' ELSE 'set_depth' END AS action, CASE WHEN category = 'AREA_DEFICIT' THEN round_even(sill_fine * 0.9, 1) ELSE sill_fine END AS value,
  CASE WHEN category = 'BLOCKED' THEN 'no wet path in the raster' WHEN category = 'SILL_DEFICIT' THEN printf('sill ratio %.2f', round_even(sill_ratio, 2)) ELSE printf('area ratio %.2f', round_even(area_ratio, 2)) END AS why FROM st WHERE category <> 'OK')
SELECT CASE category WHEN 'BLOCKED' THEN 'b' WHEN 'SILL_DEFICIT' THEN 's' ELSE 'a' END || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY ord) AS VARCHAR), 3, '0') AS key, category, {e6('lon', 'lon')}, {e6('lat', 'lat')}, action, CAST(value AS DOUBLE) AS value, category || ': ' || why AS comment FROM sg""",
    True,
)
def fix_suggestions(s, d):
    """Of the straits; the mask of one basin that is left has no land bridges."""
    found = _straits(s, d).withColumn("ord", F.row_number().over(Window.orderBy("direction", "j", "i")))
    cells = basins.mask_isolated(fixture.coarse(s, d), 1)
    bridges = basins.land_bridges(cells).join(cells.select("j", "i", "lon", "lat", "wet_fraction"), ["j", "i"]).withColumn("ord", F.col("j") * 1000 + F.col("i"))
    return r6(fixes.suggested(found, bridges), "lon", "lat").drop("ord")
