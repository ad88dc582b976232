"""Ordered, auditable cell corrections."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import written
from . import graph, spatial

ACTIONS = ("set_depth", "open_cell", "deepen_by", "close_cell", "mask_cell", "blend_cell")
# Key prefix of each category.
PREFIX = {"BLOCKED": "b", "SILL_DEFICIT": "s", "AREA_DEFICIT": "a", "LAND_BRIDGE": "lb"}


def load(spec: dict | list) -> list[dict]:
    """Fixes in order, from the flat, grouped (tw_*, phantom_islands) or list form."""
    if isinstance(spec, list):
        return [{"key": f"fix{k:03d}"} | f for k, f in enumerate(spec, 1)]
    out = []
    for key, f in (spec or {}).items():
        if key.startswith("tw_") or key == "phantom_islands":
            applied = f.get("applied", False)
            out += [{"key": f"{key}_{sub}"} | g | {"applied": applied} for sub, g in f.items() if isinstance(g, dict)]
        else:
            out.append({"key": key} | f)
    return out


def resolve(keys: list, fixes: list[dict]) -> list[dict]:
    known = {f["key"]: f for f in fixes}
    missing = [k for k in keys if isinstance(k, str) and k not in known]
    if missing:
        raise KeyError(f"unknown fixes: {', '.join(missing)}")
    return [known[k] if isinstance(k, str) else k for k in keys]


def _value(f: dict) -> float | None:
    """A fix's value; depth is another name of it."""
    v = f.get("value", f.get("depth"))
    return None if v is None else float(v)


def table(spark: SparkSession, fixes: list[dict], applied_only: bool = False) -> DataFrame:
    """ord, lon, lat, action, value of a list of fixes in its order; fields that begin with _ are notes and are left out."""
    known = [{k: v for k, v in f.items() if not k.startswith("_")} for f in fixes]
    rows = [(n, float(f["lon"]), float(f["lat"]), f.get("action", "set_depth"), _value(f)) for n, f in enumerate(known) if f.get("applied", True) or not applied_only]
    return spark.createDataFrame(rows, "ord int, lon double, lat double, action string, value double")


def located(fixes: DataFrame, cells: DataFrame) -> DataFrame:
    """fixes (ord, lon, lat, action, value) with the nearest cell's j, i and distance_deg."""
    return spatial.nearest_cell(fixes, cells.select("j", "i", "lon", "lat"), "ord").withColumn("distance_deg", F.sqrt("d2")).drop("d2")


def applied_log(fixes: DataFrame, cells: DataFrame) -> DataFrame:
    """ord, action, requested and actual place, row, col, distance_deg and value (null unless it sets a depth) of every fix."""
    at = located(fixes, cells).join(cells.select("j", "i", F.col("lon").alias("actual_lon"), F.col("lat").alias("actual_lat")), ["j", "i"])
    value = F.when(F.col("action").isin("set_depth", "open_cell"), F.coalesce("value", F.lit(10.0)))
    return at.select("ord", "action", F.col("lon").alias("requested_lon"), F.col("lat").alias("requested_lat"), "actual_lon", "actual_lat", "distance_deg", F.col("j").alias("row"), F.col("i").alias("col"), value.alias("value"))


def apply_absolute(cells: DataFrame, fixes: DataFrame) -> DataFrame:
    """cells after set_depth, open_cell, close_cell and mask_cell; of several on a cell the last by ord holds.

    A cell that was closed before it is opened has lost its wet fraction.
    """
    closes = F.col("action").isin("close_cell", "mask_cell")
    last = located(fixes, cells).groupBy("j", "i").agg(F.max(F.struct("ord", "action", "value")).alias("f"), F.max(closes).alias("was_closed"))
    out = cells.join(last, ["j", "i"], "left")
    opened, closed = F.col("f.action").isin("set_depth", "open_cell"), F.col("f.action").isin("close_cell", "mask_cell")
    return out.withColumns({
        "depth": F.when(opened, F.coalesce("f.value", F.lit(10.0))).when(~F.coalesce(closed, F.lit(False)), F.col("depth")),
        "mask": F.when(opened, 1).when(closed, 0).otherwise(F.col("mask")).cast("tinyint"),
        "wet_fraction": F.when(opened, F.when(F.col("was_closed"), 0.01).otherwise(F.greatest("wet_fraction", F.lit(0.01)))).when(closed, 0.0).otherwise(F.col("wet_fraction")),
    }).drop("f", "was_closed")


def neighbour_mean(cells: DataFrame) -> DataFrame:
    """j, i, blend: the mean depth of the wet cells around each cell, without itself."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    to = F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a, b in steps]))
    return cells.where("mask = 1").select("depth", to.alias("t")).groupBy("t.j", "t.i").agg(F.avg("depth").alias("blend"))


def _in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cells of one component after its fixes in turn; rows are the cells that fixes change or read (no ord), and the fixes."""
    known = lambda x: None if pd.isna(x) else x
    cells = {(r.j, r.i): [known(r.depth), known(r.mask), known(r.wet_fraction)] for r in pdf[pdf["ord"].isna()].itertuples()}
    listed = pdf[pdf["ord"].notna()].sort_values("ord")
    for j, i, action, value in zip(listed["j"], listed["i"], listed["action"], listed["value"], strict=True):
        c, value = cells[j, i], known(value)
        if action == "blend_cell":
            near = [cells[j + a, i + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (j + a, i + b) in cells]
            wet = [n[0] for n in near if n[1] == 1 and n[0] is not None]
            c[0] = sum(wet) / len(wet) if wet else c[0]
        elif action in ("close_cell", "mask_cell"):
            c[:] = [None, 0, 0.0]
        else:
            deeper = None if c[0] is None else max(c[0] + (value or 0.0), 0.0)  # land has no depth to start from
            c[:] = [deeper if action == "deepen_by" else 10.0 if value is None else value, 1, max(c[2] or 0.0, 0.01)]
    changed = sorted(set(zip(listed["j"], listed["i"], strict=True)))
    return pd.DataFrame([(j, i, *cells[j, i]) for j, i in changed], columns=["j", "i", "new_depth", "new_mask", "new_wet"])


def apply(cells: DataFrame, fixes: DataFrame) -> DataFrame:
    """cells after all fixes, each of which sees what those before it in the order of ord have done.

    Fixes are located by one join. Cells with fixes are linked where a blend reads one of them; each component then goes
    through its fixes in turn, beside the others, in one pass over the list.
    """
    bad = [r.action for r in fixes.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).select("action").distinct().limit(20).collect()]
    if bad:
        raise ValueError(f"unknown actions: {', '.join(sorted(map(str, bad)))}")
    cells = written(cells, "cells")
    at = written(located(fixes, cells).select("ord", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), "action", "value"), "located-fixes")
    number = lambda j, i: F.col(j).cast("long") * (1 << 32) + F.col(i)
    fixed = at.select("j", "i", number("j", "i").alias("id")).distinct()
    around = F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    read = at.where("action = 'blend_cell'").select("j", "i").distinct().select(number("j", "i").alias("a"), around.alias("t")).select("a", "t.j", "t.i")
    label = graph.components(read.join(fixed, ["j", "i"]).select("a", F.col("id").alias("b")))
    fixed = written(fixed.join(label.withColumnRenamed("node", "id"), "id", "left").select("j", "i", "id", F.coalesce("label", "id").alias("label")), "fixed-cells")
    held = fixed.select("label", "j", "i").unionByName(read.join(fixed.select(F.col("id").alias("a"), "label"), "a").select("label", "j", "i")).distinct()
    wet = F.col("wet_fraction") if "wet_fraction" in cells.columns else F.lit(None)
    state = held.join(cells.select("j", "i", F.col("depth").cast("double").alias("depth"), "mask", wet.cast("double").alias("wet_fraction")), ["j", "i"])
    listed = at.join(fixed.select("j", "i", "label"), ["j", "i"])
    changed = state.unionByName(listed, allowMissingColumns=True).groupBy("label").applyInPandas(lambda pdf: _in_turn(pdf), "j int, i int, new_depth double, new_mask tinyint, new_wet double")
    hit = F.col("new_mask").isNotNull()
    columns = {"depth": "new_depth", "mask": "new_mask"} | ({"wet_fraction": "new_wet"} if "wet_fraction" in cells.columns else {})
    out = cells.join(changed, ["j", "i"], "left").withColumns({c: F.when(hit, F.col(n)).otherwise(F.col(c)) for c, n in columns.items()})
    return out.withColumn("mask", F.col("mask").cast("tinyint")).select(cells.columns)


def number_keys(records: DataFrame) -> DataFrame:
    """records (category, ord) with keys such as b001, counted by category in order."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    n = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    return records.withColumn("key", F.concat(prefix[F.col("category")], F.lpad(n.cast("string"), 3, "0")))


def suggested(straits: DataFrame, bridges: DataFrame) -> DataFrame:
    """key, category, ord, lon, lat, action, value, comment: what straits (found by straits.find, in the order of ord) and land bridges (j, i, lon, lat, ord, wet_fraction, n_components, estimated_depth) ask for."""
    c = F.col("category")
    value = F.when(c == "AREA_DEFICIT", geo.half_even(F.col("sill_fine") * 0.9, 1)).otherwise(F.col("sill_fine"))
    why = F.when(c == "BLOCKED", "no wet path in the raster").when(c == "SILL_DEFICIT", F.format_string("sill ratio %.2f", geo.half_even("sill_ratio", 2))).otherwise(F.format_string("area ratio %.2f", geo.half_even("area_ratio", 2)))
    narrow = straits.where(c.isin("BLOCKED", "SILL_DEFICIT", "AREA_DEFICIT")).select("category", "ord", "lon", "lat", F.when(c == "BLOCKED", "open_cell").otherwise("set_depth").alias("action"), value.alias("value"), why.alias("why"))
    joined = F.format_string("wet fraction %.2f, joins %d basins", geo.half_even("wet_fraction", 2), "n_components")
    land = bridges.select(F.lit("LAND_BRIDGE").alias("category"), "ord", "lon", "lat", F.lit("open_cell").alias("action"), F.col("estimated_depth").alias("value"), joined.alias("why"))
    both = number_keys(narrow.unionByName(land))
    return both.select("key", "category", "ord", "lon", "lat", "action", "value", F.concat_ws(": ", "category", "why").alias("comment"))


def _padded(number) -> Column:
    """Three digits at least, as text; larger numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def _take_in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """o, n of one component's rows (kind, a, b, d): old fixes and their places, new fixes and theirs, near places and their distance."""
    olds, news, near = (pdf[pdf["kind"] == k] for k in range(3))
    left = {q: deque(sorted(g)) for q, g in news.groupby("b")["a"]}
    lists = {p: list(zip(g["d"].tolist(), g["b"].tolist(), strict=True)) for p, g in near.sort_values(["d", "b"]).groupby("a")}
    out = []
    for o, p in sorted(zip(olds["a"].tolist(), olds["b"].tolist(), strict=True)):
        spent, best = 0, None
        for d, q in lists[p]:
            if best is not None and d > best[0]:
                break
            if left[q]:
                best = min(best, (d, left[q][0], q)) if best else (d, left[q][0], q)
            elif best is None:
                spent += 1
        if spent:
            del lists[p][:spent]
        if best:
            out.append((o, left[best[2]].popleft()))
    return pd.DataFrame(out, columns=["o", "n"], dtype="int64")


def matched(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """o, n: places (ord, lon, lat) of old fixes and the new ones that they take, as if each old one in turn took the nearest that is left, closer than the tolerance (sum of both differences; the first on ties).

    Distinct places within the tolerance meet in bins. What an old fix takes depends only on those before it in its
    component of near places, so each component goes through its turns by itself; its fixes are held once, not in pairs.
    """
    bins = lambda c: F.floor(F.col(c) / tolerance)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    places = lambda df, name: df.groupBy("lon", "lat").agg(F.min("ord").cast("long").alias(name))
    at, to = places(old, "p"), places(new, "q")
    o = at.select("p", F.col("lon").alias("x"), F.col("lat").alias("y"), around.alias("s"), bins("lon").alias("bx"), bins("lat").alias("by")).select("p", "x", "y", (F.col("bx") + F.col("s.a")).alias("bx"), (F.col("by") + F.col("s.b")).alias("by"))
    n = to.select("q", "lon", "lat", bins("lon").alias("bx"), bins("lat").alias("by"))
    d = F.abs(F.col("x") - F.col("lon")) + F.abs(F.col("y") - F.col("lat"))
    near = written(o.join(n, ["bx", "by"]).select("p", "q", d.alias("d")).where(F.col("d") < tolerance), "near-places")
    label = written(graph.components(near.select(F.col("p").alias("a"), (-1 - F.col("q")).alias("b"))), "near-labels")  # new places below zero
    row = lambda kind, a, b, d: ("label", F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).alias("b"), d.cast("double").alias("d"))
    olds = old.join(at, ["lon", "lat"]).join(label, F.col("p") == F.col("node")).select(*row(0, "ord", "p", F.lit(None)))
    news = new.join(to, ["lon", "lat"]).join(label, -1 - F.col("q") == F.col("node")).select(*row(1, "ord", "q", F.lit(None)))
    pairs = near.join(label, F.col("p") == F.col("node")).select(*row(2, "p", "q", F.col("d")))
    out = olds.unionByName(news).unionByName(pairs).groupBy("label").applyInPandas(lambda pdf: _take_in_turn(pdf), "o long, n long")
    return out.select(F.col("o").cast(old.schema["ord"].dataType).alias("o"), F.col("n").cast(new.schema["ord"].dataType).alias("n"))


def merge(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Upsert of fixes (key, ord, lon, lat, action, value, applied, comment): key, lon, lat, action, value, applied, comment, ord.

    A matched old fix keeps key, place in the list and applied, and takes the rest from the new one. An unmatched old one
    stays if it is applied. Unmatched new ones follow; one whose key is taken is numbered after the largest of its prefix.
    """
    what = ["lon", "lat", "action", "value", "comment"]
    pairs = written(matched(old, new, tolerance), "matches")
    both = old.select(F.col("ord").alias("o"), "key", "applied").join(pairs, "o").join(new.select(F.col("ord").alias("n"), *what), "n")
    alone = old.withColumnRenamed("ord", "o").join(pairs, "o", "left_anti").where("applied")
    kept = written(both.select("key", "o", *what, "applied").unionByName(alone.select("key", "o", *what, "applied")), "kept-fixes")
    fresh = new.withColumnRenamed("ord", "n").join(pairs, "n", "left_anti")
    split = r"^(.*?)(\d*)$"
    prefix, number = (lambda c: F.regexp_extract(c, split, 1)), (lambda c: F.coalesce(F.regexp_extract(c, split, 2).try_cast("long"), F.lit(0)))
    top = kept.select("key").unionByName(fresh.select("key")).groupBy(prefix("key").alias("prefix")).agg(F.max(number("key")).alias("top"))
    fresh = fresh.join(kept.select("key", F.lit(True).alias("taken")), "key", "left").withColumn("prefix", prefix("key")).join(top, "prefix")
    n = F.row_number().over(Window.partitionBy("prefix", F.col("taken").isNull()).orderBy("n"))
    numbered = F.concat("prefix", _padded(F.col("top") + n))
    fresh = fresh.withColumn("number", numbered).select(F.when(F.col("taken").isNull(), F.col("key")).otherwise(F.col("number")).alias("key"), "n", *what, F.lit(False).alias("applied"))
    listed = kept.withColumns({"late": F.lit(0), "at": F.col("o").cast("long")}).drop("o").unionByName(fresh.withColumns({"late": F.lit(1), "at": F.col("n").cast("long")}).drop("n"))
    return listed.withColumn("ord", (F.row_number().over(Window.orderBy("late", "at")) - 1).cast("int")).select("key", *what[:4], "applied", "comment", "ord")


def merge_groups(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """grp, ord, lon, lat, action, value, applied, comment of groups of fixes (tw_*, phantom_islands), old and new.

    A group that is found anew keeps only its applied flag; of the phantom islands, cells found again also keep the
    action, which may have been edited. A group that isn't found again stays as it is.
    """
    columns = ["grp", "ord", "lon", "lat", "action", "value", "applied", "comment"]
    flags = old.groupBy("grp").agg(F.max("applied").alias("was"))
    again = new.join(flags, "grp", "left").withColumn("applied", F.coalesce("was", F.lit(False)))
    islands = F.col("grp") == "phantom_islands"
    pairs = matched(old.where(islands), new.where(islands), tolerance)
    edited = old.where(islands).select(F.col("ord").alias("o"), F.col("action").alias("edited")).join(pairs, "o").select(F.lit("phantom_islands").alias("grp"), F.col("n").alias("ord"), "edited")
    again = again.join(edited, ["grp", "ord"], "left").withColumn("action", F.coalesce("edited", "action")).select(columns)
    return again.unionByName(old.join(new.select("grp").distinct(), "grp", "left_anti").select(columns))
