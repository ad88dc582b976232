"""Slope-limited smoothing of the coarse depths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import remove, written


def envelope(cells: DataFrame, r: float, rounds: int = 10_000) -> DataFrame:
    """cells with the least depths not above the slope limit that deepen only; land stays null.

    Each round lifts a cell to its deepest neighbour over k = (1 + r) / (1 - r), to a fixpoint.
    """
    k = (1 + r) / (1 - r)
    now = written(cells.where("mask = 1").select("j", "i", "depth"), "envelope")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    for _ in range(rounds):
        near = now.select("depth", steps.alias("t"), "j", "i").groupBy((F.col("j") + F.col("t.a")).alias("j"), (F.col("i") + F.col("t.b")).alias("i")).agg(F.max("depth").alias("m"))
        after = written(now.join(near, ["j", "i"], "left").select("j", "i", F.greatest("depth", F.col("m") / k).alias("depth"), (F.coalesce(F.col("m") / k, F.lit(0.0)) > F.col("depth") + 1e-9).alias("moved")), "envelope")
        moved = after.where("moved").isEmpty()
        remove(now)
        now = after.drop("moved")
        if moved:
            break
    return cells.drop("depth").join(now, ["j", "i"], "left")


class Patch:
    """A rectangle of cells with what the solver knows of each: the primal-dual hybrid gradient of the least sum of changes on the grid's stencil.

    A step changes a cell by what its four neighbours have, so after n steps the cells more than n from a cut edge are
    as they would be in the whole grid.
    """

    FIELDS = ("x", "bar", "e0", "e1", "n0", "n1")

    def __init__(self, depth: np.ndarray, wet: np.ndarray, pinned: np.ndarray, r: float, **state: np.ndarray):
        self.k = (1 + r) / (1 - r)
        self.h0, self.wet, self.pinned = np.where(wet, depth, 0.0), wet, pinned & wet
        self.pairs = [wet[:, :-1] & wet[:, 1:], wet[:-1] & wet[1:]]
        self.x, self.bar = state.get("x", self.h0).copy(), state.get("bar", self.h0).copy()
        # multipliers of both limits between a cell and the next one east or north
        self.y = [state.get(f, np.zeros_like(self.h0))[s].copy() for f, s in zip(self.FIELDS[2:], [np.s_[:, :-1]] * 2 + [np.s_[:-1]] * 2, strict=True)]

    @staticmethod
    def ends(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        return (a[:, :-1], a[:, 1:]) if axis == 0 else (a[:-1], a[1:])

    def steps(self, n: int) -> None:
        k, size = self.k, 0.95 / np.sqrt(8 * (1 + self.k * self.k))
        for _ in range(n):
            back = np.zeros_like(self.x)
            for m in range(4):
                (a, b), (ba, bb) = self.ends(self.bar, m // 2), self.ends(back, m // 2)
                u, v, bu, bv = (a, b, ba, bb) if m % 2 == 0 else (b, a, bb, ba)
                self.y[m] = np.where(self.pairs[m // 2], np.maximum(0, self.y[m] + size * (u - k * v)), 0)
                bu += self.y[m]
                bv -= k * self.y[m]
            g = self.x - size * back - self.h0
            d = np.sign(g) * np.maximum(np.abs(g) - size, 0)
            d = np.where(self.pinned, np.maximum(d, 0), d)
            new = np.where(self.wet, self.h0 + d, 0)
            self.bar, self.x = 2 * new - self.x, new

    def state(self) -> dict[str, np.ndarray]:
        whole = [np.pad(y, ((0, 0), (0, 1)) if m < 2 else ((0, 1), (0, 0))) for m, y in enumerate(self.y)]
        return dict(zip(self.FIELDS, [self.x, self.bar, *whole], strict=True))


def lifted(h: np.ndarray, wet: np.ndarray, k: float, rounds: int) -> np.ndarray:
    """Depths after so many rounds, each of which lifts a cell to its deepest neighbour over k."""
    for _ in range(rounds):
        lift = h.copy()
        for axis in (0, 1):
            (a, b), (la, lb) = Patch.ends(h, axis), Patch.ends(lift, axis)
            both = np.logical_and(*Patch.ends(wet, axis))
            np.copyto(la, np.where(both, np.maximum(la, b / k), la))
            np.copyto(lb, np.where(both, np.maximum(lb, a / k), lb))
        if (lift == h).all():
            break
        h = lift
    return h


def _by_tiles(state: DataFrame, tile: int, halo: int, run, schema: str) -> DataFrame:
    """run(arrays of a tile and the cells within halo of it, cut to own) for each tile; halo is at most tile."""
    near = F.array(*[F.struct(F.expr(f"(j + {a * halo}) div {tile}").alias("tj"), F.expr(f"(i + {b * halo}) div {tile}").alias("ti")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    names = [c for c in state.columns if c not in ("j", "i")]
    out = [c.split()[0] for c in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        j0, i0 = pdf["j"].min(), pdf["i"].min()
        at = pdf["j"].to_numpy() - j0, pdf["i"].to_numpy() - i0
        arrays = {}
        for c in names:
            arrays[c] = np.zeros((at[0].max() + 1, at[1].max() + 1), bool if pdf[c].dtype == bool else float)
            arrays[c][at] = pdf[c].to_numpy()
        new = run(arrays)
        own = ((pdf["j"] // tile == pdf["tj"]) & (pdf["i"] // tile == pdf["ti"])).to_numpy()
        return pd.DataFrame({"j": pdf["j"], "i": pdf["i"]} | {c: new[c][at] for c in out if c not in ("j", "i")})[own][out]

    return state.withColumn("t", F.explode(F.array_distinct(near))).select("j", "i", *names, "t.*").groupBy("tj", "ti").applyInPandas(one, schema)


def smooth(cells: DataFrame, r: float, tile: int = 512, halo: int = 200, rounds: int = 4000) -> DataFrame:
    """cells (j, i from 0; with pinned if there is such a column) with depths within the limit, at nearly the least sum of changes; pinned cells don't become shallower.

    The grid is solved in tiles that overlap: a round of tasks does halo - 1 steps of the whole grid's solver, each on its
    tile and the cells within halo of it, keeps its own cells and writes them; so the result doesn't depend on the tiles.
    At last all cells are lifted to the limit exactly.
    """
    k, halo = (1 + r) / (1 - r), min(halo, tile)
    df = cells if "pinned" in cells.columns else cells.withColumn("pinned", F.lit(False))
    h, wet = F.coalesce("depth", F.lit(0.0)).cast("double"), F.coalesce(F.col("mask") == 1, F.lit(False))
    start = df.select("j", "i", F.when(wet, h).otherwise(0.0).alias("h0"), wet.alias("wet"), F.coalesce("pinned", F.lit(False)).alias("pin"))
    now = written(start.withColumns({f: F.col("h0") if f in ("x", "bar") else F.lit(0.0) for f in Patch.FIELDS}), "smooth")
    schema = "j int, i int, h0 double, wet boolean, pin boolean, " + ", ".join(f"{f} double" for f in Patch.FIELDS)
    span = now.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    if span.j is None:
        return cells
    at_once = rounds if max(span.j, span.i) < tile else halo - 1  # one tile has no cut edges

    def solved(n: int):
        def run(a: dict) -> dict:
            patch = Patch(a["h0"], a["wet"], a["pin"], r, **{f: a[f] for f in Patch.FIELDS})
            patch.steps(n)
            return a | patch.state()

        return run

    def up(a: dict) -> dict:
        new = lifted(a["x"], a["wet"], k, 10 * tile if at_once == rounds else halo - 1)
        return {"x": new, "wet": a["wet"], "moved": new > a["x"]}

    def after(state: DataFrame, run, kind: str) -> DataFrame:
        new = written(_by_tiles(state, tile, halo, run, kind), "smooth")
        remove(state)
        return new

    for done in range(0, rounds, at_once):
        now = after(now, solved(min(at_once, rounds - done)), schema)
    x = F.when(F.col("pin"), F.greatest("x", "h0")).otherwise(F.col("x"))
    solution = written(now.select("j", "i", F.when(F.col("wet"), x).otherwise(0.0).alias("x"), "wet"), "smooth")
    remove(now)
    while True:
        new = after(solution, up, "j int, i int, x double, wet boolean, moved boolean")
        moved = not new.where("moved").isEmpty()
        solution = new.drop("moved")
        if not moved:
            break
    return cells.join(solution.select("j", "i", F.col("x").alias("smooth")), ["j", "i"]).withColumn("depth", F.when(F.col("mask") == 1, F.col("smooth"))).drop("smooth")


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """max_rx0_before, max_rx0_after, n_modified, max_change, mean_change."""
    from .regrid import rx0

    d = F.abs(F.col("d1") - F.col("d0"))
    both = before.where("mask = 1").select("j", "i", F.col("depth").alias("d0")).join(after.select("j", "i", F.col("depth").alias("d1")), ["j", "i"])
    change = both.agg(F.count_if(d > 1e-4).alias("n_modified"), F.max(d).alias("max_change"), F.avg(d).alias("mean_change"))
    return rx0(before).agg(F.max("rx0").alias("max_rx0_before")).crossJoin(rx0(after).agg(F.max("rx0").alias("max_rx0_after"))).crossJoin(change)


def histogram(cells: DataFrame, bins: int = 59) -> DataFrame:
    """bin, n of the slopes over 0, in equal bins up to 1.05 times the largest."""
    from .regrid import rx0

    s = rx0(cells).select(F.explode(F.array("rx0_u", "rx0_v")).alias("x")).where("x > 0")
    top = s.agg((F.max("x") * 1.05).alias("top"))
    b = F.least(F.floor(F.col("x") / (F.col("top") / bins)), F.lit(bins - 1)).cast("int")
    return s.crossJoin(F.broadcast(top)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def verdict(cells: DataFrame, targets: list[float]) -> DataFrame:
    """target, max_rx0, status (OK or VIOLATED) for each target, the largest first."""
    from .regrid import rx0

    listed = cells.sparkSession.createDataFrame([(float(t),) for t in sorted(set(targets), reverse=True)], "target double")
    worst = rx0(cells).agg(F.coalesce(F.max("rx0"), F.lit(0.0)).alias("max_rx0"))  # one row
    return listed.crossJoin(worst).withColumn("status", F.when(F.col("max_rx0") <= F.col("target") + 1e-6, "OK").otherwise("VIOLATED"))
