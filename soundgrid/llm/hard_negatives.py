"""Hard negatives by distributed radix selection.

Scores are inner products of vectors of whole numbers (floor of 256 times each component), so they have digits. What is
asked for is, for each window, the first k rows in the order of falling score and rising vec_id: a window of positives
takes an anchor's rows of equal label, a window of negatives its rows of other labels with a score between two bounds.

Rows and anchors are dealt over the cells of a grid, a group of rows by a group of anchors. A pass goes over all cells;
each gives, for every window that is still open, a histogram of the next digit of what lies in the window's undecided
interval. The summed histograms locate the digit that holds the kth row; that digit's range is the next interval. When
an interval is down to one score, the digits of vec_id follow. A window closes once at most ``few`` rows can be among
its first k, or when its interval is one score and one vec_id. A last pass gathers those rows only, and they are ranked.
A cell leaves out of its histogram the digits after the one in which its own rows reach the kth: none of them can matter.

Rows with a null vec_id, label or vector, or a null or non-finite component take no part; nor do those whose scores
might not fit a long (a component of 2^23 or more in size, a squared length of 2^61 or more of the whole numbers) or
with a vec_id of 2^61 or more in size. A shorter vector counts as filled up with zeros. Rows are told apart by a number
of their own: of a repeated vec_id each row is an anchor and a candidate, and is "another row" to the others. An anchor
without positives, or a positive without negatives, has no rows in the result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, written

SCALE = 256


class Sizes(NamedTuple):
    """Rows and anchors of a cell of the grid (on average, at most), scores that a task holds at once, bits of a digit, and rows of a window that are gathered without another digit."""

    rows: int = 65_536
    anchors: int = 16_384
    at_once: int = 2_000_000
    digit: int = 8
    few: int = 64


STATE = ("w", "anchor", "label", "q", "lo", "hi", "top", "id_lo", "id_hi", "above", "open")


def prepared(embeddings: DataFrame, label: Column) -> DataFrame:
    """_row, vec_id, label (as given by an expression), q: the rows that take part, with whole-number vectors."""
    x = F.col("embedding")
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < 2.0**23, F.lit(False))) & (F.abs("vec_id") < 2**61)
    rows = embeddings.select("vec_id", "embedding", label.cast("long").alias("label")).where(F.col("label").isNotNull() & F.coalesce(fits, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")).alias("q"))
    size = F.aggregate("q", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    return written(rows.where(size < 2.0**61).withColumn("_row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of lists as a matrix, short ones filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(ends) * dims:
        return flat.reshape(len(ends), dims)
    out = np.zeros((len(ends), dims), flat.dtype)
    lengths = np.diff(ends, prepend=0)
    at = np.repeat(np.arange(len(ends)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


class Cell:
    """A group of rows and the windows of a group of anchors."""

    def __init__(self, rows: pa.Table, windows: pa.Table, dims: int, longest: int, same: bool, sizes: Sizes):
        self.kind = np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64  # in which sums are exact
        self.row, self.ids, self.labels = (rows[c].to_numpy() for c in ("_row", "vec_id", "label"))
        self.vectors = _matrix(rows["q"], dims).astype(self.kind).T if rows.num_rows else np.zeros((dims, 0), self.kind)
        self.windows, self.dims, self.same, self.sizes = windows, dims, same, sizes
        self.none = -np.inf if self.kind != np.int64 else np.iinfo(np.int64).min

    def scored(self, order: bool) -> Iterator[tuple[dict, np.ndarray]]:
        """Each window and its anchor's scores, none for rows that don't count; in rising order if asked for."""
        anchors = self.windows["anchor"].to_numpy()
        found, first, which = np.unique(anchors, return_index=True, return_inverse=True)
        fields = {c: self.windows[c].to_numpy() for c in ("w", "lo", "hi", "top", "id_lo", "id_hi", "above")}
        labels, vectors = self.windows["label"].to_numpy(), self.windows["q"]
        by = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[by], np.arange(len(found) + 1))
        step = max(1, self.sizes.at_once // max(1, len(self.ids)))
        for at in range(0, len(found), step):
            own = first[at : at + step]
            s = _matrix(vectors.take(pa.array(own)), self.dims).astype(self.kind) @ self.vectors
            counts = labels[own][:, None] == self.labels[None, :]
            if self.same:
                counts &= found[at : at + step][:, None] != self.row[None, :]
            else:
                counts = ~counts
            s[~counts] = self.none
            if order:
                ties = fields["lo"] == fields["hi"]
                raw = s if ties[by[starts[at] : starts[min(at + step, len(found))]]].any() else None
                s = np.sort(s, axis=1) if raw is not None else (s.sort(axis=1), s)[1]
            for k in range(len(own)):
                for n in by[starts[at + k] : starts[at + k + 1]]:
                    window = {c: int(v[n]) for c, v in fields.items()}
                    yield window, (raw[k] if order and window["lo"] == window["hi"] else s[k])

    def histogram(self, k: int) -> pa.Table:
        """w, bucket, n of the next digit."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x, s in self.scored(True):
            need = k - x["above"]
            if x["lo"] == x["hi"]:
                ids = np.sort(self.ids[s == x["lo"]])
                ids = ids[np.searchsorted(ids, x["id_lo"]) : np.searchsorted(ids, x["id_hi"], "right")]
                shift = max(0, (x["id_hi"] - x["id_lo"]).bit_length() - self.sizes.digit)
                bucket = (ids - x["id_lo"]) >> shift
                bucket = bucket[: np.searchsorted(bucket, bucket[need - 1], "right")] if len(bucket) > need else bucket
            else:
                end, start = np.searchsorted(s, x["hi"], "right"), np.searchsorted(s, x["lo"])
                shift = max(0, (x["hi"] - x["lo"]).bit_length() - self.sizes.digit)
                if end - start > need:
                    last = (x["hi"] - int(s[end - need])) >> shift
                    start = max(start, np.searchsorted(s, x["hi"] - ((last + 1) << shift) + 1))
                bucket = (x["hi"] - s[start:end].astype(np.int64)) >> shift
            if len(bucket):
                digit, n = np.unique(bucket, return_counts=True)
                out.append((np.full(len(digit), x["w"]), digit, n))
        w, digit, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"w": pa.array(w, pa.int64()), "bucket": pa.array(digit, pa.int64()), "n": pa.array(n, pa.int64())})

    def gather(self, k: int) -> pa.Table:
        """w, score, vec_id of the rows that can be among a window's first k."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x, s in self.scored(False):
            at = np.flatnonzero((s >= x["lo"]) & (s <= x["top"]))
            if x["lo"] == x["hi"]:
                at = at[(s[at] > x["lo"]) | (self.ids[at] <= x["id_hi"])]
            if len(at):
                at = at[np.lexsort((self.ids[at], -s[at]))[:k]]
                out.append((np.full(len(at), x["w"]), s[at].astype(np.int64), self.ids[at]))
        w, score, ids = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"w": pa.array(w, pa.int64()), "score": pa.array(score, pa.int64()), "vec_id": pa.array(ids, pa.int64())})


class Grid:
    """The rows dealt over cells, and what bounds their scores."""

    def __init__(self, rows: DataFrame, anchor: Column, sizes: Sizes):
        self.sizes = sizes
        top = rows.select("*", F.aggregate("q", F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long") * v).alias("length"))
        s = top.agg(F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("anchors"), F.max("length").alias("longest"), F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", F.abs))).alias("most"), F.min("vec_id").alias("id_lo"), F.max("vec_id").alias("id_hi")).first()
        self.longest, self.dims, self.id_lo, self.id_hi = s.longest or 0, s.dims or 0, s.id_lo or 0, s.id_hi or 0
        tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
        self.across = max(-(-s.n // sizes.rows), min(tasks, -(-s.n // 1024)), 1)
        self.along = max(-(-s.anchors // sizes.anchors), 1)
        self.rows = rows.withColumn("q", F.col("q").cast("array<smallint>")) if (s.most or 0) < 2**15 else rows
        self.anchors = self.rows.where(anchor)

    def over_cells(self, windows: DataFrame, same: bool, k: int, what: Callable, schema: str) -> DataFrame:
        dims, longest, sizes = self.dims, self.longest, self.sizes
        r, a = F.pmod(F.xxhash64("_row"), F.lit(self.across)).alias("r"), F.pmod(F.xxhash64("anchor"), F.lit(self.along)).alias("a")
        left = self.rows.select("*", r, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.along - 1).cast("long"))).alias("a"))
        right = windows.select("*", a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.across - 1).cast("long"))).alias("r"))
        both = left.groupBy("r", "a").cogroup(right.groupBy("r", "a"))
        return both.applyInArrow(lambda x, y: what(Cell(x, y, dims, longest, same, sizes), k), schema)

    def first(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """w, score, vec_id, rank: the first k rows of each window."""
        state = written(windows.select(*STATE), "windows")
        while not state.where("open").isEmpty():
            counts = self.over_cells(state.where("open"), same, k, Cell.histogram, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            located = counts.withColumn("before", upto - F.col("n")).join(state.select("w", "above"), "w").where((F.col("above") + F.col("before") < k) & (F.col("above") + F.col("before") + F.col("n") >= k)).drop("above")
            after = written(state.join(located, "w", "left").select(*_narrowed(self.sizes)), "windows")
            remove(state)
            state = after
        hits = self.over_cells(state, same, k, Cell.gather, "w long, score long, vec_id long")
        rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _narrowed(sizes: Sizes) -> list[Column]:
    """The state after a pass: a located digit becomes the interval; a window without one has fewer than k rows and closes."""
    found, tie = F.col("bucket").isNotNull() & F.col("open"), F.expr("lo = hi")
    shift = f"greatest(length(bin(IF(lo = hi, id_hi - id_lo, hi - lo))) - {sizes.digit}, 0)"
    hi, id_lo = F.expr(f"hi - shiftleft(bucket, {shift})"), F.expr(f"id_lo + shiftleft(bucket, {shift})")
    wide = F.expr(f"shiftleft(1L, {shift}) - 1")
    new = {
        "hi": F.when(found & ~tie, hi).otherwise(F.col("hi")),
        "lo": F.when(found & ~tie, F.greatest("lo", hi - wide)).otherwise(F.col("lo")),
        "id_lo": F.when(found & tie, id_lo).otherwise(F.col("id_lo")),
        "id_hi": F.when(found & tie, F.least("id_hi", id_lo + wide)).otherwise(F.col("id_hi")),
        "above": F.when(found, F.col("above") + F.col("before")).otherwise(F.col("above")),
        "open": found & (F.col("above") + F.col("before") + F.col("n") > sizes.few) & ~(tie & (wide == 0)),
    }
    return [new[c].alias(c) if c in new else F.col(c) for c in STATE]


def mine(embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, sizes: Sizes = Sizes()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor and label are expressions over vec_id and label; least and most are the bounds of a negative's score, in
    percent of the positive's.
    """
    rows = prepared(embeddings, label)
    grid = Grid(rows, anchor, sizes)
    bound = {"id_lo": F.lit(grid.id_lo), "id_hi": F.lit(grid.id_hi), "above": F.lit(0)}
    longs = lambda **x: [c.cast("long").alias(n) for n, c in (x | bound).items()]
    start = grid.anchors.select(F.col("_row").alias("w"), F.col("_row").alias("anchor"), "label", "q", *longs(lo=F.lit(-grid.longest), hi=F.lit(grid.longest), top=F.lit(grid.longest)), F.lit(True).alias("open"))
    found = grid.first(start, True, positives).select(F.col("w").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written(found.withColumn("w", F.monotonically_increasing_id()), "positives")
    # no bound is met below zero: the lower one is above the upper one there
    share = lambda percent, up: f"positive_score div 100 * {percent} + (positive_score % 100 * {percent} + {99 if up else 0}) div 100"
    windows = pairs.where("positive_score >= 0").select("w", "anchor", *longs(lo=F.expr(share(least, True)), hi=F.expr(share(most, False)))).where("lo <= hi")
    windows = windows.withColumn("top", F.col("hi")).withColumn("open", F.lit(True)).join(grid.anchors.select(F.col("_row").alias("anchor"), "label", "q"), "anchor")
    best = grid.first(windows, False, negatives).select("w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = grid.anchors.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(pairs, "w").join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
