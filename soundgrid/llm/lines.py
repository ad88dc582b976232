"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's counts of (line hash, documents) are first merge-anti-joined with what the runs
hold as settled, that is with hashes that reached the limit already, and what is left becomes a run of its own, sorted
by hash. ``fanout`` runs of a level are merged into one of the next level. All counts together give the hashes that are
found in at least ``min_docs`` documents, whose lines go from every document.

A row is a document, also where a doc_id repeats or is null. A null or empty text is one empty line. A key is a line
without white space at its ends and with A-Z lower-cased; empty keys never go. Hashes have 128 bits. Other columns of
the input are ignored by ``dedup`` and kept by ``dropped_from``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, remove, written

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """128 bits of a line's key, null for an empty key."""
    key = ascii_lower(F.btrim(line, F.lit(BLANK)))
    return F.when(key != "", F.unhex(F.md5(key)))


def keys_in(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(lines_of(text), key_of), lambda k: k.isNotNull()))


class LineRuns:
    """Runs of key and n (documents), by level; the youngest in level 0."""

    def __init__(self, min_docs: int, fanout: int = 4):
        self.min_docs, self.fanout, self.levels = min_docs, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """A batch's key and n; keys are distinct in it."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("n") >= self.min_docs).select("key"), "key", "left_anti")
        self.levels[0].append(self._run(batch))
        self._compact()

    def _run(self, counts: DataFrame) -> DataFrame:
        return written(counts.select("key", "n").repartition("key").sortWithinPartitions("key"), "line-run")

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._run(self._summed(level)))
            for run in level:
                remove(run)
            self.levels[k] = []

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """key: those of at least min_docs documents."""
        return self._summed(self.runs()).where(F.col("n") >= self.min_docs).select("key")


def frequent_keys(rows: DataFrame, min_docs: int, batches: int = 4) -> DataFrame:
    """Keys in at least min_docs rows of _row and keys, which are dealt over batches and merged batch by batch."""
    keys = rows.select(F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int").alias("batch"), F.explode("keys").alias("key"))
    counts = keys.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n"))
    arrived = written(counts, "line-batches")
    runs = LineRuns(min_docs)
    for k in range(batches):
        runs.add(arrived.where(F.col("batch") == k).select("key", "n"))
    remove(arrived)
    return runs.frequent()


def marked(docs: DataFrame, min_docs: int) -> DataFrame:
    """docs with ``_lines`` and ``_kept``, the lines that stay."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))  # rows that share it share at most more frequent keys
    rows = written(keyed.select("_row", keys_in(F.col("text")).alias("keys")), "line-keys")
    hot = rows.select("_row", F.explode("keys").alias("key")).join(frequent_keys(rows, min_docs), "key")
    hot = hot.groupBy("_row").agg(F.collect_set("key").alias("_hot"))
    out = keyed.join(hot, "_row", "left").withColumn("_lines", lines_of(F.col("text")))
    kept = F.filter("_lines", lambda x: ~F.coalesce(F.array_contains(F.col("_hot"), key_of(x)), F.lit(False)))
    return out.withColumn("_kept", F.when(F.col("_hot").isNull(), F.col("_lines")).otherwise(kept)).drop("_row", "_hot")


def dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped."""
    m = marked(docs.select("doc_id", "text"), min_docs)
    n = F.size("_lines").cast("long")
    return m.select("doc_id", F.concat_ws("\n", "_kept").alias("text"), n.alias("n_lines"), (n - F.size("_kept")).alias("n_dropped"))


def dropped_from(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs, all columns, with the frequent lines gone from text; a text that keeps all its lines stays as it is."""
    m = marked(docs, min_docs)
    text = F.when(F.size("_kept") < F.size("_lines"), F.concat_ws("\n", "_kept")).otherwise(F.col("text"))
    return m.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])
