"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Each partition counts its terms in byte tries, one a language. A trie is held as its leaves in depth-first order, which is
the order of UTF-8 (``Trie``); a leaf has the number of documents and a counter for each source. A trie that gets too
large is given out and begun anew. Tries merge by prefix range: all leaves are dealt over ranges of (language, term),
sorted, and leaves of one term, now side by side, are added up while they stream by. Terms in too few documents end there.

Sources are numbered within their language and stand in blocks of ``BLOCK``. One more traversal of the kept leaves, in
ranges again, sums each pair of sources for each pair of blocks and keeps the ten best terms of each source, ties in
UTF-8 order; the sums are added and the candidates ranked. No task holds more than one batch of leaves, its pair sums
and its candidates, however often a term, source or language occurs. All numbers are whole and exact while a language
has less than 9e15 occurrences of kept terms.

A null text, language or source counts as ''. Each row is a document, also where doc_id is null or repeats. A language
without kept terms has pairs of value 0. No documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, remove, written

#: Counters of a partition's tries together, beyond which they are given out; leaves of a batch of rows.
LIMIT, BATCH = 1_000_000, 4096
#: Sources of a block.
BLOCK = 256
UNIT, SMOOTH = 1_000_000_000, 2
#: Letters A-Z and a-z in lower case, bytes of other code points as they are, all else blank.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

LEAVES = "lang string, term binary, docs long, sources array<int>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Trie:
    """Leaves in depth-first order: terms, documents, and from starts[k] on the sources and counts of leaf k."""

    def __init__(self, terms: pa.Array, docs: np.ndarray, starts: np.ndarray, sources: np.ndarray, counts: np.ndarray):
        self.terms, self.docs, self.starts, self.sources, self.counts = terms, docs, starts, sources, counts

    @classmethod
    def counted(cls, docs: Counter, by_source: dict[int, Counter]) -> Trie:
        terms = sorted(docs)
        at = {t: k for k, t in enumerate(terms)}
        parts = [(np.fromiter(map(at.__getitem__, c), np.int64, len(c)), np.full(len(c), s, np.int32), np.fromiter(c.values(), np.int64, len(c))) for s, c in sorted(by_source.items())]
        leaf, source, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(leaf, kind="stable")
        starts = np.searchsorted(leaf[order], np.arange(len(terms) + 1))
        return cls(pa.array(terms, pa.binary()), np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), starts, source[order], count[order])

    @classmethod
    def of(cls, batch: pa.Table) -> Trie:
        """Leaves as they come in rows; a term may come several times in a row."""
        column = lambda c: batch[c].combine_chunks()
        sources, counts = column("sources"), column("counts")
        starts = np.append(0, np.cumsum(sources.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        return cls(column("term"), batch["docs"].to_numpy(), starts, sources.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False))

    def added(self, first: np.ndarray) -> Trie:
        """Leaves from one place of first to the next made one."""
        if not len(first):
            return self
        leaf = np.repeat(np.searchsorted(first, np.arange(len(self.docs)), "right") - 1, np.diff(self.starts))
        order = np.lexsort((self.sources, leaf))
        leaf, source = leaf[order], self.sources[order]
        new = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])))
        return Trie(self.terms.take(pa.array(first)), np.add.reduceat(self.docs, first), np.searchsorted(leaf[new], np.arange(len(first) + 1)), source[new], np.add.reduceat(self.counts[order], new))

    def rows(self, lang: list[str], only: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The leaves at those places as rows."""
        for at in range(0, len(only), BATCH):
            own = only[at : at + BATCH]
            sizes = np.diff(self.starts)[own]
            flat = np.repeat(self.starts[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang[k] for k in own], pa.string()),
                "term": self.terms.take(pa.array(own)),
                "docs": pa.array(self.docs[own], pa.int64()),
                "sources": pa.ListArray.from_arrays(ends, pa.array(self.sources[flat], pa.int32())),
                "counts": pa.ListArray.from_arrays(ends, pa.array(self.counts[flat], pa.int64())),
            })


def _count(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """lang, source (number) and text to leaves."""
    docs: dict[str, Counter] = defaultdict(Counter)
    counts: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def given() -> Iterator[pa.RecordBatch]:
        for lang, own in docs.items():
            if own:
                trie = Trie.counted(own, counts[lang])
                yield from trie.rows([lang] * len(own), np.arange(len(own)))
        docs.clear()
        counts.clear()

    for k, (lang, source, text) in enumerate(arrow_rows(batches, "lang", "source", "text")):
        found = terms_of(text)
        counts[lang][source].update(found)
        docs[lang].update(set(found))
        if k % 32 == 31 and sum(len(c) for x in counts.values() for c in x.values()) > limit:
            yield from given()
    yield from given()


def _merge(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted leaves to those of terms in enough documents; the last leaf of a batch waits for the next."""
    last: pa.Table | None = None

    def kept(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal last
        lang, term = (table[c].combine_chunks() for c in ("lang", "term"))
        new = np.append(True, (pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)) | (pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)))
        first = np.flatnonzero(new)
        trie, names = Trie.of(table).added(first), lang.take(pa.array(first)).to_pylist()
        done = len(first) if whole else len(first) - 1
        yield from trie.rows(names, np.flatnonzero(trie.docs[:done] >= min_docs))
        last = None if whole else pa.Table.from_batches(trie.rows(names, np.array([done])))

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from kept(pa.concat_tables([last, table.cast(last.schema)]) if last is not None else table, False)
    if last is not None:
        yield from kept(last, True)


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / total), digit by digit to the base 1000."""
    out, rest = np.divmod(counts + SMOOTH, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(batches: Iterator[pa.RecordBatch], best: int, size: int) -> Iterator[pa.RecordBatch]:
    """Kept leaves, each with two blocks of sources, to sums of pairs (x < y) and candidate terms (of x)."""
    sums: dict[tuple, np.ndarray] = {}
    found: dict[tuple, list[tuple[int, bytes]]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        rows = [(lang, "pair", a * size + x, b * size + y, None, int(s[x, y])) for (lang, a, b), s in sums.items() for x, y in zip(*np.nonzero(s), strict=True)]
        rows += [(lang, "term", x, None, term, -value) for (lang, x), own in found.items() for value, term in own]
        sums.clear()
        found.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip({"lang": pa.string(), "part": pa.string(), "x": pa.int32(), "y": pa.int32(), "term": pa.binary(), "value": pa.int64()}.items(), columns, strict=True)})

    def one(lang: str, a: int, b: int, table: pa.Table) -> None:
        trie, n = Trie.of(table), table.num_rows
        kept, whole = (table[c][0].as_py() for c in ("kept", "whole"))
        leaf = np.repeat(np.arange(n), np.diff(trie.starts))

        def shares(block: int, totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
            own = trie.sources // size == block
            count = np.zeros((n, len(totals)), np.int64)
            count[leaf[own], trie.sources[own] % size] = trie.counts[own]
            total = np.array(totals, np.int64) + SMOOTH * kept
            p = np.broadcast_to(share(np.zeros_like(total), total), count.shape).copy()
            at = np.nonzero(count)
            p[at] = share(count[at], total[at[1]])
            return count, p

        count, p = shares(a, table["totals_a"][0].as_py())
        other = p if a == b else shares(b, table["totals_b"][0].as_py())[1]
        s = sums.setdefault((lang, a, b), np.zeros((p.shape[1], other.shape[1]), np.int64))
        for x in range(p.shape[1]):
            y = x + 1 if a == b else 0
            s[x, y:] += distance(p[:, x : x + 1], other[:, y:]).sum(0)
        if a == b:
            q = share(np.add.reduceat(trie.counts, trie.starts[:-1]), np.int64(whole + SMOOTH * kept))
            for x in range(p.shape[1]):
                at = np.flatnonzero((count[:, x] > 0) & (p[:, x] > q))
                value = distance(p[at, x], q[at])
                if len(at) > best:
                    few = value >= np.partition(value, len(at) - best)[len(at) - best]
                    at, value = at[few], value[few]
                own = found.get((lang, a * size + x), []) + [(-int(v), trie.terms[k].as_py()) for v, k in zip(value, at, strict=True)]
                found[lang, a * size + x] = sorted(own)[:best]

    for batch in batches:
        where: dict[tuple, list[int]] = defaultdict(list)
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True)):
            where[key].append(k)
        for key, rows in where.items():
            for at in range(0, len(rows), BATCH):
                one(*key, pa.Table.from_batches([batch]).take(pa.array(rows[at : at + BATCH])))
        if sum(s.size for s in sums.values()) > 64 * BLOCK * BLOCK:
            yield from given()
    yield from given()


def audit(docs: DataFrame, min_docs: int = 10, best: int = 10, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    numbered = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"))
    groups = written(numbered, "groups")  # Spark broadcasts it while it is small, and else splits a hot source's rows

    texts = rows.join(groups, ["lang", "source"]).select("lang", F.col("number").alias("source"), F.col("text").cast("binary").alias("text"))
    leaves = written(texts.mapInArrow(lambda x: _count(x, limit), LEAVES), "leaves")
    kept = written(leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda x: _merge(x, min_docs), LEAVES).drop("docs"), "terms")
    remove(leaves)

    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("number")).agg(F.sum("x.counts").alias("total"))
    totals = groups.join(counts, ["lang", "number"], "left").select("lang", "number", F.coalesce("total", F.lit(0)).alias("total"))
    in_lang = totals.groupBy("lang").agg(F.sum("total").alias("whole")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang")
    parts = totals.groupBy("lang", F.expr(f"cast(number div {block} as int)").alias("a")).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "total"))), lambda x: x.total).alias("totals_a"))
    blocks = written(parts, "blocks")
    tiles = blocks.join(blocks.select("lang", F.col("a").alias("b"), F.col("totals_a").alias("totals_b")), "lang").where("a <= b").join(in_lang, "lang")
    compared = kept.withColumn("docs", F.lit(0).cast("long")).join(written(tiles, "tiles"), "lang")
    compared = written(compared.mapInArrow(lambda x: _compare(x, best, block), "lang string, part string, x int, y int, term binary, value long"), "compared")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = compared.where("part = 'pair'").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("to"))
    pairs = groups.join(other, "lang").where("number <> to").select("lang", "source", "item", F.least("number", "to").alias("x"), F.greatest("number", "to").alias("y"))
    pairs = pairs.join(sums, ["lang", "x", "y"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = compared.where("part = 'term'").select("lang", F.col("x").alias("number"), F.col("term").cast("string").alias("item"), "value").join(groups, ["lang", "number"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
