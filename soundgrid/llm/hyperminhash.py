"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct five-word shingles. One hash per shingle picks a bucket; a register
keeps, of the least hash in its bucket, the number of leading zeros and ten mantissa bits. Documents of equal sets form
one node, so copies never meet in pairs. For banding, an empty register borrows the register that comes first in an
order of its own, so that bands of short texts rest on as many registers as those of long ones. Registers then estimate
the Jaccard similarity, corrected for registers that agree by chance, and only pairs within reach of the limit are
compared on their full sets.

Nodes that share a band meet in a bucket. A node is compared first with the least node of the bucket that most of its
bands lead to, then with the least nodes of its other buckets that still have another label. Buckets whose other nodes
still have several labels are compared block by block, within the bucket: on registers, and the nodes that come within
reach there on full sets. A block gives out no more links than join its labels. No bucket is capped. The work on the
driver is bounded.

A null or empty text, or one of white space, has an empty set and is linked with nothing. Fewer than five words are one
shingle. Rows are what is linked; repeated rows form one node. A row with a null doc_id is linked with nothing and has
a null component_id. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, mixed, remove, small_batches, text_of, written
from .graph import components

REGISTERS, MANTISSA = 256, 10
#: Chance that two registers of different sets agree: equal zeros (1/3) and equal mantissas.
CHANCE = 2.0**-MANTISSA / 3
#: Standard errors below the limit at which an estimate still leads to a full comparison.
SLACK = 4.5
#: Nodes, and bytes of full sets, of a block of a bucket.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Chance that a pair at the limit shares no band.
MISSED = 1e-5
#: Nodes whose keys are sent to all tasks (some 10 MB) to pick their texts; more are joined.
FEW_NODES = 200_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = ByteHashes()


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of that many words; A-Z are lower-cased, ASCII white space separates."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = _HASHES.of(found)
    n = min(words, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc + h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return np.unique(mixed(acc))


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS values of 16 bits: leading zeros plus one, then mantissa; 0 for an empty bucket."""
    bits = 64 - int(REGISTERS).bit_length() + 1
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(bits)
    at = np.searchsorted(hashes, starts)
    out = np.zeros(REGISTERS, np.uint16)
    least = np.append(hashes, np.uint64(0))[at]
    full = (at < len(hashes)) & ((least >> np.uint64(bits)) == np.arange(REGISTERS, dtype=np.uint64))
    rest = (least & np.uint64((1 << bits) - 1))[full]
    length = np.frexp((rest >> np.uint64(4)).astype(np.float64))[1] + 4
    length = np.maximum(length, MANTISSA + 1)
    mantissa = (rest >> (length - MANTISSA - 1).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[full] = ((bits - length + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def rows_of_band(percent: int) -> int:
    """The most registers a band can have so that a pair at the limit shares one, but for a chance of MISSED."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED)


_BEFORE = np.argsort(np.argsort(mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), 1), 1).astype(np.uint16)


def borrowed(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty ones have the value of the full one that comes first in their order."""
    full, none = np.flatnonzero(regs), np.flatnonzero(regs == 0)
    out = regs.copy()
    if len(full) and len(none):
        out[none] = regs[full[_BEFORE[np.ix_(none, full)].argmin(1)]]
    return out


def near_enough(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate from registers (last axis) is within SLACK standard errors of the limit."""
    agree = ((a == b) & (a > 0)).sum(-1)
    union = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    estimate = (agree / union - CHANCE) / (1 - CHANCE)
    t = percent / 100
    return estimate >= t - SLACK * np.sqrt(t * (1 - t) / union) - 1e-3


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the set, null if empty), regs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for (text,) in arrow_rows([part], "text"):
                    h = shingles(text)
                    rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, registers(h).tobytes() if len(h) else None))
                n, key, regs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "regs": pa.array(regs, pa.binary())})

    return text_of(docs).mapInArrow(sketch, "doc_id long, n_shingles long, key binary, regs binary")


def _bands(nodes: DataFrame, rows: int) -> DataFrame:
    """bucket, node for every band of every node."""
    bands = REGISTERS // rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            parts = np.array([borrowed(r) for r in regs], np.uint16).reshape(-1, REGISTERS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(number, parts.shape[:2]).copy()
            for k in range(rows):
                key = mixed(key + parts[:, :, k])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.ravel().view(np.int64)), "node": pa.array(np.repeat(batch["node"].to_numpy(), bands))})

    return nodes.select("node", "regs").mapInArrow(cut, "bucket long, node long")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sizes allow a link and whose registers come within reach of the limit."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (x, y))
        return pd.Series(near_enough(u, v, percent))

    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("regs").alias(f"r{end}"), F.col("n_shingles").alias(f"n{end}")), end)
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.where(sizes).where(near("ra", "rb")).select("a", "b")


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, full (the sorted hashes of its set) for wanted nodes with their key and doc_id; written."""
    wanted = wanted.select("node", "key", "doc_id")
    texts = text_of(docs).join(F.broadcast(wanted) if wanted.count() <= FEW_NODES else wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            nodes, full = [], []
            for node, key, text in arrow_rows([part], "node", "key", "text"):
                h = shingles(text)
                if xxhash.xxh3_128_digest(h.tobytes()) == key:  # a repeated doc_id may have other texts too
                    nodes.append(node)
                    full.append(h.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "full": pa.array(full, pa.binary())})

    return written(texts.select("node", "key", "text").mapInArrow(sets, "node long, full binary").dropDuplicates(["node"]), "sets")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are linked by their full sets."""
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    full = _sets(ends.join(nodes, "node"), docs)

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), percent) for u, v in zip(x, y, strict=True)], dtype=bool)

    for end in "ab":
        pairs = pairs.join(full.select(F.col("node").alias(end), F.col("full").alias(f"f{end}")), end)
    with small_batches(docs.sparkSession):  # a row has two full sets
        out = written(pairs.where(check("fa", "fb")).select("a", "b"), "links")
    remove(full)
    return out


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (bucket, node, label) once for each pair of blocks p, q of their bucket that they take part in."""
    rows = rows.join(sizes.select("bucket", "parts"), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("bucket", "node", "label", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def _sized(rows: DataFrame) -> DataFrame:
    """bucket, parts (number of blocks) of the buckets whose rows have several labels."""
    sizes = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("whole"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") * 8 / BLOCK_BYTES)).cast("int")
    # of buckets with the same nodes one is enough
    return sizes.where("lo < hi").groupBy("n", "m", "whole").agg(F.min("bucket").alias("bucket")).select("bucket", parts.alias("parts"))


def _left_over(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links a, b that join further labels of nodes that meet in a bucket; its least node has been compared already."""
    known = members.where("node <> least").join(labels, "node", "left").join(nodes.select("node", "n_shingles"), "node")
    known = written(known.select("bucket", "node", "n_shingles", F.coalesce("label", "node").alias("label")), "known")
    sizes = written(_sized(known), "sizes")
    kind = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def sides(t: pa.Table) -> tuple:
        own = t["own"].to_numpy()
        left, right = np.flatnonzero(own == t["p"][0].as_py()), np.flatnonzero(own == t["q"][0].as_py())
        return t["node"].to_numpy(), t["label"].to_numpy().copy(), t["n_shingles"].to_numpy(), left, right, np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)

    def partners(k: int, right: np.ndarray, root: np.ndarray, size: np.ndarray, regs: np.ndarray) -> np.ndarray:
        ratio = np.minimum(size[right], size[k]) * 100 >= np.maximum(size[right], size[k]) * percent
        others = right[(root[right] != root[k]) & ratio]
        return others[near_enough(regs[others], regs[k], percent)]

    def reach(t: pa.Table) -> pa.Table:
        """The nodes of a pair of blocks that come within reach of one of another label."""
        node, root, size, left, right, regs = sides(t)
        found = np.zeros(len(node), bool)
        for k in left:
            others = partners(k, right, root, size, regs)
            found[others] = True
            found[k] |= len(others) > 0
        at = np.flatnonzero(found)
        return pa.table([pa.array(np.full(len(at), t["bucket"][0].as_py(), np.int64)), pa.array(node[at])], schema=kind)

    def compare(t: pa.Table) -> pa.Table:
        node, root, size, left, right, regs = sides(t)
        sets = [np.frombuffer(x, np.uint64) for x in t["full"].to_pylist()]
        links = []
        for k in left:
            for o in partners(k, right, root, size, regs):
                if root[o] != root[k] and linked(sets[k], sets[o], percent):
                    links.append((node[k], node[o]))
                    root[root == root[o]] = root[k]
        return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("ab")})

    with_regs = lambda rows: rows.join(nodes.select("node", "regs", "n_shingles"), "node")
    near = with_regs(_blocks(known, sizes)).groupBy("bucket", "p", "q").applyInArrow(reach, "bucket long, node long")
    near = written(known.join(near.distinct(), ["bucket", "node"], "left_semi"), "near")
    full = _sets(near.select("node").distinct().join(nodes, "node"), docs)
    rows = with_regs(_blocks(near, _sized(near))).join(full, "node")
    out = written(rows.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long").distinct(), "links")
    for table in (known, sizes, near, full):
        remove(table)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id is component_id)."""
    base = written(sketches(docs), "sketches")
    nodes = base.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n_shingles"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # ids are fixed once written
    bands = _bands(nodes, rows_of_band(percent))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least")
    members = written(bands.join(shared, "bucket"), "members")
    stars = members.where("node <> least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    stars = written(stars, "stars")
    most = stars.groupBy("b").agg(F.max_by("a", F.struct("bands", "a")).alias("a")).select("a", "b")
    links = _verified(written(_close(most, nodes, percent), "pairs"), docs, nodes, percent)
    labels = written(components(links), "labels")
    label = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    apart = stars.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    for find in (lambda: _verified(written(_close(apart, nodes, percent), "pairs"), docs, nodes, percent), lambda: _left_over(members, labels, nodes, docs, percent)):
        more = find()
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(components(links), "labels")
    remove(members)
    remove(stars)
    found = nodes.select("key", "doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = found.join(least, "label").select("key", "component_id")
    out = base.join(classes, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
