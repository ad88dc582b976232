"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A string of ``WINDOW`` bytes that also starts anywhere else is repeated; all bytes that repeated strings cover go.

1. Each window start is given the least hash of the ``GRAM``-byte grams in its window as its anchor (the first on ties).
   Equal windows have the same gram at the same distance, so only anchors whose gram occurs twice can matter; the others
   are dropped by a count over all documents. An anchor's context is the text that its windows cover. Contexts that
   occur twice are repeated in full. Of the others one representative each goes on, if its gram has several contexts.
2. The contexts of a gram meet in a bucket of about ``BUCKET`` bytes. Windows whose distances to the gram lie in one
   class (``WIDTH`` distances) have a core in common, so only the classes whose core another context of the gram has too
   are left. They make shards; each shard gets its Burrows-Wheeler transform, and the transforms are merged by interleave
   refinement: a step takes the rows of all shards in their order by the first h bytes, goes back h rows' symbols with
   the transforms, and puts the rows arrived at in order by their own blocks, stably, which orders them by 2h bytes. Rows
   whose first bytes are still equal form blocks; the step at which neighbours part bounds their common prefix. Rows
   alone in a block need no more steps. After WINDOW bytes the blocks left are the repeated intervals.
3. Contexts of grams with more than ``HOT`` of them are cut into narrow classes first (``NARROW`` distances), each of
   which meets the contexts of its core only; equal cuts are counted and one of them goes on.

A null or empty text has no bytes. Repeated rows are documents of their own, so their strings are repeated; null ids are
kept. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mixed, remove, text_of, written

WINDOW, GRAM = 200, 32
BUCKET, SHARD, HOT = 2 << 20, 256 << 10, 4096
WIDTH, NARROW = 43, 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def anchors(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, place and gram hash of each anchor of a text's bytes."""
    if len(body) < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    h, power, m = _BYTES[body], _BASE, 1
    while m < GRAM:
        h = h[:-m] * power + h[m:]
        power, m = power * power, 2 * m
    h = mixed(h)
    width = WINDOW - GRAM + 1
    bits = np.uint64(max(1, len(h).bit_length()))
    keys = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    padded = np.append(keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    n = len(body) - WINDOW + 1
    at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n) - 1
    return first, last, at[first], h[at[first]].view(np.int64)


def _batch(kind: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _body(text: str) -> tuple[bytes, np.ndarray]:
    raw = text.encode("utf-8")
    return raw, np.frombuffer(raw, np.uint8)


def occurrences(docs: DataFrame) -> DataFrame:
    """row, first, span (last - first), off (place of the gram from first), gram, context (its hash) of every anchor."""
    kind = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("span", pa.int16()), ("off", pa.int16()), ("gram", pa.int64()), ("context", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row, text in arrow_rows(batches, "row", "text"):
            raw, body = _body(text)
            first, last, at, gram = anchors(body)
            context = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
            held.append((np.full(len(first), row, np.int64), first, last - first, at - first, gram, np.array(context, np.uint64).view(np.int64)))
            if len(held) == 256:
                yield _batch(kind, [np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
        if held:
            yield _batch(kind, [np.concatenate(c) for c in zip(*held, strict=True)])

    return docs.select("row", "text").mapInArrow(find, "row long, first int, span short, off short, gram long, context long")


def _sorted_with_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and where each stood, stably; a key and a place fit in 63 bits together."""
    bits = max(1, len(keys).bit_length())
    both = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    return both >> bits, both & ((1 << bits) - 1)


def transform(shard: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes of texts with an end mark (0) each by WINDOW bytes at least, the symbol before each, and the row of the suffix that begins with it."""
    s = np.frombuffer(b"".join(bytes(x) + b"\xff" for x in shard), np.uint8) + np.uint8(1)  # the end mark 0xff, never in UTF-8, becomes 0
    n, step = len(s), 4
    ahead = np.append(s, np.zeros(step, np.uint8))
    rank = np.zeros(n, np.int64)
    for k in range(step):
        rank = rank << 8 | ahead[k : k + n]
    while True:
        found, order = _sorted_with_places(rank)
        parted = np.diff(found, prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(parted) - 1
        if step >= WINDOW or parted.all():
            break
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + following
        step *= 2
    if not parted.all():
        rank[order] = np.arange(n)
    return order, s[order - 1], rank[order - 1]


def repeated(contexts: list[bytes]) -> list[np.ndarray]:
    """For each text, whether the window from each of its starts also starts elsewhere in the texts."""
    shards: list[list[int]] = [[]]
    size = 0
    for k, c in enumerate(contexts):
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(c)
    parts = [transform([contexts[k] for k in x]) for x in shards if x]
    if not parts:
        return []
    sizes = np.array([len(p[0]) for p in parts])
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    before = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=True)])  # one step back
    symbols = np.concatenate([p[1] for p in parts])  # what stands there
    first = np.empty(total, np.uint8)
    first[before] = symbols
    rows, block, h = np.arange(total), np.zeros(total, np.int64), 0
    back = {1: before}
    # the interleave by the first byte; texts' end marks are all different, so suffixes that have reached one are alone
    key, order = _sorted_with_places(first)
    rows, block, h = rows[order], key, 1
    alive = key > 0
    while True:
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = block[1:] != block[:-1]
        shared = np.flatnonzero(alive & ~(new[:-1] & new[1:]))  # a row alone in its block stays alone, as do those that it precedes
        rows, block = rows[shared], (np.cumsum(new[:-1]) - 1)[shared]
        if not len(rows) or h == WINDOW:
            break
        step = min(h, WINDOW - h)
        mine = np.full(total, -1, np.int64)
        mine[rows] = block
        arrived = rows
        for k in sorted(back, reverse=True):
            while step >= k:
                arrived, step = back[k][arrived], step - k
        key = mine[arrived]
        here = np.flatnonzero(key >= 0)
        key, order = _sorted_with_places(key[here])
        order = here[order]
        rows, block = arrived[order], key * (total + 1) + block[order]
        alive = np.ones(len(rows), bool)
        h += min(h, WINDOW - h)
        if 2 * h <= WINDOW and h not in back:
            back[h] = back[h // 2][back[h // 2]]
    flags = np.zeros(total, bool)
    flags[rows] = True
    out: list[np.ndarray] = []
    for (order, _, _), b, members in zip(parts, base, [x for x in shards if x], strict=True):
        at = np.zeros(len(order), bool)
        at[order] = flags[b : b + len(order)]
        place = 0
        for k in members:
            n = len(contexts[k])
            out.append(at[place : place + max(0, n - WINDOW + 1)])
            place += n + 1
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    """Pairs of first and last index of runs that are true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - 1], 1).astype(np.int32)


def _cut(raw: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, removed bytes and spans, for runs of repeated window starts."""
    gone = np.zeros(len(raw) + 1, np.int32)
    for a, b in starts:
        gone[a] += 1
        gone[b + WINDOW] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_runs(gone))


STAGED = "row long, doc_id long, body binary, n_bytes long, n_removed long, n_spans long, starts array<int>, ship array<struct<gram:long,first:int,at:int,own:boolean,body:binary>>"


def _staged(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Documents with what is settled; those with a context of their own to be compared keep their whole body."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row, doc_id, text, found in arrow_rows(batches, "row", "doc_id", "text", "found"):
            raw, starts, ship = text.encode("utf-8"), [], []
            for f in found or ():
                a, b = f["first"], f["first"] + f["span"]
                body = raw[a : b + WINDOW]
                if xxhash.xxh3_64_intdigest(body) != f["context"] % (1 << 64):  # another text with the same 64-bit row
                    continue
                if f["whole"]:
                    starts.append((a, b))
                if f["ship"]:
                    ship.append({"gram": f["gram"], "first": a, "at": f["off"], "own": not f["whole"], "body": body})
            left, n, spans = (raw, 0, 0) if any(x["own"] for x in ship) else _cut(raw, starts)
            rows.append({"row": row, "doc_id": doc_id, "body": left, "n_bytes": len(raw), "n_removed": n, "n_spans": spans, "starts": [v for p in starts for v in p], "ship": ship})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, kind)

    shipped = pa.struct([("gram", pa.int64()), ("first", pa.int32()), ("at", pa.int32()), ("own", pa.bool_()), ("body", pa.binary())])
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int32())), ("ship", pa.list_(shipped))])
    lists = flagged.groupBy("row").agg(F.collect_list(F.struct("first", "span", "off", "gram", "context", "whole", "ship")).alias("found"))
    return written(docs.join(lists, "row", "left").select("row", "doc_id", "text", "found").mapInArrow(settle, STAGED), "bwt-staged")


def classes(at: int, size: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Class, first and last window start, begin and end of the core, for a context of that size with its gram at at."""
    for c in range(-(-(WINDOW - GRAM + 1) // width)):
        near, far = c * width, min((c + 1) * width, WINDOW - GRAM + 1) - 1
        a, b = max(0, at - far), min(size - WINDOW, at - near)
        if a <= b:
            yield c, a, b, at - near, at - far + WINDOW


def _in_buckets(contexts: DataFrame, n: int) -> DataFrame:
    """row, starts: runs of repeated window starts of own contexts that share a key, as a flat array of first and last."""
    kind = pa.schema([("row", pa.int64()), ("starts", pa.list_(pa.int32()))])

    def merge(t: pa.Table) -> pa.Table:
        row, key, first, at, own, body = (t[c].to_pylist() for c in ("row", "key", "first", "at", "own", "body"))
        cores = [[(a, b, (g, c, x[lo:hi])) for c, a, b, lo, hi in classes(p, len(x), WIDTH)] for g, p, x in zip(key, at, body, strict=True)]
        seen = Counter(core for these in cores for _, _, core in these)
        kept: list[tuple[int, int, bytes]] = []
        for k, these in enumerate(cores):
            runs: list[list[int]] = []
            for a, b, core in sorted(these):
                if seen[core] > 1:
                    if runs and runs[-1][1] + 1 == a:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b])
            kept += [(k, a, body[k][a : b + WINDOW]) for a, b in runs]
        out_rows, out_starts = [], []
        for (k, a, _), flags in zip(kept, repeated([x for _, _, x in kept]), strict=True):
            if own[k] and flags.any():
                out_rows.append(row[k])
                out_starts.append((_runs(flags) + first[k] + a).ravel().tolist())
        return pa.table([pa.array(out_rows, pa.int64()), pa.array(out_starts, pa.list_(pa.int32()))], schema=kind)

    bucket = F.pmod(F.xxhash64("key"), F.lit(n))
    return contexts.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(merge, "row long, starts array<int>")


def _narrowed(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts of grams with very many as cuts of narrow classes that meet by their core; row, starts of cuts that occur twice."""
    kind = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("span", pa.int32()), ("at", pa.int32()), ("own", pa.bool_()), ("key", pa.int64()), ("digest", pa.binary()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                out = []
                for row, gram, first, at, own, body in arrow_rows([batch.slice(begin, 1024)], "row", "key", "first", "at", "own", "body"):
                    for c, a, b, lo, hi in classes(at, len(body), NARROW):
                        part = body[a : b + WINDOW]
                        key = xxhash.xxh3_64_intdigest(gram.to_bytes(8, "little", signed=True) + bytes([c]) + body[lo:hi]) - (1 << 63)
                        out.append((row, first + a, b - a, at - a, own, key, xxhash.xxh3_128_digest(bytes([c]) + part), part))
                yield _batch(kind, list(zip(*out, strict=True)) if out else [[]] * len(kind))

    each = written(contexts.mapInArrow(cut, "row long, first int, span int, at int, own boolean, key long, digest binary, body binary"), "bwt-cuts")
    equal = each.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first")).alias("lead"))
    several = equal.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("key", F.lit(True).alias("several"))
    equal = written(equal.join(several, "key", "left").where("several or n > 1"), "bwt-equal")
    each = each.join(equal, ["key", "digest"])
    twice = each.where("own and n > 1").select("row", F.array("first", F.col("first") + F.col("span")).alias("starts"))
    ship = each.where(F.col("several").isNotNull() & (F.struct("row", "first") == F.col("lead")))
    return ship.select("row", "key", "first", "at", (F.col("own") & (F.col("n") == 1)).alias("own"), "body"), twice


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, body (bytes that stay), n_bytes, n_removed, n_spans."""
    docs = text_of(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    every = written(occurrences(docs), "bwt-occurrences")
    twice = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    found = written(every.join(written(twice, "bwt-grams"), "gram"), "bwt-anchors")  # in a table, so that Spark can split a hot gram
    remove(every)
    each = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first")).alias("lead"))
    several = each.groupBy("gram").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a < b").select("gram", F.lit(True).alias("several"))
    each = each.join(several, "gram", "left").where("several or n > 1")
    flagged = found.join(each, ["gram", "context"]).select(
        "row", "first", "span", "off", "gram", "context", (F.col("n") > 1).alias("whole"),
        (F.col("several").isNotNull() & (F.struct("row", "first") == F.col("lead"))).alias("ship"),
    ).where("whole or ship")
    staged = _staged(docs, flagged)
    contexts = staged.select("row", F.explode("ship").alias("s")).select("row", F.col("s.gram").alias("key"), "s.first", "s.at", "s.own", "s.body")
    hot = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "bwt-hot")
    cuts, starts = _narrowed(contexts.join(hot, "key", "left_semi"))
    meeting = contexts.join(hot, "key", "left_anti").unionByName(cuts)
    total = meeting.agg(F.sum(F.length("body")).alias("n")).first().n or 0
    starts = starts.unionByName(_in_buckets(meeting, int(total // BUCKET) + 1))
    starts = starts.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, raw, old, more in arrow_rows(batches, "doc_id", "body", "starts", "more"):
            pairs = (old or []) + (more or [])
            left, n, spans = _cut(raw, list(zip(pairs[::2], pairs[1::2], strict=True)))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "body": pa.array([left], pa.binary()), "n_bytes": [len(raw)], "n_removed": [n], "n_spans": [spans]})

    pending = F.exists("ship", lambda s: s.own)
    done = staged.where(~pending).select("doc_id", "body", "n_bytes", "n_removed", "n_spans")
    rest = staged.where(pending).select("row", "doc_id", "body", "starts").join(starts, "row", "left")
    return done.unionByName(rest.mapInArrow(finish, "doc_id long, body binary, n_bytes long, n_removed long, n_spans long"))
