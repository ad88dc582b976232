"""Token-id shards in training order.

Texts become ids, ids become sequences of ``length`` ids (the last of a text padded), and every sequence gets a global
slot by a keyed Feistel permutation of 0..n-1 with cycle-walking. Range partitions of the slots write shards of fixed
stride: sequence s lies in shard s // shard_rows at (s % shard_rows) * length * 2 bytes, so a reader can begin at any
slot. Before the permutation, sequences are numbered in the order in which the table's splits were read, so the order
belongs to the table as it is split, and a table that is dealt otherwise gets another order.

On their way sequences are packed without their padding: first by input task, then by task and shard. A shard is sorted
in one task, which holds one shard at a time.

Null and empty texts give no sequence. Repeated rows and null ids are kept, each row on its own. Other columns of the
input are ignored. A shard is written under a name of the attempt's own and renamed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_rows, mixed, new_path, pack_arrays, remove, unpack_arrays, written

PAD = 49407
ROUNDS = 6
#: Ids, about, of a pack.
PACK_IDS = 4_000_000
#: Input tasks up to which the numbers before them are sent to all tasks; beyond, they are joined.
FEW_TASKS = 100_000


class WordIds(dict):
    """word -> its ids (2-byte little-endian), for the words seen lately: of those before, the ones seen again stay."""

    LIMIT = 300_000

    def __init__(self, path: str):
        super().__init__()
        self.encoder, self.older = bpe.word_encoder(path), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encoder.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2")


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


class Pack:
    """Sequences of some documents: doc_id (and whether it is null), seq, number of ids, and the ids one after the other."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.seqs: list[int] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, seq: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.seqs.append(seq)
        self.ids.append(ids)
        self.size += len(ids)

    def packed(self, *more: bytes) -> bytes:
        ids = np.concatenate(self.ids)
        counts = np.bincount(ids, minlength=1 << 16)
        table = np.flatnonzero(counts)
        table = table[np.argsort(-counts[table], kind="stable")] if 4 * len(table) < len(ids) else np.arange(1 << 16)  # frequent ids become small numbers
        rank = np.zeros(1 << 16, np.uint16)
        rank[table] = np.arange(len(table))
        ids = rank[ids]
        table = table if len(table) < 1 << 16 else table[:0]
        lens = np.array([len(x) for x in self.ids], np.int32)
        none = np.array([d is None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], np.int64)
        return pack_arrays(docs.tobytes(), none.tobytes(), np.array(self.seqs, np.int32).tobytes(), lens.tobytes(), table.astype("<u2").tobytes(), (ids & 0xFF).astype(np.uint8).tobytes(), (ids >> 8).astype(np.uint8).tobytes(), *more)


def unpacked(raw: bytes) -> tuple[list[tuple[int | None, int, np.ndarray]], list[bytes]]:
    """The sequences of a pack as (doc_id, seq, ids), and what else it holds."""
    docs, none, seqs, lens, table, low, high, *more = unpack_arrays(raw)
    ids = np.frombuffer(low, np.uint8).astype("<u2") | np.frombuffer(high, np.uint8).astype("<u2") << 8
    ids = np.frombuffer(table, "<u2")[ids] if table else ids
    doc_ids = [None if n else d for d, n in zip(np.frombuffer(docs, np.int64).tolist(), none, strict=True)]
    parts = np.split(ids, np.cumsum(np.frombuffer(lens, np.int32))[:-1])
    return list(zip(doc_ids, np.frombuffer(seqs, np.int32).tolist(), parts, strict=True)), more


def sequences(docs: DataFrame, path: str, length: int) -> DataFrame:
    """task, first, n, pack: packs of n sequences, the first of which is that number of its input task's."""
    kind = pa.schema([("task", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("pack", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, first, task = _word_ids(path), Pack(), 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            n = len(held.seqs)
            return pa.RecordBatch.from_pydict({"task": [task], "first": [first], "n": [n], "pack": [held.packed()]}, schema=kind)

        for doc_id, text in arrow_rows(batches, "doc_id", "text"):
            ids = words.of(bpe.split_words(text or "", path))
            for k in range(0, len(ids), length):
                held.add(doc_id, k // length, ids[k : k + length])
            if held.size > PACK_IDS:
                yield out()
                first, held = first + len(held.seqs), Pack()
        if held.seqs:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(cut, "task int, first long, n long, pack binary")


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot in 0..n-1 of each number in 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & low)
        out[walk] = (left << np.uint64(half)) | right
        walk = out >= np.uint64(n)  # stays in the domain of 2 * half bits until it falls below n
    return out.astype(np.int64)


def _numbered(packs: DataFrame) -> tuple[DataFrame, int]:
    """packs with before, the number of sequences of earlier input tasks, and the number of all sequences."""
    tasks = written(packs.groupBy("task").agg(F.sum("n").alias("_n")), "tasks")
    size = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.sum("_n").alias("n")).first()
    # one row an input task: the running total stands in one place
    before = tasks.select("task", (F.sum("_n").over(Window.orderBy("task")) - F.col("_n")).alias("before"))
    return packs.join(F.broadcast(before) if size.tasks <= FEW_TASKS else before, "task"), size.n or 0


def materialise(docs: DataFrame, path: str, folder: str | None = None, length: int = 512, shard_rows: int = 8192, key: int = 20260101) -> DataFrame:
    """slot, shard (its file), offset, doc_id, seq, n_tokens, crc32 of every sequence; the shards lie in folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    table = written(sequences(docs, path, length), "sequences")
    numbered, n = _numbered(table)
    shards = max(1, -(-n // shard_rows))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By shard: packs of sequences with their slots."""
        held: dict[int, tuple[Pack, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, (pack, slots) in held.items():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "pack": pa.array([pack.packed(np.array(slots, np.int64).tobytes())], pa.binary())})

        for batch in batches:
            for row in range(batch.num_rows):
                first, count, before, raw = (batch[c][row].as_py() for c in ("first", "n", "before", "pack"))
                slots = feistel(np.arange(before + first, before + first + count), n, key)
                for slot, shard, (doc_id, seq, ids) in zip(slots.tolist(), (slots // shard_rows).tolist(), unpacked(raw)[0], strict=True):
                    pack, places = held.setdefault(shard, (Pack(), []))
                    pack.add(doc_id, seq, ids)
                    places.append(slot)
                    size += len(ids)
                if size > 4 * PACK_IDS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    kind = pa.schema([("slot", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("n_tokens", pa.int32()), ("crc32", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = None, []
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            rows = []
            for raw in packs:
                found, (slots,) = unpacked(raw)
                rows += zip(np.frombuffer(slots, np.int64).tolist(), found, strict=True)
            rows.sort(key=lambda x: x[0])
            name, part = f"shard-{now:08d}.bin", f".{uuid.uuid4().hex}.part"
            index = []
            with fs.open_output_stream(f"{root}/{part}") as out:
                for slot, (doc_id, seq, ids) in rows:
                    raw = ids.tobytes() + np.full(length - len(ids), PAD, "<u2").tobytes()
                    out.write(raw)
                    index.append((slot, f"{folder}/{name}", slot % shard_rows * length * 2, doc_id, seq, len(ids), zlib.crc32(raw)))
            fs.move(f"{root}/{part}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            for shard, raw in zip(batch["shard"].to_pylist(), batch["pack"].to_pylist(), strict=True):
                if shard != now:
                    if packs:
                        yield close()
                    now, packs = shard, []
                packs.append(raw)
        if packs:
            yield close()

    dealt = numbered.mapInArrow(deal, "shard long, pack binary")
    ranges = dealt.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("shard")
    out = written(ranges.mapInArrow(store, "slot long, shard string, offset long, doc_id long, seq int, n_tokens int, crc32 long"), "shard-index")
    remove(table)
    return out


def read_from(folder: str, slot: int, length: int = 512, shard_rows: int = 8192) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order, read one after the other."""
    fs, root = pafs.FileSystem.from_uri(folder)
    shard, skip = divmod(slot, shard_rows)
    while fs.get_file_info(path := f"{root}/shard-{shard:08d}.bin").type == pafs.FileType.File:
        with fs.open_input_file(path) as f:
            f.seek(skip * length * 2)
            while raw := f.read(length * 2):
                yield np.frombuffer(raw, "<u2")
        shard, skip = shard + 1, 0
