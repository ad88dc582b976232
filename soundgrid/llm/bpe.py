"""BPE encoding and decoding over a table of distinct words.

Every text is split into words on Spark, each distinct word is encoded once and turned back into pieces by a join of
its ids with the id-to-piece table, and the results are joined to the words' positions. The most frequent words (no more
than ``hot_words``, so of bounded size) are sent to all tasks; every other word reaches its block of documents by a
join on the word, packed by block. Blocks hold about ``block_chars`` characters, however many documents there are; a
document travels to its block as compressed word numbers.

Null and empty texts give no ids and an empty decoded text. Rows with the same doc_id are encoded one by one. A null
doc_id is kept. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks_for, pack_arrays, text_of, unpack_arrays, written

CHUNK = 200_000  # words placed at once
LONG_WORD = 256  # characters from which a word is decoded by its digest
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
# Up to U+017F all characters are composed, as are their lower cases; other texts go to the tokenizer's own rules.
_PLAIN = re.compile("[\t-\r -~\xa0-\u012f\u0131-\u017f]*")
_CLASS = {k: "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k) for k in "LN"}
_WORD = re.compile(rf"[{_CLASS['L']}]+|[{_CLASS['N']}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_CLASS['L']}{_CLASS['N']}]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def word_encoder(path: str):
    """The tokenizer for words that are normalised already."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.normalizer = None
    t.no_truncation()
    t.no_padding()
    return t


def split_words(text: str, path: str) -> list[str]:
    """The words of a text, lower-cased; a special token is a word of its own."""
    found: list[str] = []
    for part in SPECIAL.split(text) if "<|" in text else (text,):
        if SPECIAL.fullmatch(part):
            found.append(part)
        elif _PLAIN.fullmatch(part):
            found += _WORD.findall(part.lower())
        else:
            t = tokenizer(path)
            norm = t.normalizer.normalize_str(part)
            found += [norm[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(norm)]
    return found


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n: how often each distinct word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for (text,) in arrow_rows(batches, "text"):
            seen.update(split_words(text, path))
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark, path: str) -> DataFrame:
    """id, piece: as many rows as the vocabulary file has entries."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": np.array(list(vocab.values()), np.int32), "piece": list(vocab)}), "id int, piece string")


def decode(encoded: DataFrame, path: str, key: str, ids: str = "ids") -> DataFrame:
    """key, decoded: the pieces of each row's ids, in order, joined by spaces; key must be unique.

    The piece table is broadcast: its size is that of the vocabulary file.
    """
    pieces = F.broadcast(piece_table(encoded.sparkSession, path))
    return _joined(encoded.select(key, F.posexplode_outer(ids).alias("pos", "id")).join(pieces, "id", "left"), key)


def _joined(each: DataFrame, *keys: str) -> DataFrame:
    """keys, decoded: pieces by pos joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return each.groupBy(*keys).agg(F.concat_ws(" ", F.transform(ordered, lambda x: x.piece)).alias("decoded"))


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """word, n, ids, decoded: each distinct word encoded once and decoded through the piece table."""

    @F.pandas_udf("array<int>")
    def encode(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = word_encoder(path)
        for batch in words:
            yield pd.Series([np.array(e.ids, np.int32) for e in t.encode_batch(batch.tolist(), add_special_tokens=False)])

    encoded = word_counts(docs, path).withColumn("ids", encode("word"))
    pieces = F.broadcast(piece_table(docs.sparkSession, path))
    short = F.length("word") <= LONG_WORD
    each = encoded.select("word", "n", "ids", F.posexplode_outer(F.when(short, F.col("ids"))).alias("pos", "id")).join(pieces, "id", "left")
    # grouped by the word that the counts are dealt by already
    table = written(_joined(each, "word", "n", "ids"), "bpe-words")
    long = table.where(~short).drop("decoded").withColumn("key", F.sha2(F.encode("word", "UTF-8"), 256))
    if long.isEmpty():
        return table
    # each piece of these carries a digest, not the word and its ids, whose size would grow with the square of the length
    whole = long.join(decode(long, path, "key"), "key").select(table.columns)
    return table.where(short).unionByName(written(whole, "bpe-long-words"))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest frequency classes (eight an octave) that are no more than ``most`` together."""
    octave = F.floor(F.log2("n") * 8)
    classes = table.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("words")).collect()  # eight rows an octave at most
    left, least = most, 1 << 10
    for c in sorted(classes, reverse=True):
        left -= c.words
        if left < 0:
            break
        least = c.octave
    return table.where(octave >= least)


def _lines(raw: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([raw], pa.binary()).cast(pa.string()), "\n").flatten()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.int32)


def encode(docs: DataFrame, path: str, hot_words: int = 131_072, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every whole text of docs."""
    spark, docs = docs.sparkSession, text_of(docs)
    table = word_table(docs, path)
    hot = frequent(table, hot_words).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    ids = hot["ids"].combine_chunks()
    rank = spark.sparkContext.broadcast({w: k for k, w in enumerate(hot["word"].to_pylist())})
    known = spark.sparkContext.broadcast((np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy(), pa.concat_arrays([pa.array([], pa.string()), *hot["decoded"].chunks])))
    del hot, ids
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks_for(docs, "text", block_chars))).cast("int"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words without a number of each block."""
        seen: dict[int, set[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, words in seen.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(words), pa.int32()), "word": pa.array(words, pa.binary()).cast(pa.string())})

        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["pack"], strict=True):
                if found := unpack_arrays(raw.as_py())[3]:
                    words = seen.setdefault(block, set())
                    size -= len(words)
                    words.update(found.split(b"\n"))
                    size += len(words)
                if size > 300_000:
                    yield from out()
                    seen.clear()
                    size = 0
        yield from out()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: lengths, numbers of the words (low and high bytes apart) and the words without a number."""
        of, n = rank.value.get, len(rank.value)
        held: dict[int, list[tuple]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, rows in held.items():
                codes = np.concatenate([r[1] for r in rows])
                lens = np.array([len(r[1]) for r in rows], np.int64)
                pack = pack_arrays(lens.tobytes(), (codes & 0xFFFF).astype(np.uint16).tobytes(), (codes >> 16).astype(np.uint8).tobytes(), "\n".join([w for r in rows for w in r[2]]).encode())
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "doc_ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), "pack": pa.array([pack], pa.binary())})

        for block, doc_id, text in arrow_rows(batches, "block", "doc_id", "text"):
            words = split_words(text, path)
            codes = np.fromiter(map(of, words, repeat(n)), np.int32, len(words))
            held.setdefault(block, []).append((doc_id, codes, [words[k] for k in np.flatnonzero(codes == n)]))
            size += len(words)
            if size > 3_000_000:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: words with their ids and pieces."""
        held: dict[int, list[tuple]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, rows in held.items():
                lens, flat = _flat([r[1] for r in rows])
                pack = pack_arrays("\n".join([r[0] for r in rows]).encode(), lens.tobytes(), flat.tobytes(), "\n".join([r[2] for r in rows]).encode())
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "pack": pa.array([pack], pa.binary())})

        for block, word, ids, decoded in arrow_rows(batches, "block", "word", "ids", "decoded"):
            held.setdefault(block, []).append((word, ids, decoded))
            size += 1
            if size > 500_000:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids and pieces at the positions of one block's words."""
        lens, flat, texts = known.value
        n, own, texts, parts = len(lens), [pa.array([], pa.string())], [texts], [(lens, flat)]
        for raw in right["pack"].to_pylist():
            words, more, ids, decoded = unpack_arrays(raw)
            own.append(_lines(words))
            texts.append(_lines(decoded))
            parts.append((np.frombuffer(more, np.int64), np.frombuffer(ids, np.int32)))
        lens, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts, own, pieces = np.cumsum(lens) - lens, pa.concat_arrays(own), pa.concat_arrays(texts)
        doc_ids, sizes, values, decoded = [], [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [pa.array([], pa.string())]
        for these, raw in zip(left["doc_ids"].to_pylist(), left["pack"].to_pylist(), strict=True):
            counts, low, high, words = unpack_arrays(raw)
            codes = np.frombuffer(low, np.uint16).astype(np.int32) | np.frombuffer(high, np.uint8).astype(np.int32) << 16
            if words:
                codes[codes == n] = pc.index_in(_lines(words), value_set=own).to_numpy() + n
            doc_ids += these
            ends = np.cumsum(np.frombuffer(counts, np.int64))
            first = np.append(0, ends[:-1])
            for docs_of in np.split(np.arange(len(these)), np.flatnonzero(np.diff(first // CHUNK)) + 1):  # some documents at a time
                a, b = first[docs_of[0]], ends[docs_of[-1]]
                mine = codes[a:b]
                many = lens[mine]
                till = np.append(0, np.cumsum(many))
                values.append(flat[np.repeat(starts[mine] - till[:-1], many) + np.arange(till[-1])])
                bounds = np.append(first[docs_of] - a, b - a)
                sizes.append(sizes[-1][-1] + till[bounds[1:]])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces.take(pa.array(mine)))
                decoded.append(pc.binary_join(lists, " "))
        ids_out = pa.ListArray.from_arrays(pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(values), pa.int32()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids_out, "decoded": pa.chunked_array(decoded)})

    # dealt by block once: the words to look up and the places that they go to come from the same shuffle
    codes = blocked.mapInArrow(coded, "block int, doc_ids array<long>, pack binary").repartition("block")
    needed = codes.mapInArrow(rare, "block int, word string").join(table.select("word", "ids", "decoded"), "word")
    needed = needed.select("block", "word", "ids", "decoded").mapInArrow(packed, "block int, pack binary")
    return codes.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(place, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"))
