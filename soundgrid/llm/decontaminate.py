"""Benchmark decontamination by latent semantic retrieval.

Passages are blocks of ``PASSAGE`` words of the documents; their terms are the benchmark's words, weighted by tf-idf over
all passages of the corpus. A distributed randomised SVD (one pass A'AW over all passages, then a small decomposition on
the driver, bounded by the benchmark's vocabulary times ``RANK``) gives latent directions. Every document is then searched
in overlapping windows sized to the items. A stretch of the text is searched for the items of which it has ``likely`` of
the words, in any order (no window of the others can hold theirs). Of those, windows whose cosine with the item reaches
``least_cosine`` are candidates, and so is, whatever its cosine, each window that itself shares ``likely`` of the item's
words, so the projection loses nothing. Word-level longest common subsequences decide: an item is contained when the
window holds ``sure`` of its words in order, or ``likely`` of them and ``sure`` of its answer, the last quarter of the
item.

The benchmark is a stated query set and fits on the driver; documents are only ever met in tasks. Words are lower-cased
(A-Z) and lose punctuation at their ends. Null and empty texts and items match nothing. Rows are judged one by one, so
repeated rows and null ids are kept; other columns of the input stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, remove, text_of, written

PASSAGE, RANK = 32, 96
HELD_TERMS = 25_000  # terms whose passages are summed at once; more would not stay in the cache
SEGMENT = 512  # words whose windows are compared with the items' words at once
_ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Vocabulary(dict):
    """word as it stands -> number of its term from 1, or 0; words seen lately are kept."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.terms = {t: k + 1 for k, t in enumerate(terms)}

    def __reduce__(self):
        return Vocabulary, (list(self.terms),)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[word] = self.terms.get(word.strip(_ENDS), 0)
        return k

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def lcs(masks: dict[int, int], n: int, window: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words, given as bit masks by term, and a window."""
    v = full = (1 << n) - 1
    for t in window:
        if m := masks.get(t, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(ids):
        out[t] = out.get(t, 0) | 1 << k
    return out


@dataclass
class Item:
    item_id: int
    ids: list[int]

    def __post_init__(self) -> None:
        self.masks = masks_of(self.ids)
        self.answer = self.ids[-max(1, len(self.ids) // 4) :]
        self.answer_masks = masks_of(self.answer)

    def held_by(self, window: list[int], likely: float, sure: float) -> float:
        """The share of the item's words that the window holds in order, or 0 if that isn't enough."""
        there = set(window)
        if sum(map(there.__contains__, self.ids)) < likely * len(self.ids):  # no subsequence can be longer
            return 0.0
        share = lcs(self.masks, len(self.ids), window) / len(self.ids)
        if share >= sure or share >= likely and lcs(self.answer_masks, len(self.answer), window) / len(self.answer) >= sure:
            return share
        return 0.0


@dataclass
class Model:
    vocabulary: Vocabulary
    items: list[Item]
    vectors: np.ndarray  # terms (0: none) x RANK, weighted

    def __post_init__(self) -> None:
        self.informative = np.abs(self.vectors).sum(1) > 0
        latent = np.array([self.vectors[x.ids].sum(0) for x in self.items]).reshape(-1, self.vectors.shape[1])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.groups: dict[int, list[int]] = {}  # items by window length: the least 15 * 2**k that holds them
        for k, x in enumerate(self.items):
            size = 15
            while size < len(x.ids):
                size *= 2
            self.groups.setdefault(size, []).append(k)
        self.size_of = {k: size for size, members in self.groups.items() for k in members}
        own = [np.unique(x.ids, return_counts=True) for x in self.items]  # each item's terms, and how often it has them
        self.item_terms, self.item_counts = (np.concatenate([np.empty(0, np.int64), *(x[c] for x in own)]).astype(np.int64) for c in (0, 1))
        self.item_starts = np.cumsum([0] + [len(x[0]) for x in own])
        self.lengths = np.array([len(x.ids) for x in self.items], np.int64)

    def windows(self, size: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the windows for items of up to that many words."""
        starts = np.arange(0, max(1, n_words - size + size // 3), size // 3)
        return starts, np.minimum(starts + size + size // 3, n_words)

    def candidates(self, ids: np.ndarray, least_cosine: float, likely: float, by_words: bool = True) -> Iterator[tuple[int, int, int]]:
        """Item, start and end of the windows to be compared, stretch by stretch: by cosine first, then by shared words."""
        if not len(ids) or not self.items:
            return
        longest = max(self.groups)
        longest += longest // 3
        step = max(SEGMENT, 2 * longest)
        windows = {size: self.windows(size, len(ids)) for size in self.groups}
        for s in range(0, len(ids), step):
            part = ids[s : s + step + longest]
            there = np.bincount(part, minlength=len(self.vectors))
            most = np.add.reduceat(np.minimum(there[self.item_terms], self.item_counts), self.item_starts[:-1])
            possible = np.flatnonzero(most >= self.lengths * likely - 1e-9)
            if not len(possible):
                continue
            at = np.flatnonzero(self.informative[part])
            sums = np.zeros((len(at) + 1, self.vectors.shape[1]), np.float32)
            np.cumsum(self.vectors[part[at]], axis=0, out=sums[1:])
            here = {}
            for k in possible.tolist():
                starts, ends = windows[self.size_of[k]]
                lo, hi = np.searchsorted(starts, (s, s + step))
                here[k] = starts[lo:hi], ends[lo:hi]
                a, b = (np.searchsorted(at, x - s) for x in here[k])
                v = sums[b] - sums[a]
                cosine = (v @ self.latent[k]) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
                yield from ((k, here[k][0][w], here[k][1][w]) for w in np.flatnonzero(cosine >= least_cosine))
            for k, (starts, ends) in here.items() if by_words else ():
                terms, counts = (x[self.item_starts[k] : self.item_starts[k + 1]] for x in (self.item_terms, self.item_counts))
                near = np.minimum(np.searchsorted(terms, part), len(terms) - 1)
                at = np.flatnonzero(terms[near] == part)
                sums = np.zeros((len(at) + 1, len(terms)), np.int32)
                sums[np.arange(1, len(at) + 1), near[at]] = 1
                np.cumsum(sums, axis=0, out=sums)
                held = sums[np.searchsorted(at, ends - s)] - sums[np.searchsorted(at, starts - s)]
                for w in np.flatnonzero(np.minimum(held, counts).sum(1) >= self.lengths[k] * likely - 1e-9):
                    yield k, starts[w], ends[w]

    def search(self, ids: np.ndarray, least_cosine: float, likely: float, sure: float) -> dict[int, float]:
        """item_id -> share of its words, for the items that the text of these terms holds."""
        found: dict[int, float] = {}
        seen: set[tuple[int, int, int]] = set()
        for candidate in self.candidates(ids, least_cosine, likely):
            item = self.items[candidate[0]]
            if candidate not in seen and found.get(item.item_id, 0) < 1:
                seen.add(candidate)
                _, a, b = candidate
                if share := item.held_by(ids[a:b].tolist(), likely, sure):
                    found[item.item_id] = max(share, found.get(item.item_id, 0))
        return found


def _passages(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a document and the passage each stands in."""
    at = np.flatnonzero(ids)
    return ids[at], at // PASSAGE


def _document_frequencies(table: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_terms + 1, np.int64), 0
        for (raw,) in arrow_rows(batches, "ids"):
            ids = np.frombuffer(raw, np.int32)
            terms, where = _passages(ids)
            df += np.bincount(np.unique(where * (n_terms + 1) + terms) % (n_terms + 1), minlength=n_terms + 1)
            n += -(-len(ids) // PASSAGE)
        df[0] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(df[at], pa.int64())})

    rows = table.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n_terms + 1, np.int64)
    df[rows.term.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return df, int(df[0])


def _range(table: DataFrame, weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A'A start, where A holds the weighted terms of all passages."""
    n, k = start.shape
    shared = table.sparkSession.sparkContext.broadcast((weights.astype(np.float32), (start * weights[:, None]).astype(np.float32)))
    small = np.uint16 if n <= 1 << 16 else np.int64  # sorted in linear time if it fits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rows = shared.value
        out = np.zeros((n, k))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = base = 0

        def add() -> None:
            terms, where = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            keep = w[terms] > 0
            terms, where = terms[keep], where[keep]
            if not len(terms):
                return
            first = np.flatnonzero(np.diff(where, prepend=-1))
            y = np.add.reduceat(rows[terms], first, axis=0)
            passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
            order = np.argsort(terms.astype(small), kind="stable")
            sorted_terms = terms[order]
            starts = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
            at = sorted_terms[starts]
            out[at] += w[at][:, None] * np.add.reduceat(y[passage[order]], starts, axis=0)

        for (raw,) in arrow_rows(batches, "ids"):
            ids = np.frombuffer(raw, np.int32)
            terms, where = _passages(ids)
            held.append((terms, where + base))
            base += len(ids) // PASSAGE + 1
            size += len(terms)
            if size > HELD_TERMS:
                add()
                held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64())} | {f"g{c}": pa.array(out[at, c]) for c in range(k)})

    parts = table.select("ids").mapInArrow(gather, "term long, " + ", ".join(f"g{c} double" for c in range(k)))
    rows = parts.groupBy("term").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(k)]).toPandas()
    out = np.zeros((n, k))
    out[rows.term.to_numpy(np.int64)] = rows[[f"g{c}" for c in range(k)]].to_numpy()
    return out


def _items(benchmark: DataFrame) -> tuple[Vocabulary, list[Item]]:
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").collect()
    words = [(r.item_id, [w.strip(_ENDS) for w in r.text.encode("utf-8").lower().split()]) for r in rows]
    vocabulary = Vocabulary(sorted({w for _, ws in words for w in ws if w}))
    return vocabulary, [Item(i, ids) for i, ws in words if (ids := [vocabulary[w] for w in ws if w])]


def terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (4-byte term numbers) of every row; written."""
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array([vocabulary.of(t).tobytes() for (t,) in arrow_rows([part], "text")], pa.binary())})

    return written(text_of(docs).mapInArrow(tokenise, "doc_id long, ids binary"), "terms")


def fit(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, seed: int = 0) -> Model:
    """Vocabulary, items and latent vectors; the weights and the SVD come from all documents."""
    vocabulary, items = _items(benchmark)
    table = terms(docs, vocabulary)
    model = _fit(table, vocabulary, items, rank, seed)
    remove(table)
    return model


def _fit(table: DataFrame, vocabulary: Vocabulary, items: list[Item], rank: int, seed: int) -> Model:
    n = len(vocabulary.terms)
    df, passages = _document_frequencies(table, n)
    weights = np.log1p(max(passages, 1) / np.maximum(df, 1))  # positive, however common a term is
    weights[0] = 0
    rank = min(rank, max(1, n))
    start = np.random.default_rng(seed).standard_normal((n + 1, rank))
    image = _range(table, weights, start)
    small = start.T @ image  # start' A'A start, so image (small)^-1 image' approximates A'A
    values, turns = np.linalg.eigh((small + small.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-12)
    if not good.any():
        return Model(vocabulary, items, np.zeros((n + 1, 1), np.float32))
    basis, sigma, _ = np.linalg.svd(image @ (turns[:, good] / np.sqrt(values[good])), full_matrices=False)
    # coordinates are divided by the singular values, else the languages' directions outweigh all others
    return Model(vocabulary, items, (weights[:, None] * basis / sigma).astype(np.float32))


def scan(docs: DataFrame, model: Model, least_cosine: float = 0.5, likely: float = 0.6, sure: float = 0.8) -> DataFrame:
    """docs with ``items``, an array of (item_id, share) of the benchmark items each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(HITS)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in texts:
            yield pd.Series([_hits(m.search(m.vocabulary.of(t or ""), least_cosine, likely, sure)) for t in batch])

    return docs.withColumn("items", search("text"))


HITS = "array<struct<item_id:long,share:double>>"


def _hits(found: dict[int, float]) -> list[dict]:
    return [{"item_id": i, "share": s} for i, s in sorted(found.items())]


def fit_and_scan(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.5, likely: float = 0.6, sure: float = 0.8, rank: int = RANK, seed: int = 0) -> DataFrame:
    """doc_id, items of every row of docs; the texts are turned into terms once, for the model and for the search."""
    vocabulary, items = _items(benchmark)
    table = terms(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(_fit(table, vocabulary, items, rank, seed))

    @F.pandas_udf(HITS)
    def search(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in rows:
            yield pd.Series([_hits(m.search(np.frombuffer(raw, np.int32), least_cosine, likely, sure)) for raw in batch])

    return table.select("doc_id", search("ids").alias("items"))
