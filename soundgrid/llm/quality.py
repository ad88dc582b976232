"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are unigrams and bigrams of the lower-cased words, and unigrams to trigrams of the words' shapes (case, digits,
punctuation, and whether a word repeats one of the two before it), each hashed into ``BUCKETS`` weights. A group of
n-grams has the weight 1 in all, so that a score is a sparse dot product of relative frequencies, whatever the length.

The model is fitted on a bounded sample: the ``max_train`` labelled rows with the smallest hash of their doc_id, dealt
over ``SHARDS`` groups that are trained apart and averaged. Scoring covers all rows. A text that is null or has no words
gets the score of the bias alone. A label that is null is ignored; of several labels for one doc_id the least counts; a
doc_id with several texts is trained on the least of them. With no labels all scores are 0.5. Other columns stay as
they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, mixed

BUCKETS = 1 << 18
SHARDS = 8
_RUN = re.compile(r"([A-Z]+)|([a-zß-öø-ÿ]+)|([0-9]+)|([^\W\d_]+)")


class Shapes(dict):
    """word -> hash of its shape, such as Aa. or A!! or 0"""

    def __missing__(self, word: str) -> int:
        import xxhash

        shape = _RUN.sub(lambda m: "Aa0a"[m.lastindex - 1], word)[:12]
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass"), 7)
        return h


_WORDS, _SHAPES = WordHashes(), Shapes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights in a text; a bucket may come several times."""
    words = WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = len(words)
    w = _WORDS.of(list(map(str.lower, words)))
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, n)
    again = np.zeros(n, np.uint64)
    again[1:] |= (w[1:] == w[:-1]).astype(np.uint64)
    again[2:] |= (w[2:] == w[:-2]).astype(np.uint64)
    s = s + again * np.uint64(0x9E3779B97F4A7C15)
    grams = [w, w[:-1] * np.uint64(3) + w[1:], s, s[:-1] * np.uint64(5) + s[1:], s[:-2] * np.uint64(25) + s[1:-1] * np.uint64(5) + s[2:]]
    ids = [mixed(g + np.uint64(k)) % np.uint64(BUCKETS) for k, g in enumerate(grams)]
    return np.concatenate(ids).astype(np.int64), np.concatenate([np.full(len(g), 1 / max(len(g), 1), np.float32) for g in grams])


def ftrl(texts: list[str | None], y: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights; the last is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rows = []
    for t in texts:
        ids, x = features(t)
        ids, inverse = np.unique(ids, return_inverse=True)
        rows.append((np.append(ids, BUCKETS), np.append(np.bincount(inverse, x, len(ids)), 1.0)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y[k]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id's decimal text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id).__mod__(4) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 8_000) -> np.ndarray:
    """Weights learned from the labelled rows that are not held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("string")))
    chosen = chosen.groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # bounded by max_train rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        w = ftrl([t if isinstance(t, str) else None for t in pdf.text], pdf.y.to_numpy(np.float64))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], 1.0)})

    parts = rows.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).alias("shard")).applyInPandas(train, "at long, w double")
    mean = parts.groupBy("at").agg(F.sum("w").alias("w")).toPandas()  # at most BUCKETS + 2 rows
    out = np.zeros(BUCKETS + 1)
    if len(mean):
        shards = float(mean.w[mean["at"] == -1].sum())
        own = mean[mean["at"] >= 0]
        out[own["at"].to_numpy()] = own.w.to_numpy() / shards
    return out


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 as a further column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in texts:
            out = np.empty(len(batch))
            for k, text in enumerate(batch):
                ids, x = features(text)
                out[k] = w[ids] @ x + w[-1]
            yield pd.Series(1 / (1 + np.exp(-out)))

    return docs.withColumn(name, score("text"))
