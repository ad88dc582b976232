"""Language identification by string kernels.

The kernel is the blended spectrum of presence: of two texts, the number of distinct n-grams of ``ORDERS`` code points
that both have, over the root of the product of what each has with itself. N-grams are taken of the whole text, lower-
cased, with each run of other characters than letters made one blank and a blank at both ends; the blank itself is none, and
those count that the landmarks have in common (``Space``). Landmarks are training texts. Nyström's map turns kernel values against them into
features, and kernel ridge regression of each language against the rest is solved on these; the normal equations are
summed over tasks. Features, map and weights are linear in the n-grams that a text has, so a batch of texts is scored by
one sparse matrix product with the weights of all n-grams for all languages.

Fitted on a bounded sample: at most ``max_train`` texts, as many for each of the ``max_langs`` most frequent languages,
the ones with the least hash of doc_id that are no longer than ``LONG`` characters (or the shortest, should a language
have too few), and ``landmarks`` of them. Rows with a null doc_id, text or lang, or without a letter, aren't learned
from, nor are held-out ones; of several texts for one doc_id and lang the least counts. Scoring covers all rows, whatever
their length. A text that is null or has no letter gets ``und`` and the score 0, as do all texts if nothing was learned.
A text none of whose n-grams is known gets the most frequent language, at one over their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, remove, written
from .quality import held_out

ORDERS = 4
#: N-grams that are told apart at most, slots of the table that finds them, code points handled at once.
GRAMS, SLOT_BITS, AT_ONCE = 65_536, 20, 1 << 18
LONG, SHARDS, PARTS = 20_000, 8, 64
RIDGE, SHARPNESS = 1e-4, 6.0
UNKNOWN = "und"
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    """Code point -> lower case of a letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def codes(text: str | None) -> np.ndarray:
    """Letters and single blanks of a text between blanks; empty without a letter."""
    out = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.concatenate(([np.uint32(32)], out, [np.uint32(32)]))
    out = out[np.append(True, (out[1:] != 32) | (out[:-1] != 32))]
    return out if len(out) > 2 else out[:0]


def grams(own: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's n-grams but for the blank, piece by piece; with repeats."""
    for at in range(0, max(0, len(own) - 1), AT_ONCE):
        piece = own[at : at + AT_ONCE + ORDERS - 1].astype(np.uint64)
        h = np.zeros(len(piece) + 1, np.uint64)
        for n in range(min(ORDERS, len(piece))):
            h = (h[:-1] + piece[n:] + np.uint64(1)) * _STEP
            h ^= h >> np.uint64(29)
            yield h[:AT_ONCE] if n else h[:AT_ONCE][piece[:AT_ONCE] != 32]


def distinct(text: str | None) -> np.ndarray:
    found = list(grams(codes(text)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Space:
    """The n-grams that count, by number."""

    def __init__(self, sets: list[np.ndarray]):
        """Those that most of the sets have, at least two if any are in two; of n-grams that share a slot the first."""
        every, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        every, n = (every[n > 1], n[n > 1]) if (n > 1).any() else (every, n)
        every = every[np.lexsort((every, -n))][:GRAMS]
        every = every[np.sort(np.unique(self.slots(every), return_index=True)[1])]
        self.size = len(every)
        self.keys = np.append(every, np.uint64(0))
        self.table = np.full(1 << SLOT_BITS, self.size, np.int32)
        self.table[self.slots(every)] = np.arange(self.size)
        self.seen = np.zeros(self.size + 1, bool)

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return (h * _SPREAD) >> np.uint64(64 - SLOT_BITS)

    def present(self, pieces: Iterator[np.ndarray]) -> np.ndarray:
        """Numbers of the n-grams that are there, in rising order."""
        seen = self.seen
        for h in pieces:
            at = self.table[self.slots(h)]
            seen[at[self.keys[at] == h]] = True
        seen[self.size] = False
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


@dataclass
class Model:
    langs: list[str]
    space: Space
    weights: np.ndarray  # n-gram by language

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Text by language: the batch's presence matrix, sparse, times the weights; nan without a letter."""
        out, own, sizes = np.full((len(texts), len(self.langs)), np.nan), [], []
        for text in texts:
            c = codes(text)
            sizes.append(-1 if not len(c) else len(at := self.space.present(grams(c))))
            if sizes[-1] > 0:
                own.append(at)
        n = np.array(sizes)
        out[n == 0] = 0
        if own:
            filled = n[n > 0]
            out[n > 0] = np.add.reduceat(self.weights[np.concatenate(own)], np.append(0, np.cumsum(filled)[:-1]), axis=0) / np.sqrt(filled)[:, None]
        return out


def _sample(docs: DataFrame, max_train: int, max_langs: int) -> tuple[list[str], DataFrame]:
    """Languages, the most frequent first, and the texts to learn from: lang, text, rank (within its language)."""
    can = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id").cast("string")) & F.col("text").rlike(r"\p{L}"))
    langs = [r.lang for r in can.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    each = max(1, max_train // max(1, len(langs)))
    order = ["length", F.xxhash64("doc_id"), "doc_id"]
    rows = can.where(F.col("lang").isin(langs)).groupBy("doc_id", "lang").agg(F.min(F.greatest(F.length("text"), F.lit(LONG))).alias("length"))
    for part in ([F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(PARTS))], []):  # the first of each part of a language, then of those the first of all
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *part).orderBy(*order))).where(F.col("rank") <= each)
    rows = rows.drop("length")
    # bounded by max_train rows of three values, and one more for each language
    texts = can.join(F.broadcast(rows), ["doc_id", "lang"]).groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))
    return langs, written(texts, "language-sample")


def fit(docs: DataFrame, max_train: int = 8_000, landmarks: int = 256, max_langs: int = 100) -> Model | None:
    """Learned from text and lang of the documents that aren't held out; None if there are none."""
    spark = docs.sparkSession
    langs, train = _sample(docs, max_train, max_langs)
    if not langs:
        return None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct(t).tobytes() for (t,) in arrow_rows([batch], "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.string()), "grams": pa.array(found, pa.binary())})

    few = train.where(F.col("rank") <= max(1, landmarks // len(langs))).mapInArrow(sets, "doc_id string, grams binary")
    own = [np.frombuffer(r.grams, np.uint64) for r in few.orderBy("doc_id", "grams").collect()]  # the landmarks' n-grams
    space = Space(own)
    marks = np.zeros((space.size, len(own)), np.uint8)
    for k, h in enumerate(own):
        marks[space.present(iter([h])), k] = 1
    marks = marks[:, marks.any(0)]
    kernel = np.float64(marks.T.astype(np.float32) @ marks.astype(np.float32))
    root = np.sqrt(np.diag(kernel))
    value, vector = np.linalg.eigh(kernel / np.outer(root, root))
    good = value > 1e-8 * value[-1]
    to_features = (vector[:, good] / np.sqrt(value[good])) / root[:, None]  # from counts of shared n-grams, but for the text's own root

    shared = spark.sparkContext.broadcast((space, marks, to_features))
    number = {lang: k for k, lang in enumerate(langs)}

    def normal(pdf: pd.DataFrame) -> pd.DataFrame:
        space, marks, to_features = shared.value
        d, c = to_features.shape[1], len(number)
        a, b = np.zeros((d, d)), np.zeros((d, c))
        pdf = pdf.sort_values(["doc_id", "lang"])
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            found = [space.present(grams(codes(t))) for t in part.text]
            k = np.array([marks[x].sum(0, dtype=np.int32) / np.sqrt(max(1, len(x))) for x in found])
            phi = k @ to_features
            y = np.full((len(part), c), -1.0)
            y[np.arange(len(part)), [number[x] for x in part.lang]] = 1
            a += phi.T @ phi
            b += phi.T @ y
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "a": [a.tobytes()], "b": [b.tobytes()], "n": [len(pdf)]})

    parts = train.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS))).groupBy("shard").applyInPandas(normal, "shard long, a binary, b binary, n long")
    parts = sorted(parts.collect(), key=lambda r: r.shard)  # SHARDS rows of landmarks by landmarks and languages
    remove(train)
    d = to_features.shape[1]
    a = sum(np.frombuffer(r.a).reshape(d, d) for r in parts)
    b = sum(np.frombuffer(r.b).reshape(d, len(langs)) for r in parts)
    solved = to_features @ np.linalg.solve(a + RIDGE * sum(r.n for r in parts) * np.eye(d), b)
    return Model(langs, space, (marks.astype(np.float32) @ solved.astype(np.float32)).astype(np.float32))


def predicted(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and its score (0 to 1) as further columns."""
    if model is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            f = np.concatenate([m.scores(texts[at : at + 256]) for at in range(0, len(texts), 256)]) if texts else np.zeros((0, len(m.langs)))
            none = np.isnan(f[:, 0])
            e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
            yield pd.DataFrame({"lang": names[np.where(none, len(m.langs), np.where(none, 0, f.argmax(1)))], "score": np.where(none, 0.0, e.max(1) / e.sum(1))})

    return docs.withColumn("_guess", guess("text")).withColumns({lang: F.col("_guess.lang"), score: F.col("_guess.score")}).drop("_guess")
