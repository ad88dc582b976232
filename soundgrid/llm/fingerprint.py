"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A document is the multiset of its paragraphs (lines), each cut from its start into pieces of at most ``PIECE`` code
points; empty paragraphs count for nothing. A fingerprint is a vector of sums over the pieces:

* the number of pieces,
* ``WIDE`` sums of 32-bit hashes modulo 2**32, which tell multisets apart (256 bits),
* ``PACKED`` sums that each hold three counters of hash bits in 20 bits, modulo 2**60.

Sums don't depend on order, equal texts have equal fingerprints, and pieces are put in or taken out by ``plus`` and
``minus``. ``likeness`` is the cosine of the centred bit counters, from 0 (nothing in common) to 1 (equal fingerprints);
two empty documents are alike, an empty and another one are not. Counters stay apart up to 2**20 pieces of a document;
beyond, they carry over, which leaves equality and the sums right and only blurs the likeness.

``edited`` orders documents by descending doc_id (null last), then by descending text, so repeated ids have a defined
order, and shuffles each text once: documents go to ranges of ids, and the last of a range is also lent to the next.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

PIECE, WIDE, SEEDS = 32, 8, 4
SHIFT, FIELDS = 20, 3
PACKED = SEEDS * SHIFT
FIELD = sum(1 << SHIFT * k for k in range(FIELDS))
LOW32, LOW60, LOW20 = (1 << 32) - 1, (1 << 60) - 1, (1 << SHIFT) - 1
#: Rows per range of ids.
RANGE_ROWS = 1024


def _sums(unit: str = "unit") -> list[Column]:
    """count, wide sums and packed sums over the pieces of a group."""
    u, zero = F.col(unit), F.lit(0)
    out = [F.count(u)]
    for seed in range(1, WIDE // 2 + 1):
        h = F.xxhash64(u, F.lit(seed))
        for half in (h.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(h, 32)):
            out.append(F.pmod(F.sum(F.when(u.isNotNull(), half).otherwise(zero)), F.lit(1 << 32)))
    for seed in range(SEEDS):
        h = F.xxhash64(u, F.lit(100 + seed))
        for k in range(SHIFT):
            bits = F.shiftrightunsigned(h, k).bitwiseAND(F.lit(FIELD))
            out.append(F.sum(F.when(u.isNotNull(), bits).otherwise(zero)).bitwiseAND(F.lit(LOW60)))
    return out


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, vector: the fingerprint of each group of rows with a column text."""
    units = texts.select(*keys, F.explode_outer(pieces(F.coalesce("text", F.lit("")))).alias("unit"))
    return units.groupBy(*keys).agg(*[c.alias(f"_{k}") for k, c in enumerate(_sums())]).select(*keys, F.array(*[f"_{k}" for k in range(1 + WIDE + PACKED)]).alias("vector"))


def _power(k: Column) -> Column:
    return F.when(k == 0, F.lit(1 << 62)).when(k <= WIDE, F.lit(1 << 32)).otherwise(F.lit(1 << 60))


def _by_lane(a: Column, b: Column, sign: int) -> Column:
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.transform(both, lambda z, k: F.pmod(z["x"] + F.lit(sign) * z["y"], _power(k)))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _by_lane(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a without the pieces of b."""
    return _by_lane(a, b, -1)


def as_text(vector: Column) -> Column:
    """Hex digits: 16 for the count and each packed sum, 8 for each wide sum."""
    return F.concat_ws("", F.transform(vector, lambda x, k: F.lpad(F.lower(F.hex(x)), F.when((k > 0) & (k <= WIDE), 8).otherwise(16), F.lit("0"))))


def _centred(vector: Column) -> Column:
    n = F.element_at(vector, 1)
    fields = lambda p: F.array(*[F.shiftrightunsigned(p, SHIFT * k).bitwiseAND(F.lit(LOW20)) for k in range(FIELDS)])
    return F.transform(F.flatten(F.transform(F.slice(vector, 2 + WIDE, PACKED), fields)), lambda x: (x * 2 - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of two of its vectors."""
    x, y = F.col("_x"), F.col("_y")
    df = df.withColumns({"_x": _centred(F.col(a)), "_y": _centred(F.col(b))}).withColumns({"_n": _dot(x, x) * _dot(y, y), "_d": _dot(x, y)})
    close = F.when(F.col(a) == F.col(b), 1.0).when(F.col("_n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_d") / F.sqrt(F.col("_n")))))
    return df.withColumn(name, close).drop("_x", "_y", "_n", "_d")


def _ranges(ids: DataFrame) -> tuple[list[int], list[int]]:
    """Lower bounds of ranges of about RANGE_ROWS rows that all have rows, and the last id of each."""
    n = ids.count()
    parts = n // RANGE_ROWS + 1
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(parts)], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    lasts = {r.b: r.k for r in ids.select(_bucket(F.col("k"), bounds).alias("b"), "k").groupBy("b").agg(F.max("k").alias("k")).collect()} if bounds else {}
    return bounds, [lasts[b] for b in sorted(lasts)]


def _bucket(k: Column, bounds: list[int]) -> Column:
    """The number of bounds up to k less one, at least 0: a binary search."""
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])
    array = F.lit(bounds)
    found = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s < len(bounds)) & (F.get(array, lo + s) <= k), lo + s).otherwise(lo))
    return found


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (the text with its last half replaced from the next document), vector, edited_vector, next_vector."""
    keyed = text_of(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds, lasts = _ranges(keyed.select("k"))
    if not bounds:
        bounds, lasts = [0], [0]
    own, k, n = _bucket(F.col("k"), bounds), F.col("k"), len(bounds)
    # a range's last rows are lent to the next range, those of the last range to the first one
    lent = F.when(k == F.get(F.lit(lasts), F.col("own")), F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("lent")), F.struct(F.pmod(F.col("own") + 1, F.lit(n)).cast("int").alias("range"), F.lit(True).alias("lent"))))
    lent = lent.otherwise(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("lent"))))
    placed = keyed.withColumn("own", own).select("doc_id", "k", "text", F.explode(lent).alias("at")).select("doc_id", "k", "text", "at.range", "at.lent")
    order = Window.partitionBy("range").orderBy(F.desc("lent"), "k", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))")
    rows = placed.withColumns({"pos": F.row_number().over(order), "before": F.lag("text").over(order)})
    rows = rows.withColumn("edited", F.concat(head, F.substring(F.coalesce("before", F.lit("")), F.lit(1), half)))
    rows = rows.withColumn("sha", F.sha2(F.encode("edited", "UTF-8"), 256)).withColumn("n_chars", F.length("text").cast("long"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.when(~F.col("lent"), F.col("edited")).alias("text"))))
    each = rows.select("range", "pos", "doc_id", "lent", "n_chars", "sha", both.alias("t")).select("range", "pos", "doc_id", "lent", "n_chars", "sha", "t.which", "t.text")
    prints = fingerprints(each, "range", "pos", "doc_id", "lent", "n_chars", "sha", "which")
    pick = lambda w: F.first(F.when(F.col("which") == w, F.col("vector")), ignorenulls=True)
    rows = prints.groupBy("range", "pos", "doc_id", "lent", "n_chars", "sha").agg(pick(0).alias("vector"), pick(1).alias("edited_vector"))
    rows = rows.withColumn("next_vector", F.lag("vector").over(Window.partitionBy("range").orderBy("pos")))
    return rows.where(~F.col("lent")).select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "vector", "edited_vector", "next_vector")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints as hex digits, near_edited and near_next."""
    rows = likeness(likeness(edited(docs), "vector", "edited_vector", "near_edited"), "vector", "next_vector", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next")
