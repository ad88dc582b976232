"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines with words. They are looked at in overlapping windows of each length in ``WINDOWS``, so a
notice that is wrapped over lines or stands within a long line counts (the short windows keep a short notice from drowning
in the words about it), and each line is looked at by itself too. Hashed word unigrams and bigrams feed a multinomial
logistic regression over the licence families and an unknown class. It is trained on variants of the templates and a bounded
sample of the corpus's own lines as unknown (a window of each of about ``max_unknown`` distinct lines, those of the least
hashes, and a short piece of that); its probabilities are calibrated by a temperature fitted on a held-out fifth. A window
proposes each family whose probability against unknown is at least ``least_probability``. The proposal counts when the
window, with ``MARGIN`` words of its paragraph on both sides, holds ``least_overlap`` of the word bigrams of one of that
family's templates, without the words that fit another family better. A span is where the notice begins; what several
windows find there is given once, with the highest probability.

A null or empty text has no licences. Repeated rows and null ids are kept, each row on its own. Other columns of the
input are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, mixed

# Licence notices, by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License, version 2."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
FAMILIES = [*TEMPLATES, "unknown"]
BUCKETS, WINDOWS = 1 << 15, (40, 16)  # windows begin every half a window
WINDOW = WINDOWS[0]
_TOKEN = re.compile(r"[a-z0-9]+(?:[.'][a-z0-9]+)*")
_HASHES = WordHashes()
SPANS = "array<struct<line:int,word:int,family:string,probability:double,overlap:double>>"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of each pair that begins at a word (the last word has none: the bucket of a pair with nothing)."""
    w = _HASHES.of(words)
    following = np.append(w[1:], np.uint64(0)) if len(w) else w
    return tuple((mixed(x) % np.uint64(BUCKETS)).astype(np.int64) for x in (w, w * np.uint64(3) + following * np.uint64(7) + np.uint64(1)))


def _ids(words: list[str]) -> np.ndarray:
    one, two = _grams(words)
    return np.concatenate([one, two[:-1]])


def _variants(rnd: random.Random, filler: list[str], each: int = 40) -> list[tuple[list[str], int]]:
    out = []
    for k, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            words = tokens(text)
            for n in range(each):
                kept = [w for w in words if n < 5 or rnd.random() > 0.08]
                around = [[rnd.choice(filler) for _ in range(rnd.randint(0, 15))] if filler and n >= 5 else [] for _ in range(2)]
                out.append((around[0] + kept + around[1], k))
    return out


def _sample(docs: DataFrame, most: int) -> list[str]:
    """A window of words of each of the distinct lines with the least hashes; a hash limit keeps all others off the driver."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).where(F.trim("line") != "")
    place = F.shiftrightunsigned(F.xxhash64("line"), 1)
    n = lines.agg(F.approx_count_distinct("line", 0.05).alias("n")).first().n
    limit = min((1 << 63) - 1, (2 * most << 63) // max(n, 1))  # in whole numbers: a float would round up to 2**63
    words = F.split(F.trim("line"), r"\s+")
    start = F.pmod(F.xxhash64("line", F.lit(1)), F.greatest(F.size(words) - WINDOW, F.lit(0)) + 1).cast("int") + 1
    some = lines.where(place <= limit).distinct().orderBy(place, "line").limit(most)
    return [r.w for r in some.select(F.array_join(F.slice(words, start, WINDOW), " ").alias("w")).collect()]


def fit(docs: DataFrame, max_unknown: int = 4_000, epochs: int = 6, seed: int = 0) -> np.ndarray:
    """Weights, (BUCKETS + 1) x families, divided by the temperature; the last row is the bias."""
    rnd = random.Random(seed)
    unknown = [w for w in map(tokens, _sample(docs, max_unknown)) if w and max(_overlap(w, f) for f in TEMPLATES) < 0.1]  # nor a notice that the window cuts off
    filler = sorted({w for ws in unknown for w in ws})
    at = [rnd.randint(0, max(0, len(w) - WINDOWS[1])) for w in unknown]
    unknown += [w[k : k + WINDOWS[1]] for w, k in zip(unknown, at, strict=True) if len(w) > WINDOWS[1]]
    near = [tokens(t) for t in ("she lost her driving license", "the license plate was new", "a copy of the work", "general public", "version 2.0 of the file", "all rights", "free software for any purpose", "released in 2.0")]
    rows = _variants(rnd, filler) + [(w, len(TEMPLATES)) for w in unknown + near * 20]
    rnd.shuffle(rows)
    data = [(np.append(_ids(w), BUCKETS), k) for w, k in rows]
    cut = len(data) // 5
    held, train = data[:cut], data[cut:]
    w, g2 = np.zeros((BUCKETS + 1, len(FAMILIES))), np.full(BUCKETS + 1, 1e-6)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    for _ in range(epochs):
        for ids, k in train:
            at, n = np.unique(ids, return_counts=True)
            p = softmax(n @ w[at] / np.sqrt(len(ids)))
            p[k] -= 1
            grad = np.outer(n / np.sqrt(len(ids)), p)
            g2[at] += (grad**2).sum(1)
            w[at] -= 0.3 * grad / np.sqrt(g2[at])[:, None]
    scores = [(w[ids].sum(0) / np.sqrt(len(ids)), k) for ids, k in held]
    losses = {t: -np.mean([np.log(softmax(z / t)[k] + 1e-12) for z, k in scores]) for t in np.geomspace(0.3, 5, 20)}
    return w / min(losses, key=losses.get)


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = {f: [_pairs(tokens(t)) for t in texts] for f, texts in TEMPLATES.items()}
MARGIN = max(len(t) for texts in _TEMPLATE_PAIRS.values() for t in texts) + 1


def _overlap(words: list[str], family: str) -> float:
    own = _pairs(words)
    return max(len(own & t) / len(t) for t in _TEMPLATE_PAIRS[family])


def _confirmed(words: list[str], scores: dict[str, float], least: float) -> list[tuple[str, float, int]]:
    """Families, overlaps and the word where each begins, the best first (of equal overlaps that of the higher score); each takes its words from the others."""
    pairs, out, left = list(zip(words, words[1:], strict=False)), [], dict(scores)
    while left:
        own = set(pairs)
        share, _, family, t = max(((len(own & t) / len(t), z, f, t) for f, z in left.items() for t in _TEMPLATE_PAIRS[f]), key=lambda x: x[:3])
        if share < least:
            break
        del left[family]
        runs = [len({p for p in pairs[k : k + len(t)] if p in t}) if pairs[k] in t else 0 for k in range(len(pairs))]
        at = max(range(len(runs)), key=runs.__getitem__)
        pairs[at : at + len(t)] = [None] * len(pairs[at : at + len(t)])
        out.append((family, share, at))
    return out


def _windows(lines: list[list[str]]) -> np.ndarray:
    """Distinct windows as rows of begin, end and their paragraph's begin and end, counted in words of the text."""
    first = np.cumsum([0] + [len(line) for line in lines])
    runs, since = [], None
    for k, line in enumerate(lines):
        since = k if line and since is None else since
        if since is not None and (k + 1 == len(lines) or not lines[k + 1]):
            x, y = first[since], first[k + 1]
            runs += [(a, b, x, y) for a, b in {(x, y), *zip(first[since : k + 1], first[since + 1 : k + 2], strict=True)}]
            since = None
    out = []
    for a, b, x, y in runs:
        for size in WINDOWS:
            starts = np.arange(a, max(a + 1, b - size // 2), size // 2)
            out.append(np.stack([starts, np.minimum(b, starts + size), np.full_like(starts, x), np.full_like(starts, y)], 1))
            if b - a <= WINDOWS[-1]:
                break
    return np.unique(np.concatenate(out), axis=0)


def spans(text: str, w: np.ndarray, least_probability: float, least_overlap: float) -> list[dict]:
    """Licence spans of a text: line and word where the notice begins, family, probability, overlap."""
    lines = [tokens(x) for x in text.split("\n")]
    words = [x for line in lines for x in line]
    if not words:
        return []
    one, two = _grams(words)
    a, b = (np.concatenate([np.zeros((1, w.shape[1]), np.float32), np.cumsum(w[x], 0, dtype=np.float64)]) for x in (one, two))
    windows = _windows(lines)
    starts, ends = windows[:, 0], windows[:, 1]
    z = (a[ends] - a[starts] + b[ends - 1] - b[starts] + w[-1]) / np.sqrt(2 * (ends - starts))[:, None]
    p = 1 / (1 + np.exp(np.clip(z[:, -1:] - z[:, :-1], -500, 500)))  # against unknown
    best: dict[tuple[int, str], tuple[float, float]] = {}
    for k in np.flatnonzero((p >= least_probability).any(1)):
        x = max(windows[k, 2], starts[k] - MARGIN)
        found = _confirmed(words[x : min(windows[k, 3], ends[k] + MARGIN)], dict(zip(TEMPLATES, map(float, z[k]), strict=False)), least_overlap)
        for family, share, at in found:
            probability = float(p[k, FAMILIES.index(family)])
            if probability >= least_probability:
                key = (int(x) + at, family)
                best[key] = max(best.get(key, (0.0, 0.0)), (probability, share))
    first = np.cumsum([0] + [len(line) for line in lines])
    out = []
    for (at, family), (probability, share) in sorted(best.items()):
        line = int(np.searchsorted(first, at, side="right")) - 1
        out.append({"line": line, "word": at - int(first[line]), "family": family, "probability": probability, "overlap": share})
    return out


def scan(docs: DataFrame, weights: np.ndarray, least_probability: float = 0.5, least_overlap: float = 0.6) -> DataFrame:
    """doc_id, families (sorted names), spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = pa.struct([("line", pa.int32()), ("word", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [spans(t or "", shared.value, least_probability, least_overlap) for (t,) in arrow_rows([part], "text")]
                families = [sorted({s["family"] for s in x}) for x in found]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "families": pa.array(families, pa.list_(pa.string())), "spans": pa.array(found, pa.list_(kind))})

    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id long, families array<string>, spans {SPANS}")
