import random
import zlib

import numpy as np
from soundgrid.llm import quality


def corpus(n):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        ws = [rnd.choice(words) for _ in range(rnd.randint(5, 80))]
        ws = [w.upper() + "!!" for w in ws] if bad and k % 2 else [w for w in ws for _ in range(5)] if bad else ws
        docs.append((k, " ".join(ws), "x"))
        labels.append((k, int(not bad), "clash"))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs + [(900, None, None), (901, "", "x"), (None, "some words here", "x"), (5, docs[5][1], "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(7, None, "c"), (None, 1, "c"), (4000, 1, "c"), (8, 1, "c")], "doc_id long, quality int, text string")
    w = quality.fit(d, lab)
    got = [r for r in quality.scored(d, w, "p").collect()]
    assert len(got) == len(docs) + 4 and all(0 <= r.p <= 1 for r in got)
    want = {k: y for k, y, _ in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(r.p >= 0.7) == want[r.doc_id] for r in held]) > 0.97
    empty = {r.p for r in got if not r.text}
    assert len(empty) == 1


def test_learns_nothing_from_held_out_labels(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    flip = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y, z) for k, y, z in labels]
    a, b = (quality.fit(d, spark.createDataFrame(x, "doc_id long, quality int, t string")) for x in (labels, flip))
    assert (a == b).all() and a.any()


def test_no_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    w = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.scored(d, w).collect()] == [0.5]
    assert quality.scored(d.limit(0), w).collect() == []
