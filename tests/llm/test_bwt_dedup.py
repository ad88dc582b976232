import random

import numpy as np
import pytest
from soundgrid.llm import bwt_dedup as bd


def brute(rows):
    seen = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for x in range(len(b) - 199):
            seen.setdefault(b[x : x + 200], []).append((k, x))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for at in seen.values():
        if len(at) > 1:
            for k, x in at:
                gone[k][x : x + 200] = True
    out = []
    for (d, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        out.append((d, bytes(np.frombuffer(b, np.uint8)[~g]), len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(n))
    shared = [prose(n) for n in (30, 45, 60, 120, 300)]
    rows = []
    for k in range(60):
        parts = [prose(rnd.randint(0, 80)) for _ in range(2)]
        if k % 2:
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            parts.insert(1, s[a : len(s) - rnd.randint(0, len(s) // 3)])
        rows.append((k, "|".join(parts)))
    rows += [(100, rows[5][1]), (101, None), (102, ""), (103, "z" * 450), (104, "ab" * 300 + "c"), (5, rows[5][1]), (None, "q" * 199), (105, "q" * 200), (106, "\x00" * 230 + "é" * 120)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(bd, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").repartition(5)
    got = sorted(((r.doc_id, bytes(r.body), r.n_bytes, r.n_removed, r.n_spans) for r in bd.dedup(df).collect()), key=str)
    assert got == brute(rows)
    if hot == 3:
        assert bd.dedup(df.limit(0)).collect() == []


def test_merged_transforms(monkeypatch):
    monkeypatch.setattr(bd, "SHARD", 700)
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"abc") for _ in range(900))
    texts = [base[rnd.randint(0, 300) : rnd.randint(550, 900)] for _ in range(30)] + [bytes(rnd.choice(b"ab") for _ in range(300)) for _ in range(5)] + [b"a" * 260]
    seen = {}
    for k, t in enumerate(texts):
        for x in range(len(t) - 199):
            seen.setdefault(t[x : x + 200], []).append((k, x))
    for k, flags in enumerate(bd.repeated(texts)):
        assert flags.tolist() == [len(seen[texts[k][x : x + 200]]) > 1 for x in range(len(texts[k]) - 199)]
