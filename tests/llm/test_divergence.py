import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from soundgrid.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, item string, number int, total long"


def f(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, min_docs, best=10):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in rows}:
        own = [x[1:] for x in rows if x[0] == lang]
        kept = sorted(t for t, n in Counter(t for _, ts in own for t in set(ts)).items() if n >= min_docs)
        count = {s: Counter(t for x, ts in own if x == s for t in ts if t in set(kept)) for s, _ in own}

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(sum(count.values(), Counter()))
        for part, items in (("pair", [(s, o, sum(f(p[s][t], p[o][t]) for t in kept)) for s, o in permutations(p, 2)]), ("term", [(s, t, f(p[s][t], q[t])) for s in p for t in kept if count[s][t] and p[s][t] > q[t]])):
            for s in p:
                ranked = sorted((x for x in items if x[0] == s), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (_, item, value) in enumerate(ranked) if part == "pair" or k < best]
    return sorted(out)


def audited(spark, rows, min_docs, **more):
    df = spark.createDataFrame([(*r, "i", 1, 2) for r in rows], SCHEMA)
    out = divergence.audit(df, min_docs, **more)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def corpus(n, sources, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéßñzΩ字 ") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(n):
        text = " ".join(rnd.choice([w, w.upper(), w + "1", w + "-" + w, w + "..."]) for w in rnd.choices(words, [1 / (i + 1) for i in range(60)], k=rnd.randint(0, 30)))
        rows.append((k, text, rnd.choice(["en", "de", None, ""]), "hot" if k % 3 == 0 else rnd.choice(sources)))
    return rows


@pytest.mark.parametrize("limit", [divergence.LIMIT, 20])  # tries given out many times
def test_against_brute_force(spark, limit):
    rows = corpus(400, ["a", "b", "é", None, "z"], 1) + [(None, None, None, None), (5, "", "fr", "lone"), (5, "", "fr", "lone"), (6, "x", "it", "p"), (7, "y", "it", "o"), (8, "word " * 100_000, "en", "a")]
    want = brute(rows, 4)
    assert len(want) > 100 and any(r[4] == 0 for r in want) and audited(spark, rows, 4, limit=limit) == want


def test_blocks_of_sources(spark):
    rows = corpus(300, [f"s{k}" for k in range(11)], 2)
    assert audited(spark, rows, 3, best=4, block=3) == brute(rows, 3, 4)


def test_ties_are_in_utf8_order(spark):
    rows = [(k, " ".join(f"{c}{d}" for c in "zaé字\U0001f600" for d in "ba"), "en", "one") for k in range(5)] + [(k, "other", "en", "two") for k in range(5)]
    got = [r for r in audited(spark, rows, 5, best=3) if r[2] == "term" and r[1] == "one"]
    assert [r[3] for r in got] == ["aa", "ab", "za"] and got == [r for r in brute(rows, 5, 3) if r[2] == "term" and r[1] == "one"]


def test_no_documents(spark):
    assert audited(spark, [], 10) == []


def test_shares_are_exact():
    rnd = random.Random(4)
    for _ in range(2000):
        total = rnd.randrange(1, 9 * 10**15)
        count = rnd.randrange(0, max(1, total - 2))
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_a_term_over_many_batches():
    """One term's leaves come in batches of one row each."""
    rows = [("en", t, 1, [s], [n]) for t in (b"a", b"b", b"c") for s in range(3) for n in (1, 2)]
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pydict(dict(zip(schema.names, ([v] for v in r), strict=True)), schema) for r in rows]
    got = [x for b in divergence._merge(iter(batches), 6) for x in b.to_pylist()]
    assert [(x["term"], x["docs"], x["sources"], x["counts"]) for x in got] == [(t, 6, [0, 1, 2], [3, 3, 3]) for t in (b"a", b"b", b"c")]
