import random
import re

import numpy as np
from soundgrid.llm import graph, hyperminhash as hm


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, percent):
    s = [sets(t) for _, t in rows]
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                comp[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(rnd, base, n, rate):
    return [" ".join(w if rnd.random() > rate else f"x{rnd.randint(0, 10**6)}" for w in base) for _ in range(n)]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = ["", None, " \t", "one", "ONE", "one two", "a b c d e", "A b C d e", "é É", "É É"]
    for n, rate in ((60, 0.02), (200, 0.03), (300, 0.012), (1500, 0.025), (9, 0.05)):
        base = [rnd.choice(words) for _ in range(n)]
        texts += [" ".join(base)] + near_copies(rnd, base, 14, rate)
    shared = " ".join(rnd.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rnd.choice(words) for _ in range(40)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (12, texts[12]), (None, texts[12]), (7, "another text under seven")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, key string")
    for percent in (85, 80):
        assert sorted(map(tuple, hm.near_duplicates(df, percent).collect()), key=str) == brute(rows, percent)


def test_no_rows(spark):
    assert hm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(200):
        x = rng.integers(0, 2**64, 1000, np.uint64)
        a, b = (hm.registers(np.unique(v)) for v in (x[:900], x[100:]))
        got.append((((a == b) & (a > 0)).sum() / hm.REGISTERS - hm.CHANCE) / (1 - hm.CHANCE))
    assert abs(np.mean(got) - 0.8) < 0.02


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in graph.components(e).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_many_unlike_nodes_in_one_bucket(spark, monkeypatch):
    """Texts around one another's limit share buckets without being linked; the links among them are found in blocks."""
    monkeypatch.setattr(hm, "BLOCK", 16)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(90):
        t = list(base)
        for k in rnd.sample(range(90), rnd.choice((1, 2, 3))):
            t[k] = f"x{rnd.randint(0, 10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        assert sorted(map(tuple, hm.near_duplicates(df, percent).collect()), key=str) == brute(rows, percent)


def test_borrowed_registers_agree_as_the_sets_do():
    rng = np.random.default_rng(2)
    for n, same in ((10, 9), (40, 34), (400, 340)):
        got = []
        for _ in range(200):
            x = rng.integers(0, 2**64, 2 * n - same, np.uint64)
            a, b = (hm.borrowed(hm.registers(np.unique(v))) for v in (x[:n], x[n - same :]))
            got.append((a == b).mean())
        assert abs(np.mean(got) - same / (2 * n - same)) < 0.03
    assert not hm.borrowed(np.zeros(hm.REGISTERS, np.uint16)).any()
