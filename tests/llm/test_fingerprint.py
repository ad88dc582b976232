import hashlib
import random

from pyspark.sql import functions as F
from soundgrid.llm import fingerprint as fp


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(rnd, n):
    word = lambda: "".join(rnd.choice("abcdeé😀") for _ in range(rnd.randint(1, 9)))
    return ["\n".join(" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))) for _ in range(n)]


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rnd = random.Random(2)
    ids = rnd.sample(range(-1000, 10**12), 60)
    rows = list(zip(ids, texts(rnd, 60), strict=True)) + [(ids[0], "again"), (ids[1], None), (None, "no id"), (5, ""), (6, "x"), (8, "y" * 100_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int").repartition(5)
    got = fp.compared(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 900 and r.doc_id != 8]
    assert min(r.near_edited for r in long) > 0.15 and sum(r.near_edited > r.near_next for r in long) == len(long)
    assert fp.compared(df.limit(0)).collect() == []
    one = fp.compared(df.where("doc_id = 6")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in one] == [(1, 1.0, 1.0)]


def test_sums_do_not_depend_on_order(spark):
    rnd = random.Random(4)
    a, b = texts(rnd, 2)
    lines = (a + "\n" + b).split("\n")
    mixed = lines[:]
    rnd.shuffle(mixed)
    df = spark.createDataFrame([(1, a), (2, b), (3, "\n".join(lines)), (4, "\n\n".join(mixed)), (5, "")], "doc_id long, text string")
    v = fp.fingerprints(df, "doc_id").groupBy().pivot("doc_id", [1, 2, 3, 4, 5]).agg(F.first("vector"))
    r = v.select("*", fp.plus(F.col("1"), F.col("2")).alias("sum"), fp.minus(F.col("3"), F.col("2")).alias("less")).first()
    assert r["3"] == r["4"] == r["sum"] and r["less"] == r["1"] and not any(r["5"])
