import random
from collections import Counter

from pyspark.sql import functions as F
from soundgrid.llm import lines

ASCII = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def brute(rows, least):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if seen[key(x)] < least]
        out.append((d, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    pool = ["Alpha", " alpha\t", "ALPHA\r", "É", "é", "", "   ", "\x0b", "a\xa0", "beta  x", "gamma", "x" * 5000]
    rows = [(k, "\n".join(rnd.choice([*pool, f"own {k} {rnd.random()}"]) for _ in range(rnd.randint(1, 6)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (None, "alpha\nmine"), (None, None)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, key string")
    for least in (2, 10):
        assert sorted(map(tuple, lines.dedup(df, least).collect()), key=str) == brute(rows, least)
    out = lines.dropped_from(df, 10)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted(((d, t) for d, t, *_ in brute(rows, 10)), key=str)
    assert lines.dedup(df.limit(0)).collect() == []


def test_runs_compact_and_settle(spark):
    runs = lines.LineRuns(min_docs=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(b"a", 1), (bytes([k + 10]), 1), (b"s", 3)], "key binary, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(bytes(r.key) for r in runs.frequent().collect()) == [b"a", b"s"]
    assert sum(r.n for run in runs.runs() for r in run.where(F.col("key") == F.lit(b"s")).collect()) == 3
