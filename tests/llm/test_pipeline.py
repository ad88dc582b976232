import hashlib
import random

import corpus_pipeline as cp
import public_tokenizers
from soundgrid.llm import bpe
from soundgrid.llm.hyperminhash import linked, shingles

PATH = public_tokenizers.path(cp.WORD_BPE)


def survivors(rows):
    """Rows that stay when all pairs of rows are compared; of each component the least doc_id, null last."""
    sets, label = [shingles(t or "") for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a]) and len(sets[b]) and label[a] != label[b] and linked(sets[a], sets[b], 80):
                label = [label[b] if x == label[a] else x for x in label]
    groups = {}
    for row, k in zip(rows, label, strict=True):
        groups.setdefault(k, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_repeated_and_null_ids(spark, tmp_path):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    text = lambda: " ".join(word() for _ in range(80))
    a, b, c, d, e, item = (text() for _ in range(6))
    item = " ".join(item.split()[:25])
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c), (None, d), (None, d), (None, None), (None, ""), (5, text() + " " + item + " " + text()), (6, e), (None, e)]
    rows += [(k, text()) for k in range(10, 40)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_dedup(spark, docs, str(tmp_path))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    want = sorted(survivors(rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert (2, b) in want and (2, a + " tail") not in want and want.count((3, c)) == want.count((None, d)) == 1
    ids = [(k, bpe.tokenizer(PATH).encode(t or "", add_special_tokens=False).ids) for k, t in want if item not in (t or "")]
    ids = [(k, hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for k, x in ids]
    out = cp.encoded(spark, cp.decontaminated(spark, got, str(tmp_path)), str(tmp_path))
    assert sorted(((r.doc_id, r.ids_sha256) for r in out.collect()), key=key) == sorted(ids, key=key)
