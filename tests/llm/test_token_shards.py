import zlib

import numpy as np
import public_tokenizers
from soundgrid.llm import bpe, token_shards as ts
from soundgrid.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        a, b = (ts.feistel(np.arange(n), n, k) for k in (1, 2))
        assert sorted(a) == list(range(n)) and (n < 10 or (a != b).any())


def test_shards_hold_every_sequence(spark):
    rows = [(k, "some words " * (k * 3)) for k in range(40)] + [(3, "some words " * 9), (None, "x"), (50, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int").repartition(5)
    folder = new_path(spark, "shards")
    got = ts.materialise(df, PATH, folder, length=16, shard_rows=10).collect()
    t = bpe.tokenizer(PATH)
    want = sorted((ids[k : k + 16] + [ts.PAD] * (16 - len(ids[k : k + 16])) for _, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids] for k in range(0, len(ids), 16)))
    read = [list(map(int, x)) for x in ts.read_from(folder, 0, 16, 10)]
    assert sorted(read) == want and sorted(r.slot for r in got) == list(range(len(want)))
    for r in got:
        assert zlib.crc32(np.array(read[r.slot], "<u2").tobytes()) == r.crc32 and r.offset == r.slot % 10 * 32
    assert [list(map(int, x)) for x in ts.read_from(folder, 23, 16, 10)] == read[23:]
    assert ts.materialise(df.limit(0), PATH).collect() == []
