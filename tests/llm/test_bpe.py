import hashlib
import random

import public_tokenizers
from soundgrid.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello,  World!! it's  naïve 12345 <|endoftext|> ünï 😀\n\tfoo_bar don't x̀ \x00\x1c a b", "", None, "  \n", "İstanbul ΣΑΣ ς <|startoftext|><|endoftext|>",
    "²³ ¼ ª º ' ' ''s 'S 'LL \x85   　 中文字 한국어 é \x7f", "word " * 30000, "DON'T's 'reve", "<| endoftext |> <|ENDOFTEXT|>", "ǅ ŉ ſ ß ẞ",
]


def test_matches_the_tokenizer(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(1, "again", "x"), (None, "no id", "x")], "doc_id long, text string, decoded string")
    for hot in (0, 3, 32768):
        got = bpe.digests(bpe.encode(docs, PATH, hot_words=hot, block_chars=1000)).collect()
        t = bpe.tokenizer(PATH)
        want = []
        for k, text in [*enumerate(TEXTS), (1, "again"), (None, "no id")]:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs, PATH)).collect() == []


def test_one_word_of_very_many_ids(spark):
    rnd = random.Random(5)
    run = "".join(rnd.choice("acgt") for _ in range(300_000))
    texts = [run, *(f"rareword{chr(97 + k)}zq unusual{chr(97 + k)}xv" for k in range(20)), f"before {run} after"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = bpe.tokenizer(PATH)
    want = {k: t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert len(want[0]) > 65_535
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(docs, PATH, hot_words=0).collect()}
    assert got == {k: (ids, t.decode(ids, skip_special_tokens=False)) for k, ids in want.items()}
