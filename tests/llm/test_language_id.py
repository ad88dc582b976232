import random
import zlib

import numpy as np
from soundgrid.llm import language_id
from soundgrid.llm.language_id import Space, codes, distinct, grams

SCHEMA = "doc_id long, text string, lang string, source string, rank int, length long"
SOUNDS = {"en": "th er and ing the of tion wh", "de": "sch ung der ein keit ß ü ö", "fr": "eau é è que oi ment ç les", "el": "ος α και του η λη μ ν"}


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(sorted(SOUNDS))
        words = ["".join(rnd.choices(SOUNDS[lang].split(), k=rnd.randint(1, 3))) for _ in range(rnd.randint(2, 60))]
        rows.append((k, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words) + rnd.choice([".", "!!!", " 123"]), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus(800, 1)
    odd = [(None, rows[0][1], rows[0][2]), (5000, None, "en"), (5001, "", "en"), (5002, " 12 !? ", "en"), (5003, rows[1][1], None), (rows[2]), (5004, "字字", "en"), (5005, "the thing " * 200_000, "de"), (5006, "\U0001f600 x", None)]
    d = frame(spark, rows + odd)
    model = language_id.fit(d, max_train=400, landmarks=40)
    assert sorted(model.langs) == sorted(SOUNDS)
    got = language_id.predicted(d, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got) and d.columns + ["lang_pred", "score"] == list(got[0].asDict())
    own = {r.doc_id: r for r in got}
    assert [own[k].lang_pred for k in (5000, 5001, 5002)] == ["und"] * 3 and own[5005].lang_pred == "en" and own[5004].lang_pred == model.langs[0] and own[5004].score == 0.25
    test = [(k, lang) for k, _, lang in rows if held(k)]
    assert len(test) > 150 and np.mean([own[k].lang_pred == lang for k, lang in test]) > 0.98


def test_learns_nothing_from_held_out_rows(spark):
    rows = corpus(160, 2)
    other = [(k, text + " zzz", "el") if held(k) else (k, text, lang) for k, text, lang in rows]
    a, b = (language_id.fit(frame(spark, x), 100, 16) for x in (rows, other))
    assert sorted(a.langs) == sorted(b.langs)
    assert (a.space.keys == b.space.keys).all() and np.allclose(a.weights[:, np.argsort(a.langs)], b.weights[:, np.argsort(b.langs)], atol=1e-5)


def test_repeated_rows_are_learned_once(spark):
    rows = corpus(80, 3)
    a, b = (language_id.fit(frame(spark, x), 60, 16) for x in (rows, rows + [rows[0]] * 200))
    assert (a.space.keys == b.space.keys).all()


def test_nothing_to_learn(spark):
    for rows in ([], [(1, None, "en"), (None, "word", "en"), (2, "word", None)]):
        d = frame(spark, rows)
        assert language_id.fit(d) is None
        assert [(r.lang_pred, r.score) for r in language_id.predicted(d, None).collect()] == [("und", 0.0)] * len(rows)


def test_few_landmarks(spark):
    """Languages of one text each, and more languages than landmarks."""
    rows = [(k, t, f"l{k}") for k, t in enumerate(("abc abd", "xyz xyw", "klm kln", "opq opr", "stu stv", "ghi ghj")) if not held(k)]
    model = language_id.fit(frame(spark, rows), 10, 2)
    got = language_id.predicted(frame(spark, rows), model).collect()
    assert len(model.langs) == len(rows) > 2 and all(r.lang_pred == r.lang for r in got)


def plain(text):
    """Distinct n-grams by sets."""
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    s = f" {' '.join(s.split(' '))} "
    while "  " in s:
        s = s.replace("  ", " ")
    return {s[i : i + n] for n in range(1, language_id.ORDERS + 1) for i in range(len(s) - n + 1)} - {" "} if s.strip() else set()


def test_kernel_counts_shared_n_grams(monkeypatch):
    texts = [t for _, t, _ in corpus(30, 4)] + ["", "a", "Ab  c--d", "İx", "ab" * 300]
    for size in (language_id.AT_ONCE, 7):  # pieces of long texts overlap
        monkeypatch.setattr(language_id, "AT_ONCE", size)
        sets = [distinct(t) for t in texts]
        for a, x in zip(texts, sets, strict=True):
            assert len(x) == len(plain(a))
            for b, y in zip(texts, sets, strict=True):
                assert len(np.intersect1d(x, y)) == len(plain(a) & plain(b))
        space = Space(sets)
        for t, x in zip(texts, sets, strict=True):
            at = space.present(grams(codes(t)))
            assert (space.keys[at] == np.sort(space.keys[:-1][np.isin(space.keys[:-1], x)])[np.argsort(np.argsort(space.keys[at]))]).all()
