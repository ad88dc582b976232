import random

from soundgrid.llm import decontaminate as dc


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(1, 6) for _ in range(rnd.randint(1, 70))] for _ in range(2))
        assert dc.lcs(dc.masks_of(a), len(a), b) == plain_lcs(a, b)


def test_finds_passages_and_paraphrases(spark):
    rnd = random.Random(2)
    common = ["the", "of", "and", "to", "in"]
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(n)]
    items = [(k, prose(rnd.randint(14, 59))) for k in range(30)]
    docs, want = [], {}
    for k in range(300):
        body, held = prose(rnd.randint(5, 700)), []
        if k % 3 == 0:
            i, item = rnd.choice(items)
            item = [w if j % 7 else "changed" for j, w in enumerate(item)] if k % 2 else item
            at = rnd.randint(0, len(body))
            body, held = body[:at] + [w.upper() + "," for w in item] + body[at:], [i]
        docs.append((k, " ".join(body), "c"))
        want[k] = held
    df = spark.createDataFrame(docs + [(900, None, "c"), (901, "", "c"), (None, " ".join(items[3][1]), "c")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None), (None, "x"), (51, "")], "item_id long, text string")
    model = dc.fit(df.drop("items"), bench)
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in dc.scan(df.drop("items"), model).collect()}
    assert got.pop(None) == [3] and got.pop(900) == got.pop(901) == []
    assert got == want
    both = {r.doc_id: [x.item_id for x in r["items"]] for r in dc.fit_and_scan(df, bench).collect()}
    assert {k: v for k, v in both.items() if k in want} == want
    none = dc.fit(df.limit(0), bench.limit(0))
    assert [r["items"] for r in dc.scan(df.limit(2), none).collect()] == [[], []]


def held(model, ids, likely=0.6, sure=0.8):
    """Items of a text, from the longest common subsequence of every item with every one of its windows."""
    out = set()
    for size, members in model.groups.items():
        for a, b in zip(*model.windows(size, len(ids)), strict=True):
            out |= {model.items[k].item_id for k in members if model.items[k].held_by(ids[a:b].tolist(), likely, sure)}
    return sorted(out)


def by_doc(docs, bench):
    return {r.doc_id: [x.item_id for x in r["items"]] for r in dc.fit_and_scan(docs, bench).collect()}


def test_passage_in_a_third_of_the_rows(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    items = [(k, [rnd.choice(words) for _ in range(24)]) for k in range(10)] + [(10, "to be or not to be that is the question of the day".split())]
    docs, want = [], {}
    for k in range(120):
        body = [rnd.choice([*words, *["to", "be", "or", "not", "that", "is", "the"] * 300]) for _ in range(20)]
        held_here = [0] if k % 3 == 0 else [10] if k == 1 else []
        docs.append((k, " ".join([*body[:9], *(w for i in held_here for w in items[i][1]), *body[9:]])))
        want[k] = held_here
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert by_doc(spark.createDataFrame(docs, "doc_id long, text string"), bench) == want


def test_three_documents(spark):
    item = "what is the capital of the old kingdom by the river answer it is the town of stones"
    docs = [(1, "some words before " + item + " and after"), (2, item), (3, "nothing of it here")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert by_doc(spark.createDataFrame(docs, "doc_id long, text string"), bench) == {1: [7], 2: [7], 3: []}


def test_same_as_every_window_with_more_items_than_the_rank(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 6))) for _ in range(700)]
    prose = lambda n: [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(n)]
    items = [(k, prose(rnd.randint(4, 62))) for k in range(dc.RANK + 60)]
    docs = []
    for k in range(260):
        body = prose(rnd.randint(0, 1500))
        for _, item in rnd.sample(items, 2):
            share = rnd.uniform(0.05, 0.45)  # words lost or changed
            at = rnd.randint(0, len(body))
            body[at:at] = [w if rnd.random() > share else rnd.choice(words) for w in item]
        docs.append((k, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    model = dc.fit(df, bench)
    ids = {k: model.vocabulary.of(text) for k, text in docs}
    want = {k: held(model, x) for k, x in ids.items()}
    assert sum(map(len, want.values())) > 150
    latent = sum(len({model.items[c[0]].item_id for c in model.candidates(x, 0.5, 0.6, by_words=False)} & set(want[k])) for k, x in ids.items())
    print(f"the cosine alone reaches {latent} of {sum(map(len, want.values()))} held items")
    assert by_doc(df, bench) == want
