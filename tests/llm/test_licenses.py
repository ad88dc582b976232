import random

from soundgrid.llm import licenses as lic


def corpus():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeioubdlmnrst") for _ in range(rnd.randint(2, 9)))
    docs, want = [], {}
    cases = [("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("licensed under the mozilla public license, version 2.0", "MPL-2.0"), ("My driving license is lost and the public was here.", None), (None, None)]
    for k in range(140):
        text, family = cases[k % len(cases)]
        body = [" ".join(word() for _ in range(rnd.randint(3, 90))) for _ in range(4)]
        if text:
            body[2] = body[2] + " " + text if k % 2 else text
        docs.append((k, "\n".join(body), "c"))
        want[k] = [family] if family else []
    return docs, want


def test_families(spark):
    docs, want = corpus()
    df = spark.createDataFrame(docs + [(900, None, "c"), (901, "", "c"), (None, "MIT", "c"), (0, docs[0][1], "c")], "doc_id long, text string, families string")
    w = lic.fit(df, max_unknown=300)
    got = lic.scan(df, w).collect()
    assert len(got) == len(docs) + 4
    wrong = [(r.doc_id, r.families) for r in got if r.doc_id is not None and r.families != want.get(r.doc_id, [])]
    assert not wrong
    assert lic.scan(df.limit(0), w).collect() == []


def test_wrapped_and_dual_notices(spark):
    df = spark.createDataFrame(corpus()[0], "doc_id long, text string, families string")
    w = lic.fit(df, max_unknown=300)
    cases = [
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet", ["BSD"]),
        (" * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted\n", ["ISC"]),
        ("Licensed under the MIT license. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the MIT license.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the GNU General Public\nLicense, version 2.", ["GPL"]),
        ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        ("This work is licensed under a Creative Commons Attribution-\nNonCommercial 4.0 International License.", ["CC-BY-NC"]),
        (" ".join(f"zq{n}" for n in range(33)) + " This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA"]),
        ("my driving\nlicense is lost\nand the public was here", []),
    ]
    docs = spark.createDataFrame([(k, "a first line\n\n" + t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.spans) for r in lic.scan(docs, w).collect()}
    assert {k: got[k][0] for k in got} == {k: f for k, (_, f) in enumerate(cases)}
    assert [(s.line, s.word) for s in got[0][1]] == [(2, 0)]
    assert [(s.line, s.word) for s in got[8][1]] == [(2, 33)]


def test_very_long_text(spark):
    df = spark.createDataFrame(corpus()[0], "doc_id long, text string, families string")
    w = lic.fit(df, max_unknown=300)
    text = " ".join(f"w{n % 977}" for n in range(200_000)) + " Released under the MIT License. " + "x" * 300_000
    found = lic.spans(text, w, 0.5, 0.6)
    assert [(s["line"], s["word"], s["family"]) for s in found] == [(0, 200_000, "MIT")]
