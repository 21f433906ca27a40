import random

from tiltscale.llm import license_texts as T
from tiltscale.llm import licenses as L


def _longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_rising_and_equal():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) <= _longest_common(a, b)


def test_alignment_of_unique_words_is_the_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.sample(range(30), rng.randint(0, 30)) for _ in range(2))
        assert len(L.align(a, b)) == _longest_common(a, b)


def test_rising_run_is_the_longest():
    rng = random.Random(3)
    for _ in range(200):
        b = rng.sample(range(20), 12)
        run = L._longest_rising(list(enumerate(b)))
        assert len(run) == _longest_common(b, sorted(b))


def _found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license, texts[r.doc_id][r.start : r.end]) for r in L.scan(df).collect()}


def test_notices_are_found_and_told_apart(spark):
    filler = "many other words stand here and there " * 20
    texts = [
        filler + "Licensed under the Apache License, Version 2.0." + filler,
        "Licensed under CC BY-NC 4.0.\n" + filler,
        filler + "RELEASED under the\n MIT license",
        "This work is licensed under the new GNU General Public License version 3, see below",
        filler,
        "a license is not a notice, and released songs are reserved",
        ("Released under the MIT License. " + filler) * 3,
    ]
    assert _found(spark, texts) == {
        (0, "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
        (1, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
        (2, "MIT", "RELEASED under the\n MIT license"),
        (3, "GPL-3.0", texts[3][: texts[3].index(", see")]),
        (6, "MIT", "Released under the MIT License"),
    }
    df = spark.createDataFrame([(1, texts[6])], "doc_id long, text string")
    assert L.scan(df).count() == 3


def test_documents(spark, documents, texts):
    rows = L.scan(documents).collect()
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "rights-reserved": "All rights reserved",
    }
    want = {(doc, name) for doc, text in texts.items() for name, line in lines.items() if line.lower() in text.lower()}
    assert want <= {(r.doc_id, r.license) for r in rows}
    assert all(L.COVERAGE <= r.coverage <= 1 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    assert L.scan(odd_documents).collect() == []
    assert L.scan(no_documents).collect() == []
    long = spark.createDataFrame([(1, "license " * 20_000), (2, "the under License released mit " * 5_000)], "doc_id long, text string")
    assert {r.doc_id for r in L.scan(long).collect()} <= {2}


def test_look_alikes_are_told_apart(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}"
    texts = {
        "Licensed under CC BY 4.0": {"CC-BY-4.0"},
        "Licensed under CC BY-ND 4.0": {"CC-BY-ND-4.0"},
        "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0"},
        "Licensed under CC BY-NC 3.0": {"CC-BY-NC-3.0"},
        "This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.": {"CC-BY-NC-4.0"},
        gnu.format("", "3"): {"GPL-3.0"},
        gnu.format("", "2"): {"GPL-2.0"},
        gnu.format("Lesser ", "3"): {"LGPL-3.0"},
        gnu.format("Library ", "2"): {"LGPL-2.0"},
        gnu.format("Affero ", "3"): {"AGPL-3.0"},
        gnu.format("", "7"): set(),
        "Licensed under the Apache License, Version 1.1": {"Apache-1.1"},
        "Licensed under the Apache License v2": {"Apache-2.0"},
        "Released under the MIT No Attribution License": {"MIT-0"},
        "Licensed by the authors for commercial use under CC BY 4.0": {"CC-BY-4.0"},
    }
    got = {}
    for doc, name, _ in _found(spark, list(texts)):
        got.setdefault(doc, set()).add(name)
    assert {text: got.get(i, set()) for i, text in enumerate(texts)} == texts


def test_bodies_are_told_apart(spark):
    bodies = {
        "MIT": T.MIT, "MIT-0": T.MIT_0, "BSD-2-Clause": T.BSD_2, "BSD-3-Clause": T.BSD_3, "BSD-4-Clause": T.BSD_4,
        "ISC": T.ISC, "Apache-2.0": T.APACHE_2, "MPL-2.0": T.MPL_2_NOTICE,
    }
    filler = "many other words stand here and there " * 50
    want = {(i, name, text) for i, (name, text) in enumerate(bodies.items())}
    texts = [filler + "\n" + text + "\n" + filler for text in bodies.values()]
    got = _found(spark, texts)
    assert {(i, name) for i, name, _ in got} == {(i, name) for i, name, _ in want}
    evil = T.MIT.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED")
    assert "MIT" not in {name for _, name, _ in _found(spark, [evil])}


def test_long_insertions_are_seen(spark):
    notice = T._GNU_TERMS.format(thing="program", name="General Public License", version="3")
    one_line = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3"}
    df = spark.createDataFrame([(1, "some words before it. " * 30 + notice + " and some words behind it" * 30)], "doc_id long, text string")
    (row,) = L.scan(df, one_line).collect()
    assert (row.license, round(row.coverage * 12)) == ("GPL-3.0", 10)
    own = "Licensed under, " + "with thanks to everyone who took part, " * 2 + "the Apache License, Version 2.0"
    assert _found(spark, [own]) == {(0, "Apache-2.0", own)}
