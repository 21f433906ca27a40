import random

import numpy as np
import pytest
from llm_brute import near_groups, shingles

from tiltscale.llm import near_dup as N


def _by_number(spark, texts, k, percent):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = N.near_duplicates(df.repartition(3), k, percent).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r for r in rows}


def _check(spark, texts, k=5, percent=80):
    got = _by_number(spark, texts, k, percent)
    groups, sizes = near_groups(texts, k, percent)
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (groups[i], sizes[i], groups[i] == i), i


@pytest.mark.parametrize("k", [4, 5])
def test_documents_equal_brute_force(spark, texts, k):
    _check(spark, [texts[i] for i in sorted(texts)], k)


def test_borderline_similarities(spark):
    """Pairs whose similarity is 0.8 exactly, and just under."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        own = [f"{w}x{i}" for w in words[:104]]
        texts += [" ".join(own), " ".join(own[: 104 - 20]), " ".join(own[: 104 - 21])]
    _check(spark, texts)


def test_chains_reach_their_end(spark):
    words = [f"w{i}" for i in range(600)]
    _check(spark, [" ".join(words[i * 8 : i * 8 + 100]) for i in range(60)])


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Two large groups with a common passage, whose members drift, in small blocks."""
    monkeypatch.setattr(N, "SHORT_LIST", 3)
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for group in range(3):
        base = passage + [f"g{group}w{i}" for i in range(90)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(30, 120)] = f"n{rng.random()}"
            texts.append(" ".join(own))
    texts += [" ".join(passage + [f"s{j}w{i}" for i in range(60)]) for j in range(40)]
    _check(spark, texts)


def test_residue_finds_every_link_across_blocks(spark, monkeypatch):
    """Chains in one long list, of which nothing is linked yet, in blocks of four."""
    monkeypatch.setattr(N, "BLOCK", 4)
    runs = [(a, a + 60) for a in range(0, 30, 2)] + [(a, a + 60) for a in range(500, 530, 3)]
    sets = [N.shingle_set(" ".join(f"w{i}" for i in range(*r)), 5) for r in runs]
    rows = [(i, [int(t) for t in N.signature(s)]) for i, s in enumerate(sets)]
    token = 12345
    for row in rows:
        row[1][0] = token
    classes = spark.createDataFrame(rows, "cid long, postings array<long>")
    lists = spark.createDataFrame([(token, i) for i in range(len(sets))], "token long, cid long")
    comps = spark.createDataFrame([], "cid long, comp long")
    raw = [(i, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    full = spark.createDataFrame(raw, "cid long, own binary")
    links = N._list_residue(lists, comps, classes, full, 80).collect()
    parent = list(range(len(sets)))
    for r in links:
        a, b = parent[r.a], parent[r.b]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert parent == [0] * 15 + [15] * 10


def test_shingle_rule():
    assert len(N.shingle_set("A b\tC\x0bd e", 4)) == 2
    assert set(N.shingle_set("ONE two", 4)) == set(N.shingle_set("one  TWO", 4))
    assert len(N.shingle_set("É x", 4)) == 1 and set(N.shingle_set("É x", 4)) != set(N.shingle_set("é x", 4))
    # Other white space belongs to words.
    assert len(N.shingle_set("a b c d e f", 4)) == len(shingles("a b c d e f", 4)) == 1
    assert len(N.shingle_set(None, 4)) == len(N.shingle_set(" \n", 4)) == 0


def test_odd_rows(spark, odd_documents, no_documents):
    rows = N.near_duplicates(odd_documents, 5, 80).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == 1
    for doc in (3, 4, 5):
        assert (by_id[doc].n_shingles, by_id[doc].component_id, by_id[doc].kept) == (0, doc, True)
    assert N.near_duplicates(no_documents, 5, 80).count() == 0


def test_one_of_each_group_stays(spark, odd_documents):
    kept = N.without_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a b c d e f g h i j")] * 4 + [(5, "another text altogether with its own words")] + [(None, "a b c d e f g h i j")] * 3
    kept = N.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text[:1] for r in kept) == ["a", "a"] and {r.doc_id for r in kept} == {5}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "a long, b long")
    got = {r.cid: r.comp for r in N.components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def test_near_copies_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (0, 99)] + ["nothing like it " * 9, " ".join(f"v{i}" for i in range(50))]
    texts += [texts[3] + " more"]
    groups, _ = near_groups(texts, 5, 80)
    assert groups[1] == groups[0] and groups[4] == groups[3] and groups[2] == 2
    ids = [7, None, 9, None, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows = [(r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(7, 7), (None, 7), (9, 9), (None, None), (None, None)]))
    kept = [(r.doc_id, r.text) for r in N.without_duplicates(docs).collect()]
    assert len(kept) == 3 and {(7, texts[0]), (9, texts[2])} <= set(kept)


def test_words_remembered_are_short_and_counted(monkeypatch):
    words = N._WordHashes()
    for i in range(300):
        N.shingle_set("x" * 20_000 + str(i), 4, words)
    assert not words
    monkeypatch.setattr(N, "_MEMORY", 100)
    text = " ".join(f"w{i}" for i in range(1_000))
    assert (N.shingle_set(text, 4, words) == N.shingle_set(text, 4)).all() and len(words) <= 100
