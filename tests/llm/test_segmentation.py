import random

import pytest

from tiltscale.llm import segmentation as G


@pytest.fixture(scope="module")
def pieces():
    return G.Pieces(G.default_path(), 6)


def _ways(pieces, text):
    """Scores of all segmentations, the best first."""
    memo = {len(text): [0.0]}
    for at in range(len(text) - 1, -1, -1):
        own = []
        for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
            piece = pieces.score.get(text[at:end])
            if piece:
                own += [piece[1] + s for s in memo[end]]
        if text[at] not in pieces.score:
            own += [pieces.byte_score * len(text[at].encode()) + s for s in memo[at + 1]]
        memo[at] = sorted(own, reverse=True)[:50]
    return memo[0][: pieces.n_best]


def _same(got, want):
    return len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want))


def test_search_equals_brute_force(pieces):
    rng = random.Random(1)
    for _ in range(300):
        word = G.SPACE + "".join(rng.choice("thenaiosr💥é") for _ in range(rng.randint(1, 10)))
        assert _same([s for s, _ in pieces.search(word)], _ways(pieces, word)), word


def test_whole_texts_equal_brute_force(pieces):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("then a\né") for _ in range(rng.randint(1, 30)))
        found = pieces.encode(text)
        assert _same([s for s, _ in found], _ways(pieces, G.SPACE + text.replace(" ", G.SPACE))), text
        assert len({i for _, i in found}) == len(found)
        assert all(pieces.decode(i) == text for _, i in found)


def test_forward_pass_equals_search(pieces):
    rng = random.Random(4)
    words = {G.SPACE + "".join(rng.choice("etaoinshr,.é💥") for _ in range(rng.randint(1, 20))) for _ in range(400)}
    pieces.memory.clear()
    pieces.learn(words)
    for word in words & set(pieces.memory):
        ids, loss, top = pieces.memory[word]
        found = pieces.search(word)
        assert abs(found[0][0] - top) < 1e-6
        assert loss == float("inf") if len(found) == 1 else abs(found[0][0] - found[1][0] - loss) < 1e-6
        assert pieces.decode(ids) == word.replace(G.SPACE, " ")[1:]


def test_documents_are_restored(spark, documents, texts):
    rows = G.segment(documents, with_ids=True).collect()
    assert len(rows) == len(texts)
    assert all(r.restored for r in rows)
    for r in rows:
        assert list(r.scores) == sorted(r.scores, reverse=True) and len(r.ids_crc32) == len(r.scores) <= G.N_BEST
        assert r.n_tokens == len(r.ids[0])


def test_odd_rows(spark, odd_documents, no_documents):
    rows = G.segment(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r.restored for r in rows)
    assert {(r.n_tokens, len(r.scores)) for r in rows if r.doc_id in (3, 4)} == {(0, 0)}
    assert G.segment(no_documents).collect() == []
