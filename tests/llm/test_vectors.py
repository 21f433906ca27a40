import math
import os

import numpy as np
import pytest

from tiltscale.llm import ann, metric_topk

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def _table(df):
    rows = df.collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def _best(ids, scores, own, k=5):
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != own][:k]


def _by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores_of_nearest(spark, embeddings):
    ids, x = _table(embeddings)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    got = _by_query(ann.nearest(embeddings, 5, "vec_id % 50 = 0").collect())
    hits = 0
    for at in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[at]
        own, place = got[ids[at]], {int(i): s for i, s in zip(ids, scores)}
        assert len(own) == 5 and all(math.isclose(s, place[v], abs_tol=1e-12) for v, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        hits += len({v for v, _ in own} & {v for v, _ in _best(ids, scores, ids[at])})
    assert hits >= 0.9 * 5 * len(got)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = ann.Codes(rng.standard_normal((300, 16)), 5, bits=64)
    words = rng.integers(0, 2**16, (400, 4)).astype(np.uint16)
    words[200:] = words[:200] ^ (1 << rng.integers(0, 16, (200, 4))).astype(np.uint16)
    for radius in (0, 3, 4, 9, 20):
        hit = ann.Index(words).within(words[:50], radius)
        apart = np.bitwise_count(words[:50, None, :] ^ words[None]).sum(axis=2)
        assert hit[apart <= radius].all()
    assert 0 <= codes.radius <= 64


def test_products_equal_brute_force(spark, embeddings):
    ids, x = _table(embeddings)
    whole = np.floor(256 * x).astype(np.int64)
    got = _by_query(metric_topk.top_products(embeddings, 5, "vec_id % 50 = 0").collect())
    for at in np.flatnonzero(ids % 50 == 0):
        assert got[ids[at]] == _best(ids, whole @ whole[at], ids[at])


def test_tree_with_ties_and_equal_vectors():
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([3.0, 4.0, 0.0], (500, 1)), rng.integers(-4, 5, (700, 3)).astype(float)])
    top = (x * x).sum(axis=1).max()
    tree = metric_topk.Tree(np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))[:, None]]), page=16)
    assert sorted(tree.order) == list(range(len(x)))
    ids, own = rng.permutation(len(x)), x[tree.order]
    for q in rng.integers(-4, 5, (40, 3)).astype(float):
        allowed = rng.random(len(x)) < 0.9
        found = tree.search(np.append(q, 0), 5, lambda at, q=q: own[at] @ q, lambda s, q=q: np.sqrt(max(0, q @ q + top - 2 * s)), allowed)
        want = sorted((-(own[i] @ q), ids[i]) for i in np.flatnonzero(allowed))[:5]
        assert sorted((-s, ids[i]) for s, i in found)[:5] == want


@pytest.mark.parametrize("search", [ann.nearest, metric_topk.top_products])
def test_odd_vectors(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (50, [0.0, 1.0]), (10, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("score", df.vec_id).withColumn("rank", df.vec_id)
    got = _by_query(search(df, 5, "vec_id % 50 = 0").collect())
    zero = search is metric_topk.top_products
    assert set(got) == {0, 50}
    assert {v for v, _ in got[0]} == {1, 2, 9, 50} | ({10} if zero else set())
    assert got[0][0][0] == 1 and got[50][0][0] == 2
    assert search(df.where("vec_id < 0"), 5).collect() == []
    assert search(df.where("vec_id = 0"), 5).collect() == []


def test_blocks_of_queries_and_rows(spark, embeddings, monkeypatch):
    from tiltscale.llm import vectors

    monkeypatch.setattr(vectors, "DATA_BLOCK", 60)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    ids, x = _table(embeddings)
    whole = np.floor(256 * x).astype(np.int64)
    got = _by_query(metric_topk.top_products(embeddings, 3, "vec_id % 20 = 0").collect())
    for at in np.flatnonzero(ids % 20 == 0):
        assert got[ids[at]] == _best(ids, whole @ whole[at], ids[at], 3)


@pytest.mark.parametrize("search", [ann.nearest, metric_topk.top_products])
def test_an_id_over_many_vectors_counts_once(spark, search):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(8)] + [(2 + i, [0.5, 0.1 * i + 0.1]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = _by_query(search(df, 5, "vec_id = 0").collect())[0]
    assert len({i for i, _ in got}) == 5 and got[0][0] == 1
    if search is ann.nearest:
        assert {i for i, _ in got} == {1, 2, 3, 4, 5}
    else:
        # Each of the others has the same product; the lesser ids stand.
        assert [i for i, _ in got] == [1, 2, 3, 4, 5]
