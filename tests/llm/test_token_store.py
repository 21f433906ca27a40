import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tiltscale.llm import token_store as S
from tiltscale.llm.tokens import default_path


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.arange(n) * 7919 - 3
    hashes = S._hashes(keys, np.zeros(n, bool), np.zeros(n, np.int64))
    slots = S.find_slots(hashes, S.build_hash(hashes), n)
    assert sorted(slots.tolist()) == list(range(n))


@pytest.fixture(scope="module")
def store(spark, documents, tmp_path_factory):
    return S.write_store(documents.repartition(4), str(tmp_path_factory.mktemp("store") / "x"), shard_ids=20_000)


def _ids(texts):
    tokenizer = Tokenizer.from_file(default_path())
    return {doc: tokenizer.encode(text or "", add_special_tokens=False).ids + [2] for doc, text in texts.items()}


def test_round_trip(spark, store, texts):
    rows = sorted(S.read_back(spark, store).collect())
    want, start = [], 0
    for doc, ids in sorted(_ids(texts).items()):
        want.append((doc, 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want


def test_keyed_access(spark, store, texts):
    wanted = [*sorted(texts)[::17], -5, 10**12]
    got = {r.doc_id: r.ids for r in S.get(spark, store, spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()}
    ids = _ids(texts)
    assert got == {w: ids[w] for w in wanted if w in ids}


def test_keyed_access_beyond_the_directory(spark, store, texts, monkeypatch):
    monkeypatch.setattr(S, "DIRECTORY_ROWS", 1)
    wanted = sorted(texts)[::29]
    got = {r.doc_id: r.ids for r in S.get(spark, store, spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()}
    ids = _ids(texts)
    assert got == {w: ids[w] for w in wanted}


def test_odd_rows(spark, odd_documents, no_documents, tmp_path):
    path = S.write_store(odd_documents, str(tmp_path / "odd"))
    rows = S.read_back(spark, path).collect()
    assert len(rows) == odd_documents.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert sorted(r.copy for r in rows if r.doc_id == 2) == [0, 1]
    assert min(r.start for r in rows if r.doc_id is None) == 0
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    none = spark.createDataFrame([(None,), (10,)], "doc_id long")
    assert {r.doc_id for r in S.get(spark, path, none).collect()} == {None, 10}
    path = S.write_store(no_documents, str(tmp_path / "none"))
    assert S.read_back(spark, path).count() == 0
