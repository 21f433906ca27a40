import math
import zlib
from itertools import product

import numpy as np

from tiltscale.llm import hilbert as H


def test_curve_visits_every_cell_by_neighbours():
    for dimensions, bits in ((2, 4), (3, 3)):
        points = np.array(list(product(range(2**bits), repeat=dimensions)))
        index = H.hilbert_index(points.T, bits)
        assert sorted(index) == list(range(len(points)))
        walk = points[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def _check(rows, n, shards=16):
    assert len(rows) == n
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r.slot)
    counts = [len(places.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for own in places.values():
        assert sorted(own) == list(range(len(own)))
    assert not places or 0 <= min(places) and max(places) < shards


def test_documents(spark, documents, texts):
    rows = H.shard_by_curve(documents).collect()
    _check(rows, len(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    order = sorted(rows, key=lambda r: (r["shard"], r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_files_can_be_pruned(spark, documents):
    """A shard spans less of each dimension than its share of a random cut would."""
    rows = H.shard_by_curve(documents).join(documents, "doc_id").collect()
    for name, share in (("lang", 0.9), ("source", 0.8)):
        shards = {}
        for r in rows:
            shards.setdefault(r["shard"], set()).add(r[name])
        everything = len({r[name] for r in rows})
        assert sum(map(len, shards.values())) / len(shards) <= share * everything


def test_one_text_holds_most_rows(spark):
    rows = [(i, "same", "en", "a") for i in range(2000)] + [(5000 + i, "x" * i, "fr", "b") for i in range(111)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    _check(H.shard_by_curve(df, shards=7).collect(), len(rows), 7)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = H.shard_by_curve(odd_documents).collect()
    _check(rows, odd_documents.count())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}
    assert H.shard_by_curve(no_documents).collect() == []
    assert math.isfinite(sum(r.size for r in rows))
