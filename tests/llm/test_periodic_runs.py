import hashlib
import random
import re
import zlib

import numpy as np

from tiltscale.llm import periodic_runs
from tiltscale.llm.recompression import Grammar


def runs_by_search(words):
    """Each period tried at each place; of equal stretches the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items())


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_search(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest(),
    )


def _rows(df):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted(((r.doc_id, *[r[n] for n in names]) for r in df.collect()), key=str)


def test_common_extensions():
    rng = random.Random(2)
    for _ in range(150):
        n, letters = rng.randint(1, 50), rng.choice([1, 2, 3, 8])
        s = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            p, start = rng.randint(1, 6), rng.randrange(n)
            s[start:] = [s[start + i % p] if start + i % p < n else 0 for i in range(n - start)]
        grammar = Grammar(s)
        one, other = np.repeat(np.arange(n + 1), n + 1), np.tile(np.arange(n + 1), n + 1)

        def ahead(i, j):
            k = 0
            while max(i, j) + k < n and s[i + k] == s[j + k]:
                k += 1
            return k

        def behind(i, j):
            k = 0
            while min(i, j) - k > 0 and s[i - k - 1] == s[j - k - 1]:
                k += 1
            return k

        assert grammar.ahead(one, other).tolist() == [ahead(i, j) for i, j in zip(one, other)]
        assert grammar.behind(one, other).tolist() == [behind(i, j) for i, j in zip(one, other)]


def test_runs_of_several_texts():
    rng = random.Random(4)

    def some():
        n, letters = rng.choice([0, 1, 5, 6, 10, 60, 200]), rng.choice([1, 2, 3, 8])
        s = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n:
                p, start = rng.randint(1, 9), rng.randrange(n)
                for i in range(start, min(n, start + rng.randint(1, 60))):
                    s[i] = s[start + (i - start) % p]
        return s

    for _ in range(120):
        texts = [some() for _ in range(rng.randint(1, 12))]
        found = periodic_runs.runs_in([np.array(t, np.int64) for t in texts])
        assert [list(map(tuple, f.tolist())) for f in found] == [runs_by_search(t) for t in texts]


def test_documents_equal_brute_force(documents, texts):
    short = {i: t for i, t in texts.items() if len(t or "") < 15_000}
    rows = [r for r in _rows(periodic_runs.report(documents)) if r[0] in short]
    assert rows == sorted(((i, *expected(i, t)) for i, t in short.items()), key=str)
    assert any(r[1] for r in rows)


def test_periods_are_planted_and_found(spark):
    """Texts of many ids, so that a tenth is changed, of runs that touch, overlap and nest."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        words += ["x", "y"] * rng.randint(0, 6) + ["x"] * rng.randint(0, 8)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(None, "a " * 8), (None, "a " * 8), (-7, " \n"), (10**15, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(periodic_runs.report(df)) == sorted(((i, *expected(i, t)) for i, t in rows), key=str)


def test_long_texts(spark):
    rows = [(1, "word " * 60_000), (2, "a b c " * 20_000), (3, " ".join(map(str, range(100_000)))), (4, "x" * 500_000)]
    found = periodic_runs.find(spark.createDataFrame(rows, "id long, text string"))
    got = {r.id: [tuple(x) for x in r.runs] for r in found.select("doc.id", "found.runs").collect()}
    assert got == {1: [(0, 60_000, 1)], 2: [(0, 60_000, 3)], 3: [], 4: []}


def test_collapsing_keeps_other_texts(spark):
    rows = [(1, "say  it it it it it it now", 5), (2, "as  it is", 6), (3, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found long")
    got = {r.doc_id: (r.text, r.found) for r in periodic_runs.collapse(df).collect()}
    assert got == {1: ("say it now", 5), 2: ("as  it is", 6), 3: (None, 7)}


def test_odd_rows(odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *expected(r.doc_id, r.text)) for r in rows if len(r.text or "") < 50_000), key=str)
    short = [r for r in _rows(periodic_runs.report(odd_documents)) if r[0] not in (8, 9)]
    assert short == [w for w in want if w[0] not in (8, 9)]
    assert periodic_runs.report(odd_documents).count() == odd_documents.count()
    assert periodic_runs.report(no_documents).count() == 0
