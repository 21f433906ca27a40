import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from tiltscale.llm import token_alignment as ta


@pytest.fixture(scope="module")
def encoders():
    return ta.Encoders(*ta.default_paths())


def plain(encoders, text):
    """Groups of ids by the ends that both sides share, with the tokenizers as they are."""
    data = (" " + (text or "")).encode()
    if not text:
        return None
    a = encoders.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    pieces = [[encoders.bytes[side][i] for i in ids] for side, ids in enumerate((a, b))]
    if any(b"".join(p) != data for p in pieces):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
    groups = [defaultdict(list), defaultdict(list)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    for side, ids in enumerate((a, b)):
        for token, end in zip(ids, ends[side]):
            groups[side][bisect_left(cuts, end)].append(token)
    return [(groups[0][i], groups[1][i]) for i in range(len(cuts))]


def expected(encoders, texts):
    """Rows of all texts, with links, counts and best pairs spelled out."""
    aligned = [plain(encoders, t) for t in texts]
    links = [[(x, y) for a, b in groups or [] for x in a for y in b] for groups in aligned]
    counts = Counter(pair for own in links for pair in set(own))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for groups, own in zip(aligned, links):
        if groups is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own),
            sum(counts[p] == highest[p[0]] for p in own), sum(counts[p] for p in own),
            hashlib.sha256(listed.encode()).hexdigest(),
        )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _check(encoders, df, rows):
    got = sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in df.collect()), key=str)
    want = [(i, *row) for (i, _), row in zip(rows, expected(encoders, [t for _, t in rows]))]
    assert got == sorted(want, key=str)


PARTS = [
    "a", "hello", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "日本語", "💥", "<s>", "</s>", "<|endoftext|>", "▁", "'s", "123", "...",
    "\xa0", "　", "\x1c", "\x85", "the", "\r\n", "ﬁ", "\x00", "​", "x" * 60, "<0x0A>", " world", "Ω", "ñ",
]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_documents_equal_brute_force(encoders, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    _check(encoders, ta.report(documents), rows)


def test_odd_texts_equal_brute_force(spark, encoders):
    texts = ["", " ", "  ", "a ", "\n", "x" * 5000, "ab " * 3000, None, None, "a ", "日" * 2000, "a\n" * 2000, *odd_texts(1200)]
    rows = list(enumerate(texts))
    _check(encoders, ta.report(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_pairs_beyond_the_broadcast(spark, encoders, monkeypatch):
    """The same numbers when no pair, and when every pair, is common."""
    rows = list(enumerate(odd_texts(150, seed=9)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1.0, 0.0, 0.002):
        monkeypatch.setattr(ta, "_HOT_SHARE", share)
        _check(encoders, ta.report(df), rows)


def test_the_fast_encoder_gives_the_tokenizers_ids(encoders, documents):
    assert encoders.a.fast is not None
    texts = [r.text for r in documents.select("text").collect() if r.text] + odd_texts(2000, seed=4)
    rng = random.Random(8)
    letters = "abcdeinorstuéßñçàöü'.,-0123456789 \n"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    want = [e.ids for e in encoders.a.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoders.a.encode(texts) == want


def test_coalescing():
    starts, ends = np.array([4, 0, 2, 0, 9, 6]), np.array([6, 2, 4, 3, 10, 9])
    assert ta.coalesced(starts, ends).tolist() == [1, 0, 0, 0, 3, 2]
    assert ta.coalesced(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_memory_is_bounded_by_bytes(encoders, monkeypatch):
    """Long stretches are not kept; short ones only up to the bound, and results stay the same."""
    aligner = ta.Aligner(encoders)
    long = ["".join(random.Random(i).choices("abcdefgh", k=2000)) for i in range(100)]
    first = aligner.align(long)
    assert not aligner.numbers and aligner.bytes == 0 and len(aligner.known.pairs) == 0
    words = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(50)]
    whole = aligner.align(words)
    monkeypatch.setattr(ta, "_MEMORY", 10_000)
    parts = [aligner.align([text]) for text in words]
    assert len(aligner.numbers) <= 200
    assert [d for p in parts for d in p[1]] == whole[1]
    assert aligner.align(long)[1] == first[1]


def test_odd_rows(spark, encoders, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    _check(encoders, ta.report(odd_documents), rows)
    assert ta.report(no_documents).count() == 0
