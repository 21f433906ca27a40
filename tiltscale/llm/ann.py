"""Approximate nearest neighbours by multi-index hashing.

Rotations learned from a sample turn vectors into binary codes (iterative quantisation).
A code is split into substrings, each with an index of its own.  Two codes that differ in
at most ``r`` of their bits differ in at most ``r // m`` bits of at least one of ``m``
substrings, so probing every index to that distance retrieves every code within the
radius.  What is retrieved is ranked by the cosine of the vectors themselves.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tiltscale.llm.vectors import best, in_blocks, usable

# Rows the codes are fitted to, and of those the queries the radius is measured with.
SAMPLE_ROWS = 4_096
SAMPLE_QUERIES = 512
BITS = 256
SUBSTRING_BITS = 16
# Share of a sample query's true neighbours that the radius has to take in.
WITHIN = 0.98
_ROUNDS = 20
_QUERIES_AT_ONCE = 32


def _unit(x):
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Codes:
    """Rotations and radius, learned from a sample of vectors."""

    def __init__(self, sample, k, bits=BITS):
        x = _unit(np.asarray(sample, float))
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        axes = np.linalg.svd(centred, full_matrices=False)[2]
        width = len(axes)
        turns = []
        for seed in range(-(-bits // width)):
            turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
            flat = centred @ axes.T
            for _ in range(_ROUNDS):
                # The rotation that brings the sample closest to the corners it falls to.
                u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ w).T
            turns.append(axes.T @ turn)
        self.planes = np.hstack(turns)[:, :bits]
        self.radius = self._fit_radius(x, k)

    def _fit_radius(self, x, k):
        codes = self.words(x)
        asked = min(len(x), SAMPLE_QUERIES)
        cosines = x[:asked] @ x.T
        np.fill_diagonal(cosines[:, :asked], -np.inf)
        near = np.argsort(-cosines, axis=1)[:, : min(k, len(x) - 1)]
        if near.size == 0:
            return self.planes.shape[1]
        apart = np.bitwise_count(codes[:asked, None, :] ^ codes[near]).sum(axis=2)
        return int(np.quantile(apart, WITHIN, method="higher"))

    def words(self, unit):
        """Codes of unit vectors, in substrings of 16 bits."""
        bits = (unit - self.mean) @ self.planes >= 0
        pad = -bits.shape[1] % SUBSTRING_BITS
        packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
        return np.ascontiguousarray(packed).view(np.uint16)


class Index:
    """An index per substring over the codes of a block of vectors."""

    def __init__(self, words):
        self.words = words
        self.keys, self.places = zip(*(np.unique(column, return_inverse=True) for column in words.T))

    def within(self, asked, radius):
        """Mask of the codes that some index has within the share of ``radius`` of a substring."""
        share = radius // len(self.keys)
        hit = np.zeros((len(asked), len(self.words)), bool)
        for j, (keys, places) in enumerate(zip(self.keys, self.places)):
            probed = np.bitwise_count(keys[None, :] ^ asked[:, j, None]) <= share
            hit |= probed[:, places]
        return hit


def _search(codes, k):
    def search(queries, rows):
        out = []
        if len(queries) and len(rows):
            ids, asked = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            x, q = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            lengths, own = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
            words, probes = codes.words(_unit(x)), codes.words(_unit(q))
            index = Index(words)
            names, name = np.unique(ids, return_inverse=True)
            shared = len(names) < len(ids)
            for at in range(0, len(q), _QUERIES_AT_ONCE):
                some = slice(at, at + _QUERIES_AT_ONCE)
                others = asked[some, None] != ids[None, :]
                hit = index.within(probes[some], codes.radius) & others
                apart = np.full(hit.shape, np.iinfo(np.uint16).max, np.uint16)
                a, b = np.nonzero(hit)
                apart[a, b] = np.bitwise_count(probes[some][a] ^ words[b]).sum(axis=1)
                hit &= apart <= codes.radius
                # A query with too few finds takes its nearest codes, however far they are.
                finds = np.array([len(np.unique(name[h])) for h in hit]) if shared else hit.sum(axis=1)
                for i in np.flatnonzero(finds < k):
                    far = np.where(others[i], np.bitwise_count(probes[some][i] ^ words).sum(axis=1), np.iinfo(np.int64).max)
                    # Rows that share an id are as near as the nearest of them.
                    least = np.full(len(names), far.max(), far.dtype)
                    np.minimum.at(least, name, far)
                    reach = np.sort(least)[min(k, len(np.unique(name[others[i]]))) - 1] if others[i].any() else -1
                    hit[i] = others[i] & (far <= reach)
                a, b = np.nonzero(hit)
                score = np.einsum("ij,ij->i", q[some][a], x[b]) / (own[some][a] * lengths[b])
                order = np.lexsort((ids[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                if shared:
                    once = ~pd.DataFrame({"a": a, "name": name[b]}).duplicated().to_numpy()
                    a, b, score = a[once], b[once], score[once]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                keep = place < k
                out.append(pd.DataFrame({"query_id": asked[some][a[keep]], "vec_id": ids[b[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return search


def fit(rows, k, sample_rows=SAMPLE_ROWS):
    """Codes learned from the ``sample_rows`` rows with the lowest hash; None without two rows."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).collect()
    return Codes([r.v for r in sample], k) if len(sample) > 1 else None


def nearest(vectors, k=5, is_query=None, vec="embedding", key="vec_id"):
    """``[query_id, rank, vec_id, score]``: the ``k`` nearest found of each query, by cosine.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows with another id.
    Rows that are null, zero or hold a null or non-finite component take no part.  Rows
    that share an id count once, with the best score.  Every block of rows gives a query
    its ``k`` nearest at least, so fewer come back only where there are fewer rows.
    """
    rows, dimension = usable(vectors, vec, key, allow_zero=False)
    schema = "query_id long, vec_id long, score double"
    codes = fit(rows, k) if dimension else None
    if codes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(is_query) if is_query is not None else rows
    return best(in_blocks(rows, queries, _search(codes, k), schema), k)
