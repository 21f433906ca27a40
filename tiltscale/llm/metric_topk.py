"""Exact top-k by inner product, by best-first search of M-trees.

Inner products become distances: with a coordinate added that brings every vector to the
norm of the longest, ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, so the nearest vectors are those of
the highest product.  Each block of vectors is an M-tree of pages.  An entry of a page has a
routing vector, the radius that covers what lies beneath, and the distance to the routing
vector of the page above.  By the triangle inequality those two stored numbers rule most
entries out before their distance to the query is computed, and the search ends when the
nearest page left cannot hold a better vector.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tiltscale.llm.vectors import best, in_blocks, usable

PAGE = 256
# Room for rounding in distances; bounds are widened by it, so that it costs no result.
_SLACK = 1e-6


class Tree:
    """An M-tree over rows of ``points``, loaded from the top down."""

    def __init__(self, points, page=PAGE):
        self.points, self.page = points, page
        # Rows in the order of the leaves, so that a leaf is a slice of them.
        self.pages, self.leaves, self.loaded = [], [], 0
        everything = np.arange(len(points))
        self.root = self._load(everything, 0)
        self.order = np.concatenate(self.leaves)

    def _apart(self, rows, centre):
        gap = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _load(self, rows, centre):
        """Page for ``rows`` under a routing vector; its number.

        A leaf holds a slice of ``order``; an inner page holds routing vectors, radii and
        pages.  Both hold the distances to ``centre``.
        """
        number = len(self.pages)
        self.pages.append(None)
        if len(rows) <= self.page:
            self.pages[number] = (True, self.loaded, self._apart(rows, centre), None, None)
            self.leaves.append(rows)
            self.loaded += len(rows)
            return number
        count = min(self.page, -(-len(rows) // self.page))
        # Spread routing vectors: each is the row farthest from those before.
        heads, far = [], self._apart(rows, centre)
        nearest, belongs = np.full(len(rows), np.inf), np.zeros(len(rows), int)
        for i in range(max(2, count)):
            at = int(np.argmax(far))
            heads.append(int(rows[at]))
            own = self._apart(rows, rows[at])
            closer = own < nearest
            nearest[closer], belongs[closer] = own[closer], i
            far = nearest
        sizes = np.bincount(belongs, minlength=len(heads))
        if sizes.max() == len(rows):
            # Equal vectors: cut by number.
            belongs = np.arange(len(rows)) * len(heads) // len(rows)
        centres, radii, children = [], [], []
        for i, head in enumerate(heads):
            own = rows[belongs == i]
            if len(own):
                centres.append(head)
                radii.append(self._apart(own, head).max())
                children.append(self._load(own, head))
        centres = np.array(centres)
        self.pages[number] = (False, centres, self._apart(centres, centre), np.array(radii), children)
        return number

    def search(self, query, k, score, distance, allowed, ids=None):
        """The ``k`` best places of ``order``, with those that tie with the last: ``[(score, place)]``.

        ``query`` is in the tree's space.  ``score`` takes a slice or an array of places,
        ``distance`` gives the distance that a score stands for, and ``allowed`` marks places
        that may be found.  Places of equal ``ids`` count once, with the best score.
        """
        found, last, worst = [], -np.inf, np.inf

        def to_query(rows):
            gap = self.points[rows] - query
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        queue = [(0.0, self.root, float(to_query(np.array([0]))[0]))]
        while queue:
            bound, number, above = heapq.heappop(queue)
            if bound > worst + _SLACK:
                break
            leaf, rows, apart, radii, children = self.pages[number]
            reach = np.abs(above - apart)
            if leaf:
                near = reach <= worst + _SLACK
                if near.all():
                    places = np.arange(rows, rows + len(apart))
                    scores = score(slice(rows, rows + len(apart)))
                else:
                    places = rows + np.flatnonzero(near)
                    scores = score(places)
                good = np.flatnonzero((scores >= last) & allowed[places])
                if len(good):
                    found += zip(scores[good].tolist(), places[good].tolist())
                    if len(found) >= k:
                        found.sort(key=lambda x: -x[0])
                        if ids is not None:
                            once = {}
                            for x in found:
                                once.setdefault(ids[x[1]], x)
                            found = list(once.values())
                    if len(found) >= k:
                        last = found[k - 1][0]
                        found = [x for x in found if x[0] >= last]
                        worst = distance(last)
                continue
            near = np.flatnonzero(reach - radii <= worst + _SLACK)
            own = to_query(rows[near])
            for i, d in zip(near.tolist(), own.tolist()):
                least = max(bound, d - radii[i])
                if least <= worst + _SLACK:
                    heapq.heappush(queue, (least, children[i], d))
        return found


def _search(k):
    def search(queries, rows):
        out = []
        if len(queries) and len(rows):
            asked = queries["vec_id"].to_numpy()
            x, q = (np.stack(df["v"].to_numpy()) for df in (rows, queries))
            norms, lengths = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
            top = norms.max()
            scale = max(1.0, float(np.sqrt(top)), float(np.sqrt(lengths.max())))
            tree = Tree(np.hstack([x, np.sqrt(np.maximum(0, top - norms))[:, None]]) / scale)
            ids, own = rows["vec_id"].to_numpy()[tree.order], x[tree.order]
            shared = ids if len(np.unique(ids)) < len(ids) else None
            # Whole numbers: doubles hold their products exactly up to 2**53, integers beyond.
            if max(top, lengths.max()) >= 2.0**52:
                own, q = own.astype(np.int64), q.astype(np.int64)
            for i in range(len(q)):
                query = np.append(q[i], 0.0) / scale

                def distance(score, length=lengths[i]):
                    return np.sqrt(max(0.0, length + top - 2.0 * score)) / scale

                for s, place in tree.search(query, k, lambda at, v=q[i]: own[at] @ v, distance, ids != asked[i], shared):
                    out.append((asked[i], ids[place], int(s)))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return search


def top_products(vectors, k=5, is_query=None, scale=256, vec="embedding", key="vec_id"):
    """``[query_id, rank, vec_id, score]``: the ``k`` highest inner products of each query.

    Components count as ``floor(scale * x)``.  ``is_query`` is a condition on ``vec_id``;
    candidates are all rows with another id.  Rows that are null or hold a null or
    non-finite component take no part; rows that share an id count once, with the best
    score.
    """
    rows, dimension = usable(vectors, vec, key)
    if not dimension:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = F.transform("v", lambda x: F.floor(x * float(scale)).cast("double"))
    rows = rows.select("vec_id", whole.alias("v"))
    queries = rows.where(is_query) if is_query is not None else rows
    return best(in_blocks(rows, queries, _search(k), "query_id long, vec_id long, score long"), k)
