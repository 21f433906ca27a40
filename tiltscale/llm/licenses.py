"""License notices in texts, by patience alignment with templates.

Text and template are aligned like two versions of a file: words that are unique in both
are anchors, the longest run of anchors in the same order stands, and the gaps between
them are aligned in the same way.  Where a gap has no anchor, equal words at its two ends
are matched.  The share of a template's words that find a partner is its coverage.

Coverage alone does not tell a license from its neighbours, which may differ in one word.
The naming words of a template (license family, version, NC/SA/ND, Lesser/Affero, words of
a clause) must each be matched, and where the text has a naming word between them that finds
no partner, it is another license.

A notice may stand anywhere in a text, and more than once.  Words that a notice cannot do
without say where to look; around each a window of the template's length is aligned, and
widened until the notice is found, or neither its coverage rises nor the window is short.
"""

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.llm.license_texts import templates

TEMPLATES = templates()
# Words that are telling, by their stems.
STEMS = ("licens", "permission", "permitted", "redistribut", "reserved", "released")
COVERAGE = 0.8
# Windows grow to so many lengths of the template on either side, and on while coverage rises.
REACH = 4

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)*?)(?:\.0)*")
# One word, however it is written.
_SPELLINGS = {"v": "version", "noderivs": "noderivatives"}
_SPLIT = {
    ("non", "commercial"): "noncommercial", ("share", "alike"): "sharealike", ("no", "derivatives"): "noderivatives",
    ("no", "derivs"): "noderivatives", ("no", "derivative"): "noderivatives",
}
# Words that name a family: they must be matched.
_NAMES = {"apache", "mit", "mozilla", "mpl", "gnu", "gpl", "lgpl", "agpl", "cc", "cc0", "creative", "commons", "general", "public"}
# Words that tell members of a family apart: they must be matched, and no other may come between.
_VARIANTS = {
    "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "lesser", "affero", "attribution",
    "substantial", "advertising", "endorse", "evil",
}
# The same of words that tell in one place only: behind these.
_BEHIND = {"library": {"gnu"}, "by": {"cc", "commons"}}


def words_with_places(text):
    """Words in lower case, in one spelling, with where they start and end."""
    out = []
    for m in _WORD.finditer(text):
        word, start, end = m.group().lower(), m.start(), m.end()
        if number := _VERSION.fullmatch(word):
            word = number.group(1)
        word = _SPELLINGS.get(word, word)
        if out and (joined := _SPLIT.get((out[-1][0], word))):
            word, start = joined, out.pop()[1]
        out.append((word, start, end))
    return out


def _is_variant(words, i, heads=("version", "by", "license")):
    """Whether ``words[i]`` tells a license from others of its family; a number does behind a name or ``heads``."""
    word, before = words[i], words[i - 1] if i else ""
    if word in _BEHIND:
        return before in _BEHIND[word]
    if word[0].isdigit():
        return _VERSION.fullmatch(word) is not None and (before in heads or before in _NAMES or before in _VARIANTS)
    return word in _VARIANTS


def _longest_rising(pairs):
    """The longest run of ``(i, j)`` rising in both; ``pairs`` are in order of ``i``, each ``j`` once."""
    tops, piles, back = [], [], {}
    for pair in pairs:
        at = bisect_left(tops, pair[1])
        if at == len(tops):
            tops.append(pair[1])
            piles.append(pair)
        else:
            tops[at], piles[at] = pair[1], pair
        back[pair] = piles[at - 1] if at else None
    run, pair = [], piles[-1] if piles else None
    while pair is not None:
        run.append(pair)
        pair = back[pair]
    return run[::-1]


def _places(words, lo, hi):
    """Word → its place in ``words[lo:hi]``, or -1 if it is there more than once."""
    places = {}
    for i in range(lo, hi):
        places[words[i]] = -1 if words[i] in places else i
    return places


def align(a, b):
    """Pairs ``(i, j)`` of equal words of two lists, rising in both."""
    matched, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        there = _places(b, b0, b1)
        unique = [(i, there[w]) for w, i in _places(a, a0, a1).items() if i >= 0 and there.get(w, -1) >= 0]
        anchors = _longest_rising(sorted(unique))
        if not anchors:
            continue
        matched += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(matched)


class Template:
    def __init__(self, name, text):
        self.name = name
        self.words = [w for w, _, _ in words_with_places(text)]
        self.telling = any(w.startswith(STEMS) for w in self.words)
        self.counts = Counter(self.words)
        # A number behind "license" may be that of the next clause.
        self.naming = {w for i, w in enumerate(self.words) if w in _NAMES or _is_variant(self.words, i, ("version", "by"))}
        self.by_name = bool(self.naming & (_NAMES - {"mit"}))
        self.slack = max(3, len(self.words) // 2)

    def may_be_in(self, counts, least):
        """Whether a text of these words may have the notice."""
        if not self.naming <= counts.keys():
            return False
        return sum(min(n, counts[w]) for w, n in self.counts.items()) >= least * len(self.words)

    def starts(self, where, least):
        """Where the template's first word would be, for words one of which every notice has."""
        if self.naming:
            word = min(self.naming, key=lambda w: (len(where[w]) * self.counts[w], w))
            places = [at for at, w in enumerate(self.words) if w == word]
        else:
            rare = sorted(range(len(self.words)), key=lambda at: len(where.get(self.words[at], ())))
            places = rare[: int(len(rare) * (1 - least) + 1e-9) + 1]
        return sorted({i - at for at in places for i in where.get(self.words[at], ())})

    def stands(self, words, pairs, least):
        """Whether matched ``pairs`` of places make the notice, and no other of its family."""
        if len(pairs) < least * len(self.words) or not pairs:
            return False
        named = [i for i, j in pairs if self.words[j] in self.naming]
        if {words[i] for i in named} != self.naming:
            return False
        # A license that goes by its clauses may have a telling word anywhere.
        first, last = (named[0], named[-1]) if self.by_name else (pairs[0][0], pairs[-1][0])
        matched = {i for i, _ in pairs}
        return not any(i not in matched and _is_variant(words, i) for i in range(first, last + 1))


def _notices(text, templates, least):
    """``(name, coverage, start, end)`` of the notices in a text, by place."""
    placed = words_with_places(text)
    words = [w for w, _, _ in placed]
    where = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    counts = Counter(words)
    good = set()
    for template in templates:
        if not template.may_be_in(counts, least):
            continue
        size, seen = len(template.words), None
        for at in template.starts(where, least):
            # Windows that begin nearly together see the same notice.
            if seen is not None and size > 50 and at - seen <= template.slack // 4:
                continue
            seen = at
            slack, most = template.slack, 0
            while True:
                lo, hi = max(0, at - slack), min(len(words), at + size + slack)
                pairs = [(lo + i, j) for i, j in align(words[lo:hi], template.words)]
                if template.stands(words, pairs, least):
                    good.add((-len(pairs), -len(pairs) / size, pairs[0][0], pairs[-1][0], template.name))
                    break
                if (slack >= REACH * size and len(pairs) <= most) or (lo == 0 and hi == len(words)):
                    break
                slack, most = 2 * slack, max(most, len(pairs))
    # Windows overlap, and so do templates; of notices that share words the longest stands.
    found, taken = [], set()
    for _, share, first, last, name in sorted(good):
        if taken.isdisjoint(range(first, last + 1)):
            taken.update(range(first, last + 1))
            found.append((name, -share, placed[first][1], placed[last][2]))
    return sorted(found, key=lambda f: f[2])


def scan(docs, templates=None, least=COVERAGE, key="doc_id", text="text"):
    """``[doc_id, license, coverage, start, end]``: a row per notice, with its place in code points.

    ``templates`` maps names to a wording or a list of them, each with a telling word.  A null or empty text has
    no notice.  Texts without a telling word, which every template has, are left out
    before they reach Python.
    """
    named = [(name, [own] if isinstance(own, str) else own) for name, own in (templates or TEMPLATES).items()]
    known = [Template(name, wording) for name, wordings in named for wording in wordings]
    if silent := [t.name for t in known if not t.telling]:
        raise ValueError(f"no telling word in {', '.join(silent)}")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()),
    ])

    def look(batches):
        for batch in batches:
            rows = []
            for doc, whole in zip(batch.column(0), batch.column(1)):
                rows += [(doc.as_py(), *notice) for notice in _notices(whole.as_py(), known, least)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    telling = slim.where(F.col("text").rlike("(?iu)" + "|".join(STEMS)))
    return telling.mapInArrow(look, "doc_id long, license string, coverage double, start long, end long")
