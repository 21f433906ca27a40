"""Two tokenizers' tokens of a text, aligned by the bytes they cover.

Both cut the same bytes, a space and the text.  All tokens of both are intervals of bytes,
sorted by start; a running maximum of their ends tells where no token reaches across, and there
a group of tokens ends (interval coalescing).  Every token of one side in a group is linked to
every one of the other.

Neither tokenizer joins a character and a space behind it, so texts are cut there, and the
stretches between, mostly words, are encoded and aligned for themselves; workers remember short
ones, within a bound of bytes.  The links of a text are its stretches' links.  Counts over the
corpus are joins: pairs that fill most rows are broadcast, of which there are so many at most
whatever the corpus is, and the others meet their rows in a shuffle.
"""

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.llm.common import written

# A stretch ends before a space that stands behind something else than white space.
_CUT = re.compile(r"(?<=\S) ")
# Fixed value: how byte-level tokenizers cut a text into words.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\x00-\u024f]*\\Z")
# Stretches of at most so many characters are remembered, up to so many bytes in all.
_SHORT = 48
_MEMORY = 40 * 1024 * 1024
# Bytes a remembered stretch takes beside its texts and pairs.
_OVERHEAD = 300
# Characters of texts, texts, and new stretches that are worked on at once.
_CHARACTERS = 1_000_000
_TEXTS = 4096
_STRETCHES = 20_000
# Pairs that hold more than this share of all rows are broadcast; there are never more than
# one over it.
_HOT_SHARE = 1 / 100_000
# Two token ids in one number; ids are below a million.
_WIDTH = 2**20


def default_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    """Byte → letter of byte-level tokenizers: printable bytes stand for themselves, the rest count on from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ByteEncoder:
    """Ids of texts by a byte-level tokenizer file, without special tokens.

    The tokenizers library keeps much more of a text than its ids.  Where a file has the usual
    cut into words, and its merges are numbered in their order, its vocabulary is a table of ranks,
    and texts in Latin letters go through tiktoken, which gives the same ids at a fraction of the
    cost; others do not, as the libraries may know other versions of Unicode.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_of = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(bytes_of[c] for c in token): n for token, n in vocabulary.items() if set(token) <= bytes_of.keys()}
        # A special token stands for no bytes, and none is made here.
        self.bytes = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for token, number in ranks.items():
            self.bytes[number] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        numbers = [vocabulary["".join(merge)] for merge in merges]
        cut = spec["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.fast = None
        if usual and not spec["normalizer"] and numbers == sorted(numbers):
            import tiktoken

            special = {t["id"] for t in spec["added_tokens"]}
            ranks = {token: number for token, number in ranks.items() if number not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts):
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = [self.fast(text) if _LATIN.match(text) else None for text in texts]
        others = [i for i, found in enumerate(ids) if found is None]
        encodings = self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)
        for i, encoding in zip(others, encodings):
            ids[i] = encoding.ids
        return ids


class Encoders:
    """Both tokenizers, and the bytes that each of their tokens covers."""

    def __init__(self, path_a, path_b):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteEncoder(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(number) for number in range(self.b.get_piece_size())]
        bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()
            for number, piece in enumerate(pieces)
        ]
        self.bytes = (self.a.bytes, bytes_b)
        self.lengths = tuple(np.array(list(map(len, side)), np.int64) for side in self.bytes)
        self.names = list(map(str, range(max(map(len, self.bytes)))))
        self.space = self.b.piece_to_id("▁")
        # Only vocabularies without pieces across the end of a word can be cut there.
        self.cuts = not any(re.search("[^▁]▁", piece) for piece in pieces)

    def encode(self, stretches):
        """Token ids of each stretch, which begins with a space, by side; and which stretches have the same bytes."""
        ids_a = self.a.encode(stretches)
        # This tokenizer puts a space in front by itself, but not in front of nothing.
        ids_b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        ids_b = [[self.space] if s == " " else ids for s, ids in zip(stretches, ids_b)]
        same = np.ones(len(stretches), bool)
        for side, ids in enumerate((ids_a, ids_b)):
            parts = list(map(self.bytes[side].__getitem__, chain.from_iterable(ids)))
            joined, ends = b"".join(parts), _offsets(list(map(len, parts)))
            cuts = ends[_offsets(list(map(len, ids)))].tolist()
            same &= [joined[i:j] == s.encode() for s, i, j in zip(stretches, cuts, cuts[1:])]
        return ids_a, ids_b, same


def coalesced(starts, ends):
    """Group number of intervals: those that reach into one another, directly or by others, share one.

    Intervals that only touch do not.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.append(True, starts[order][1:] >= reach[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def _ranges(first, sizes):
    """The numbers ``first[i], first[i] + 1, …``, ``sizes[i]`` of them, for each i."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _offsets(sizes):
    return np.append(0, np.cumsum(sizes))


def _summed_pairs(owner, pairs, times):
    """``(owner, pair, times)`` with one row per owner and pair, in their order."""
    key, place = np.unique(owner * _WIDTH**2 + pairs, return_inverse=True)
    return key // _WIDTH**2, key % _WIDTH**2, np.bincount(place, times, len(key)).astype(np.int64)


class Alignments:
    """Alignments of many stretches, by column.

    ``rows`` has n_a, n_b, n_groups and n_links of each; ``groups`` its text,
    ``a1,a2|b1;a3|b2,b3``, null for one without tokens; ``pairs`` from ``offsets[i]`` to
    ``offsets[i + 1]`` its linked id pairs, ``a * _WIDTH + b``, and ``times`` how often each.
    """

    def __init__(self, rows=None, groups=(), offsets=(0,), pairs=(), times=()):
        self.rows = np.zeros((0, 4), np.int64) if rows is None else rows
        self.groups = list(groups)
        self.offsets = np.asarray(offsets, np.int64)
        self.pairs, self.times = np.asarray(pairs, np.int64), np.asarray(times, np.int64)

    def added(self, other):
        return Alignments(
            np.concatenate([self.rows, other.rows]), self.groups + other.groups,
            np.concatenate([self.offsets, other.offsets[1:] + self.offsets[-1]]),
            np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times]),
        )

    def first(self, n):
        end = self.offsets[n]
        return Alignments(self.rows[:n], self.groups[:n], self.offsets[: n + 1], self.pairs[:end], self.times[:end])


def aligned(encoded, encoders):
    """``Alignments`` of encodings: ids of A, ids of B, and which of them count; the others get no tokens."""
    *sides, same = encoded
    n = len(same)
    sides = [[ids if good else () for ids, good in zip(side, same.tolist())] for side in sides]
    counts = [np.array(list(map(len, side)), np.int64) for side in sides]
    ids = [np.fromiter(chain.from_iterable(side), np.int64, c.sum()) for side, c in zip(sides, counts)]
    # All stretches lie behind one another; both sides cover the same bytes, so no group crosses over.
    ends = [np.cumsum(lengths[i]) for lengths, i in zip(encoders.lengths, ids)]
    starts = [np.append(0, e[:-1])[: len(e)] for e in ends]
    both = coalesced(np.concatenate(starts), np.concatenate(ends))
    group = [both[: len(ids[0])], both[len(ids[0]) :]]
    total = int(both.max(initial=-1)) + 1
    sizes = [np.bincount(g, minlength=total) for g in group]
    owner = np.zeros(total, np.int64)
    owner[group[0]] = np.repeat(np.arange(n), counts[0])
    n_groups = np.bincount(owner, minlength=n)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, owner, sizes[0] * sizes[1])

    # Ids within a group, each once, meet those of the other side.
    held = [np.unique(g * _WIDTH + i, return_counts=True) for g, i in zip(group, ids)]
    at = [key // _WIDTH for key, _ in held]
    distinct = np.bincount(at[1], minlength=total)
    met = distinct[at[0]]
    other = _ranges((np.cumsum(distinct) - distinct)[at[0]], met)
    pairs = np.repeat(held[0][0] % _WIDTH, met) * _WIDTH + held[1][0][other] % _WIDTH
    times = np.repeat(held[0][1], met) * held[1][1][other]
    of, pairs, times = _summed_pairs(np.repeat(owner[at[0]], met), pairs, times)

    rows = np.column_stack([counts[0], counts[1], n_groups, n_links])
    groups = _texts(ids, group, sizes, counts, encoders.names)
    groups = [text if good else None for text, good in zip(groups, same.tolist())]
    return Alignments(rows, groups, _offsets(np.bincount(of, minlength=n)), pairs, times)


def _texts(ids, group, sizes, counts, names):
    """``a1,a2|b1;a3|b2,b3`` of each stretch, from the tokens of both sides and their groups."""
    before = [_offsets(s) for s in sizes]
    tokens = len(ids[0]) + len(ids[1])
    # A group's tokens of A, then those of B; behind each a mark, which depends on what comes next.
    places = [np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]]
    flat = np.empty(2 * tokens, object)
    marks = np.full(tokens, ",", object)
    for side in (0, 1):
        flat[2 * places[side]] = list(map(names.__getitem__, ids[side].tolist()))
    marks[before[0][1:] + before[1][:-1] - 1] = "|"
    marks[before[0][1:] + before[1][1:] - 1] = ";"
    flat[1::2] = marks
    flat = flat.tolist()
    cuts = (2 * _offsets(counts[0] + counts[1])).tolist()
    return ["".join(flat[i : j - 1]) if i < j else "" for i, j in zip(cuts, cuts[1:])]


class Aligner:
    """A worker's aligner of texts, which remembers alignments of short stretches."""

    def __init__(self, encoders):
        self.encoders = encoders
        self._forget()

    def _forget(self):
        self.numbers, self.bytes, self.known = {}, 0, Alignments()

    def _stretches(self, text):
        whole = " " + text
        first, *others = _CUT.split(whole) if self.encoders.cuts else [whole]
        return [first, *[" " + s for s in others]]

    def align(self, texts):
        """``(rows, digests, offsets, pairs, times)`` of texts, as in ``Alignments``.

        A text that is null or empty, or that a tokenizer does not give back, has zeros, an empty
        digest and no pairs.
        """
        if self.bytes > _MEMORY:
            self._forget()
        stretches = [self._stretches(text) if text else [] for text in texts]
        flat = [s for own in stretches for s in own]
        # Long ones come last, and are dropped again.
        unseen = set(flat).difference(self.numbers)
        new = [s for s in unseen if len(s) <= _SHORT]
        short = len(new)
        new += [s for s in unseen if len(s) > _SHORT]
        known, numbers = self.known, self.numbers
        base = len(known.groups)
        for at in range(0, len(new), _STRETCHES):
            some = new[at : at + _STRETCHES]
            known = known.added(aligned(self.encoders.encode(some), self.encoders))
        numbers.update(zip(new, range(base, base + len(new))))
        found = self._gathered(stretches, np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat)), known)
        for stretch in new[short:]:
            del numbers[stretch]
        self.known = known.first(base + short)
        self.bytes += short * _OVERHEAD + sum(len(s) + len(g or "") for s, g in zip(new[:short], self.known.groups[base:]))
        self.bytes += 16 * int(self.known.offsets[-1] - self.known.offsets[base])
        return found

    def _gathered(self, stretches, flat, known):
        n = len(stretches)
        ends = _offsets([len(s) for s in stretches])
        owner = np.repeat(np.arange(n), np.diff(ends))
        digests, good = [], np.zeros(n, bool)
        for text, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
            groups = list(map(known.groups.__getitem__, flat[start:end].tolist()))
            good[text] = bool(groups) and None not in groups
            digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if good[text] else "")
        kept = good[owner]
        owner, flat = owner[kept], flat[kept]
        rows = np.column_stack([np.bincount(owner, column[flat], n) for column in known.rows.T]).astype(np.int64)
        width = max(len(known.groups), 1)
        key, often = np.unique(owner * width + flat, return_counts=True)
        owner, number = key // width, key % width
        sizes = known.offsets[number + 1] - known.offsets[number]
        place = _ranges(known.offsets[number], sizes)
        of, pairs, times = _summed_pairs(
            np.repeat(owner, sizes), known.pairs[place], known.times[place] * np.repeat(often, sizes)
        )
        return rows, digests, _offsets(np.bincount(of, minlength=n)), pairs, times


def _in_parts(texts):
    """Texts in parts of a bounded number and length; a longer text is a part of its own."""
    part, size = [], 0
    for text in texts:
        length = len(text or "")
        if part and (size + length > _CHARACTERS or len(part) == _TEXTS):
            yield part
            part, size = [], 0
        part.append(text)
        size += length
    if part:
        yield part


_ALIGNED = (
    "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string,"
    " pairs: array<long>, times: array<long>>"
)


def alignment_of(text, path_a, path_b):
    """Column of a text column's alignment; see ``Aligner.align``."""

    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Tasks run side by side; threads within them only get in each other's way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(Encoders(path_a, path_b))
        for batch in batches:
            parts = [_structs(*aligner.align(part)) for part in _in_parts(batch.to_pylist())]
            yield pa.concat_arrays(parts) if parts else _structs(np.zeros((0, 4), np.int64), [], [0], [], [])

    # Non-deterministic, so that the optimizer never encodes a text twice.
    return F.arrow_udf(align, _ALIGNED).asNondeterministic()(text)


def _structs(rows, digests, offsets, pairs, times):
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c, pa.int64())) for c in (pairs, times)]
    return pa.StructArray.from_arrays(
        [*[pa.array(c) for c in np.asarray(rows).T.copy()], pa.array(digests, pa.string()), *lists],
        ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def align(docs, text="text", path_a=None, path_b=None):
    """Rows of ``docs`` as ``doc`` with ``row``, a number of its own, and ``aligned``, as a written table.

    A null or empty text, or one that either tokenizer does not give back byte for byte behind
    a space, has no tokens: zeros, an empty digest and no pairs.
    """
    defaults = default_paths()
    column = alignment_of(F.col(text), path_a or defaults[0], path_b or defaults[1])
    row = F.struct(*[F.col(c) for c in docs.columns if c != text])
    done = docs.select(row.alias("doc"), column.alias("aligned"))
    return written(done.select(F.monotonically_increasing_id().alias("row"), "doc", "aligned"), "aligned")


def pair_counts(alignments):
    """``[pair, count, best]``: in how many texts an id pair is linked, and whether no pair of its first id is in more."""
    counts = alignments.select(F.explode("aligned.pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / _WIDTH).cast("long")), "pair_counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _summed(links, *by):
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long")
    return links.groupBy(*by).agg(best.alias("n_best"), F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum"))


def scored(alignments):
    """``alignments`` with ``n_best`` and ``count_sum``: over their links, those of best pairs, and the pairs' counts.

    A pair in most texts would be most of a shuffle: pairs with over a hundred-thousandth of all
    rows are broadcast, at most a hundred thousand of them, and only rows of the others shuffle.
    """
    counts = written(pair_counts(alignments), "counts")
    rows = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > rows * _HOT_SHARE)
    cold = counts.where(F.col("count") <= rows * _HOT_SHARE)
    # The array positions stay together, so a pair's two columns are one generator.
    both = F.arrays_zip(F.col("aligned.pairs").alias("pair"), F.col("aligned.times").alias("times"))
    links = alignments.select("row", F.inline(both))
    marked = links.join(F.broadcast(hot), "pair", "left")
    known = _summed(marked.where(F.col("count").isNotNull()), "row")
    others = marked.where(F.col("count").isNull()).select("row", "pair", "times")
    sums = known.unionByName(_summed(others.join(cold, "pair"), "row"))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return alignments.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def report(docs, key="doc_id", text="text"):
    """The alignment of every document in numbers.

    ``[doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256]``.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = scored(align(slim))
    return found.select(
        "doc.doc_id", "aligned.n_a", "aligned.n_b", "aligned.n_groups", "aligned.n_links", "n_best", "count_sum",
        "aligned.groups_sha256",
    )
