"""Stretches of a text in which the same words come round again and again.

A run has its smallest period ``q`` and at least ``max(LEAST, TIMES * q)`` words, and no
neighbouring word prolongs it.  So for each ``q`` it holds ``TIMES`` neighbours on the grid of
multiples of ``q``, all the same word: those are the candidates, of which a text of ``n`` words
has some ``n / q`` for each ``q``.  How far a candidate's period holds, to both sides, the
grammar of ``recompression`` tells exactly.  Texts of a batch share a grammar, each behind a
number of its own; texts without a candidate need none.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.llm.recompression import Grammar

# How often a period has to come round, and the least words of a run.
TIMES = 4
LEAST = 6
# Words whose numbers, candidates and grammar a task holds at once, but for one longer text.
_WORDS_AT_ONCE = 200_000
# Rounds in which one candidate of a chain is extended to spare those that its run covers.
_ROUNDS = 3

_FOUND = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _candidates(sequence, starts, sizes):
    """Places and periods of candidates; the texts lie in ``sequence`` with the longest first."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places, periods = [], []
    for period in range(1, int(sizes.max(initial=0)) // TIMES + 1):
        texts = int(np.searchsorted(-sizes, -TIMES * period, side="right"))
        grid = sequence[: int(starts[texts - 1] + sizes[texts - 1]) : period]
        same = grid[1:] == grid[:-1]
        several = same[: len(same) - TIMES + 2]
        for shift in range(1, TIMES - 1):
            several = several & same[shift : len(same) - TIMES + 2 + shift]
        found = np.flatnonzero(several) * period
        found = found[owner[found] == owner[found + (TIMES - 1) * period]]
        if len(found):
            places.append(found)
            periods.append(np.full(len(found), period))
    if not places:
        return owner, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return owner, np.concatenate(places), np.concatenate(periods)


def _extended(grammar, places, periods):
    """The stretches ``(start, end, period)`` that candidates lie in, each at least once."""
    found = []
    for turn in range(_ROUNDS + 1):
        if not len(places):
            break
        breaks = np.append(True, (periods[1:] != periods[:-1]) | (places[1:] != places[:-1] + periods[1:]))
        heads = np.flatnonzero(breaks) if turn < _ROUNDS else np.arange(len(places))
        one, period = places[heads], periods[heads]
        ends = one + period + grammar.ahead(one, one + period)
        found.append((one - grammar.behind(one, one + period), ends, period))
        chain = np.cumsum(breaks) - 1 if turn < _ROUNDS else heads
        left = places + periods >= ends[chain]
        places, periods = places[left], periods[left]
    return [np.concatenate(part) for part in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def runs_in(texts):
    """The runs of several sequences of numbers: per sequence, an array of (start, length, period).

    In order of start and then period.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    none = np.zeros((0, 3), np.int64)
    runs = [none] * len(texts)
    if not sizes.sum():
        return runs
    sequence = np.concatenate([texts[i] for i in order])
    owner, places, periods = _candidates(sequence, starts, sizes)
    if not len(places):
        return runs
    # The texts with a candidate, each followed by a number that stands nowhere else.
    wanted = np.unique(owner[places])
    parts, shift, at = [], np.zeros(len(sizes), np.int64), 0
    fresh = int(sequence.max()) + 1
    for text in wanted:
        parts += [sequence[starts[text] : starts[text] + sizes[text]], [fresh + text]]
        shift[text] = at - starts[text]
        at += sizes[text] + 1
    grammar = Grammar(np.concatenate(parts), least=len(wanted))
    begins, ends, period = _extended(grammar, places + shift[owner[places]], periods)
    good = ends - begins >= np.maximum(LEAST, TIMES * period)
    begins, ends, period = begins[good], ends[good], period[good]
    # A multiple of a period holds in the same stretch; the smallest one counts.
    by = np.lexsort((period, ends, begins))
    begins, ends, period = begins[by], ends[by], period[by]
    first = np.append(True, (begins[1:] != begins[:-1]) | (ends[1:] != ends[:-1])) if len(by) else np.zeros(0, bool)
    begins, ends, period = begins[first], ends[first], period[first]
    moved = starts[wanted] + shift[wanted]
    text = np.searchsorted(moved, begins, side="right") - 1
    for number in np.unique(text):
        own = text == number
        rows = np.column_stack([begins[own] - moved[number], ends[own] - begins[own], period[own]])
        runs[order[wanted[number]]] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return runs


def _kept(words, runs):
    """Words that stay when each run keeps its first period only."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edges[:-1]) == 0
    return [word for word, stays in zip(words, keep.tolist()) if stays]


def _analysed(texts):
    """Rows ``(n_words, runs, collapsed)`` of texts as bytes."""
    numbers = defaultdict(count().__next__)
    words = [text.split() for text in texts]
    found = runs_in([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
    for own, runs in zip(words, found):
        yield len(own), runs, b" ".join(_kept(own, runs) if len(runs) else own)


def _in_parts(texts):
    """Texts in parts of a bounded number of words; a longer text is a part of its own."""
    part, words = [], 0
    for text in texts:
        # A text has no more words than every other byte.
        size = len(text) // 2 + 1
        if part and words + size > 2 * _WORDS_AT_ONCE:
            yield part
            part, words = [], 0
        part.append(text)
        words += size
    if part:
        yield part


def runs_of(text):
    """Column of what is found in a text column: ``struct<n_words, runs, collapsed>``.

    Words are runs of other characters than ASCII white space, numbered from 0; ``runs`` are
    ``(start, length, period)`` in words, in order of start and then period; ``collapsed`` is the
    words that stay, joined by one space, when every run keeps its first period only.  A null or
    empty text has no words, no runs, and is empty when collapsed.
    """

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for part in _in_parts([text or b"" for text in batch.cast(pa.binary()).to_pylist()]):
                for n_words, own, rest in _analysed(part):
                    sizes.append(n_words)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                    collapsed.append(rest)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, _ARROW_RUNS),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["n_words", "runs", "collapsed"],
            )

    # Non-deterministic, so that the optimizer never does the work twice.
    return F.arrow_udf(found, _FOUND).asNondeterministic()(text)


def find(docs, text="text"):
    """Rows of ``docs`` as ``doc`` beside ``found``; see ``runs_of``.

    One row for each row, whatever repeats; no column of ``docs`` can clash.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    return docs.select(row.alias("doc"), runs_of(F.col(text)).alias("found"))


def collapse(docs, text="text"):
    """``docs`` with every run cut down to its first period; columns and rows stay.

    Texts without a run, nulls among them, are left as they are.
    """
    found = find(docs, text)
    clean = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("doc")[text])
    return found.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])


def with_planted_periods(docs, key, text):
    """``docs`` in which a tenth of the texts repeat a stretch of themselves up to their end.

    With ``h`` the CRC of the key and ``g = h div 10``, where ``h`` ends in 0 and there are
    ``n`` words, each word ``i`` from ``a = g mod n`` on becomes word ``a + (i - a) mod p``, with
    ``p = 1 + (n - a) div (3 + g mod 8)``.  A null key changes nothing.
    """
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("__g", F.when(hashed % 10 == 0, F.floor(hashed / 10).cast("long")))
    chosen = chosen.withColumn("__words", F.when(F.col("__g").isNotNull(), words))
    n, g, all_words = F.size("__words"), F.col("__g"), F.col("__words")
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    turned = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get(all_words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    )
    planted = F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col(text))
    return chosen.withColumn(text, planted).drop("__g", "__words")


def report(docs, key="doc_id", text="text"):
    """Runs of every document, with periods planted: the longest, and digests of all and of the rest.

    ``[doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256]``;
    of runs of one length the first counts, and of those the one of the smallest period.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = find(with_planted_periods(slim, "doc_id", "text"))
    runs = F.col("found.runs")
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    )
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select("doc.doc_id", "found", longest.alias("best"), listed.alias("listed")).select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
