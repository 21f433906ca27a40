"""Best-fit packing by minimum bin slack: documents into sequences of a fixed size.

The fullest feasible combination of lengths is found for one sequence, by a subset-sum
table in the bits of an integer, and taken away; then the next.  What is left to pack is
a count per length, at most ``capacity`` numbers however many documents there are, and
a combination is taken as often as the counts allow.  Each combination uses a length up
or nearly so, so the plan has about as many steps as there are lengths.  Documents then
find their place by their rank among those of their length.
"""

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.llm.common import ranked, salts_for, written
from tiltscale.llm.tokens import default_path, encoder

CAPACITY = 4096


def fullest(room, counts):
    """Lengths that fill ``room`` best: ``[(length, how often)]``, and their sum.

    ``counts`` maps lengths to how many there are.  Bit ``s`` of the table is set when a
    sum of ``s`` can be had from the lengths so far; the table is cut at ``room``, and
    the search ends at a sum that leaves no slack.  Longer lengths go first, so of equal
    sums one of fewer, longer documents is taken.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    table, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        # Multiples in powers of two, so that few shifts reach any number of copies.
        left, some = min(counts[length], room // length), 1
        while left and not table & goal:
            take = min(some, left)
            steps.append((length, take, table))
            table |= (table << (take * length)) & mask
            left, some = left - take, 2 * some
        if table & goal:
            break
    best = table.bit_length() - 1
    rest, used = best, {}
    for length, take, before in reversed(steps):
        if not (before >> rest) & 1:
            rest -= take * length
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True), best


def plan(counts, capacity=CAPACITY):
    """Combinations that pack ``counts`` (length → number): ``[(lengths, copies)]``.

    Each starts from the longest length that is left, which has to go somewhere, and
    fills the rest of the sequence with the least slack.
    """
    counts, steps = {int(k): int(v) for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used, _ = fullest(capacity - longest, {k: v for k, v in counts.items() if v})
        counts[longest] += 1
        combination = dict(used)
        combination[longest] = combination.get(longest, 0) + 1
        copies = min(counts[k] // m for k, m in combination.items())
        steps.append((sorted(combination.items(), reverse=True), copies))
        for k, m in combination.items():
            counts[k] -= m * copies
            if not counts[k]:
                del counts[k]
    return steps


_SLOTS = "length long, first_rank long, until_rank long, times long, first_sequence long, at long"


def _slots(counts, capacity):
    """The plan as rows: which ranks of a length go to which sequences, at which offset."""
    used, sequence, rows = {}, 0, []
    for combination, copies in plan(counts, capacity):
        at = 0
        for length, times in combination:
            first = used.get(length, 0)
            rows.append((length, first, first + times * copies, times, sequence, at))
            used[length] = first + times * copies
            at += times * length
        sequence += copies
    return rows


def pack(pieces, capacity=CAPACITY, order=("doc_id", "piece")):
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which have a ``length`` of 1 to ``capacity``.

    ``order`` names the columns that tell pieces of one length apart; rows equal in all of
    them are interchangeable.  A length may hold any share of the pieces.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows; the plan is made in one task, and is some times that.
    slots = counts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        lambda df: pd.DataFrame(_slots(dict(zip(df["length"], df["n"])), capacity), columns=[c.split()[0] for c in _SLOTS.split(", ")]),
        _SLOTS,
    )
    slots = written(slots, "plan")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    ranks = ranked(pieces, ["length"], list(order), salts_for(rows))
    # Combinations of one length partition its ranks, so a row meets exactly one; they are
    # found by the length and the last start at or before the rank.
    by_length = slots.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first_rank", "until_rank", "times", "first_sequence", "at"))).alias("steps")
    )
    step = F.filter("steps", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["until_rank"]))[0]
    # One row per length, so at most ``capacity``; all steps together are some times that.
    placed = ranks.join(F.broadcast(by_length), "length").withColumn("step", step)
    behind = F.col("rank") - F.col("step.first_rank")
    return placed.withColumns({
        "sequence_id": F.col("step.first_sequence") + F.floor(behind / F.col("step.times")).cast("long"),
        "offset": F.col("step.at") + F.pmod(behind, F.col("step.times")) * F.col("length"),
    }).drop("step", "steps", "rank")


def cut_pieces(docs, tokenizer=None, end_id=1, capacity=CAPACITY, key="doc_id", text="text"):
    """Tokenize whole texts and cut the long ones: ``[doc_id, piece, start, length, ids_crc32]``.

    A null text is an empty one: the end id alone.  Ids are counted and summed where
    they are made and go no further.
    """
    tokenizer = tokenizer or default_path()
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column(0), batch.column(1)):
                ids = ids_of(words.as_py()) + end
                doc = doc.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs, tokenizer=None, end_id=1, capacity=CAPACITY, key="doc_id", text="text"):
    """Pack every document: one row per piece, with its sequence and place there.

    Only documents of over ``capacity`` ids are cut.  Rows that share a doc_id are packed
    each for itself.  Columns other than key and text are not looked at.
    """
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces")
    order = ["doc_id", "piece", "start", "ids_crc32"]
    return pack(pieces, capacity, order).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
