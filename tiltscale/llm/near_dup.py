"""Near-duplicate groups by an inverted join over MinHash signatures.

1. A document's words become a set of hashed shingles, and the set a signature of
   ``COORDINATES`` minima.  Documents with one set are one *class* from here on, however
   many copies there are.
2. Classes are posted under each pair of coordinate and value.  A pair of classes is a
   candidate if it collides in ``MATCHES`` coordinates or more.  Such a pair meets in the
   ``COORDINATES - MATCHES + 1`` postings of a class that come first when the rarest
   come first, so only those are merged; the others are skipped until a pair is there to
   be counted in full.
3. Short posting lists give all their pairs.  In a long list each class is paired with one
   pivot, drawn by a hash of the list; where the links found leave a list in more than one
   component, the classes of different components are compared block by block, and only
   pairs that collide often enough leave the task.
4. Candidates are confirmed on the full sets, the best partner of each class first, then
   what still runs between components.  A pair inside a component needs no confirmation:
   its classes are linked already.

Signatures are a filter alone: two sets of similarity 0.8 collide in less than
``MATCHES`` of the coordinates about 6.6 times in a million, and are missed then.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tiltscale.llm.common import written

COORDINATES = 32
MATCHES = 15
PREFIX = COORDINATES - MATCHES + 1
# Posting lists of up to so many classes give all their pairs.
SHORT_LIST = 6
# Classes of a long list that are compared with one another in one task.
BLOCK = 1_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Words a worker remembers, of so many bytes each at most.
_MEMORY, _LONG = 400_000, 64


def _mixed(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest

        value = xxh3_64_intdigest(word)
        if len(word) <= _LONG:
            if len(self) >= _MEMORY:
                self.clear()
            self[word] = value
        return value


def shingle_set(text, k, words=None):
    """Sorted 64-bit hashes of the distinct ``k``-word shingles of a text.

    A-Z are put in lower case; words are parted by ASCII white space.  Fewer words than
    ``k`` are one shingle, no words none.
    """
    known = _WordHashes() if words is None else words
    # Of bytes, lower() and split() concern ASCII letters and white space alone.
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        width = min(k, len(parts))
        joined = np.full(len(parts) - width + 1, width, np.uint64)
        for i in range(width):
            joined = joined * _STEP + hashes[i : i + len(joined)]
            joined ^= joined >> np.uint64(29)
        return np.unique(_mixed(joined))


def _multipliers():
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def signature(hashes):
    """Postings of a set: its minimum under each coordinate's order, told apart by coordinate."""
    factors = _multipliers()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[at : at + 2048, None] * factors).min(axis=0))
        return _mixed(least ^ (factors + _STEP)).view(np.int64)


_words = _WordHashes()


def _set_id(hashes):
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def sets_of(docs, k, key="doc_id", text="text"):
    """``[doc_id, text_hash, n_shingles, set_id, postings]``; no postings and no id for an empty set."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
        ("postings", pa.list_(pa.int64())),
    ])

    def hashed(batches):
        for batch in batches:
            rows = []
            for doc, text_hash, words in zip(*batch.columns):
                own = shingle_set(words.as_py(), k, _words)
                full = len(own) > 0
                rows.append((doc.as_py(), text_hash.as_py(), len(own), _set_id(own) if full else None, signature(own) if full else None))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return slim.mapInArrow(hashed, "doc_id long, text_hash long, n_shingles long, set_id binary, postings array<long>")


def _prefixes(classes):
    """``[token, cid]``: the first ``PREFIX`` postings of each class, the rarest first.

    Postings that one class has alone come first and meet nobody, so they are counted only.
    """
    posted = classes.select(F.explode("postings").alias("token"), "cid")
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(often, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    alone = COORDINATES - F.size("own")
    first = F.slice("own", 1, F.greatest(F.lit(0), PREFIX - alone))
    return shared.select("cid", F.explode(first).alias("p")).select(F.col("p.token").alias("token"), "cid")


def _best_first(pairs):
    """Of each class the candidate that collides most."""
    best = F.max(F.struct("hits", (-F.col("a")).alias("a")))
    return pairs.groupBy("b").agg(best.alias("x")).select((-F.col("x.a")).alias("a"), "b")


def _counted(pairs, classes):
    """Pairs that collide in ``MATCHES`` coordinates or more, with ``hits``."""
    left = classes.select(F.col("cid").alias("a"), F.col("postings").alias("pa"))
    right = classes.select(F.col("cid").alias("b"), F.col("postings").alias("pb"))
    hits = F.size(F.array_intersect("pa", "pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", hits.alias("hits"))
    return both.where(F.col("hits") >= MATCHES)


def _confirmed(pairs, sets, percent):
    """Pairs of ``[a, b]`` whose full sets are ``percent`` similar or more."""

    def compare(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (p, q))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"]
            )

    left = sets.select(F.col("cid").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("own").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


def components(links, most_rounds=100):
    """``[cid, comp]`` of the classes in ``links``: the least class each can reach.

    Every round takes the least label among a class and its neighbours, then that label's
    own label, so labels travel at doubling distances.  Labels are written each round.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(
        both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels"
    )
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "cid").select("cid", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        own = labels.select(F.col("cid").alias("low"), F.col("comp").alias("jump"))
        after = written(
            lower.join(own, "low", "left").select("cid", "was", F.least("low", "jump").alias("comp")), "labels"
        )
        moved = after.where("was <> comp").limit(1).count()
        labels = after.select("cid", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _between(pairs, comps):
    """Pairs that run between components; a class without one is its own."""
    own = comps.select(F.col("cid"), F.col("comp"))
    a = own.select(F.col("cid").alias("a"), F.col("comp").alias("ca"))
    b = own.select(F.col("cid").alias("b"), F.col("comp").alias("cb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _list_residue(long_lists, comps, classes, sets, percent):
    """Links ``[a, b]`` between components, found inside long lists, compared block by block.

    Nothing but links leaves a task, and no more of them than it takes to join what they
    join.  Two classes may share many lists; they are compared in the one whose coordinate
    comes first among those that are in the prefix of both.
    """
    member = long_lists.join(comps, "cid", "left").select("token", "cid", F.coalesce("comp", "cid").alias("comp"))
    split = member.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    split = split.where("lo <> hi").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = member.join(split, "token").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    posted = long_lists.groupBy("cid").agg(F.collect_set("token").alias("first"))
    rows = rows.join(classes.select("cid", "postings"), "cid").join(posted, "cid").join(sets.withColumnRenamed("own", "hashes"), "cid")
    # A class goes to the groups of its block with every block, the lower number first.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "comp", "postings", "first", "hashes"
    )

    def compare(df):
        token, i, j = df["token"].iat[0], df["i"].iat[0], df["j"].iat[0]
        own, cid, comp = (df[c].to_numpy().copy() for c in ("own", "cid", "comp"))
        post = np.stack(df["postings"].to_numpy())
        prefix = np.stack([np.isin(p, f) for p, f in zip(post, df["first"])])
        full = [np.frombuffer(h, np.uint64) for h in df["hashes"]]
        sizes = np.array([len(f) for f in full])
        # Hashes by bucket: two sets have no more in common than the lesser counts add up to.
        buckets = min(4096, 1 << int(2 * sizes.max()).bit_length())
        counts = np.stack([np.bincount((f % np.uint64(buckets)).astype(np.int64), minlength=buckets) for f in full]).astype(np.uint16)
        left, right, found = np.flatnonzero(own == i), np.flatnonzero(own == j), []
        for at in left:
            near = right[comp[right] != comp[at]]
            fits = np.minimum(sizes[near], sizes[at]) * 100 >= percent * np.maximum(sizes[near], sizes[at])
            near = near[fits]
            equal = post[near] == post[at]
            both = equal & prefix[near] & prefix[at]
            here = post[at][both.argmax(axis=1)] == token
            near = near[(equal.sum(axis=1) >= MATCHES) & here]
            most = np.minimum(counts[near], counts[at]).sum(axis=1, dtype=np.int64)
            for r in near[100 * most >= percent * (sizes[near] + sizes[at] - most)].tolist():
                if comp[r] != comp[at]:
                    common = len(np.intersect1d(full[at], full[r], assume_unique=True))
                    if 100 * common >= percent * (sizes[at] + sizes[r] - common):
                        found.append((min(cid[at], cid[r]), max(cid[at], cid[r])))
                        comp[comp == comp[r]] = comp[at]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("token", "i", "j").applyInPandas(compare, "a long, b long")


def _class_sets(docs, wanted, k, key, text):
    """``[cid, own]``: the full sets of the classes in ``wanted``, ``[cid, source, set_id]``, read from their texts.

    ``source`` tells a row by its doc_id, which may be null, and the hash of its text.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def hashed(batches):
        for batch in batches:
            cids, sets = [], []
            for cid, set_id, words in zip(batch.column(0), batch.column(1), batch.column(2)):
                own = shingle_set(words.as_py(), k, _words)
                # Another text may have the same hash.
                if len(own) and _set_id(own) == set_id.as_py():
                    cids.append(cid.as_py())
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "own"])

    same = slim["doc_id"].eqNullSafe(wanted["source.doc_id"]) & (slim["text_hash"] == wanted["source.text_hash"])
    read = slim.join(wanted, same).select("cid", "set_id", "text").mapInArrow(hashed, "cid long, own binary")
    return read.dropDuplicates(["cid"])


def _grouped(docs, k, percent, key, text):
    """Rows of ``sets_of``, and ``[set_id, comp]``: sets by the group that links lead to."""
    rows = written(sets_of(docs, k, key, text), "rows")
    # A copy of a set adds an id to its class and nothing to what follows.
    classes = (
        rows.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("source"), F.first("postings").alias("postings")
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")

    prefixes = written(_prefixes(classes), "prefixes")
    draw = F.min(F.struct(F.xxhash64("token", "cid"), "cid"))["cid"]
    lists = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n"), draw.alias("pivot")).where("n > 1")
    lists = written(lists, "lists")
    short = prefixes.join(lists.where(F.col("n") <= SHORT_LIST).select("token"), "token")
    near = short.select("token", F.col("cid").alias("a")).join(short.select("token", F.col("cid").alias("b")), "token")
    near = near.where("a < b").select("a", "b")
    long_lists = prefixes.join(lists.where(F.col("n") > SHORT_LIST).select("token", "pivot"), "token")
    star = long_lists.where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    pairs = written(_counted(near.union(star).distinct(), classes), "pairs")

    first = _best_first(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    residue_ids = long_lists.select("cid").distinct()
    ids = wanted.union(residue_ids).distinct()
    sets = written(_class_sets(docs, classes.join(ids, "cid").select("cid", "source", "set_id"), k, key, text), "sets")

    links = written(_confirmed(first, sets, percent), "links")
    comps = components(links)
    links = written(links.union(_confirmed(_between(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), comps), sets, percent)), "links")
    comps = components(links)
    residue = written(_list_residue(long_lists, comps, classes, sets, percent), "residue")
    if residue.limit(1).count():
        comps = components(links.union(residue))

    return rows, classes.join(comps, "cid", "left").select("set_id", "doc_id", F.coalesce("comp", "cid").alias("comp"))


def near_duplicates(docs, k=5, percent=80, key="doc_id", text="text"):
    """``[doc_id, n_shingles, component_id, kept]``, a row per row of ``docs``.

    Documents are linked when ``100 * common >= percent * union`` of their sets of distinct
    ``k``-word shingles; ``component_id`` is the least doc_id that links lead to, the
    document's own included, and ``kept`` says that it is the document's own.  An empty set
    (null, or no words) is linked with nothing.  A null doc_id is the least of nothing: it
    keeps its row only in a component without any id.
    """
    rows, placed = _grouped(docs, k, percent, key, text)
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_set = placed.join(least, "comp").select("set_id", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_duplicates(docs, k=5, percent=80, key="doc_id", text="text"):
    """Rows of ``docs``, one of each group: that of the least doc_id, a null one last.

    Of rows that share it, that of the least hash of the text; of equal rows, one.  Rows
    with an empty set all stay.
    """
    rows, placed = _grouped(docs, k, percent, key, text)
    full = rows.where(F.col("set_id").isNotNull()).select("doc_id", "text_hash", "set_id")
    # A null doc_id comes behind every other.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # Sets come together first, then groups: copies are gone before anything is shuffled twice.
    first = full.groupBy("set_id").agg(F.min(order).alias("x"))
    best = first.join(placed.select("set_id", "comp"), "set_id").groupBy("comp").agg(F.min("x").alias("x"))
    empty = rows.where(F.col("set_id").isNull()).select("doc_id", "text_hash").distinct()
    stay = best.select("x.doc_id", "x.text_hash", F.lit(True).alias("one")).union(empty.withColumn("one", F.lit(False)))
    stay = written(stay, "stay").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("one").alias("__one"))
    same = F.col(key).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__hash"))
    kept = docs.join(stay, same)
    # Only a table that holds a row more than once has its rows numbered.
    twins = rows.where(F.col("set_id").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    if twins.where("n > 1").limit(1).count():
        number = F.row_number().over(Window.partitionBy("__doc", "__hash").orderBy("__one"))
        kept = kept.withColumn("__n", number).where(~F.col("__one") | (F.col("__n") == 1))
    return kept.select(*docs.columns)
