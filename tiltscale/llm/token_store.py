"""Token ids in files with keyed access through minimal perfect hashes.

A store is a folder of two tables, so it can lie wherever Spark writes:

* ``shards``: one row per shard, in ascending order of the document keys.  ``payload``
  holds the raw ids of its documents, little-endian, ``width`` bytes each.  ``seeds``,
  ``prints``, ``offsets`` and ``lengths`` are its index: a minimal perfect hash of the
  keys ``(doc_id, copy)`` to slots, and for every slot a fingerprint of its key, the
  offset of the document in the shard, and its number of ids.  ``keys`` and ``copies``
  list the keys in file order.
* ``directory``: shard, first key, and the number of ids in all shards before it.

A key goes to its shard by the directory, and from there to its ids in constant time,
without a look at other keys.  A key that is not stored is told by its fingerprint.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tiltscale.llm.tokens import default_path, encoder

# A shard is closed at so many ids; a longer document has one of its own.
SHARD_IDS = 1 << 20
# ... or so many documents.
SHARD_DOCS = 1 << 16
# A directory of up to so many shards is held by each task that routes keys.
DIRECTORY_ROWS = 1 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NULL_KEY = np.uint64(0x5851F42D4C957F2D)
_KEYS_PER_SEED = 4
_TRIES = 32


def _mixed(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _hashes(keys, nulls, copies):
    """64-bit hashes of ``(doc_id, copy)``; ``nulls`` marks keys that are null."""
    with np.errstate(over="ignore"):
        base = _mixed(np.where(nulls, _NULL_KEY, keys.astype(np.int64).view(np.uint64) + _STEP))
        return _mixed(base + copies.astype(np.uint64) * _STEP + _MIX[0])


def _slot(hashes, seeds, n):
    with np.errstate(over="ignore"):
        return (_mixed(hashes + seeds.astype(np.uint64) * _STEP) % np.uint64(n)).astype(np.int64)


def build_hash(hashes):
    """Seeds of a minimal perfect hash of distinct 64-bit hashes to ``0 .. n-1``.

    Keys are dealt into groups of some four.  Group by group, the largest first, a seed
    is sought that sends its keys to free slots.  Groups of one key come last and name
    their slot outright, as ``-1 - slot``.
    """
    n = len(hashes)
    groups = max(1, -(-n // _KEYS_PER_SEED))
    seeds = np.zeros(groups, np.int64)
    if n == 0:
        return seeds
    group = (hashes >> np.uint64(32)).astype(np.int64) % groups
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    taken = np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] < 2:
            break
        own = hashes[order[starts[g] : starts[g] + sizes[g]]]
        first, tries = 0, _TRIES
        while True:
            tried = np.arange(first, first + tries)
            slots = np.sort(_slot(own[None, :], tried[:, None], n), axis=1)
            good = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                seeds[g] = tried[at]
                taken[slots[at]] = True
                break
            first, tries = first + tries, min(2 * tries, 4096)
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    seeds[single] = -1 - free[: len(single)]
    return seeds


def find_slots(hashes, seeds, n):
    """Slots of hashes; any slot for a key that is not stored."""
    if n == 0:
        return np.zeros(len(hashes), np.int64)
    own = seeds[(hashes >> np.uint64(32)).astype(np.int64) % len(seeds)]
    return np.where(own < 0, -1 - own, _slot(hashes, np.maximum(own, 0), n))


def _prints(hashes):
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")


_SHARD = (
    "part int, shard int, n_docs int, n_ids long, width int, payload binary, seeds binary, "
    "prints binary, offsets binary, lengths binary, keys array<long>, copies array<long>"
)


def _shard_row(part, shard, keys, copies, ids):
    """One row of ``shards``; ids come as 32-bit integers and are held in 16 bits where they fit."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    offsets = np.cumsum(lengths) - lengths
    values = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if len(values) == 0 or int(values.max()) < 1 << 16 else 4
    nulls = np.array([k is None for k in keys], bool)
    hashes = _hashes(np.array([k or 0 for k in keys], np.int64), nulls, np.array(copies, np.int64))
    seeds = build_hash(hashes)
    slots = find_slots(hashes, seeds, len(keys))
    at = np.empty(len(keys), np.int64)
    at[slots] = np.arange(len(keys))
    return {
        "part": part, "shard": shard, "n_docs": len(keys), "n_ids": int(lengths.sum()), "width": width,
        "payload": values.astype(f"<u{width}").tobytes(), "seeds": seeds.astype("<i8").tobytes(),
        "prints": _prints(hashes)[at].tobytes(), "offsets": offsets[at].astype("<u4").tobytes(),
        "lengths": lengths[at].astype("<u4").tobytes(), "keys": keys, "copies": copies,
    }


def _shard_schema():
    return pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
        ("width", pa.int32()), ("payload", pa.binary()), ("seeds", pa.binary()), ("prints", pa.binary()),
        ("offsets", pa.binary()), ("lengths", pa.binary()), ("keys", pa.list_(pa.int64())),
        ("copies", pa.list_(pa.int64())),
    ])


def write_store(docs, path, tokenizer=None, end_id=2, key="doc_id", text="text", shard_ids=SHARD_IDS):
    """Encode every whole text and write the store to ``path``.

    A null text is an empty one, so its document is the end id alone.  Documents lie in
    ascending order of key, a null key first; rows that share a key are told apart by
    ``copy``, which counts from 0 in each run of them in a partition of the writing job
    (a shard never spans two).  Other columns are not looked at.
    """
    tokenizer = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        ids_of, shard, last, copy = encoder(tokenizer).ids, 0, (), 0
        keys, copies, ids, held, part = [], [], [], 0, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for doc, words in zip(batch.column(0), batch.column(1)):
                doc, coded = doc.as_py(), ids_of(words.as_py()) + end
                copy, last = (copy + 1, last) if last == (doc,) else (0, (doc,))
                if keys and (held + len(coded) > 4 * shard_ids or len(keys) >= SHARD_DOCS):
                    yield pa.RecordBatch.from_pylist([_shard_row(part, shard, keys, copies, ids)], _shard_schema())
                    shard, keys, copies, ids, held = shard + 1, [], [], [], 0
                keys.append(doc)
                copies.append(copy)
                ids.append(coded)
                held += len(coded)
        if keys:
            yield pa.RecordBatch.from_pylist([_shard_row(part, shard, keys, copies, ids)], _shard_schema())

    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie
    )
    # The partition's number is taken where the rows are written: once, in one job.
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(encode, _SHARD).write.parquet(f"{path}/shards")

    shards = spark.read.parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per task of the writing job, so this window is small; the next is per task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.select(
        "part", "shard", F.col("keys")[0].alias("first_key"),
        F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part"),
    )
    directory = rows.join(parts, "part").select(
        "part", "shard", "first_key", (F.col("part_start") + F.col("in_part")).alias("start")
    )
    directory.write.parquet(f"{path}/directory")
    return path


def _slices(row, keys, copies):
    """For each key of a shard: found, offset, number of ids, ids as 32-bit integers."""
    nulls = np.array([k is None for k in keys], bool)
    hashes = _hashes(np.array([k or 0 for k in keys], np.int64), nulls, np.array(copies, np.int64))
    slots = find_slots(hashes, np.frombuffer(row["seeds"], "<i8"), row["n_docs"])
    found = np.frombuffer(row["prints"], "<u4")[slots] == _prints(hashes)
    offsets, lengths = np.frombuffer(row["offsets"], "<u4")[slots], np.frombuffer(row["lengths"], "<u4")[slots]
    payload = np.frombuffer(row["payload"], f"<u{row['width']}")
    for hit, at, n in zip(found, offsets.tolist(), lengths.tolist()):
        yield bool(hit), at, n, payload[at : at + n].astype("<u4")


def _starts(spark, path):
    return spark.read.parquet(f"{path}/directory").select("part", "shard", "start")


def read_back(spark, path):
    """Every document of a store: ``[doc_id, copy, start, n_tokens, ids_crc32]``.

    Each key is looked up through its shard's index, and its ids are cut from the raw
    payload.  The payload stays where it is read: only the small rows meet the directory.
    """
    out = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int64()),
        ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows = []
                for key, copy, (hit, at, n, ids) in zip(
                    row["keys"], row["copies"], _slices(row, row["keys"], row["copies"])
                ):
                    if not hit:
                        raise ValueError(f"the index of shard {row['part']}/{row['shard']} lacks key {key}")
                    rows.append((row["part"], row["shard"], key, copy, at, n, zlib.crc32(ids.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    shards = spark.read.parquet(f"{path}/shards")
    read_rows = shards.mapInArrow(
        read, "part int, shard int, doc_id long, copy long, at long, n_tokens long, ids_crc32 long"
    )
    return read_rows.join(_starts(spark, path), ["part", "shard"]).select(
        "doc_id", "copy", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def get(spark, path, keys):
    """Ids of ``keys`` (a DataFrame with ``doc_id``): ``[doc_id, ids]``, first copies only.

    Keys that are not stored give no row.  The directory routes each key to its shard;
    beyond ``DIRECTORY_ROWS`` shards the routing is a join with the shards' key lists.
    """
    directory = spark.read.parquet(f"{path}/directory").select("part", "shard", "first_key")
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    firsts = directory.orderBy("part", "shard").limit(DIRECTORY_ROWS + 1).collect()
    if len(firsts) > DIRECTORY_ROWS:
        stored = spark.read.parquet(f"{path}/shards").select("part", "shard", F.explode("keys").alias("stored"))
        routed = wanted.join(stored, F.col("doc_id").eqNullSafe(F.col("stored"))).drop("stored").distinct()
    else:
        least = np.iinfo(np.int64).min
        first = np.array([least if r.first_key is None else r.first_key for r in firsts], np.int64)
        places = [(r.part, r.shard) for r in firsts]

        def route(batches):
            for batch in batches:
                docs = batch.column(0).to_pylist()
                rows = []
                for doc in docs:
                    # A key's copies may begin in the shard before the first that starts with it.
                    value = least if doc is None else doc
                    low = max(0, int(np.searchsorted(first, value, "left")) - 1)
                    high = int(np.searchsorted(first, value, "right"))
                    rows += [(doc, *places[i]) for i in range(low, high)]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                    names=["doc_id", "part", "shard"],
                )

        routed = wanted.mapInArrow(route, "doc_id long, part int, shard int")
    asked = routed.groupBy("part", "shard").agg(F.array_compact(F.collect_list("doc_id")).alias("asked"), F.max(F.col("doc_id").isNull()).alias("null_asked"))
    shards = spark.read.parquet(f"{path}/shards").join(asked, ["part", "shard"])
    out = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = row["asked"] + [None] * bool(row["null_asked"])
                rows = [
                    {"part": row["part"], "shard": row["shard"], "doc_id": doc, "ids": ids.tolist()}
                    for doc, (hit, _, _, ids) in zip(docs, _slices(row, docs, [0] * len(docs)))
                    if hit
                ]
                yield pa.RecordBatch.from_pylist(rows, out)

    found = shards.mapInArrow(cut, "part int, shard int, doc_id long, ids array<long>")
    return found.groupBy("doc_id").agg(F.min_by("ids", F.struct("part", "shard")).alias("ids"))
