"""Joins that look rows up by key and stay even when one key holds most rows."""

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows.  By arithmetic
# there are then never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
# Below this many rows for the hottest key one task copes with it.
HOT_MIN_ROWS = 100_000
# Entries of a sketch of frequent keys.
_TRACKED = 16_384
# An input of at most this many bytes per core, and in all, is small.
SMALL_BYTES_PER_CORE = 16 * 1024 * 1024
SMALL_BYTES = 1024 * 1024 * 1024
# Java object overhead of one broadcast key, added to the bytes of its text.
_KEY_OVERHEAD = 64


@dataclass(frozen=True)
class KeyProfile:
    """Sizes of a set of key columns, and the keys that hold most rows."""

    rows: int
    null_rows: int  # rows without a key
    keys: int
    key_bytes: int
    hottest: int  # rows of the most frequent key
    hot: tuple = ()  # (hash of the key, rows), at most 1 / HOT_SHARE of them

    @property
    def hot_floor(self):
        return max(HOT_MIN_ROWS, int(self.rows * HOT_SHARE))

    @property
    def skewed(self):
        return self.hottest > self.hot_floor or self.null_rows > self.hot_floor


def _no_nulls(keys):
    test = F.lit(True)
    for key in keys:
        test = test & F.col(key).isNotNull()
    return test


def key_hash(keys):
    """Hash of a key; null without one.  Equal keys have equal hashes on both sides."""
    return F.when(_no_nulls(keys), F.xxhash64(*keys))


def profile_keys(df, keys):
    """Measure ``keys`` of a batch DataFrame; reads no other columns.

    Keys are counted by their hash, in fixed-size rows, and pre-aggregated before
    they are shuffled.  A collision makes two keys count as one, which spreads
    both and changes no result.
    """
    length = F.lit(_KEY_OVERHEAD)
    for key in keys:
        length = length + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    counts = (
        df.select(key_hash(keys).alias("h"), length.alias("size"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    )
    keyed = F.col("h").isNotNull()
    row = counts.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~keyed, F.col("n"))).alias("null_rows"),
        F.count("h").alias("keys"),
        F.sum(F.when(keyed, F.col("size"))).alias("key_bytes"),
        F.max(F.when(keyed, F.col("n"))).alias("hottest"),
    ).first()
    profile = KeyProfile(**{name: int(value or 0) for name, value in row.asDict().items()})
    if profile.hottest <= profile.hot_floor:
        return profile
    # At most rows / hot_floor rows of two numbers each come to the driver.
    hot = counts.where(keyed & (F.col("n") > profile.hot_floor)).select("h", "n").collect()
    return KeyProfile(**{**vars(profile), "hot": tuple(map(tuple, hot))})


def sketch_keys(df, keys):
    """The profile of ``keys`` that salts need, from one pass and a sketch of bounded size.

    For a micro-batch, whose keys would not be worth a shuffle: frequent hashes are tracked
    within each task and the trackers merged.  A key that holds ``HOT_SHARE`` of the rows is always
    among those tracked, as an entry may be off by no more than ``3.5 / _TRACKED`` of the rows;
    counts are close, which is enough to choose salts by.  Numbers of keys stay unknown, as 0.
    """
    top = F.expr(f"approx_top_k(h, {int(1 / HOT_SHARE)}, {_TRACKED})")
    row = df.select(key_hash(keys).alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("h").alias("keyed"), top.alias("top")
    ).first()
    top = [(item["item"], item["count"]) for item in row.top or [] if item["item"] is not None]
    hottest = max((n for _, n in top), default=0)
    profile = KeyProfile(row.rows, row.rows - row.keyed, 0, 0, hottest)
    return replace(profile, hot=tuple((h, n) for h, n in top if n > profile.hot_floor))


def broadcast_bytes(spark):
    """Most bytes a side may have to be broadcast: Spark's own setting for it."""
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    text = value.lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def lookup(left, right, keys, how="left", profile=None, measured=None):
    """Join ``left`` to ``right``, which has one row per key.

    Rows of a hot key, and rows without a key, are spread over salts; the right
    rows of hot keys are repeated once per salt, at most 2 / HOT_SHARE times in
    all.  The salt comes from the input partition, so copies of one row are spread
    as well and a retried task repeats its salts.  ``profile`` may have been taken
    of part of the keys, ``measured``, of which ``right`` then has few rows each.  A streaming ``left`` is joined as it is:
    its micro-batches are bounded by the source.
    """
    keys = list(keys)
    measured = measured or keys
    if left.isStreaming:
        return left.join(right, keys, how)
    profile = profile or profile_keys(left, measured)
    if not profile.skewed:
        return left.join(right, keys, how)

    rows = [(hashed, -(-n // profile.hot_floor)) for hashed, n in profile.hot]
    # Bounded by 1 / HOT_SHARE rows of two numbers, so broadcast whatever the setting.
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, "__hash long, __salts int"))

    def with_salts(df):
        hashed = df.withColumn("__hash", key_hash(measured))
        return hashed.join(hot, "__hash", "left").drop("__hash")

    salts = F.when(_no_nulls(measured), F.coalesce("__salts", F.lit(1))).otherwise(int(1 / HOT_SHARE))
    spread = F.pmod(F.xxhash64(F.spark_partition_id()), salts).cast("int")
    salted_left = with_salts(left).withColumn("__salt", spread).drop("__salts")
    every_salt = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    salted_right = with_salts(right).withColumn("__salt", every_salt).drop("__salts")
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")


def spread_small_input(df, judged=None):
    """Give a small batch input one partition per core.

    Parsing is bound by CPU, and a small table is often one file, so one task.  The
    size is the optimizer's estimate, so nothing runs to get it; a table past it is
    returned as it is, as it has splits enough.  ``judged`` is the input whose size
    counts, where that is not ``df`` itself.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    judged = df if judged is None else judged
    size = int(judged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= min(SMALL_BYTES, cores * SMALL_BYTES_PER_CORE) else df
