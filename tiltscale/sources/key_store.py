"""Keys of a growing table, so that a new batch is checked without reading the old keys.

Keys are kept by bucket, beside a Bloom filter of them: a table of bitmaps, one for each block of
hashes, in which every key sets four bits of its block.  Batches add bitmaps of their own, which
are merged where they are read.  A key of which a bit is missing is not stored; only for the
others, which are few unless they are there, are the buckets read that they would be in.

    <path>/keys/key_bucket=<n>/…    key columns, ``n_rows`` of a batch
    <path>/filter/…                 block, bitmap
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of a block are what Spark's bitmap functions have.
_BITS = 32_768
_HASHES = 4
BUCKET, BLOCK = "key_bucket", "key_block"


def _held(keys):
    held = F.lit(True)
    for key in keys:
        held = held & F.col(key).isNotNull()
    return held


class KeyStore:
    """Keys at ``path``.  ``blocks`` of some 2,000 keys each let one of a thousand new keys through.

    Numbers of blocks and buckets belong to the store: give the same ones each time.
    """

    def __init__(self, spark, path, keys, buckets=256, blocks=16_384):
        self.spark, self.path, self.keys, self.buckets, self.blocks = spark, path, list(keys), buckets, blocks

    def _placed(self, df):
        """``df`` with its block, its bucket, and the places of its bits in the block."""
        own = F.xxhash64(*self.keys)
        other = F.xxhash64(F.lit("bits"), *self.keys)
        bits = [F.pmod(F.shiftrightunsigned(other, 15 * i), F.lit(_BITS)) for i in range(_HASHES)]
        block = F.pmod(own, F.lit(self.blocks))
        return df.withColumns({BLOCK: block, BUCKET: F.pmod(block, F.lit(self.buckets)).cast("int"), "__bits": F.array(*bits)})

    def _counted(self, df):
        return df.where(_held(self.keys)).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_rows"))

    def add(self, df):
        """Add the keys of a batch; rows without one are left out.  Order of columns and repeats do not matter."""
        placed = self._placed(self._counted(df))
        rows = placed.select(*self.keys, "n_rows", BUCKET).repartition(BUCKET)
        rows.write.mode("append").partitionBy(BUCKET).parquet(f"{self.path}/keys")
        bits = placed.select(BLOCK, F.explode("__bits").alias("bit"))
        bits.groupBy(BLOCK).agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode("append").parquet(f"{self.path}/filter")

    def _exists(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filter")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def candidates(self, keyed):
        """Rows of ``keyed`` whose key may be stored, by the filter alone."""
        bitmaps = self.spark.read.schema(f"{BLOCK} long, bitmap binary").parquet(f"{self.path}/filter")
        merged = bitmaps.groupBy(BLOCK).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

        def is_set(bit):
            # A byte of a binary as a number, by its two hexadecimal digits.
            byte = F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
            return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0

        return self._placed(keyed).join(merged, BLOCK).where(F.forall("__bits", is_set)).drop("bitmap", "__bits", BLOCK)

    def stored(self, keyed):
        """``[*keys, n_rows]`` of the keys of ``keyed``, one row each, that are stored.

        A job finds the buckets to read, of which there are as many as the store has; the other
        buckets' files are not opened.
        """
        fields = [*keyed.select(*self.keys).schema.fields, T.StructField("n_rows", T.LongType())]
        schema = T.StructType(fields)
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        hits = self.candidates(keyed.select(*self.keys))
        wanted = [row[0] for row in hits.select(BUCKET).distinct().collect()]
        # Without a bucket nothing is listed at all.
        if not wanted:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/keys")
        rows = rows.where(F.col(BUCKET).isin(wanted)).join(hits.select(*self.keys), self.keys, "left_semi")
        return rows.groupBy(*self.keys).agg(F.sum("n_rows").alias("n_rows"))


def appended_key_violations(batch, store):
    """Keys that a batch makes null or not unique: ``[*keys, n_rows]``, with the rows of all batches.

    Check a batch before it is added.  The latest count of each key, over all batches, is what
    ``primary_key_violations`` gives for the whole table; keys that hold a null are not stored, so
    their counts are of the batch alone.
    """
    counted = batch.groupBy(*store.keys).agg(F.count(F.lit(1)).alias("n_rows"))
    held = _held(store.keys)
    before = store.stored(counted.where(held)).withColumnRenamed("n_rows", "__before")
    total = F.col("n_rows") + F.coalesce("__before", F.lit(0))
    checked = counted.join(before, store.keys, "left").withColumn("n_rows", total).drop("__before")
    return checked.where((F.col("n_rows") > 1) | ~held)


def appended_reference_violations(batch, key, store):
    """Keys of a batch that no stored parent has: ``[key, n_rows]``, with the rows of the batch.

    Keys that the filter lets through are confirmed; of the others nothing is read.
    """
    (parent_key,) = store.keys
    referred = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(parent_key)).agg(F.count(F.lit(1)).alias("n_rows"))
    missing = referred.join(store.stored(referred).select(parent_key), parent_key, "left_anti")
    return missing.select(F.col(parent_key).alias(key), "n_rows")
