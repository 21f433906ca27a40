"""Tables of numbered batches, each of which counts once however often it is written.

A batch is written to a folder of its own attempt, and then published by one small file under
its number, which is moved into place; readers follow those files.  An attempt that failed
half-way, or was repeated, is never read.  One job at a time writes a table, as one checkpoint
belongs to one query.

    <path>/data/batch=<n>/attempt=<id>/…      rows
    <path>/published/batch=<n>/attempt.txt    the attempt that counts
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the layout.
BATCH, ATTEMPT = "batch", "attempt"
_LAYOUT = "batch long, attempt string"
_NOTE = "attempt.txt"


def _data(path):
    return f"{path}/data"


def _published(path):
    return f"{path}/published"


def _file_system(spark, path):
    """Hadoop's file system of a path, which every cluster store has, and a maker of its paths."""
    jvm = spark._jvm
    of = jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def is_published(spark, path, batch):
    system, of = _file_system(spark, path)
    return system.exists(of(f"{_published(path)}/{BATCH}={batch}"))


def write_attempt(rows, path, batch):
    """Write the rows of a batch where nobody reads them yet; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    rows.write.mode("errorifexists").parquet(f"{_data(path)}/{BATCH}={batch}/{ATTEMPT}={attempt}")
    return attempt


def publish_attempt(spark, path, batch, attempt):
    """Make an attempt the one that counts; false where the batch has one already.

    The folder that says so is made aside and moved into place, so it is there as a whole or
    not at all.
    """
    system, of = _file_system(spark, path)
    target = of(f"{_published(path)}/{BATCH}={batch}")
    if system.exists(target):
        return False
    aside = of(f"{path}/publishing/{attempt}")
    system.mkdirs(aside)
    note = system.create(of(f"{path}/publishing/{attempt}/{_NOTE}"))
    note.writeBytes(attempt)
    note.close()
    system.mkdirs(target.getParent())
    if not system.rename(aside, target):
        if system.exists(target):
            return False
        raise OSError(f"batch {batch} of {path} could not be published")
    return True


def commit_batch(rows, path, batch):
    """Write and publish a batch, unless that was done before; true where it was this call."""
    spark = rows.sparkSession
    if is_published(spark, path, batch):
        return False
    return publish_attempt(spark, path, batch, write_attempt(rows, path, batch))


def published(spark, path):
    """``[batch, attempt]`` of what counts."""
    system, of = _file_system(spark, path)
    if not system.exists(of(_published(path))):
        return spark.createDataFrame([], _LAYOUT)
    notes = spark.read.schema(f"value string, {BATCH} long").option("basePath", _published(path)).text(_published(path))
    # A filter on this side is what Spark's dynamic pruning of the other side needs.
    return notes.select(BATCH, F.col("value").alias(ATTEMPT)).where(F.col(ATTEMPT) > "")


def read_committed(spark, path, schema):
    """Rows of the published attempts, with their ``batch``; empty where there are none.

    The list of attempts meets the folders' names; while it is small enough to broadcast,
    Spark's dynamic pruning leaves the other folders unread.  Nothing is collected.
    """
    system, of = _file_system(spark, path)
    if not system.exists(of(_data(path))):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(ATTEMPT, T.StringType())])
    rows = spark.read.schema(whole).option("basePath", _data(path)).parquet(_data(path))
    return rows.join(published(spark, path), [BATCH, ATTEMPT], "left_semi").drop(ATTEMPT)


def remove_unpublished(spark, path):
    """Delete attempts of published batches that do not count; returns how many.

    Batches that are not published are left alone, as one may be under way.
    """
    system, of = _file_system(spark, path)
    removed = 0
    for row in published(spark, path).toLocalIterator():
        folder = of(f"{_data(path)}/{BATCH}={row[BATCH]}")
        if not system.exists(folder):
            continue
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith(f"{ATTEMPT}=") and name != f"{ATTEMPT}={row[ATTEMPT]}":
                removed += bool(system.delete(status.getPath(), True))
    return removed


def numbered(rows, batch):
    """``rows`` with ``batch`` and ``row_key``, by which a repeated batch knows its rows again.

    The key is the hash of the row, and, of rows that are equal, how many came before.
    """
    columns = rows.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns]
    sized = [F.concat(F.length(part).cast("string"), F.lit(":"), part) for part in parts]
    hashed = rows.withColumn("row_key", F.sha2(F.concat(*sized), 256))
    # Equal rows are counted and dealt out again, so a row that repeats is no large group.
    counted = hashed.groupBy(*columns, "row_key").agg(F.count(F.lit(1)).alias("__n"))
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.concat("row_key", F.lit("/"), F.col("__copy").cast("string"))
    return copies.select(*columns, F.lit(batch).cast("long").alias(BATCH), key.alias("row_key"))


def not_stored_yet(rows, stored, batch):
    """What of a batch a table still lacks, ``stored`` being its ``[batch, row_key]``.

    For tables that cannot publish a batch at once, a database's among them: the part that an
    attempt got in before it failed is left out of the next one.
    """
    held = stored.where(F.col(BATCH) == batch).select("row_key")
    return numbered(rows, batch).join(held, "row_key", "left_anti").select(*rows.columns, BATCH, "row_key")
