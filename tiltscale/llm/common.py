"""Helpers the operators share: tables, scratch folders, ranks without hot tasks."""

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiltscale.session import shared_folder

# Rows one task ranks or compares at ease.
ROWS_PER_TASK = 1_000_000


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark, name):
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df, name):
    """``df`` written to the shared folder and read again.

    Cuts the lineage: what follows reads files, whatever executors are lost, and
    work that is not repeatable to the row (range sampling) happens once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salts_for(rows, least=64):
    """Salts that keep a group of all ``rows`` under ``ROWS_PER_TASK`` a task."""
    return max(least, math.ceil(rows / ROWS_PER_TASK))


def ranked(df, group, order, salts, name="rank"):
    """Add ``name``, the row's place from 0 within ``group``.

    A group may hold any share of the rows: it is dealt over ``salts`` hash slices
    of ``order``, ranked slice by slice, and each slice starts where the ones before
    it end.  Rows equal in ``order`` are interchangeable.
    """
    keys = [*group, "__slice"]
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        sliced.withColumn("__place", place)
        .join(starts, keys)
        .withColumn(name, F.col("__before") + F.col("__place"))
        .drop("__slice", "__place", "__before")
    )
