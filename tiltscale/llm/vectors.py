"""Vector tables: which rows take part, and queries against all rows in blocks."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

# Rows of a block of data, and queries of a block of queries, that meet in one task.
DATA_BLOCK = 4_096
QUERY_BLOCK = 2_048


def usable(vectors, vec="embedding", key="vec_id", allow_zero=True):
    """``[vec_id, v]``, distinct rows that take part, and their dimension (None: no rows).

    Rows without a key or vector, with a null or non-finite component, with another
    dimension than most rows have (of ties the least), or, unless ``allow_zero``, of
    zeros alone, do not.
    """
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vec) > 0)
    if not allow_zero:
        good = good & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(good).select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return rows, None
    return rows.where(F.size("v") == sizes.n).distinct(), sizes.n


def in_blocks(rows, queries, search, schema):
    """``search(queries, rows)``, two pandas frames, for every block of queries and of rows.

    Each block of rows is dealt once per block of queries, and the other way round, so a
    task holds one of each, whatever the sizes.
    """
    data_blocks = max(1, math.ceil(rows.count() / DATA_BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def dealt(df, own, count, other, others):
        numbered = df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(queries, "qb", query_blocks, "db", data_blocks).groupBy("qb", "db")
    right = dealt(rows, "db", data_blocks, "qb", query_blocks).groupBy("qb", "db")
    return left.cogroup(right).applyInPandas(search, schema)


def best(found, k):
    """The ``k`` best of each query's finds, as ``[query_id, rank, vec_id, score]``; ties to the lesser id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
