"""Shards cut from the Hilbert-curve order of document metadata."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tiltscale.llm.common import ranked, salts_for, written

BITS = 5
# Letters of a text dimension that its quantiles tell apart, after the common prefix.
_LETTERS = 6


def hilbert_index(axes, bits=BITS):
    """Place on the Hilbert curve of points given as integer arrays, one per axis.

    John Skilling's transform (2004): undo the rotations from the top bit down, take
    the Gray code, and interleave the bits.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ flip) >> bit) & 1)
    return index


def _as_number(df, name):
    """An order-preserving number of a dimension: itself, or the letters after a common prefix."""
    kind = dict(df.dtypes)[name]
    if kind != "string":
        return F.col(name).cast("double")
    ends = df.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
    same = 0
    for p, q in zip(ends.a or "", ends.b or ""):
        if p != q:
            break
        same += 1
    letters = F.rpad(F.hex(F.substring(F.encode(F.substring(F.col(name), same + 1, _LETTERS), "utf-8"), 1, _LETTERS)), 2 * _LETTERS, "0")
    return F.conv(letters, 16, 10).cast("double")


def quantised(df, dimensions, bits=BITS):
    """Cells of each dimension, ``0 .. 2**bits - 1``: equal shares of the rows, by quantiles.

    Null is the lowest cell.  The quantiles, ``2**bits - 1`` numbers a dimension, are all
    that reaches the driver.
    """
    numbers = df.select(*[_as_number(df, name).alias(name) for name in dimensions])
    shares = [i / 2**bits for i in range(1, 2**bits)]
    cuts = numbers.agg(*[F.percentile_approx(name, shares, 1000).alias(name) for name in dimensions]).first()
    cells = []
    for name in dimensions:
        own = cuts[name] or []
        number = _as_number(df, name)
        # A cell is the number of cuts at or below the value; a frequent value takes up several.
        cell = F.size(F.filter(F.array(*map(F.lit, own)), lambda c, v=number: c <= v)) if own else F.lit(0)
        cells.append(F.when(F.col(name).isNull(), 0).otherwise(cell).cast("int").alias(f"cell_{name}"))
    return cells


def shard_by_curve(docs, shards=16, dimensions=("lang", "source", "n_bytes"), key="doc_id", text="text", bits=BITS):
    """``[doc_id, size, text_crc32, curve, shard, slot]`` of every document.

    ``n_bytes`` is the UTF-8 size of the text; the other dimensions are columns of ``docs``
    (one that is missing counts as null).  Documents are put in the order of their cells
    along the curve, which is cut into runs of equal counts, at most one row apart.  The
    order within a cell is that of a hash of the identifiers; rows that are equal in all of
    them are interchangeable.  Texts are read once and go no further.
    """
    nothing = F.lit(None).cast("string")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (n_bytes + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *[
            (n_bytes if d == "n_bytes" else F.col(d) if d in docs.columns else nothing).alias(f"dim_{d}")
            for d in dimensions
        ],
    )
    slim = written(slim, "metadata")

    @F.pandas_udf("long")
    def curve(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    cells = quantised(slim, [f"dim_{d}" for d in dimensions], bits)
    placed = slim.select("doc_id", "size", "text_crc32", *cells)
    placed = placed.select("doc_id", "size", "text_crc32", curve(*placed.columns[3:]).alias("curve"))
    placed = written(placed, "placed")
    rows = placed.count()

    # Where each cell begins: sums of blocks of cells, then of the cells in a block.
    # There are at most 2 ** (bits * dimensions) cells.
    cell = placed.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    cell = cell.withColumn("block", F.shiftright("curve", bits * len(dimensions) // 2))
    preceding = (Window.unboundedPreceding, -1)
    blocks = cell.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(*preceding)), F.lit(0)).alias("a"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("curve").rowsBetween(*preceding))
    starts = cell.withColumn("b", F.coalesce(within, F.lit(0))).join(blocks, "block").select("curve", (F.col("a") + F.col("b")).alias("first"))

    order = ["text_crc32", "doc_id", "size"]
    place = ranked(placed, ["curve"], order, salts_for(rows)).join(starts, "curve").withColumn("place", F.col("first") + F.col("rank"))
    cut = place.withColumn("shard", F.expr(f"cast(place * {shards}L div {max(rows, 1)}L as int)"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return cut.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - first).alias("slot"))
