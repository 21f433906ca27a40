"""Stored tables: type conformance and key checks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltscale.operators.lookup import lookup
from tiltscale.schemas import STORED_RESULT


def _conformed(df, field):
    column = F.col(field.name)
    if isinstance(df.schema[field.name].dataType, T.DoubleType) and isinstance(field.dataType, T.IntegerType):
        # The way a database stores a double in an INT column: nearest, ties to even.
        column = F.rint(column)
    return column.try_cast(field.dataType).alias(field.name)


def conform(df, schema):
    """Columns, order and types of ``schema``; values that do not fit become null."""
    return df.select(*[_conformed(df, field) for field in schema.fields])


def conform_rejects(df, schema):
    """Rows that ``conform`` would change or break, as they are, with ``misfits``.

    Those are the fields, comma-joined in order, whose value does not fit its type, or
    which are null and must not be.
    """
    misfits = []
    for field in schema.fields:
        lost = F.col(field.name).isNotNull() & _conformed(df, field).isNull()
        if not field.nullable:
            lost = lost | F.col(field.name).isNull()
        misfits.append(F.when(lost, F.lit(field.name)))
    return df.withColumn("misfits", F.concat_ws(",", *misfits)).where("misfits <> ''")


def to_stored_results(results):
    """Decoded result messages as rows of the result table."""
    return conform(results.withColumnRenamed("score", "bias_score"), STORED_RESULT)


def primary_key_violations(df, keys):
    """Keys that are null or not unique, with the number of rows that hold them."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | null_key)


def foreign_key_violations(child, key, parent, parent_key):
    """Missing parents: each referenced key without a row, and how many rows refer to it.

    Both sides are pre-aggregated, so neither a popular key nor a repeated
    parent reaches one task as rows.  Null keys refer to nothing.
    """
    referred = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    present = parent.select(F.col(parent_key).alias(key)).distinct()
    return referred.join(present, key, "left_anti")


def orphans(child, key, parent, parent_key):
    """The child rows themselves whose key has no parent row."""
    present = parent.select(F.col(parent_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return lookup(child.where(F.col(key).isNotNull()), present, [key], how="left_anti")
