"""Tables written by the jobs."""

from tiltscale.operators.tables import to_stored_results
from tiltscale.sources.committed import not_stored_yet


def append_results(results, path=None, fmt="parquet", **options):
    """Append decoded results to the result table, files or JDBC (``dbtable``, ``url``).

    Every partition writes its rows over one connection, in batches.
    """
    writer = to_stored_results(results).write.format(fmt).options(**options).mode("append")
    writer.save(path) if path else writer.save()


def append_missing(rows, stored, batch, fmt="parquet", path=None, **options):
    """Append what ``stored``, ``[batch, row_key]`` of the table, lacks of a numbered batch.

    The number and the key are columns of the table, so a batch that failed half-way and is
    repeated adds the rest of it.
    """
    writer = not_stored_yet(rows, stored, batch).write.format(fmt).options(**options).mode("append")
    writer.save(path) if path else writer.save()


def write_once(df, path, *partition_by):
    """Materialise ``df`` as parquet and return the table read back.

    Everything that branches from paid or heavy work should branch from here.
    """
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
