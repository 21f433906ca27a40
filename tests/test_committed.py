"""Batches of a stored table count once."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltscale import schemas
from tiltscale.plans.catalog import QUERIES
from tiltscale.sources import committed
from tiltscale.sources.sinks import append_missing


def _rows(spark, n, first=0):
    rows = [(f"u{i % 7}", None if i % 5 == 0 else "gpt", "r" * (i % 3), float(i % 4)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, schemas.STORED_RESULT)


def _sorted(df):
    return sorted(map(str, df.select(*schemas.STORED_RESULT.fieldNames()).collect()))


def test_a_batch_counts_once_however_often_it_is_written(spark, tmp_path):
    path = str(tmp_path / "table")
    first, second = _rows(spark, 20), _rows(spark, 10, 100)
    assert committed.read_committed(spark, path, schemas.STORED_RESULT).count() == 0
    committed.write_attempt(first.limit(3), path, 0)
    assert committed.read_committed(spark, path, schemas.STORED_RESULT).count() == 0
    assert committed.commit_batch(first, path, 0)
    assert not committed.commit_batch(first, path, 0)
    late = committed.write_attempt(first, path, 0)
    assert not committed.publish_attempt(spark, path, 0, late)
    assert committed.commit_batch(second, path, 1)
    table = committed.read_committed(spark, path, schemas.STORED_RESULT)
    assert _sorted(table) == _sorted(first.union(second))
    assert {r.batch for r in table.collect()} == {0, 1}
    assert committed.remove_unpublished(spark, path) == 2
    assert _sorted(committed.read_committed(spark, path, schemas.STORED_RESULT)) == _sorted(first.union(second))


def test_an_attempt_of_an_unpublished_batch_stays(spark, tmp_path):
    path = str(tmp_path / "table")
    attempt = committed.write_attempt(_rows(spark, 4), path, 3)
    assert committed.remove_unpublished(spark, path) == 0
    assert committed.publish_attempt(spark, path, 3, attempt)
    assert committed.read_committed(spark, path, schemas.STORED_RESULT).count() == 4


def test_other_attempts_are_not_read(spark, tmp_path):
    """The list of attempts prunes folders; their files are not opened."""
    path = str(tmp_path / "table")
    attempt = committed.write_attempt(_rows(spark, 4), path, 0)
    committed.commit_batch(_rows(spark, 5), path, 0)
    folder = f"{path}/data/batch=0/attempt={attempt}"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(f"{folder}/{name}", "wb") as file:
                file.write(b"no parquet")
    for name in os.listdir(folder):
        if name.startswith("."):
            os.unlink(f"{folder}/{name}")
    assert committed.read_committed(spark, path, schemas.STORED_RESULT).count() == 5


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_a_table_that_took_part_of_a_batch_gets_the_rest(spark, tmp_path, share):
    path = str(tmp_path / "table")
    rows = _rows(spark, 30).union(_rows(spark, 30))  # every row at least twice
    schema = T.StructType(rows.schema.fields + T.StructType().add("batch", "long").add("row_key", "string").fields)

    def stored():
        return spark.read.schema(schema).parquet(path)

    spark.createDataFrame([], schema).write.parquet(path)
    append_missing(_rows(spark, 30), stored(), 6, path=path)
    rng = random.Random(1)
    part = [r for r in committed.numbered(rows, 7).collect() if rng.random() < share]
    spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    for _ in range(2):
        append_missing(rows, stored(), 7, path=path)
    assert _sorted(stored().where("batch = 7")) == _sorted(rows)
    assert stored().where("batch = 6").count() == 30
    assert stored().select("batch", "row_key").distinct().count() == 90


def test_keys_tell_nulls_from_texts(spark):
    df = spark.createDataFrame([("a", None), ("a", "null"), (None, "a"), ("1:a", "")], "x string, y string")
    assert committed.numbered(df, 1).select("row_key").distinct().count() == 4


def test_replayed_storage_equals_a_single_run(spark):
    folder = "/root/testdata/sf0.001"
    once, again = (QUERIES[n](spark, folder) for n in ("storage_stream", "storage_stream_replayed"))
    assert again.columns == once.columns
    assert again.exceptAll(once).count() == 0 and once.exceptAll(again).count() == 0
    assert once.agg(F.count("*")).first()[0] > 0
