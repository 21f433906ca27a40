"""Key checks of batches equal those of the whole table, and leave old keys alone."""

import os

from pyspark.sql import functions as F

from tiltscale.operators.tables import foreign_key_violations, primary_key_violations
from tiltscale.sources.key_store import KeyStore, appended_key_violations, appended_reference_violations


def _batches(spark):
    """Keys of two columns: some null, some twice in a batch, some again in a later one."""
    a = "case when id % 50 = 7 then null else id % 900 end as a"
    rows = spark.range(2000).selectExpr(a, "concat('k', id % 30) as b", "id div 500 as batch")
    return [rows.where(F.col("batch") == i).drop("batch") for i in range(4)], rows.drop("batch")


def test_batches_find_what_a_full_check_finds(spark, tmp_path):
    batches, whole = _batches(spark)
    store, latest = KeyStore(spark, str(tmp_path / "keys"), ["a", "b"], buckets=4, blocks=16), {}
    nulls = {}
    for batch in batches:
        for r in appended_key_violations(batch, store).collect():
            if r.a is None or r.b is None:
                nulls[r.a, r.b] = nulls.get((r.a, r.b), 0) + r.n_rows
            else:
                latest[r.a, r.b] = r.n_rows
        store.add(batch)
    assert latest | nulls == {(r.a, r.b): r.n_rows for r in primary_key_violations(whole, ["a", "b"]).collect()}
    assert len(latest) > 100


def test_references_find_what_a_full_check_finds(spark, tmp_path):
    parents = spark.range(1000).selectExpr("concat('p', id) as link")
    children = spark.range(3000).selectExpr("case when id % 11 = 0 then null else concat('p', id % 1300) end as parent")
    store = KeyStore(spark, str(tmp_path / "keys"), ["link"], buckets=4, blocks=16)
    for part in (0, 1):
        store.add(parents.where(F.xxhash64("link") % 2 == (0 if part else 1)))
    store.add(parents.where(F.xxhash64("link") % 2 == -1))
    got = {(r.parent, r.n_rows) for r in appended_reference_violations(children, "parent", store).collect()}
    assert got == {(r.parent, r.n_rows) for r in foreign_key_violations(children, "parent", parents, "link").collect()}
    assert len(got) == 300 and all(n for _, n in got)


def test_a_filter_lets_few_others_through(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"), ["k"], buckets=4, blocks=8)
    store.add(spark.range(16_000).selectExpr("concat('old', id) as k"))
    others = spark.range(16_000).selectExpr("concat('new', id) as k")
    assert store.candidates(others).count() < 16_000 / 200
    assert store.candidates(spark.range(16_000).selectExpr("concat('old', id) as k")).count() == 16_000


def test_old_keys_are_read_only_where_the_filter_hits(spark, tmp_path):
    path = str(tmp_path / "keys")
    store = KeyStore(spark, path, ["k"], buckets=16, blocks=64)
    old = spark.range(2000).selectExpr("concat('old', id) as k")
    store.add(old)
    batch = spark.createDataFrame([("old5",), ("new1",), ("new2",)], "k string")
    hits = {r.key_bucket for r in store.candidates(batch).collect()}
    assert 1 <= len(hits) <= 2
    # Files of the other buckets could as well be no files at all.
    for folder in os.listdir(f"{path}/keys"):
        if folder.startswith("key_bucket=") and int(folder.split("=")[1]) not in hits:
            for name in os.listdir(f"{path}/keys/{folder}"):
                os.unlink(f"{path}/keys/{folder}/{name}") if name.startswith(".") else open(f"{path}/keys/{folder}/{name}", "w").write("none")
    assert [tuple(r) for r in appended_key_violations(batch, store).collect()] == [("old5", 2)]
    misses = [f"new{i}" for i in range(100)]
    keyed = spark.createDataFrame([(k,) for k in misses], "k string")
    missed = keyed.join(store.candidates(keyed).select("k"), "k", "left_anti")
    assert "FileScan" not in store.stored(missed)._jdf.queryExecution().executedPlan().toString()


def test_an_empty_store_and_an_empty_batch(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"), ["k"], buckets=4, blocks=8)
    batch = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {tuple(r) for r in appended_key_violations(batch, store).collect()} == {("a", 2), (None, 1)}
    store.add(batch.where("false"))
    assert {tuple(r) for r in appended_key_violations(batch, store).collect()} == {("a", 2), (None, 1)}
    assert appended_key_violations(batch.where("false"), store).count() == 0
