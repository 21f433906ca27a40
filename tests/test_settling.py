"""Calls are made once, across copies, lost workers and runs."""

import os

import pytest
from pyspark.sql import functions as F

from tiltscale.fixed_values import UNKNOWN_MODEL
from tiltscale.operators import lookup as lookups
from tiltscale.operators import rating
from tiltscale.operators.settling import called_once, settled_calls
from tiltscale.plans.catalog import QUERIES


def _articles(spark, n=60, contents=20):
    rows = [(i, f"u{i}", f"text {i % contents}", ("gpt", "claude")[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, url string, content string, model string").repartition(4)


def _counting(folder, fail=None, die=None):
    """A client that notes each call, refuses some texts, and ends its worker once at one."""

    def client():
        def ask(prompt, options):
            text = next(f"text {i}" for i in reversed(range(100)) if f"text {i}" in prompt)
            with open(f"{folder}/{os.getpid()}", "a") as file:
                file.write(f"{options['provider_model']}/{text}\n")
            if text == die and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            if text == fail and not os.path.exists(f"{folder}/mended"):
                raise ValueError("refused")
            return f"{options['provider_model']} on {text}"

        return ask

    return client


def _calls(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n") if line)


def _rated(spark, articles, client, store, **more):
    return rating.rate(articles, called_once(client, store, parts=4, **more))


def _texts(df):
    return {(r.doc_id, r.result, r.rating_error) for r in df.select("doc_id", "result", "rating_error").collect()}


@pytest.fixture
def folders(tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    return str(notes), str(tmp_path / "store")


def test_equal_contents_are_asked_once_and_all_rows_get_the_answer(spark, folders):
    notes, store = folders
    rated = _rated(spark, _articles(spark), _counting(notes), store, calls_in_flight=3)
    rows = rated.collect()
    assert len(rows) == 60 and all(r.result.endswith(f"on {r.content}") and r.rating_error is None for r in rows)
    assert len(_calls(notes)) == len(set(_calls(notes))) == 20
    rated.count()  # branching from the result makes no more calls
    again = _rated(spark, _articles(spark, 90, 30), _counting(notes), store)
    assert again.where("result is null").count() == 0
    assert len(_calls(notes)) == len(set(_calls(notes))) == 30
    assert settled_calls(spark, store).count() == 30


def test_a_failed_call_is_an_error_now_and_made_again_later(spark, folders):
    notes, store = folders
    first = _rated(spark, _articles(spark), _counting(notes, fail="text 7"), store)
    assert {(r.content, r.rating_error) for r in first.where("result is null").collect()} == {("text 7", "refused")}
    open(f"{notes}/mended", "w").close()
    second = _rated(spark, _articles(spark), _counting(notes, fail="text 7"), store)
    assert second.where("result is null or rating_error is not null").count() == 0
    assert len(_calls(notes)) == 21


def test_a_lost_worker_repeats_only_what_was_under_way(spark, folders):
    notes, store = folders
    client = _counting(notes, die="text 11")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        try:
            _rated(spark, _articles(spark), client, store, settle_every=1)
        except Exception:
            # One attempt a task in this session: the job is run again instead.
            pass
        assert os.path.exists(f"{notes}/died")
        rated = _rated(spark, _articles(spark), client, store, settle_every=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    assert rated.where("result is null").count() == 0 and rated.count() == 60
    # Other tasks may have been stopped in a call of theirs as the job failed.
    repeated = len(_calls(notes)) - len(set(_calls(notes)))
    assert len(set(_calls(notes))) == 20 and 1 <= repeated <= 4


def test_a_content_that_most_rows_share_is_spread(spark, folders, monkeypatch):
    notes, store = folders
    monkeypatch.setattr(lookups, "HOT_MIN_ROWS", 10)
    hot = _articles(spark, 200, 100).withColumn("content", F.when(F.col("doc_id") < 150, "text 1").otherwise(F.col("content")))
    rated = _rated(spark, hot.withColumn("model", F.lit("gpt")), _counting(notes), store)
    assert rated.count() == 200 and rated.where("result is null").count() == 0
    assert "__salt" in rated._jdf.queryExecution().optimizedPlan().toString()
    assert len(_calls(notes)) == 51


def test_unasked_rows_and_empty_inputs(spark, folders):
    notes, store = folders
    articles = _articles(spark, 6).withColumn("model", F.when(F.col("doc_id") < 3, "other").otherwise("gpt"))
    assert {t[2] for t in _texts(_rated(spark, articles, _counting(notes), store)) if t[1] is None} == {UNKNOWN_MODEL}
    assert _rated(spark, articles.where("false"), _counting(notes), store).count() == 0
    assert len(_calls(notes)) == 3


def test_query_equals_the_plain_calls(spark):
    folder = "/root/testdata/sf0.001"
    plain, once = (QUERIES[name](spark, folder) for name in ("rate_called", "rate_called_once"))
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
