"""Input that does not fit is refused by name, wherever it comes in."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tiltscale import schemas
from tiltscale.fixed_values import KNOWN_MODELS, PROMPTS
from tiltscale.functions.text import decoded as decoded_fields
from tiltscale.operators import messages, rating, tables
from tiltscale.operators.fetch import attach_pages
from tiltscale.operators.intake import parse_requests
from tiltscale.plans.profiles import SYNC
from tiltscale.plans.requests import scrape

# Length and MD5 of each prompt template, so that a changed letter shows.
PROMPT_DIGESTS = {
    "detailed": (765, "931b1eb7d87b7e6f26a8f1b4c10046a8"),
    "detailed_legacy": (798, "c8759be18bf35cfa510e6fc7f32ede00"),
    "brief": (485, "0d28d13626b7b9d47f24609e89fd10fa"),
    "strict_format": (301, "1e3de2056455020a1492001fd9103808"),
}


def test_prompt_templates_are_unchanged():
    assert {n: (len(t), hashlib.md5(t.encode()).hexdigest()) for n, t in PROMPTS.items()} == PROMPT_DIGESTS


def _values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


GOOD = '{"url":"u","model":"gpt","result":"r","score":1.5}'


TAILS = [" junk", "{}", GOOD, "]", "] {}", ",", '"x"', "}", ',"z":2', ',"end":1}', "],[{}", "],[", ":1", "\x00"]


@pytest.mark.parametrize("tail", TAILS)
def test_what_follows_an_object_makes_it_malformed(spark, tail):
    df = _values(spark, GOOD, GOOD + " \n", GOOD + tail)
    assert messages.decode_results(df).count() == 2
    assert [r.reason for r in messages.result_rejects(df).collect()] == ["malformed"]
    bodies = spark.createDataFrame([(1, '{"url":"u"}'), (2, '{"url":"u"}' + tail)], "request_id long, body string")
    assert {r.request_id: r.status for r in parse_requests(bodies, SYNC).collect()} == {1: None, 2: 400}


def _object(text):
    """The object that a text is, for a parser that reads it whole; else None."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def test_only_texts_that_are_one_object_decode(spark):
    """Random texts around what a request, a list and the places it is parsed in look like."""
    rng = random.Random(11)
    parts = [
        "{", "}", "[", "]", ",", ":", '"url"', '"model"', '"end"', '"whole"', "1", "null", " ", '"u"', '{"url":"u"}', '"url":"a"',
        '"end":1', ',"end":1}', '1,"whole":', "],[", '"\\u0075rl"', "'url'", "//", "true", "-1", '"__nothing":2',
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    texts += [a + t + b for t in ('{"url":"u"}', '{"model":null}', "{}") for a in parts for b in parts]
    members = ['"url":"a"', '"url":null', '"model":1', '"end":1', '"whole":{"url":"x"}', '"\\u0075rl":"z"', '"temperature":0.5', '"url":7']
    texts += ["{" + ",".join(rng.sample(members, rng.randint(0, 4))) + rng.choice(["}", "}", "},", ""]) for _ in range(500)]
    bodies = spark.createDataFrame(list(enumerate(texts)), "request_id long, body string")
    decoded = {r.request_id: r for r in bodies.select("request_id", decoded_fields("body", schemas.REQUEST_BODY)).collect()}
    assert len(decoded) == len(texts)
    goods = 0
    for i, text in enumerate(texts):
        found, keys = _object(text), decoded[i]["__keys"]
        assert (found is None) == (keys is None), text
        if found is not None:
            goods += 1
            assert {k for k in ("url", "model") if k in keys} >= {k for k in ("url", "model") if k in found}, text
            assert isinstance(found.get("url"), (dict, list)) or decoded[i].url in (found.get("url"), str(found.get("url"))) or (
                decoded[i].url == json.dumps(found.get("url"))
            ), text
    assert goods > 100


@pytest.mark.parametrize(
    "score, good", [("1.5", 1.5), ('"1.5"', 1.5), ("null", None), ('"high"', "bad"), ("[1]", "bad"), ("{}", "bad"), ("true", "bad")]
)
def test_scores_are_numbers_or_rejects(spark, score, good):
    df = _values(spark, f'{{"url":"u","model":"gpt","result":"r","score":{score}}}')
    decoded, rejected = messages.decode_results(df).collect(), messages.result_rejects(df).collect()
    if good == "bad":
        assert not decoded and [r.reason for r in rejected] == ["bad score"]
    else:
        assert [r.score for r in decoded] == [good] and not rejected


def test_good_and_rejected_are_all(spark):
    rows = [(1, "a", 1.0, "x"), (3_000_000_000, "b", 1.0, "x"), (None, "c", 1.0, "x"), (2, None, 1e12, None), (3, "d", None, "x")]
    df = spark.createDataFrame(rows, "id long, Link string, Score double, Comments string")
    rejects = {(r.id, r.Link): r.misfits for r in tables.conform_rejects(df, schemas.RESPONSE).collect()}
    assert rejects == {(3_000_000_000, "b"): "id", (None, "c"): "id", (2, None): "Score"}


def _articles(spark, n=6):
    rows = [(i, f"u{i}", "text " * i, KNOWN_MODELS[0]) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id long, url string, content string, model string")


@pytest.mark.parametrize("answer", [None, 5, b"\xff", "\ud800", ["x"]])
def test_answers_that_are_no_text_concern_their_row(spark, answer):
    def client():
        return lambda prompt, options: "fine" if "text text text" in prompt else answer

    rows = rating.rate(_articles(spark), rating.called(client, calls_in_flight=3)).collect()
    assert {r.doc_id for r in rows if r.result == "fine"} == {3, 4, 5, 6}
    assert all(r.rating_error and r.result is None for r in rows if r.doc_id < 3)


def test_articles_do_not_travel_to_the_client(spark):
    rated = rating.rate(_articles(spark), rating.called(lambda: lambda prompt, options: "x"))
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    python = [line for line in plan.splitlines() if "EvalPython" in line]
    assert len(python) == 1 and "content" not in python[0].split("]")[0]
    assert "MapInArrow" not in plan


def test_calls_overlap_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = rating.rate(_articles(spark, 11).coalesce(1), rating.called(lambda: lambda p, o: str(len(p)), 4)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    lengths = {r.doc_id: int(r.result) for r in rows}
    assert len(lengths) == 11 and all(lengths[i + 1] - lengths[i] == 5 for i in range(1, 11))


def test_known_answers_are_not_paid_for_again(spark):
    articles = _articles(spark)
    held = rating.content_key(articles.where("doc_id <= 2")).select("url", "model", "content_hash")
    changed = articles.withColumn("content", F.when(F.col("doc_id") == 1, F.lit("new")).otherwise(F.col("content")))
    assert {r.doc_id for r in rating.not_rated_yet(changed, held).collect()} == {1, 3, 4, 5, 6}


def test_settled_answers_need_no_sort_of_texts(spark):
    rows = [("u", "gpt", "b"), ("u", "gpt", "a"), ("v", "gpt", "c"), (None, "gpt", "d"), ("w", "claude", None)]
    answers = spark.createDataFrame(rows, "url string, model string, result string")
    assert {tuple(r) for r in rating.settled(answers).collect()} == {("u", "gpt", "a"), ("v", "gpt", "c"), ("w", "claude", None)}


def _web(spark):
    rows = [(None, "https://x.org/1", "<p>old</p>"), (1, "https://x.org/1", "<p>new</p>"), (None, "https://x.org/2", "<p>only</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _requests(spark):
    bodies = [(1, "https://x.org/1", "gpt"), (2, "https://x.org/2", "gpt"), (3, "https://x.org/2", "other"), (4, "https://x.org/9", "gpt")]
    rows = [(i, f'{{"url":"{u}","model":"{m}"}}') for i, u, m in bodies]
    return spark.createDataFrame(rows, "request_id long, body string")


@pytest.mark.parametrize("way", ["auto", "no_broadcast"])
def test_captures_without_a_number_and_content_by_own_model(spark, request, way):
    if way == "no_broadcast":
        request.getfixturevalue("no_broadcast")
    fetched = {r.request_id: r.html for r in attach_pages(parse_requests(_requests(spark), SYNC), _web(spark), SYNC).collect()}
    assert fetched == {1: "<p>new</p>", 2: "<p>only</p>", 3: "<p>only</p>", 4: None}
    scraped = scrape(_requests(spark), _web(spark), SYNC, KNOWN_MODELS).collect()
    assert {r.request_id: r.content for r in scraped} == {1: "new", 2: "only", 3: None, 4: None}


def test_html_is_not_shuffled_before_the_url_join(spark):
    pages = spark.range(200).selectExpr("id as page_id", "concat('https://x.org/', id) as url", "repeat('<p>x</p>', 50) as html")
    plan = attach_pages(parse_requests(_requests(spark), SYNC), pages, SYNC)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("Join")[-1]
