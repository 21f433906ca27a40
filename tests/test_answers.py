"""Micro-batches against large static tables: pruned buckets, sketched keys, indexed captures."""

import json

import pytest
from pyspark.sql import functions as F

from tiltscale.operators import lookup as lookups
from tiltscale.operators.fetch import attach_pages
from tiltscale.operators.intake import parse_requests
from tiltscale.operators.messages import decode_results
from tiltscale.operators.rating import rate, recorded
from tiltscale.plans.catalog import QUERIES
from tiltscale.plans.profiles import SYNC
from tiltscale.sources.captures import BUCKET, count_last, indexed_last, near, write_answers, write_captures, write_index
from tiltscale.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _responses(spark, n=400):
    rows = [(f"u{i}", "gpt", f"because !$*_&{i % 5 - 2}!$*_&") for i in range(n)] + [("u3", "gpt", "a"), (None, "gpt", "x")]
    return spark.createDataFrame(rows, "url string, model string, result string")


def _stream(spark, folder, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").repartition(1).write.text(folder)
    return spark.readStream.schema("value string").text(folder)


def _article(url, content="text", model="gpt"):
    return json.dumps({"content": content, "model": model, "url": url})


def test_answers_of_other_buckets_are_not_read(spark, tmp_path):
    answers = write_answers(_responses(spark), str(tmp_path / "answers"), buckets=64)
    assert answers.count() == 400
    lines = [_article(u) for u in ("u3", "u5", "u3", "gone")] + [_article("u9", content=""), "junk"]
    plans, results = [], []

    def publish(messages, number):
        plans.append(plan_of(messages))
        results.extend(decode_results(messages).collect())

    source = _stream(spark, str(tmp_path / "in"), lines)
    jobs.answer_job(source, answers, str(tmp_path / "checkpoint"), publish, jobs.DRAIN).awaitTermination()
    assert sorted((r.url, r.result, r.score) for r in results) == [
        ("gone", "Error processing article.", -999.0), ("u3", "a", -999.0), ("u3", "a", -999.0), ("u5", "because !$*_&-2!$*_&", -2.0),
    ]
    scans = [line for line in plans[0].splitlines() if "FileScan" in line and BUCKET in line]
    assert scans and all(f"{BUCKET}" in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)
    # Three URLs fall in three buckets at most; that of the article without content is not asked for.
    wanted = spark.createDataFrame([(u,) for u in ("u3", "u5", "gone")], "url string")
    assert near(answers, wanted).select(BUCKET).distinct().count() <= 3


def test_a_sketch_finds_what_a_profile_finds(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_MIN_ROWS", 300)
    url = "case when id % 2 = 0 then 'hot' when id % 10 = 1 then 'warm' when id % 10 = 3 then null else concat('u', id) end"
    df = spark.range(0, 20_000, 1, 8).selectExpr(f"{url} as url")
    full, sketch = lookups.profile_keys(df, ["url"]), lookups.sketch_keys(df, ["url"])
    assert (sketch.rows, sketch.null_rows) == (full.rows, full.null_rows) == (20_000, 2_000)
    assert dict(sketch.hot).keys() == dict(full.hot).keys() and len(full.hot) == 2
    assert all(abs(n - dict(full.hot)[h]) <= 100 for h, n in sketch.hot)
    assert sketch.skewed and full.skewed
    empty = lookups.sketch_keys(df.where("false"), ["url"])
    assert (empty.rows, empty.null_rows, empty.hot, empty.skewed) == (0, 0, (), False)


def test_a_sketch_costs_one_exchange_of_one_row_a_task(spark):
    df = spark.range(1000).selectExpr("concat('u', id) as url")
    plan = plan_of(df.select(lookups.key_hash(["url"]).alias("h")).agg(F.expr("approx_top_k(h, 1000, 16384)")))
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan


def test_a_url_in_half_of_a_batch_is_spread(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_MIN_ROWS", 100)
    rows = spark.range(0, 8000, 1, 16).selectExpr(
        "case when id % 2 = 0 then 'u3' else concat('u', id % 300) end as url", "'gpt' as model", "'text' as content", "0.0D as temperature"
    )
    answers = recorded(_responses(spark).where("url is not null and result <> 'a'"), unique=True)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        shares = {}
        for name, measure in (("sketch", lookups.sketch_keys), ("none", lambda df, keys: lookups.KeyProfile(8000, 0, 0, 0, 0))):
            rated = rate(rows, answers, measure=lambda: measure(rows, ["url"]))
            sizes = rated.groupBy(F.spark_partition_id()).count().collect()
            shares[name] = max(r["count"] for r in sizes) / sum(r["count"] for r in sizes)
            assert sum(r["count"] for r in sizes) == 8000
            assert rated.where("result is null").count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert shares["none"] > 0.5 and shares["sketch"] < 0.35


def _captures(spark):
    """URLs captured once, again under one number, without a number, and one very often."""
    url = "case when id % 3 = 0 then 'https://x.org/hot' else concat('https://x.org/', id % 500) end"
    return spark.range(3000).selectExpr(f"{url} as url", "case when id % 7 = 0 then null else id div 4 end as page_id", "concat('<p>', id, '</p>') as html")


def test_an_index_grown_in_parts_equals_a_count_of_all(spark, tmp_path):
    captures, path = _captures(spark), str(tmp_path / "index")
    for part in range(4):
        index = write_index(captures.where(F.xxhash64("html") % 4 == part - 3 if part < 3 else F.xxhash64("html") % 4 >= 0), path, buckets=8 * (1 + part % 2))
    left = captures.where(~(F.xxhash64("html") % 4).isin(-3, -2, -1) & (F.xxhash64("html") % 4 < 0))
    assert left.count() == 0
    assert sorted(map(tuple, indexed_last(index).collect())) == sorted(map(tuple, count_last(captures).collect()))


@pytest.mark.parametrize("way", ["auto", "no_broadcast"])
def test_an_index_answers_without_the_identifiers(spark, tmp_path, request, way):
    if way == "no_broadcast":
        request.getfixturevalue("no_broadcast")
    captures = _captures(spark)
    laid = write_captures(captures, str(tmp_path / "captures"), buckets=32)
    index = write_index(captures, str(tmp_path / "index"), buckets=32)
    urls = ["https://x.org/hot", "https://x.org/1", "https://x.org/2", "https://x.org/gone", "https://x.org/1"]
    bodies = [(i, json.dumps({"url": u, "model": "gpt"})) for i, u in enumerate(urls)]
    requests = parse_requests(spark.createDataFrame(bodies, "request_id long, body string"), SYNC)
    plain = attach_pages(requests, captures, SYNC).collect()
    fetched = attach_pages(requests, laid, SYNC, index)
    assert sorted(map(str, fetched.collect())) == sorted(map(str, plain))
    scans = [line for line in plan_of(fetched).splitlines() if "FileScan" in line]
    # One of captures and one of the index (read by the broadcast of it as well), both pruned.
    assert scans and all(BUCKET in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)
    assert all("html" in s.split("ReadSchema")[1] for s in scans if "/captures" in s)


def test_only_repeated_captures_are_grouped_and_no_html_is_sorted(spark, no_broadcast):
    plan = plan_of(QUERIES["page_fetch_recaptured"](spark, "/root/testdata/sf0.001"))
    sorting = [line for line in plan.splitlines() if "SortAggregate" in line or " Sort " in line]
    assert sorting and not any("html" in line for line in sorting)


def test_few_jobs_run_before_the_answers_do(spark):
    from tiltscale.plans.catalog import QUERIES as queries

    context = spark.sparkContext
    context.setJobGroup("before", "plan of sync_answers")
    try:
        queries["sync_answers"](spark, "/root/testdata/sf0.001")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("before")) <= 12
