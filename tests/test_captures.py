"""Captures laid out by URL: same answers, fewer files."""

import pytest
from pyspark.sql import functions as F

from tiltscale.operators.fetch import attach_pages
from tiltscale.operators.intake import parse_requests
from tiltscale.plans.profiles import SYNC
from tiltscale.sources.captures import BUCKET, near, write_captures


def _pages(spark):
    """A third of the captures are of one URL; one URL is null, one page has no number."""
    url = "case when id % 3 = 0 then 'https://x.org/hot' when id = 1 then null else concat('https://x.org/', id) end"
    return spark.range(3000).selectExpr("case when id <> 2 then id end as page_id", f"{url} as url", "concat('<p>', id, '</p>') as html")


def _requests(spark, urls):
    rows = [(i, f'{{"url":"{u}","model":"gpt"}}') for i, u in enumerate(urls)]
    return parse_requests(spark.createDataFrame(rows, "request_id long, body string"), SYNC)


WANTED = ["https://x.org/hot", "https://x.org/2", "https://x.org/1000", "https://x.org/gone", "https://x.org/hot"]


@pytest.mark.parametrize("way", ["auto", "no_broadcast"])
def test_same_pages_from_any_layout(spark, tmp_path, request, way):
    if way == "no_broadcast":
        request.getfixturevalue("no_broadcast")
    pages, requests = _pages(spark), _requests(spark, WANTED)
    laid = write_captures(pages, str(tmp_path / "captures"), buckets=64)
    assert laid.drop("capture_buckets", BUCKET).exceptAll(pages).count() == 0 and laid.count() == 3000
    answer = [(r.request_id, r.status, r.html) for r in attach_pages(requests, laid, SYNC).orderBy("request_id").collect()]
    assert answer == [(r.request_id, r.status, r.html) for r in attach_pages(requests, pages, SYNC).orderBy("request_id").collect()]
    assert [a[2] for a in answer] == ["<p>2997</p>", "<p>2</p>", "<p>1000</p>", None, "<p>2997</p>"]


def test_only_buckets_with_a_wanted_url_are_read(spark, tmp_path):
    laid = write_captures(_pages(spark), str(tmp_path / "captures"), buckets=64)
    read = near(laid, spark.createDataFrame([(u,) for u in WANTED[1:3]] + [(None,)], "url string"))
    assert read.select(BUCKET).distinct().count() == 2
    plan = attach_pages(_requests(spark, WANTED), laid, SYNC)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(f"{BUCKET}" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scans)


def test_layouts_of_two_sizes_in_one_table(spark, tmp_path):
    path, pages = str(tmp_path / "captures"), _pages(spark)
    write_captures(pages.where("page_id % 2 = 0"), path, buckets=4)
    laid = write_captures(pages.where("page_id % 2 = 1"), path, buckets=16, mode="append")
    got = attach_pages(_requests(spark, WANTED[:3]), laid, SYNC).orderBy("request_id").collect()
    assert [r.html for r in got] == ["<p>2997</p>", None, "<p>1000</p>"]


def test_an_empty_layout_and_no_wanted_url(spark, tmp_path):
    pages = _pages(spark)
    empty = pages.where("false").withColumns({"capture_buckets": F.lit(4), BUCKET: F.lit(0)})
    assert [r.html for r in attach_pages(_requests(spark, WANTED[:1]), empty, SYNC).collect()] == [None]
    laid = write_captures(pages, str(tmp_path / "captures"), buckets=4)
    nothing = near(laid, spark.createDataFrame([(None,)], "url string"))
    assert nothing.count() == 0
