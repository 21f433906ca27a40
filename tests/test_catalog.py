"""Every catalog query against its SQL, and the shape of the plans."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.EXTRA_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.EXTRA_ORACLES)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.EXTRA_ORACLES)))
def test_query_equals_sql(spark, connection, name):
    assert compare(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize(
    "name", ["sync_answers", "page_fetch", "accepted_articles", "result_messages", "fk_orphans", "fk_violations"]
)
def test_query_equals_sql_without_broadcast(spark, connection, no_broadcast, name):
    assert compare(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    answers = entry.entry(spark)
    assert answers.where("status = 200 and score is not null").count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sync_answers", "async_outcomes", "accepted_articles", "page_fetch", "blocks_p"])
def test_html_is_read_once_and_parsed_once(spark, no_broadcast, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert plan.count("html:string>") == 1
    assert plan.count("ArrowEvalPython") == (0 if name == "page_fetch" else 1)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["parse_score", "prompt_brief", "rateable", "decode_results", "model_options"])
def test_column_work_needs_no_python_and_no_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "Python" not in plan and "Exchange" not in plan


def test_html_is_not_shuffled_when_most_pages_are_wanted(spark, no_broadcast):
    plan = plan_of(entry.queries()["sync_answers"](spark, FOLDER))
    parser, scan = plan.index("ArrowEvalPython"), plan.index("html:string>")
    assert parser < scan and "Exchange" not in plan[parser:scan]


@pytest.mark.parametrize("name", ["decode_articles", "decode_results", "article_rejects", "result_rejects"])
def test_messages_are_parsed_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert plan.count("from_json(StructField(whole,StructType") == 1
    assert plan.count("from_json") == 2


def test_prompts_stay_out_of_joins_that_do_not_need_them(spark, no_broadcast):
    plan = plan_of(entry.queries()["result_messages"](spark, FOLDER))
    assert "You are an AI" not in plan


def test_shared_captures_equal_sql_without_broadcast(spark, connection, no_broadcast):
    name = "page_fetch_recaptured"
    assert compare(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) is None
