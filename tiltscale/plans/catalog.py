"""Every operator as a query over the given tables."""

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tiltscale import schemas
from tiltscale.functions.html_blocks import block_rows
from tiltscale.functions.prompts import build_prompt, model_options
from tiltscale.functions.score import clean_result, parse_score
from tiltscale.functions.source import identify_source
from tiltscale.functions.text import article_text, is_blank
from tiltscale.operators import messages, rating, tables
from tiltscale.operators.fetch import attach_pages, explode_blocks, extract_blocks
from tiltscale.operators.intake import parse_requests
from tiltscale.operators.lookup import spread_small_input
from tiltscale.operators.settling import called_once
from tiltscale.plans import requests as plans
from tiltscale.plans.profiles import ASYNC, LEGACY_ASYNC, LEGACY_SYNC, SYNC
from tiltscale.session import bound_arrow_batches, shared_folder
from tiltscale.sources import committed, derived
from tiltscale.sources.captures import write_answers, write_captures, write_index
from tiltscale.sources.key_store import KeyStore, appended_key_violations, appended_reference_violations
from tiltscale.sources.messages import publish, read_articles, read_messages, read_messages_batch
from tiltscale.sources.sinks import append_results, write_once
from tiltscale.streaming import jobs

QUERIES = {}


def _named(name):
    """Register a query under ``name``."""

    def register(function):
        def run(spark, folder):
            return function(bound_arrow_batches(spark), folder)

        QUERIES[name] = run
        return function

    return register


def _query(function):
    """Register a query under its own name."""
    return _named(function.__name__)(function)


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _new_folder(spark):
    return f"{shared_folder(spark)}/tiltscale-{uuid.uuid4().hex}"


def _web(spark, folder):
    return derived.from_tables(spark, folder, derived.WEB)


def _requests(spark, folder):
    return derived.from_tables(spark, folder, derived.REQUESTS)


def _articles(spark, folder):
    return derived.from_tables(spark, folder, derived.ARTICLES)


def _responses(spark, folder):
    return derived.from_tables(spark, folder, derived.RESPONSES)


def _all_responses(spark, folder):
    return derived.from_tables(spark, folder, derived.ALL_RESPONSES)


def _page_responses(spark, folder):
    return derived.from_tables(spark, folder, derived.PAGE_RESPONSES)


def _messages(spark, folder):
    return derived.from_tables(spark, folder, derived.MESSAGES)


def _result_messages(spark, folder):
    return derived.from_tables(spark, folder, derived.RESULT_MESSAGES)


# --- intake and fetch -----------------------------------------------------------

@_query
def request_intake(spark, folder):
    return parse_requests(_requests(spark, folder), SYNC)


@_query
def request_intake_async(spark, folder):
    return parse_requests(_requests(spark, folder), ASYNC)


@_query
def request_intake_legacy(spark, folder):
    return parse_requests(_requests(spark, folder), LEGACY_SYNC)


@_named("identify_source")
def sources(spark, folder):
    return _web(spark, folder).select("page_id", "url", identify_source(F.col("url")).alias("source"))


@_named("identify_source_strict")
def strict_sources(spark, folder):
    return _web(spark, folder).select("page_id", "url", identify_source(F.col("url"), strict_www=True).alias("source"))


def _fetched(spark, folder, pages, index=None):
    fetched = attach_pages(parse_requests(_requests(spark, folder), SYNC), pages, SYNC, index)
    return fetched.select(
        "request_id", "url", "status", "error",
        F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("html_length"),
    )


@_query
def page_fetch(spark, folder):
    return _fetched(spark, folder, _web(spark, folder))


@_query
def page_fetch_by_bucket(spark, folder):
    """The same from captures laid out by URL."""
    return _fetched(spark, folder, write_captures(_web(spark, folder), _new_folder(spark), buckets=16))


@_query
def page_fetch_recaptured(spark, folder):
    """The same where captures share URL and number."""
    return _fetched(spark, folder, derived.from_tables(spark, folder, derived.RECAPTURED))


@_query
def page_fetch_indexed(spark, folder):
    """The same from captures and an index of the last ones, both grown in two goes."""
    captures = derived.from_tables(spark, folder, derived.RECAPTURED)
    base, part = _new_folder(spark), F.pmod(F.xxhash64("html"), F.lit(2))
    for turn in (0, 1):
        new = captures.where(part == turn)
        laid = write_captures(new, f"{base}/captures", buckets=16, mode="append")
        index = write_index(new, f"{base}/index", buckets=16)
    return _fetched(spark, folder, laid, index)


# --- extraction -----------------------------------------------------------------

@_query
def blocks_p(spark, folder):
    pages = spread_small_input(_table(spark, folder, "pages").select("page_id", "html"))
    return block_rows(pages, F.col("html"), F.lit("p"), keep=["page_id"])


@_query
def blocks_div(spark, folder):
    """Blocks by source: class selectors where the publisher has one."""
    return explode_blocks(_web(spark, folder)).drop("url")


@_query
def article_text_keep_empty(spark, folder):
    blocks = extract_blocks(_web(spark, folder))
    return blocks.select("page_id", "source", article_text(F.col("blocks"), drop_empty=False).alias("content"))


@_query
def article_text_drop_empty(spark, folder):
    blocks = extract_blocks(_web(spark, folder))
    text = blocks.select("page_id", "source", article_text(F.col("blocks"), drop_empty=True).alias("content"))
    return text.withColumn("blank", is_blank(F.col("content")))


# --- messages -------------------------------------------------------------------

@_query
def article_messages(spark, folder):
    """Encoded for the topic, written, read back and decoded."""
    articles = _articles(spark, folder)
    path = f"{_new_folder(spark)}/articles"
    publish(messages.to_article_messages(articles), "text", path)
    return messages.decode_articles(read_messages_batch(spark, "text", path))


@_query
def decode_articles(spark, folder):
    return messages.decode_articles(_messages(spark, folder), "doc_id")


@_query
def article_rejects(spark, folder):
    return messages.article_rejects(_messages(spark, folder), "doc_id")


@_query
def result_messages(spark, folder):
    results = rating.rate_articles(_articles(spark, folder), rating.recorded(_responses(spark, folder)))
    return messages.decode_results(messages.to_result_messages(results))


@_query
def decode_results(spark, folder):
    return messages.decode_results(_result_messages(spark, folder), "doc_id")


@_query
def result_rejects(spark, folder):
    return messages.result_rejects(_result_messages(spark, folder), "doc_id")


# --- rating ---------------------------------------------------------------------

@_query
def rateable(spark, folder):
    return rating.rateable(_articles(spark, folder))


def _prompt_query(name, template):
    @_named(name)
    def prompt(spark, folder):
        text = build_prompt(F.col("content"), template)
        return rating.rateable(_articles(spark, folder)).select(
            "doc_id", F.md5(text).alias("prompt_md5"), F.length(text).cast("long").alias("prompt_length")
        )


_prompt_query("prompt_detailed", "detailed")
_prompt_query("prompt_detailed_legacy", "detailed_legacy")
_prompt_query("prompt_brief", "brief")
_prompt_query("prompt_strict", "strict_format")


@_query
def rate_recorded(spark, folder):
    """Recorded answers; an article without one gets the failure text."""
    articles = rating.rateable(_articles(spark, folder))
    rated = rating.with_fallback(rating.rate(articles, rating.recorded(_responses(spark, folder))))
    return rated.select("doc_id", "url", "model", "result", "rating_error")


@_query
def rate_stub(spark, folder):
    return rating.rate_articles(_articles(spark, folder), rating.stub(), any_model=True)


def _local_client():
    """A stand-in for a provider: rates by length, refuses texts that hold a bar."""

    def ask(prompt, options):
        if "|" in prompt:
            raise ValueError("refused")
        return f"{options['provider_model']} read {len(prompt)} characters !$*_&{len(prompt) % 5 - 2}!$*_&"

    return ask


@_query
def rate_called(spark, folder):
    """A client called on the executors, failing on some rows."""
    articles = rating.rateable(_articles(spark, folder))
    rated = rating.with_fallback(rating.rate(articles, rating.called(_local_client, calls_in_flight=4)))
    return rated.select("doc_id", "result", "rating_error", parse_score(F.col("result")).alias("score"))


@_query
def rate_called_once(spark, folder):
    """The same with equal prompts asked once, in two runs, of which the second finds half of them answered."""
    articles = rating.rateable(_articles(spark, folder))
    store = f"{_new_folder(spark)}/calls"
    for rows in (articles.where(F.col("doc_id") % 2 == 0), articles):
        backend = called_once(_local_client, store, parts=8, calls_in_flight=4)
        rated = rating.with_fallback(rating.rate(rows, backend))
    return rated.select("doc_id", "result", "rating_error", parse_score(F.col("result")).alias("score"))


@_query
def rate_repeated(spark, folder):
    """Answers that were recorded more than once; the smallest text counts."""
    responses = derived.from_tables(spark, folder, derived.REPEATED_RESPONSES)
    articles = rating.rateable(_articles(spark, folder))
    rated = rating.with_fallback(rating.rate(articles, rating.recorded(responses)))
    return rated.select("doc_id", "url", "model", "result", "rating_error")


def _odd_client():
    """A stand-in whose answers are not always text."""

    def ask(prompt, options):
        n = len(prompt)
        return (f"read {n}", n, None, b"\xff", "\ud800")[n % 5]

    return ask


@_query
def rate_called_odd_answers(spark, folder):
    """Answers that are no text are errors of their rows, and nothing else fails."""
    known = rating.rateable(_articles(spark, folder)).where(rating.is_known_model(F.col("model")))
    rated = rating.rate(known, rating.called(_odd_client, calls_in_flight=4))
    surrogate = F.contains("rating_error", F.lit("surrogates not allowed"))
    error = F.when(surrogate, "surrogates not allowed").otherwise(F.col("rating_error"))
    return rated.select("doc_id", "result", error.alias("rating_error"))


@_query
def rate_skips_known(spark, folder):
    """What a rerun still has to pay for: articles that no earlier table holds with that text."""
    articles = rating.rateable(_articles(spark, folder))
    before = articles.where("doc_id % 3 = 0").withColumn(
        "content", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.lit("an earlier text"))
    )
    held = write_once(rating.content_key(before).select("url", "model", "content_hash"), f"{_new_folder(spark)}/rated")
    return rating.not_rated_yet(articles, held).select("doc_id", "url", "model")


def _options_query(name, streaming):
    @_named(name)
    def options(spark, folder):
        temperature = (F.col("doc_id") % 3 / 2).cast("double")
        return _articles(spark, folder).select(
            "doc_id", "model", model_options(F.col("model"), temperature, streaming).alias("options")
        ).select("doc_id", "model", "options.*")


_options_query("model_options", streaming=False)
_options_query("model_options_stream", streaming=True)


@_named("parse_score")
def scores(spark, folder):
    return _all_responses(spark, folder).select("url", "model", parse_score(F.col("result")).alias("score"))


@_named("clean_result")
def cleaned(spark, folder):
    return _all_responses(spark, folder).select("url", "model", clean_result(F.col("result")).alias("result"))


# --- outcomes -------------------------------------------------------------------

def _answers_query(name, profile):
    @_named(name)
    def answered(spark, folder):
        backend = rating.recorded(_page_responses(spark, folder))
        return plans.answers(_requests(spark, folder), _web(spark, folder), backend, profile)


_answers_query("sync_answers", SYNC)
_answers_query("legacy_sync_answers", LEGACY_SYNC)


def _routed_query(name, part):
    """Rated once into a table, from which answers and refusals branch."""

    @_named(name)
    def routed(spark, folder):
        backend = rating.recorded(_page_responses(spark, folder))
        answered = plans.answers(_requests(spark, folder), _web(spark, folder), backend, SYNC)
        return plans.route(write_once(answered, f"{_new_folder(spark)}/outcomes"))[part]


_routed_query("outcome_answers", 0)
_routed_query("outcome_errors", 1)


@_query
def response_bodies(spark, folder):
    backend = rating.recorded(_page_responses(spark, folder))
    answered = plans.answers(_requests(spark, folder), _web(spark, folder), backend, SYNC)
    bodies = plans.response_body(answered)
    # Compared by field: engines differ in how they write numbers into JSON.
    fields = F.from_json("body", "source string, result string, score double, error string")
    return bodies.select("request_id", "status", fields.alias("fields")).select("request_id", "status", "fields.*")


def _acknowledgements_query(name, profile):
    @_named(name)
    def outcomes(spark, folder):
        scraped = plans.scrape(_requests(spark, folder), _web(spark, folder), profile)
        return plans.acknowledgements(scraped, profile)


_acknowledgements_query("async_outcomes", ASYNC)
_acknowledgements_query("legacy_async_outcomes", LEGACY_ASYNC)


@_query
def accepted_articles(spark, folder):
    scraped = plans.scrape(_requests(spark, folder), _web(spark, folder), ASYNC)
    return plans.accepted_articles(scraped)


@_query
def end_to_end(spark, folder):
    """The asynchronous chain: scraped once, published, rated, published, stored."""
    base = _new_folder(spark)
    scraped = write_once(plans.scrape(_requests(spark, folder), _web(spark, folder), ASYNC), f"{base}/scraped")
    publish(messages.to_article_messages(plans.accepted_articles(scraped)), "text", f"{base}/articles")
    backend = rating.recorded(_page_responses(spark, folder))
    articles = read_messages_batch(spark, "text", f"{base}/articles")
    publish(jobs.rated_messages(articles, backend), "text", f"{base}/results")
    results = messages.decode_results(read_messages_batch(spark, "text", f"{base}/results"))
    append_results(results, f"{base}/stored")
    return spark.read.schema(schemas.STORED_RESULT).parquet(f"{base}/stored")


# --- tables ---------------------------------------------------------------------

@_named("append_results")
def appended(spark, folder):
    """Result messages appended to a table, in two goes."""
    path = f"{_new_folder(spark)}/results"
    decoded = messages.decode_results(_result_messages(spark, folder), "doc_id")
    for part in (0, 1):
        append_results(decoded.where(F.col("doc_id") % 2 == part), path)
    return spark.read.schema(schemas.STORED_RESULT).parquet(path)


@_query
def news_table(spark, folder):
    return tables.conform(derived.from_tables(spark, folder, derived.NEWS), schemas.NEWS)


@_query
def rated_table(spark, folder):
    responses = _all_responses(spark, folder)
    rated = responses.select(
        F.col("url").alias("Link"), F.col("model").alias("Model"),
        parse_score(F.col("result")).alias("Score"), clean_result(F.col("result")).alias("Reason"),
    )
    return tables.conform(rated, schemas.RATED)


@_query
def conform_rejects(spark, folder):
    """Ratings that do not fit the table: numbers out of range, and keys that are null."""
    return tables.conform_rejects(derived.from_tables(spark, folder, derived.WIDE_RESPONSE), schemas.RESPONSE)


@_query
def response_table(spark, folder):
    return tables.conform(derived.from_tables(spark, folder, derived.RESPONSE), schemas.RESPONSE)


@_query
def pk_violations(spark, folder):
    return tables.primary_key_violations(derived.from_tables(spark, folder, derived.NEWS), ["Link"])


@_query
def pk_violations_nullable(spark, folder):
    return tables.primary_key_violations(derived.from_tables(spark, folder, derived.RESPONSE), ["Link"])


@_query
def fk_violations(spark, folder):
    response = derived.from_tables(spark, folder, derived.RESPONSE)
    news = derived.from_tables(spark, folder, derived.SOME_NEWS)
    return tables.foreign_key_violations(response, "Link", news, "Link")


@_query
def fk_orphans(spark, folder):
    response = derived.from_tables(spark, folder, derived.RESPONSE)
    news = derived.from_tables(spark, folder, derived.SOME_NEWS)
    return tables.orphans(response, "Link", news, "Link")


def _in_batches(df, key, n=4):
    """Disjoint parts of a table, as they might have come in; rows without a key in the first."""
    part = F.coalesce(F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)), F.lit(0))
    return df.withColumn("__part", part), [F.col("__part") == i for i in range(n)]


@_query
def pk_violations_appended(spark, folder):
    """The same found batch by batch, old keys being read only where a filter hits."""
    base = _new_folder(spark)
    news, parts = _in_batches(derived.from_tables(spark, folder, derived.NEWS).select("Link"), "Link")
    news = write_once(news, f"{base}/news")
    store = KeyStore(spark, f"{base}/links", ["Link"], buckets=8, blocks=64)
    for number, part in enumerate(parts):
        batch = news.where(part)
        appended_key_violations(batch, store).write.parquet(f"{base}/violations/batch={number}")
        store.add(batch)
    found = spark.read.schema("Link string, n_rows long").parquet(f"{base}/violations")
    counts = F.when(F.col("Link").isNull(), F.sum("n_rows")).otherwise(F.max("n_rows"))
    return found.groupBy("Link").agg(counts.alias("n_rows"))


@_query
def fk_violations_appended(spark, folder):
    """The same against a store of the parents' keys, which came in batches."""
    base = _new_folder(spark)
    store = KeyStore(spark, f"{base}/links", ["Link"], buckets=8, blocks=64)
    news, parts = _in_batches(derived.from_tables(spark, folder, derived.SOME_NEWS), "Link", 2)
    news = write_once(news, f"{base}/news")
    for part in parts:
        store.add(news.where(part))
    response, parts = _in_batches(derived.from_tables(spark, folder, derived.RESPONSE).select("Link"), "Link", 2)
    response = write_once(response, f"{base}/response")
    found = [appended_reference_violations(response.where(part), "Link", store) for part in parts]
    return found[0].unionByName(found[1]).groupBy("Link").agg(F.sum("n_rows").alias("n_rows"))


# --- streams --------------------------------------------------------------------

def _message_files(spark, df, base):
    """The derived messages as files of a shared folder, to be streamed from."""
    path = f"{base}/messages"
    df.select("value").write.text(path)
    return path


@_query
def rating_stream(spark, folder):
    base = _new_folder(spark)
    path = _message_files(spark, _messages(spark, folder), base)
    _drain_ratings(spark, base, path, _settled_backend(spark, folder, base))
    return messages.decode_results(read_messages_batch(spark, "text", f"{base}/results"))


def _settled_backend(spark, folder, base):
    """Recorded answers, made unique once, so that no micro-batch does it again."""
    answers = write_once(rating.settled(_responses(spark, folder)), f"{base}/answers")
    return rating.recorded(answers, unique=True)


def _drain_ratings(spark, base, path, backend):
    jobs.rating_job(
        read_articles(spark, fmt="text", path=path), backend, f"{base}/checkpoint", fmt="text", path=f"{base}/results",
        trigger=jobs.DRAIN,
    ).awaitTermination()


@_query
def rating_stream_resumed(spark, folder):
    """Half of the messages, then the rest, from one checkpoint: each is rated once."""
    base = _new_folder(spark)
    backend = _settled_backend(spark, folder, base)
    derived_messages = _messages(spark, folder)
    for part in (0, 1):
        derived_messages.where(F.col("doc_id") % 2 == part).select("value").write.mode("append").text(f"{base}/messages")
        _drain_ratings(spark, base, f"{base}/messages", backend)
    return messages.decode_results(read_messages_batch(spark, "text", f"{base}/results"))


@_query
def rating_stream_by_bucket(spark, folder):
    """The same from answers laid out by URL, of which a micro-batch reads its buckets."""
    base = _new_folder(spark)
    path = _message_files(spark, _messages(spark, folder), base)
    answers = write_answers(_responses(spark, folder), f"{base}/answers", buckets=16)

    def to_files(results, number):
        results.write.mode("overwrite").text(f"{base}/results/batch={number}")

    articles = read_articles(spark, fmt="text", path=path)
    jobs.answer_job(articles, answers, f"{base}/checkpoint", to_files, jobs.DRAIN).awaitTermination()
    return messages.decode_results(read_messages_batch(spark, "text", f"{base}/results"))


@_query
def reject_stream(spark, folder):
    base = _new_folder(spark)
    source = read_messages(spark, "text", _message_files(spark, _messages(spark, folder), base))
    jobs.reject_job(source, f"{base}/checkpoint", f"{base}/rejects", jobs.DRAIN).awaitTermination()
    return spark.read.schema("value string, reason string").parquet(f"{base}/rejects")


@_query
def storage_stream(spark, folder):
    base = _new_folder(spark)
    source = read_messages(spark, "text", _message_files(spark, _result_messages(spark, folder), base))
    jobs.storage_job(source, f"{base}/checkpoint", f"{base}/stored", jobs.DRAIN).awaitTermination()
    return spark.read.schema(schemas.STORED_RESULT).parquet(f"{base}/stored")


class _Interrupted(Exception):
    """A job's end at a bad moment."""


@_query
def storage_stream_replayed(spark, folder):
    """The same from a job that ends once after writing and once half-way, and repeats a whole batch."""
    base = _new_folder(spark)
    path = _message_files(spark, _result_messages(spark, folder), base)

    def run(store):
        job = jobs.committed_storage_job(
            read_messages(spark, "text", path), f"{base}/checkpoint", f"{base}/stored", jobs.DRAIN, store
        )
        job.awaitTermination()

    def unpublished(batch, path, number):
        committed.write_attempt(batch, path, number)
        raise _Interrupted

    def half(batch, path, number):
        committed.write_attempt(batch.where(F.xxhash64("url") % 2 == 0), path, number)
        raise _Interrupted

    def twice(batch, path, number):
        committed.commit_batch(batch, path, number)
        committed.commit_batch(batch, path, number)

    for store in (unpublished, half):
        try:
            run(store)
        except StreamingQueryException:
            pass
    run(twice)
    return committed.read_committed(spark, f"{base}/stored", schemas.STORED_RESULT).drop("batch")


@_query
def intake_stream(spark, folder):
    base = _new_folder(spark)
    _requests(spark, folder).write.parquet(f"{base}/requests")
    source = spark.readStream.schema("request_id long, body string").parquet(f"{base}/requests")

    def to_files(articles, number):
        articles.write.mode("overwrite").text(f"{base}/articles/batch={number}")

    jobs.intake_job(
        source, _web(spark, folder), f"{base}/checkpoint", base, to_files, trigger=jobs.DRAIN
    ).awaitTermination()
    return messages.decode_articles(read_messages_batch(spark, "text", f"{base}/articles"))
