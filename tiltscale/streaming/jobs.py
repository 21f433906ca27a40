"""The streaming jobs: requests in, articles rated, results stored.

Each is one stateless query with its own checkpoint.  Nothing is collected; the
work of a micro-batch stays on the executors.
"""

from tiltscale.operators.messages import (
    article_rejects,
    decode_articles,
    decode_results,
    result_rejects,
    to_article_messages,
    to_result_messages,
)
from tiltscale.operators.lookup import sketch_keys
from tiltscale.operators.rating import is_rateable, rate_articles, recorded
from tiltscale.operators.tables import to_stored_results
from tiltscale.plans.profiles import ASYNC
from tiltscale.plans.requests import accepted_articles, acknowledgements, scrape
from tiltscale.sources.captures import near
from tiltscale.sources.committed import commit_batch
from tiltscale.sources.messages import publish_stream
from tiltscale.sources.sinks import append_missing

# Work off everything that is there, then stop.
DRAIN = {"availableNow": True}


def rated_messages(article_messages, backend, any_model=False):
    """Article messages → result messages, batch or streaming."""
    return to_result_messages(rate_articles(decode_articles(article_messages), backend, any_model))


def rating_job(article_messages, backend, checkpoint, any_model=False, **sink):
    """Rate the article stream and publish the results."""
    return publish_stream(rated_messages(article_messages, backend, any_model), checkpoint, **sink)


def answer_job(article_messages, answers, checkpoint, publish, trigger=None):
    """Rate the article stream with recorded answers that are laid out by URL.

    For answers too many to join whole with every micro-batch (``sources.captures.write_answers``):
    only the buckets of the micro-batch's URLs are read, and URLs that hold much of it are
    spread, as a sketch of its keys says.  ``publish(messages, number)`` gets the number of the
    micro-batch, so that a repeated one can replace what it published.
    """

    def rate_batch(batch, number):
        articles = decode_articles(batch)
        articles.persist()  # read for its keys first, then for the work
        try:
            backend = recorded(near(answers, articles.where(is_rateable())), unique=True)
            publish(to_result_messages(rate_articles(articles, backend, measure=lambda: sketch_keys(articles, ["url"]))), number)
        finally:
            articles.unpersist()

    return _each_batch(article_messages, checkpoint, trigger, rate_batch)


def reject_job(article_messages, checkpoint, path, trigger=None):
    """Keep what the rating job leaves out, with the reason."""
    return _to_table(article_rejects(article_messages), checkpoint, path, trigger)


def result_reject_job(result_messages, checkpoint, path, trigger=None):
    """Keep result messages that lack a key."""
    return _to_table(result_rejects(result_messages), checkpoint, path, trigger)


def storage_job(result_messages, checkpoint, path, trigger=None):
    """Append the result stream to a parquet table; the file sink writes each row once."""
    return _to_table(to_stored_results(decode_results(result_messages)), checkpoint, path, trigger)


def committed_storage_job(result_messages, checkpoint, path, trigger=None, store=commit_batch):
    """Append the result stream to a table of numbered batches, each of which counts once.

    A micro-batch that is repeated, after whatever failure, is read once; see
    ``sources.committed``.  ``read_committed`` reads the table while it grows.
    """
    rows = to_stored_results(decode_results(result_messages))
    return _each_batch(rows, checkpoint, trigger, lambda batch, number: store(batch, path, number))


def jdbc_storage_job(result_messages, checkpoint, trigger=None, **jdbc):
    """Append the result stream to a database table, which has ``batch`` and ``row_key`` as well.

    Each partition's rows go in with one transaction.  A micro-batch that is repeated first asks
    the table for the keys of its number, and appends what is missing.
    """

    def append(batch, number):
        held = f"(select batch, row_key from {jdbc['dbtable']} where batch = {int(number)}) held"
        stored = batch.sparkSession.read.format("jdbc").options(**{**jdbc, "dbtable": held}).load()
        append_missing(batch, stored, number, "jdbc", **jdbc)

    return _each_batch(to_stored_results(decode_results(result_messages)), checkpoint, trigger, append)


def intake_job(requests, pages, checkpoint, folder, publish, profile=ASYNC, trigger=None, index=None):
    """Scrape a stream of ``[request_id, body]`` and publish the accepted articles.

    Each micro-batch is written once, under its own number, to ``folder``; the
    articles to publish and the acknowledgements both come from that table.
    Acknowledgements end up in ``folder/acknowledgements/batch=<number>``.  A
    repeated batch overwrites both; ``publish(messages, number)`` gets the number
    so that it can do the same.  With an ``index`` of last captures, and captures by URL, a
    micro-batch reads what its URLs need and no more.
    """

    def scrape_batch(batch, batch_id):
        scraped_path = f"{folder}/scraped/batch={batch_id}"
        batch.persist()  # read for its keys first, then for the work
        try:
            scrape(batch, pages, profile, index=index).write.mode("overwrite").parquet(scraped_path)
        finally:
            batch.unpersist()
        scraped = batch.sparkSession.read.parquet(scraped_path)
        publish(to_article_messages(accepted_articles(scraped)), batch_id)
        acknowledgements(scraped, profile).write.mode("overwrite").parquet(
            f"{folder}/acknowledgements/batch={batch_id}"
        )

    return _each_batch(requests, checkpoint, trigger, scrape_batch)


def _each_batch(rows, checkpoint, trigger, work):
    """Start a query that does ``work(batch, number)`` for each micro-batch."""
    return (
        rows.writeStream.foreachBatch(lambda batch, number: work(batch, number) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def _to_table(rows, checkpoint, path, trigger):
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start(path)
    )
