"""From rating requests to answers: the batch plans of all profiles."""

from pyspark.sql import functions as F

from tiltscale.fixed_values import ACCEPTED, INTERNAL_ERROR, KNOWN_MODELS
from tiltscale.functions.score import clean_result, parse_score
from tiltscale.operators.fetch import attach_articles
from tiltscale.operators.intake import parse_requests
from tiltscale.operators.lookup import profile_keys
from tiltscale.operators.rating import rate
from tiltscale.plans.profiles import ASYNC, SYNC


def scrape(requests, pages, profile, only_models=None, index=None):
    """``[request_id, body]`` → requests with status, error, source and content.

    Articles to publish and acknowledgements both branch from this: write it to a
    table first (``sinks.write_once``) so that no page is parsed twice.
    """
    return attach_articles(parse_requests(requests, profile), pages, profile, only_models, index=index)


def answers(requests, pages, backend, profile=SYNC, index=None):
    """One row per request: an answer (status 200) or an error.

    Columns ``request_id, status, [source,] result, score, error``; also ``url``
    and ``model`` for storing.  Jobs over identifiers run while the plan is built.
    """
    parsed = parse_requests(requests, profile)
    urls = profile_keys(parsed, ["url"])
    scraped = attach_articles(parsed, pages, profile, KNOWN_MODELS, urls, index)
    good = F.col("status").isNull()
    rated = rate(scraped, backend, profile.template, when=good, measure=lambda: urls)
    failed = good & F.col("rating_error").isNotNull()
    cause = F.col("rating_error") if profile.error_details else F.lit(INTERNAL_ERROR)
    settled = rated.withColumns({
        "status": F.when(failed, 500).when(good, 200).otherwise(F.col("status")).cast("int"),
        "error": F.when(failed, cause).otherwise(F.col("error")),
    })
    answered = F.col("status") == 200
    columns = ["request_id", "url", "model", "status"]
    if profile.source_in_answer:
        columns.append(F.when(answered, F.col("source")).alias("source"))
    return settled.select(
        *columns,
        F.when(answered, clean_result(F.col("result"))).alias("result"),
        F.when(answered, parse_score(F.col("result"))).alias("score"),
        "error",
    )


def accepted_articles(scraped):
    """``[url, content, model]`` of the requests whose article goes on to rating."""
    return scraped.where("status is null").select("url", "content", "model")


def acknowledgements(scraped, profile=ASYNC):
    """One row per request: accepted (status 202) or an error."""
    good = F.col("status").isNull()
    columns = ["request_id", F.coalesce("status", F.lit(202)).alias("status"), F.when(good, ACCEPTED).alias("message")]
    if profile.source_in_answer:
        columns.append(F.when(good, F.col("source")).alias("source"))
    return scraped.select(*columns, "error")


def route(outcomes):
    """Outcomes as (answers, errors), every request in exactly one of them.

    Both read ``outcomes``, so give it a written table, not the work itself.
    """
    refused = F.col("error").isNotNull()
    return outcomes.where(~refused).drop("error"), outcomes.where(refused).select("request_id", "status", "error")


def response_body(outcomes):
    """The JSON body each request is answered with, beside its id and status."""
    names = [name for name in ("message", "source", "result", "score") if name in outcomes.columns]
    good = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct("error"))
    return outcomes.select(
        "request_id", "status", F.when(F.col("error").isNull(), good).otherwise(bad).alias("body")
    )
