"""The rating step and the backends that can answer it.

A backend is a function ``(df, measure) → DataFrame``.  It gets rows with at
least ``url``, ``model``, ``asked``, ``prompt`` and ``options`` (JSON text) and
adds ``result`` and ``rating_error``, one of which is null.  Rows that are not
``asked``, whose prompt is null, are passed through with both null, so one pass
serves good and refused rows alike.  ``measure()`` gives the profile of the batch's URLs, without the work done
on ``df`` since, to backends that join.
"""

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.fixed_values import FAILED_RATING_TEXT, KNOWN_MODELS, STUB_RATING_TEXT, UNKNOWN_MODEL
from tiltscale.functions.prompts import build_prompt, model_options
from tiltscale.functions.score import parse_score
from tiltscale.operators.lookup import lookup, profile_keys


def is_known_model(model):
    return F.coalesce(model.isin(*KNOWN_MODELS), F.lit(False))


def is_rateable():
    """Content and model are there and not empty; white space counts as content."""
    return F.expr("content <> '' AND model <> ''")


def rateable(articles):
    return articles.where(is_rateable())


# --- backends -----------------------------------------------------------------

def settled(responses):
    """``[url, model, result]`` with one row per key: the smallest text of those recorded.

    Keys are counted first, which needs no texts; only texts of keys that were counted
    more than once are compared.  For a stream, write this once and use it as
    ``recorded(..., unique=True)``.
    """
    keys = ["url", "model"]
    answers = responses.select(*keys, "result")
    repeated = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    single = answers.join(repeated, keys, "left_anti")
    smallest = answers.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min("result").alias("result"))
    nameless = F.col("url").isNull() | F.col("model").isNull()
    return single.where(~nameless).union(smallest.select(*keys, "result"))


def recorded(responses, unique=False):
    """Answers captured earlier, ``[url, model, result]``.

    Should a key be recorded more than once, the smallest text is the answer, so
    that articles never multiply.  ``unique`` says that the keys were checked
    (``primary_key_violations``) and saves that step, once per micro-batch in a
    stream.
    """
    # Only known models are asked, so a URL has no more answers than there are of those.
    answers = responses.select("url", "model", "result").where(is_known_model(F.col("model")))
    if not unique:
        answers = settled(answers)

    def backend(df, measure):
        urls = None if df.isStreaming else measure()
        found = lookup(df, answers, ["url", "model"], profile=urls, measured=["url"])
        return found.withColumns({
            "result": F.when(F.col("asked"), F.col("result")),
            "rating_error": F.when(F.col("asked") & F.col("result").isNull(), "no recorded answer"),
        })

    return backend


def stub():
    """The same text for every article, whatever the model."""

    def backend(df, measure):
        return df.withColumns({
            "result": F.when(F.col("asked"), STUB_RATING_TEXT),
            "rating_error": F.lit(None).cast("string"),
        })

    return backend


def _usable(answer):
    """An answer as text; whatever else a client returns concerns its own row only."""
    if not isinstance(answer, str):
        raise TypeError(f"the client answered with {type(answer).__name__}, not text")
    answer.encode()
    return answer


def asked_safely(client, prompt, options):
    """``(answer, error)`` of a call, one of them None."""
    try:
        return _usable(client(prompt, json.loads(options))), None
    except Exception as error:
        text = str(error) or type(error).__name__
        return None, text.encode(errors="replace").decode()


def _called_batches(make_client, calls_in_flight, batches):
    """``(result, rating_error)`` of each ``(prompt, options)``, batch by batch.

    The next batch's calls are under way before the last answer of this one is in.
    """
    client = make_client()

    def ask(prompt, options):
        return (None, None) if prompt is None else asked_safely(client, prompt, options)

    def gathered(calls):
        results, errors = zip(*[call.result() for call in calls]) if calls else ((), ())
        return pa.StructArray.from_arrays(
            [pa.array(results, pa.string()), pa.array(errors, pa.string())], ["result", "rating_error"]
        )

    with ThreadPoolExecutor(calls_in_flight) as pool:
        before = None
        for prompts, options in batches:
            calls = [pool.submit(ask, p.as_py(), o.as_py()) for p, o in zip(prompts, options)]
            if before is not None:
                yield gathered(before)
            before = calls
        if before is not None:
            yield gathered(before)


def called(make_client, calls_in_flight=1, partitions=None):
    """Answers of ``make_client()(prompt, options)``, called on the executors.

    ``make_client`` runs once per task, so connections are reused for all of a
    partition.  ``options`` is a dict with the provider's settings.  An exception
    concerns its own row only, and so does an answer that is not text, or text that
    is no Unicode.  ``calls_in_flight`` threads per task overlap waiting, across
    batches as well.  ``partitions`` spreads the rows over that many tasks, whatever
    the step before left; times ``calls_in_flight`` it is the most calls at once.

    Only prompts and options go to Python, and only answers come back.  A retried task
    repeats its calls: write the rated rows to a table and branch from there rather
    than use the returned DataFrame twice; ``not_rated_yet`` leaves out what such a
    table holds.
    """

    def answer(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _called_batches(make_client, calls_in_flight, batches)

    # Non-deterministic, so that the optimizer never makes a call twice.
    ask = F.arrow_udf(answer, "result string, rating_error string").asNondeterministic()

    def backend(df, measure):
        spread = df.repartition(partitions) if partitions else df
        # A generator keeps the call from being repeated for each of its fields.
        answered = spread.withColumn("__answer", ask("prompt", "options"))
        return answered.select(*df.columns, F.inline(F.array("__answer")))

    return backend


def content_key(articles):
    """``articles`` with ``content_hash``: what a paid answer is kept under, beside URL and model."""
    return articles.withColumn("content_hash", F.sha2("content", 256))


def not_rated_yet(articles, rated):
    """Articles whose URL, model and content hash ``rated`` does not hold; nulls are equal here.

    Put before ``called``, it keeps a rerun from paying again for what was written.
    """
    keys = ("url", "model", "content_hash")
    held = rated.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    keyed = content_key(articles)
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return keyed.join(held, same, "left_anti").drop("content_hash")


# --- the step -------------------------------------------------------------------

def rate(df, backend, template="detailed", streaming_options=False, when=None, any_model=False, measure=None):
    """Add ``prompt``, ``result`` and ``rating_error`` to ``[url, content, model, …]``.

    Rows where ``when`` does not hold are left unrated.  A model nobody knows
    fails without a call, unless ``any_model`` (for the stub, which asks nobody).
    """
    wanted = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    known = F.lit(True) if any_model else is_known_model(F.col("model"))
    temperature = F.col("temperature") if "temperature" in df.columns else F.lit(0.0)
    asked = wanted & known & F.col("content").isNotNull()
    prepared = df.withColumns({
        "asked": asked,
        "prompt": F.when(asked, build_prompt(F.col("content"), template)),
        "options": F.to_json(model_options(F.col("model"), temperature, streaming_options)),
    })
    rated = backend(prepared, measure or (lambda: profile_keys(df, ["url"]))).drop("asked", "options")
    return rated.withColumn(
        "rating_error", F.when(wanted & ~known, UNKNOWN_MODEL).otherwise(F.col("rating_error"))
    )


def with_fallback(rated):
    """Failed calls get the fixed failure text, which has no score, and go on."""
    return rated.withColumn(
        "result", F.when(F.col("rating_error").isNotNull(), FAILED_RATING_TEXT).otherwise(F.col("result"))
    )


def rate_articles(articles, backend, any_model=False, measure=None):
    """``[content, model, url]`` → ``[url, model, result, score]`` for rateable rows.

    The whole rating stage of the asynchronous chain; works on batch and
    streaming DataFrames.  The filters stand before the backend because none is
    pushed through it.  ``measure`` gives the profile of the URLs in another way than a full one.
    """
    accepted = rateable(articles)
    if not any_model:
        accepted = accepted.where(is_known_model(F.col("model")))
    rated = rate(
        accepted,
        backend,
        "brief",
        streaming_options=True,
        any_model=any_model,
        measure=measure or (lambda: profile_keys(articles, ["url"])),
    )
    rated = with_fallback(rated)
    return rated.select("url", "model", "result", parse_score(F.col("result")).alias("score"))
