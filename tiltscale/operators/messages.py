"""Messages between the jobs: JSON text in a ``value`` column."""

from pyspark.sql import functions as F

from tiltscale.functions.score import parse_number
from tiltscale.functions.text import KEYS, decoded, has_key
from tiltscale.operators.rating import is_known_model
from tiltscale.schemas import ARTICLE, RESULT

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _message(*names):
    return F.to_json(F.struct(*names), _KEEP_NULLS).alias("value")


def to_article_messages(articles):
    return articles.select(_message("url", "content", "model"))


def to_result_messages(results):
    return results.select(_message("url", "model", "result", "score"))


def _with_fields(messages, schema, keep, *raw):
    value = F.col("value").cast("string")
    return messages.select(*keep, value.alias("value")).select(*keep, "value", decoded("value", schema, *raw))


def _with_result_fields(messages, keep):
    """Result fields, and ``score_text``: what stands for a score that did not decode as a number."""
    fields = _with_fields(messages, RESULT, keep, "score")
    return fields.withColumn("score", F.coalesce("score", parse_number(F.col("score_text"))))


def decode_articles(messages, *keep):
    """``[value]`` → ``[content, model, url]``; all null where it is not one object and nothing else."""
    return _with_fields(messages, ARTICLE, keep).drop("value", KEYS)


def article_rejects(messages, *keep):
    """Messages the rating stage leaves out: ``[value, reason]``."""
    content, model = F.col("content"), F.col("model")
    empty = content.isNull() | (content == "") | model.isNull() | (model == "")
    left_out = _with_fields(messages, ARTICLE, keep).where(empty | ~is_known_model(model))
    reason = F.when(~empty, "unknown model").when(F.col(KEYS).isNull(), "malformed").otherwise("nothing to rate")
    return left_out.select(*keep, "value", reason.alias("reason"))


def _has_all_keys(schema):
    present = F.lit(True)
    for name in schema.fieldNames():
        present = present & has_key(name)
    return present


def _bad_score():
    """Whether a score is there that is no number; a null one is just null."""
    return F.col("score_text").isNotNull() & F.col("score").isNull()


def decode_results(messages, *keep):
    """``[value]`` → ``[url, model, result, score]`` of messages with all four keys and a usable score."""
    good = _has_all_keys(RESULT) & ~_bad_score()
    return _with_result_fields(messages, keep).where(good).select(*keep, "url", "model", "result", "score")


def result_rejects(messages, *keep):
    """Result messages that are no object, lack a key, or whose score is no number: ``[value, reason]``."""
    whole = _has_all_keys(RESULT)
    reason = F.when(whole, "bad score").when(F.col(KEYS).isNull(), "malformed").otherwise("missing key")
    rejected = _with_result_fields(messages, keep).where(~whole | _bad_score())
    return rejected.select(*keep, "value", reason.alias("reason"))
