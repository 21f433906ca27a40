"""Rating requests: decode, defaults, and the rule that a URL is needed."""

from pyspark.sql import functions as F

from tiltscale.fixed_values import NO_URL
from tiltscale.functions.text import decoded, has_key
from tiltscale.plans.profiles import SYNC
from tiltscale.schemas import REQUEST_BODY


def parse_requests(requests, profile=SYNC):
    """``[request_id, body]`` → ``[request_id, url, model, temperature, status, error]``.

    Defaults stand in for keys that are absent, not for nulls.  ``status`` and
    ``error`` stay null while a request is still good.
    """
    fields = requests.select("request_id", decoded("body", REQUEST_BODY))
    url = F.col("url")
    missing = ~has_key("url")
    if profile.empty_url_is_missing:
        missing = missing | url.isNull() | (url == "")

    model = F.col("model")
    if profile.default_model is not None:
        model = F.when(~has_key("model"), profile.default_model).otherwise(model)
    temperature = F.lit(profile.default_temperature)
    if profile.temperature_in_request:
        temperature = F.when(~has_key("temperature"), temperature).otherwise(F.col("temperature"))

    return fields.select(
        "request_id",
        "url",
        model.alias("model"),
        temperature.cast("double").alias("temperature"),
        F.when(missing, 400).cast("int").alias("status"),
        F.when(missing, NO_URL).alias("error"),
    )
