"""Prompts and provider options."""

from pyspark.sql import functions as F

from tiltscale.fixed_values import PROMPTS, STREAM_OPTIONS, SYNC_OPTIONS


def build_prompt(content, template="detailed"):
    """The template around the content.

    Plain concatenation: content may hold any character, also ones a format or
    replacement string would read as its own.
    """
    before, _, after = PROMPTS[template].partition("{content}")
    return F.concat(F.lit(before), content, F.lit(after))


def model_options(model, temperature, streaming=False):
    """Struct of what the provider behind ``model`` is called with.

    Null for an unknown model.  Three fixed rows need no table and no join: they
    fold into one conditional expression.
    """
    table = STREAM_OPTIONS if streaming else SYNC_OPTIONS

    def options(row):
        return F.struct(
            F.lit(row["provider_model"]).alias("provider_model"),
            F.lit(row.get("max_tokens")).cast("int").alias("max_tokens"),
            F.lit(row.get("top_p")).cast("double").alias("top_p"),
            F.lit(row.get("n")).cast("int").alias("n"),
            (temperature if row["temperature"] else F.lit(None)).cast("double").alias("temperature"),
        )

    return F.coalesce(*[F.when(model == name, options(row)) for name, row in table.items()])
