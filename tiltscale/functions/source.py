"""Which publisher a URL belongs to, and where its pages keep the article."""

from pyspark.sql import functions as F

from tiltscale.fixed_values import (
    CONTAINER_CLASSES,
    SOURCE_PATTERNS,
    STRICT_SOURCE_PATTERNS,
    UNKNOWN_SOURCE,
)


def identify_source(url, strict_www=False):
    """First pattern contained anywhere in the URL.

    ``strict_www`` wants the ``www.`` of the first two publishers and gives null,
    not ``unknown``, where nothing matches.
    """
    patterns = STRICT_SOURCE_PATTERNS if strict_www else SOURCE_PATTERNS
    return F.coalesce(
        *[F.when(F.contains(url, F.lit(text)), source) for text, source in patterns],
        F.lit(None if strict_www else UNKNOWN_SOURCE),
    )


def block_element(source):
    """Element name of the blocks; null for an unidentified (null) source."""
    return F.when(source.isin(*CONTAINER_CLASSES), "div").when(source.isNotNull(), "p")


def block_class(source):
    """Class token of the blocks; null where every element of the name counts."""
    return F.coalesce(*[F.when(source == name, token) for name, token in CONTAINER_CLASSES.items()])
