"""Reading the score out of an answer."""

import unicodedata

from pyspark.sql import functions as F

from tiltscale.fixed_values import FAILED_SCORE, SCORE_MARKER

# The white space a number may stand in: Unicode's, without the four separators
# that str.strip() takes as well.
_SPACE = r"(?U)^\s+|\s+$"
_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
_FLOAT = rf"(?i)^[+-]?(?:{_NUMBER}|nan|inf(?:inity)?)$"

# Every decimal digit of every script, with its value, by rule from the Unicode
# tables: Python reads them all as digits, Spark's cast only the ASCII ones.
_FOREIGN_DIGITS = {
    chr(point): str(unicodedata.decimal(chr(point)))
    for point in range(0x80, 0x110000)
    if unicodedata.category(chr(point)) == "Nd"
}


def _parse_ascii(text):
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    # The only such text that the cast does not take is a NaN with a sign.
    return F.when(F.rlike(text, F.lit(_FLOAT)), F.coalesce(number, F.lit(float("nan"))))


def parse_number(text):
    """``text`` as Python's float() reads it; null where that would fail.

    Spark's own cast also takes ``1d``, ``1.0f`` and ``0x1p3`` and does not take
    ``1_0``, hence the check of the grammar in front of it.
    """
    bare = F.regexp_replace(text, _SPACE, "")
    translated = F.translate(bare, "".join(_FOREIGN_DIGITS), "".join(_FOREIGN_DIGITS.values()))
    foreign = F.when(F.rlike(bare, F.lit(r"[^\x00-\x7f]")), translated)
    return F.coalesce(_parse_ascii(bare), _parse_ascii(foreign))


def parse_score(result):
    """Number in the last piece that a marker closes, or the failed score.

    That piece lies between the last marker and the one before it, or the start
    of the text.
    """
    piece = F.substring_index(F.substring_index(result, SCORE_MARKER, -2), SCORE_MARKER, 1)
    score = F.when(F.contains(result, F.lit(SCORE_MARKER)), parse_number(piece))
    return F.coalesce(score, F.lit(FAILED_SCORE))


def clean_result(result):
    """The answer without its markers."""
    return F.replace(result, F.lit(SCORE_MARKER), F.lit(""))
