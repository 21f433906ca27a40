"""Text expressions: white space, joins, and decoding of JSON."""

from pyspark.sql import functions as F

# What str.strip() removes: Unicode white space and the four separators
# U+001C-U+001F.
_STRIPPED = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_KEPT = r"(?U)[^\s\x1c-\x1f]"


# The forms of JSON that the standard does not have stay errors.
_STRICT = {"allowSingleQuotes": "false"}
# Where ``decoded`` puts the key names of a message.
KEYS = "__keys"


def decoded(text, schema, *raw):
    """Generator of the fields of a JSON object, of ``__keys``, and of ``<name>_text`` for each of ``raw``.

    All are null where the text is not one JSON object and nothing else.  Spark stops at the end
    of a value and ignores what follows, so the text is parsed in two places at once: as the
    member of an object that goes on behind it, and as the only item of a list.  What closes
    the one early, or goes on behind the value, is an error in the other, or a second item.

    ``__keys`` holds at least the fields that are there, be it with a null; only a message with a
    field that came out null is asked for its keys, and only where the field came out null is
    ``<name>_text``, what stands there instead, not null.

    A filter on the fields of a plain ``from_json`` is pushed below it, and the text is then
    parsed once for the filter's every mention of a field.  Nothing is pushed through a
    generator, so here all of it happens once.
    """
    text = F.col(text) if isinstance(text, str) else text
    wrapped = F.concat(F.lit('{"whole":'), text, F.lit(',"end":1}'))
    listed = F.concat(F.lit("["), text, F.lit("]"))
    contexts = F.struct(
        F.from_json(wrapped, f"whole {schema.simpleString()}, end int", _STRICT).alias("member"),
        # The items are looked at, but nothing in them is read.
        F.from_json(listed, "array<struct<__nothing: int>>", _STRICT).alias("items"),
    )
    names = schema.fieldNames()

    def fields(parsed):
        whole = parsed["member"]["whole"]
        single = (F.size(parsed["items"]) == 1) & F.get(parsed["items"], F.lit(0)).isNotNull()
        good = (parsed["member"]["end"] == 1) & whole.isNotNull() & single
        missing = F.lit(False)
        for name in names:
            missing = missing | whole[name].isNull()
        keys = F.when(missing, F.json_object_keys(text)).otherwise(F.array(*map(F.lit, names)))
        texts = [F.when(whole[n].isNull(), F.get_json_object(text, f"$.{n}")).alias(f"{n}_text") for n in raw]
        return F.when(good, F.struct(*[whole[n].alias(n) for n in names], keys.alias(KEYS), *texts))

    return F.inline(F.transform(F.array(contexts), fields))


def has_key(name):
    """Whether a message has the key, be it with a null; false where it is no object."""
    return F.coalesce(F.array_contains(KEYS, name), F.lit(False))


def strip(text):
    return F.regexp_replace(text, _STRIPPED, "")


def is_blank(text):
    """Whether nothing is left after stripping; null for null."""
    return ~F.rlike(text, F.lit(_KEPT))


def article_text(blocks, drop_empty):
    """Join block texts with newlines, with or without the empty ones."""
    kept = F.filter(blocks, lambda block: block != "") if drop_empty else blocks
    return F.array_join(kept, "\n")
