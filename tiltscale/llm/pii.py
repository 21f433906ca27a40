"""Personal data: fixed patterns, and what their contexts lead to.

Base spans are what fixed patterns match and checks confirm.  They are the seeds of a
bootstrap: the words beside them are *patterns*, the strings found beside a pattern its
*instances*.  Patterns earn trust by the share of trusted ones, for a kind, among the
instances that can be judged, instances by the trusted patterns they stand beside, round after round.  Strings of
the right shape that end up trusted are spans as well, though no base pattern knows them.

All of it is DataFrame functions.  Texts are read once; positions, graph and spans come
from a slim table of matches that is written first.
"""

from pyspark.sql import functions as F

from tiltscale.llm.common import written

# Possessive forms of the base patterns.  They match the same strings from the same
# places; a failed attempt is not repeated from inside the run of characters it began in,
# so long runs cost linear time, and no group recurses.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SMALL_NUMBER = "0*+(?:|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_SMALL_NUMBER}(?:\.{_SMALL_NUMBER}){{3}}$"

# Strings that may be identifiers though no base pattern says so: something with an @, or
# a run of digits.  Base matches are tried first, so that parts of them are not taken.
_AROUND_AT = r"(?<![^\s,;<>()])[^\s@,;<>()]++@[^\s@,;<>()]++"
_DIGITS = r"(?<![0-9A-Za-z+])[0-9](?:[\x20().-]{0,2}+[0-9])++"
_CANDIDATE = "|".join([KINDS["phone"], _AROUND_AT, _DIGITS])
_MAY_HAVE = r"@|[0-9](?:[\x20().-]{0,2}[0-9]){5}"
# Shapes of unseen identifiers by kind, and the most and least digits.
_SHAPES = {
    "email": (r"^[^\s@]+@[^\s@]*\pL[^\s@]*$", 0, 99),
    "ip": (r"^[0-9]+(?:\.[0-9]+){3}$", 4, 12),
    "card": (r"^[0-9][0-9\x20-]+$", 12, 19),
    "phone": (r"^[0-9][0-9\x20().-]+$", 7, 15),
}

# Characters beside a string in which its neighbour word is sought.
_CONTEXT = 48
ROUNDS = 3
# A pattern is trusted from this share of trusted instances on, and from so many of them.
PATTERN_SHARE = 0.8
PATTERN_SUPPORT = 5
# So many of the strings of one layout beside a pattern have to be known, for it to vouch for the rest.
KNOWN_SHARE = 1 / 3
# Digits of a country code, which unseen telephone numbers may lack.
_COUNTRY_DIGITS = 3
# An instance is trusted from this score on.
INSTANCE_SCORE = 0.9

_BLOCK = 64


def _fold_sums(numbers):
    """Running sums of an array, by appending; for short arrays."""
    start = F.expr("cast(array() as array<long>)")
    return F.aggregate(
        numbers, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    )


def running_sums(name):
    """Running sums of an array column.

    Appending copies, so long arrays are summed in blocks, and then the blocks.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(name) - 1) / _BLOCK).cast("int")),
        lambda b: _fold_sums(F.slice(F.col(name), b * _BLOCK + 1, _BLOCK)),
    )
    ends = _fold_sums(F.transform(blocks, lambda x: F.element_at(x, -1)))
    starts = F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), 1, F.size(blocks))
    long = F.flatten(F.zip_with(blocks, starts, lambda x, base: F.transform(x, lambda v: v + base)))
    none = F.expr("cast(array() as array<long>)")
    return F.when(F.size(name) <= 0, none).when(F.size(name) <= _BLOCK, _fold_sums(F.col(name))).otherwise(long)


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits):
    """Whether digits pass: from the right, every second one doubled, less 9 if above 9."""
    n = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind, match):
    count = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return F.when(count.between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


def _found(text, may, pattern, each, between):
    """Matches of a pattern and the texts between them, each put through a function.

    Splitting at the pattern finds the same matches, so the pieces say where they are.
    """
    none = F.array()
    matches = F.when(may, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each))
    gaps = F.when(may, F.transform(F.split(text, pattern, -1), between))
    return matches, gaps


def _measured(kind):
    return lambda m: F.struct(F.length(m).alias("n"), F.coalesce(_passes(kind, m), F.lit(False)).alias("ok"))


def _matches(docs, text):
    """One row per row of ``docs``: the row, and what the patterns match in its text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hints = {"email": F.contains(whole, F.lit("@")), "phone": F.contains(whole, F.lit("+"))}
    columns = []
    for kind, pattern in KINDS.items():
        may = hints.get(kind, F.lit(True)) & whole.rlike(pattern)
        found, gaps = _found(
            whole, may, pattern,
            _measured(kind), F.length,
        )
        columns += [found.alias(kind), gaps.alias(f"{kind}_gaps")]

    def words(g):
        # The last word before a match and the first behind one; a cut word is still one.
        last = F.element_at(F.split(F.rtrim(F.right(g, F.lit(_CONTEXT))), r"\s+"), -1)
        first = F.element_at(F.split(F.ltrim(F.left(g, F.lit(_CONTEXT))), r"\s+"), 1)
        return F.struct(F.length(g).alias("n"), F.lower(last).alias("last"), F.lower(first).alias("first"))

    found, gaps = _found(whole, whole.rlike(_MAY_HAVE), _CANDIDATE, lambda m: m, words)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"),
        *columns, found.alias("any"), gaps.alias("any_gaps"),
    )


def _placed(kind, number):
    return lambda m, e: F.struct(
        (e - m["n"]).alias("start"), F.lit(number).alias("number"), e.alias("end"), F.lit(kind).alias("kind"), m["ok"].alias("ok")
    )


def _with_base(matches):
    """Add ``base``: the confirmed spans, by start and then kind, as structs."""
    for kind in KINDS:
        steps = F.zip_with(F.col(kind), F.slice(f"{kind}_gaps", 1, F.greatest(F.size(kind), F.lit(0))), lambda m, g: (m["n"] + g).cast("long"))
        matches = matches.withColumn(f"{kind}_steps", F.coalesce(steps, F.expr("cast(array() as array<long>)")))
    for kind in KINDS:
        matches = matches.withColumn(f"{kind}_ends", running_sums(f"{kind}_steps"))
    spans = []
    for number, kind in enumerate(KINDS):
        at = F.zip_with(F.col(kind), f"{kind}_ends", _placed(kind, number))
        spans.append(F.coalesce(F.filter(at, lambda s: s["ok"]), F.expr("cast(array() as array<struct<start:long,number:int,end:long,kind:string,ok:boolean>>)")))
    return matches.withColumn("base", F.array_sort(F.concat(*spans)))


def _occurrences(matches):
    """``[row, start, end, value, left, right]``: strings that may be identifiers, and their neighbours."""
    some = matches.where(F.size("any") > 0).select("row", "any", "any_gaps")
    steps = F.zip_with(F.col("any"), F.slice("any_gaps", 1, F.size("any")), lambda m, g: (F.length(m) + g["n"]).cast("long"))
    some = some.withColumn("steps", steps)
    some = some.withColumn("ends", running_sums("steps"))
    # Words of the gap before and behind each: the same array, one place on.
    sides = F.arrays_zip(
        F.col("any").alias("value"), F.col("ends").alias("end"), F.slice("any_gaps", 1, F.size("any")).alias("before"),
        F.slice("any_gaps", 2, F.size("any")).alias("behind"),
    )
    one = some.select("row", F.explode(sides).alias("x")).select("row", "x.*")
    return one.select(
        "row", (F.col("end") - F.length("value")).alias("start"), "end", "value",
        F.col("before.last").alias("left"), F.col("behind.first").alias("right"),
    )


def _seed_kind(value):
    """The kind whose base pattern a string holds, in the order of ``KINDS``; null for an unseen one."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        match = F.regexp_extract(value, f"({KINDS[name]})", 1)
        kind = F.when(value.rlike(KINDS[name]) & _passes(name, match), name).otherwise(kind)
    return kind


def _shape_kinds(value):
    """Kinds whose shape a string has."""
    digits = F.length(_digits(value))
    return F.array_compact(
        F.array(*[F.when(value.rlike(shape) & digits.between(lo, hi), kind) for kind, (shape, lo, hi) in _SHAPES.items()])
    )


def _layout(value):
    """Digits of a string in their groups, as in ``ddd ddd dddd``."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, "[^0-9]+", " ")), "[0-9]", "d")


def _layouts(value, kind, seed):
    """Layouts of a kind a string stands for: a seed also for those without its country code.

    Addresses of mail and machines have no layout but their shape.
    """
    one = _layout(value)
    tails = [one]
    for _ in range(_COUNTRY_DIGITS):
        tails.append(F.ltrim(F.substring(tails[-1], 2, 99)))
    return (
        F.when(kind.isin("email", "ip"), F.array(F.lit("")))
        .when(seed.isNotNull() & (kind == "phone"), F.array_distinct(F.array(*tails)))
        .otherwise(F.array(one))
    )


def bootstrap(
    occurrences, rounds=ROUNDS, share=PATTERN_SHARE, support=PATTERN_SUPPORT, least=INSTANCE_SCORE, known_share=KNOWN_SHARE
):
    """``[value, kind, score]``: strings that no base pattern knows and their contexts vouch for.

    The graph has an edge for each pattern (the word on the left, or on the right) and
    distinct string beside it, so copies of a text count once.  Every round, a pattern's
    trust for a kind is the scores of its instances (seeds, and what was found before) over
    the number of strings that can be judged: an unseen string of the kind's shape that is not
    found yet speaks neither for nor against.  A pattern vouches for strings of one layout of
    digits at a time, and only where ``support`` strings of that layout, and a ``known_share``
    of all of them beside it, are seeds or found: a few telephone numbers say nothing about
    thousands of others in their place, and nothing about numbers that are grouped otherwise.
    An instance's score is what is left when each of its trusted patterns has had its doubt.
    """
    values = occurrences.select("value", "left", "right")
    sides = F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col("left").alias("word")),
        F.struct(F.lit("right").alias("side"), F.col("right").alias("word")),
    ))
    edges = values.select("value", sides.alias("p")).where("p.word <> ''").select(
        F.concat("p.side", F.lit(" "), "p.word").alias("pattern"), "value"
    ).distinct()
    value = F.col("value")
    edges = written(edges.select("pattern", "value", _seed_kind(value).alias("seed"), _shape_kinds(value).alias("shapes")), "graph")

    # Strings beside a pattern by what they say of a kind: seeds, those that fit, and the others.
    fits = F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.col("shapes"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    fitting = edges.select("pattern", "value", "seed", F.explode(fits).alias("kind"))
    others = fitting.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("fits")).where(F.col("fits") >= support)
    others = others.join(sizes, "pattern").select("pattern", "kind", (F.col("n") - F.col("fits")).alias("others"))
    keys = ["pattern", "kind", "layout"]
    laid = fitting.select("pattern", "kind", "value", "seed", F.explode(_layouts(value, F.col("kind"), F.col("seed"))).alias("layout"))
    counts = laid.groupBy(*keys).agg(F.count("seed").alias("seeds"), F.count(F.lit(1)).alias("alike"))
    # Where nothing is unseen there is nothing to find.
    counts = counts.where((F.col("alike") >= support) & (F.col("alike") > F.col("seeds")))
    counts = written(counts.join(others, ["pattern", "kind"]), "counts")
    # Only what stands beside a pattern that may come to be trusted is met again, round by round.
    unseen = written(laid.where(F.col("seed").isNull()).join(counts.select(*keys), keys, "left_semi").select(*keys, "value"), "unseen")
    found = None
    for _ in range(rounds):
        trust = counts.withColumns({"hits": F.lit(0), "gained": F.lit(0.0)})
        if found is not None:
            more = unseen.join(found, ["value", "kind"]).groupBy(*keys)
            more = more.agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("gained"))
            trust = counts.join(more, keys, "left").fillna(0, ["hits", "gained"])
        known = F.col("seeds") + F.col("hits")
        share_of = (F.col("seeds") + F.col("gained")) / (known + F.col("others"))
        enough = (known >= support) & (known >= known_share * F.col("alike"))
        trusted = trust.where(enough).withColumn("trust", F.least(share_of, F.lit(0.999)))
        trusted = trusted.where(F.col("trust") >= share).select(*keys, "trust")
        doubt = F.exp(F.sum(F.log(1 - F.col("trust"))))
        scores = unseen.join(trusted, keys).groupBy("value", "kind").agg((1 - doubt).alias("score"))
        found = written(scores.where(F.col("score") >= least), "found")
    # A string that two kinds vouch for is of the one that does so more.
    best = found.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("x"))
    return best.select("value", "x.kind", "x.score")


def find(docs, text="text"):
    """Rows of ``docs`` as ``doc``, with ``base`` and ``spans``: arrays of (start, number, end, kind, ok).

    A null text is an empty one.  Offsets count code points; ends are exclusive.  Rows are
    told apart by the row itself, so equal ids and equal rows do not meet.  What the
    bootstrap adds never overlaps a base span.
    """
    matches = written(_matches(docs, text), "matches")
    based = _with_base(matches)
    occurrences = _occurrences(matches)
    found = bootstrap(occurrences)
    number = F.element_at(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS))))), F.col("kind"))
    added = occurrences.join(found, "value").groupBy("row").agg(
        F.collect_list(F.struct("start", number.alias("number"), "end", "kind", F.lit(True).alias("ok"))).alias("added")
    )
    joined = based.select("row", "doc", "base").join(added, "row", "left")
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return joined.select("doc", "base", spans.alias("spans"))


def _listed(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","
    )


def _count(kind):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def report(docs, key="doc_id", text="text"):
    """``[doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans]`` of every document.

    The counts are of base spans; ``base_sha256`` is over ``kind:start:end`` of those, in
    order of start and kind, comma-joined; ``spans`` lists all spans in the same way.
    """
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc.doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def redact(docs, text="text"):
    """``docs`` with every span replaced by its kind in brackets; columns and rows stay.

    Of overlapping spans the first stands, and of those that start together the longest.
    Texts without a span, nulls among them, are left as they are.
    """
    found = find(docs, text)
    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    whole = F.col(f"doc.{text}")

    def take(acc, s):
        piece = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.concat(piece, F.lit("["), s["kind"], F.lit("]")))).alias("parts"))
        return F.when(s["start"] < acc["at"], acc).otherwise(grown)

    folded = F.aggregate(by_start, start, take)
    found = found.withColumn("cut", F.when(F.size("spans") > 0, folded))
    rest = F.substring(whole, (F.col("cut.at") + 1).cast("int"), F.length(whole))
    clean = F.when(F.col("cut").isNull(), whole).otherwise(F.concat(F.array_join("cut.parts", ""), rest))
    return found.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
