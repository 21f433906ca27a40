"""Secrets in texts: every rule in one pass of one automaton.

The rules are compiled on the driver, where their size alone counts; the tables go out with
the tasks.  Texts stay in their rows, and only spans come back from Python.
"""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from tiltscale.llm.automaton import Automaton, Rule


def _assigned(match):
    """What an assignment assigns: neither space nor quote is part of a value."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


def _after_spaces(match):
    return match.rpartition(b" ")[2]


# The base rules, then forms of credentials as their issuers publish them.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        8,
        _assigned,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # Eight tell a run from a word; the others are counted when it is over.
    Rule("hex", r"[0-9a-f]{8,}", 32),
)
RULES = (
    *BASE,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]+", 20, _after_spaces),
)

_SPANS = "array<struct<start: long, number: int, end: long, kind: string>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("number", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
)


def _in_letters(data, spans):
    """Spans in code points.  Matches are of ASCII, so they cut no character."""
    places, at, count = {}, 0, 0
    for place in sorted({p for start, _, end in spans for p in (start, end)}):
        count += len(data[at:place].decode())
        at = place
        places[place] = count
    return [(places[start], number, places[end]) for start, number, end in spans]


@lru_cache(maxsize=8)
def compiled(rules):
    return Automaton(rules)


def spans_of(text, rules=RULES):
    """Column of the secrets in a text column: ``array<struct<start, number, end, kind>>``.

    In order of start and then of the rules; starts and ends count code points, ends are
    exclusive.  A null or empty text has none.  Matches of one rule never overlap, those of
    different rules may.
    """
    automaton = compiled(rules)
    names = [rule.name for rule in rules]

    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = automaton.scanner()
        for batch in texts:
            lists = []
            for value in batch:
                data = (value.as_py() or "").encode()
                spans = scanner.spans(data)
                if spans and not data.isascii():
                    spans = _in_letters(data, spans)
                lists.append([{"start": s, "number": n, "end": e, "kind": names[n]} for s, n, e in spans])
            yield pa.array(lists, _ARROW_SPANS)

    # Non-deterministic, so that the optimizer never scans a text twice.
    return F.arrow_udf(scanned, _SPANS).asNondeterministic()(text)


def find(docs, text="text", rules=RULES):
    """Rows of ``docs`` as ``doc`` beside their ``spans``; see ``spans_of``.

    One row for each row, whatever repeats; no column of ``docs`` can clash.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    return docs.select(row.alias("doc"), spans_of(F.col(text), rules).alias("spans"))


def _listed(spans):
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def _count(number):
    return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("long")


def report(docs, key="doc_id", text="text"):
    """``[doc_id, n_assign, n_access, n_hex, base_sha256, spans]`` of every document.

    Counts and digest are of base spans: ``kind:start:end``, comma-joined, in order of start
    and then kind; ``spans`` lists those of all rules in the same way.
    """
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    counts = [_count(number).alias(f"n_{rule.name}") for number, rule in enumerate(BASE)]
    return found.select(
        "doc.doc_id", *counts,
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def redact(docs, text="text", rules=RULES):
    """``docs`` with every secret replaced by its kind in brackets; columns and rows stay.

    Spans that overlap go as one, under the kind of the first.
    """
    found = find(docs, text, rules)
    whole = F.col("doc")[text]
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def take(acc, s):
        piece = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        part = F.concat(piece, F.lit("["), s["kind"], F.lit("]"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        added = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))
        return F.when(s["start"] < acc["at"], longer).otherwise(added)

    cut = F.aggregate("spans", begin, take)
    found = found.withColumn("cut", F.when(F.size("spans") > 0, cut))
    rest = F.substring(whole, (F.col("cut.at") + 1).cast("int"), F.length(whole))
    clean = F.when(F.col("cut").isNull(), whole).otherwise(F.concat(F.array_join("cut.parts", ""), rest))
    return found.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
