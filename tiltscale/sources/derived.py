"""Inputs of the catalog queries, derived from the given tables.

The given tables hold no publisher URLs, score markers, nulls or key violations;
these statements derive them, row by row, from whole tables.  They are plain SQL
that Spark and DuckDB read alike: ``{name}`` stands for a table.
"""

# The marker around a score, and the scores recorded answers give.
_MARKER = "!$*_&"
_SCORES = ("-2", "-1.5", "-1", "-0.5", "0", "0.5", "1", "1.5", "2")


# The models that pages were rated with; a statement's {each model} gives a row for each.
_MODELS = "'gpt', 'claude', 'gemini'"


def _case(subject, values, default="null"):
    whens = " ".join(f"when {number} then {value}" for number, value in values.items())
    return f"case {subject} {whens} else {default} end"


def _container(classes):
    return (
        f"""replace(replace(html, '<article>', '<div class="{classes}">'), '</article>', '</div>')"""
    )


_ID = "cast(page_id as string)"
_DOC = "cast(doc_id as string)"
_MODEL = _case("doc_id % 3", {0: "'gpt'", 1: "'claude'", 2: "'gemini'"})
_SCORE = _case("doc_id % 9", {i: f"'{score}'" for i, score in enumerate(_SCORES)})

WEB = f"""
select page_id,
  {_case("page_id % 8", {
      0: f"'https://www.cnn.com/a/' || {_ID}",
      1: f"'https://www.foxnews.com/a/' || {_ID}",
      2: f"'https://abcnews.go.com/a/' || {_ID}",
      3: f"'https://notcnn.com/a/' || {_ID}",
      4: "url || '&via=foxnews.com,cnn.com'",
      5: f"'https://WWW.CNN.COM/a/' || {_ID}",
  }, "url")} as url,
  {_case("page_id % 8", {
      0: _container("x article__content-container"),
      1: _container("article-body"),
  }, "html")} as html
from {{pages}}
"""

_BODY_MODEL = _case("page_id % 3", {0: "'gpt'", 1: "'claude'", 2: "'gemini'"})

REQUESTS = f"""
select page_id as request_id,
  {_case("page_id % 11", {
      5: """'{"url":"' || url || '","model":"other"}'""",
      6: """'{"url":"' || url || '/gone","model":"claude"}'""",
      7: """'{"model":"gpt","temperature":0.25}'""",
      8: """'{"url":"","model":"gpt"}'""",
      9: """'{"url":"' || url || '","model":null}'""",
      10: """'{"url":"' || url || '"}'""",
  }, f'''\'{{"url":"\' || url || \'","model":"\' || {_BODY_MODEL} || \'","temperature":0.5}}\'''')} as body
from ({WEB}) web
"""

ARTICLES = f"""
select doc_id, source || '/' || {_DOC} as url,
  {_case("doc_id % 13", {10: "' '", 11: "cast(null as string)", 12: "''"}, "text")} as content,
  {_case("doc_id % 17", {15: "''", 16: "cast(null as string)"}, _MODEL)} as model
from {{documents}}
"""

_ANSWER = _case("doc_id % 10", {
    6: "'- no score given'",
    7: f"'- a' || chr(10) || '{_MARKER}1{_MARKER} revised {_MARKER}' || {_SCORE} || '{_MARKER}'",
    8: f"{_SCORE} || '{_MARKER}'",
    9: f"case when doc_id % 20 = 9 then '{_MARKER}score: ' || {_SCORE} || '{_MARKER}'"
       f" else '{_MARKER}' || {_SCORE} || 'd{_MARKER}' end",
}, f"'- ' || text || chr(10) || '{_MARKER} ' || {_SCORE} || ' {_MARKER}'")

ALL_RESPONSES = f"""
select source || '/' || {_DOC} as url, {_MODEL} as model, {_ANSWER} as result
from {{documents}}
"""

# The same with every 23rd missing, for what happens where no answer was recorded.
RESPONSES = f"{ALL_RESPONSES} where doc_id % 23 <> 0"

# The same pages captured more than once: again as they were, otherwise under the same number,
# before without a number, and some without a number in all their captures.
RECAPTURED = f"""
select case when page_id % 4 = 1 then null else page_id end as page_id, url, html from (
  {WEB}
  union all
  select page_id, url, html from ({WEB}) again where page_id % 3 = 0
  union all
  select page_id, url, html || '<p>again</p>' from ({WEB}) otherwise where page_id % 5 = 0
  union all
  select cast(null as bigint), url, html || '<p>before</p>' from ({WEB}) before where page_id % 7 = 0
) captures
"""
# Answers of which some were recorded more than once, with other texts or the same.
REPEATED_RESPONSES = f"""
{ALL_RESPONSES}
union all
select url, model, result || ' again' from ({ALL_RESPONSES}) again where length(result) % 5 = 0
union all
select url, model, result from ({ALL_RESPONSES}) once_more where length(result) % 7 = 0
"""

# Answers recorded for the pages' requests; every ninth page has none.
PAGE_RESPONSES = f"""
select url, {{each model}} as model,
  'about ' || {_ID} || chr(10) || '{_MARKER}' || {_case("page_id % 9", {i: f"'{s}'" for i, s in enumerate(_SCORES)})}
    || '{_MARKER}' as result
from ({WEB}) web where page_id % 9 <> 4
"""

NEWS = f"""
select source || '/' || {_DOC} as Link, left(text, 60) as Title, text as Content, source as Source,
  date '2024-01-01' + cast(doc_id % 30 as int) as CollectDate
from {{documents}}
union all
select source || '/' || {_DOC}, left(text, 60), text, source, date '2024-01-01' + cast(doc_id % 30 as int)
from {{documents}} where doc_id % 97 = 1
"""

# News of which some are missing, for keys that lead nowhere.
SOME_NEWS = f"select source || '/' || {_DOC} as Link from {{documents}} where doc_id % 29 <> 0"

# Ratings whose values do not all fit the table they go to.
WIDE_RESPONSE = f"""
select case when doc_id % 37 = 0 then cast(null as bigint) else doc_id * 3000000 end as id,
  source || '/' || {_DOC} as Link,
  case when doc_id % 11 = 0 then 1e12 when doc_id % 13 = 0 then cast(null as double) else doc_id / 8.0e0 end as Score,
  'c' || {_DOC} as Comments
from {{documents}}
"""

RESPONSE = f"""
select labels.doc_id as id,
  case when labels.doc_id % 31 = 0 then cast(null as string)
       else source || '/' || cast(labels.doc_id as string) end as Link,
  cast(quality * 2 - toxic as double) as Score, 'c' || cast(labels.doc_id as string) as Comments
from {{labels}} labels join {{documents}} documents on labels.doc_id = documents.doc_id
"""

# Article messages, some of them broken, as a JSON text per document.  Quoting a text is
# the engines' own affair: {{quoted text}} is the text as each writes it.
MESSAGES = f"""
select doc_id,
  {_case("doc_id % 19", {
      1: "'not json'",
      2: "'[1]'",
      3: """'{"content":"cut off","mod'""",
      4: f"""'{{"content":"extra","model":"gpt","url":"u/' || {_DOC} || '","more":true}}'""",
      5: f"""'{{"content":' || {_DOC} || ',"model":"claude","url":"u/' || {_DOC} || '"}}'""",
      6: f"""'{{"content":"c' || {_DOC} || '","model":"other","url":"u/' || {_DOC} || '"}}'""",
      7: f"""'{{"content":"","model":"gpt","url":"u/' || {_DOC} || '"}}'""",
      8: f"""'{{"content":"c","model":null,"url":"u/' || {_DOC} || '"}}'""",
      9: """'null'""",
      10: f"""'{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}} and more'""",
      11: f"""'{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}}{{"content":"d"}}'""",
      12: f"""'{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}},"z":2'""",
      13: f"""'1,"whole":{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}}'""",
      14: f"""'{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}},"end":1}}'""",
      15: f"""'{{"content":"c","model":"gpt","url":"u/' || {_DOC} || '"}}],[{{}}'""",
  }, f'''\'{{"url":"\' || source || \'/\' || {_DOC} || \'","content":\' || {{quoted text}} || \',"model":"\' || {_MODEL} || \'"}}\'''')} as value
from {{documents}}
"""

# Result messages, some of them without a key.
RESULT_MESSAGES = f"""
select doc_id,
  {_case("doc_id % 7", {
      1: f"""'{{"url":"u/' || {_DOC} || '","model":"gpt","result":"r"}}'""",
      2: f"""'{{"url":"u/' || {_DOC} || '","model":"gpt","result":null,"score":-999}}'""",
      3: "'{broken'",
      4: f"""'{{"url":"u/' || {_DOC} || '","model":"gemini","result":"r","score":"' || case when doc_id % 2 = 0 then 'NaN' else 'high' end || '"}}'""",
      5: f"""'{{"url":"u/' || {_DOC} || '","model":"gpt","result":"r","score":' || {_case("doc_id % 8", {0: "'[1]'", 1: "'1}x'", 2: "'null'", 4: """'1},"z":{'""", 5: """'1},"end":1}'""", 6: "'1}],[{'"}, "'1}{'")} || '}}'""",
  }, f'''\'{{"url":"u/\' || {_DOC} || \'","model":"claude","result":"r\' || {_DOC} || \'","score":\' || {_SCORE} || \'}}\'''')} as value
from {{documents}}
"""

_TABLES = ("pages", "documents", "labels")


def for_duckdb(statement):
    """The statement over DuckDB views of the tables' own names."""
    for table in _TABLES:
        statement = statement.replace("{" + table + "}", table)
    statement = statement.replace("{quoted text}", "cast(to_json(text) as varchar)")
    statement = statement.replace("{each model}", f"unnest([{_MODELS}])")
    return f"({statement.strip()})"


def from_tables(spark, folder, statement):
    """The statement as a DataFrame over the parquet tables of ``folder``."""
    for table in _TABLES:
        statement = statement.replace("{" + table + "}", f"parquet.`{folder}/{table}.parquet`")
    # The member of a JSON object without the object.
    member = "to_json(named_struct('t', text))"
    statement = statement.replace("{quoted text}", f"substring({member}, 6, length({member}) - 6)")
    return spark.sql(statement.replace("{each model}", f"explode(array({_MODELS}))"))
