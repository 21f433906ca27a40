import os
import subprocess
import sys
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltscale.functions.html_blocks import block_rows, block_texts, select_blocks
from tiltscale.functions.source import block_class, block_element, identify_source
from tiltscale.functions.text import article_text, is_blank, strip

PARAGRAPHS = [
    ("", []),
    ("<p>a <b>b</b> c</p>", ["abc"]),
    ("<p>a<p>b</p>", ["ab", "b"]),
    ("<p>a<p>b</p>c</p>d", ["abc", "b"]),
    ("<p>a", ["a"]),
    ("<p/>x<p>y</p>", ["", "y"]),
    ("<P>A</P>", ["A"]),
    ("<p>a</p></p><p>b</p>", ["a", "b"]),
    ("<p>a<!-- no --> b</p>", ["ab"]),
    ("<p>a<script>var t='</p>';</script>b<style>p{}</style></p>", ["ab"]),
    ("<p>a &amp b &lt;c&gt; &nothing; &#233;&#x41;&#150;</p>", ["a & b <c> &nothing éA–"]),
    ("<p>  a  </p>", ["a"]),
    ("<p> \n </p>", [""]),
    ("<p>x<br>y<img src=a>z</p>", ["xyz"]),
    ("<p>x<br>a </br> b</p>", ["xa  b"]),  # the end tag of a closed void element is not there
    ("<p>a </i> b</p>", ["ab"]),  # any other stray end tag still ends the run
    ("<p>a<template>t<b>u</b></template>b</p>", ["ab"]),
    ("<p>a<![CDATA[ b ]]>c</p>", ["abc"]),
    ("<div><p>a</div>b</p>c", ["a"]),  # closing the outer element closes the inner one
    ("<pre>a</pre><param>", []),
]


@pytest.mark.parametrize("page, wanted", PARAGRAPHS)
def test_paragraphs(page, wanted):
    assert block_texts(page, "p") == wanted


@pytest.mark.parametrize("page, wanted", [
    ('<div class="x article-body">a</div>', ["a"]),
    ('<div class="article-body2">a</div>', []),
    ("<div>a</div>", []),
    ("<div class>a</div>", []),
    ('<p class="article-body">a</p>', []),
    ('<div class="article-body">a<div>b</div>c</div>d', ["abc"]),
    ('<div class="article-body">a<div class=article-body>b</div></div>', ["ab", "b"]),
    ('<div class="no" class="article-body">a</div>', ["a"]),  # the last of repeated attributes counts
    ('<div class="article-body\n\tx">a</div>', ["a"]),
])
def test_class_tokens(page, wanted):
    assert block_texts(page, "div", "article-body") == wanted


# Random well-formed trees, whose texts can be told without a parser.
words = st.text("ab \n", max_size=4)
trees = st.recursive(
    words, lambda children: st.tuples(st.sampled_from(["p", "b", "div"]), st.lists(children, max_size=4)), max_leaves=20
)


def write(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(write, node[1]))}</{node[0]}>"


def runs(node):
    """Text runs; neighbouring words are one run, as nothing stands between them."""
    found, current = [], ""
    for child in node[1]:
        if isinstance(child, str):
            current += child
        else:
            found += [current.strip(), *runs(child)]
            current = ""
    return [*found, current.strip()]


def wanted_texts(node):
    if isinstance(node, str):
        return []
    own = ["".join(runs(node))] if node[0] == "p" else []
    return own + [text for child in node[1] for text in wanted_texts(child)]


@settings(max_examples=200, deadline=None)
@given(trees)
def test_well_formed_trees(tree):
    assert block_texts(write(tree), "p") == wanted_texts(tree)


def test_many_voids_and_deep_nesting():
    page = "<p>" * 300 + "x<br>" * 3000 + "y"
    texts = block_texts(page, "p")
    assert len(texts) == 300 and all(text == "x" * 3000 + "y" for text in texts)


def test_select_blocks_by_row(spark):
    rows = [
        (1, "<p>a</p><p> </p><p>b</p>", "https://x.org/"),
        (2, '<div class="article-body">f</div><p>no</p>', "https://www.foxnews.com/"),
        (3, None, "https://x.org/"),
        (4, "<p>a</p>", "https://notcnn.com/"),
    ]
    df = spark.createDataFrame(rows, "id int, html string, url string")
    source = identify_source(F.col("url"))
    blocks = select_blocks(F.col("html"), block_element(source), block_class(source))
    found = {
        row.id: (row.blocks, row.all, row.some)
        for row in df.select("id", blocks.alias("blocks"))
        .select("id", "blocks", article_text(F.col("blocks"), False).alias("all"), article_text(F.col("blocks"), True).alias("some"))
        .collect()
    }
    assert found == {
        1: (["a", "", "b"], "a\n\nb", "a\nb"),
        2: (["f"], "f", "f"),
        3: (None, None, None),
        4: ([], "", ""),
    }


@pytest.mark.parametrize("url, plain, strict", [
    ("https://www.cnn.com/a", "cnn", "cnn"),
    ("https://notcnn.com/a", "cnn", None),
    ("https://x.org/?ref=cnn.com", "cnn", None),
    ("https://www.foxnews.com/?x=cnn.com", "cnn", "foxnews"),
    ("https://foxnews.com/a", "foxnews", None),
    ("https://abcnews.go.com/a", "abcnews", "abcnews"),
    ("https://WWW.CNN.COM/a", "unknown", None),
    ("", "unknown", None),
])
def test_sources(spark, url, plain, strict):
    df = spark.createDataFrame([(url,)], "url string")
    row = df.select(identify_source(F.col("url")), identify_source(F.col("url"), strict_www=True)).first()
    assert tuple(row) == (plain, strict)


def test_white_space_is_pythons(spark):
    texts = ["", " ", " 　\t\x1c\x1f\x85", "a", " a ", "​", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = sorted(df.select("id", is_blank(F.col("t")), strip(F.col("t"))).collect())
    for text, (_, blank, stripped) in zip(texts, rows):
        assert blank == (None if text is None else not text.strip())
        assert stripped == (None if text is None else text.strip())


def test_output_far_larger_than_its_pages(spark, monkeypatch):
    """Batches are split where unclosed paragraphs repeat much text; rows stay in place."""
    monkeypatch.setattr("tiltscale.functions.html_blocks._BATCH_CHARACTERS", 10_000)
    pages = spark.range(0, 60, 1, 2).select(
        "id", F.expr("case when id % 5 = 0 then null else concat(repeat('<p>ab', cast(id as int)), id) end").alias("html")
    )
    found = pages.select("id", select_blocks(F.col("html"), F.lit("p")).alias("blocks")).collect()
    assert len(found) == 60
    for row in found:
        wanted = None if row.id % 5 == 0 else ["ab" * (row.id - i) + str(row.id) for i in range(row.id)]
        assert row.blocks == wanted


def test_block_rows_equal_exploded_blocks(spark):
    texts = [page for page, _ in PARAGRAPHS] + [None, "<![x", "plain"]
    pages = spark.createDataFrame([(i, t, [i, None]) for i, t in enumerate(texts)], "id int, html string, more array<int>").repartition(4)
    rows = block_rows(pages, F.col("html"), F.lit("p"), keep=["id", "more"])
    assert rows.columns == ["id", "more", "block_no", "block_text"]
    lists = pages.select("id", "more", select_blocks(F.col("html"), F.lit("p")).alias("blocks"))
    wanted = lists.select("id", "more", F.posexplode("blocks").alias("block_no", "block_text"))
    assert sorted(rows.collect()) == sorted(wanted.collect())
    assert block_rows(pages.where("id < 0"), F.col("html"), F.lit("p")).collect() == []
    assert block_rows(pages, F.col("html"), F.lit(None)).collect() == []
    with pytest.raises(ValueError, match="block_no"):
        block_rows(pages.withColumnRenamed("id", "Block_No"), F.col("html"), F.lit("p"))


def test_block_rows_in_several_batches_of_one_page(spark, monkeypatch):
    monkeypatch.setattr("tiltscale.functions.html_blocks._BATCH_CHARACTERS", 5_000)
    pages = spark.range(3).select("id", F.expr("repeat('<p>ab', cast(400 * id as int))").alias("html"))
    found = block_rows(pages, F.col("html"), F.lit("p"), keep=["id"])
    rows = sorted(found.collect())
    assert [(r.id, r.block_no) for r in rows] == [(i, n) for i in (1, 2) for n in range(400 * i)]
    assert all(r.block_text == "ab" * (400 * r.id - r.block_no) for r in rows)


def test_a_page_of_unclosed_paragraphs_under_a_memory_limit():
    """2.4 GB of nested block texts pass through a process that may hold half of them."""
    code = """
        import resource
        import pyarrow as pa
        from tiltscale.functions.html_blocks import _rows_of_batches
        n = 20_000
        page = pa.record_batch({"id": [7], "page": ["<p>twelve chars" * n], "element": ["p"], "class": pa.array([None], pa.string())})
        resource.setrlimit(resource.RLIMIT_AS, (1_200_000_000, 1_200_000_000))
        rows = length = most = 0
        for batch in _rows_of_batches(iter([page])):
            assert batch.column("block_no").to_pylist() == list(range(rows, rows + len(batch)))
            rows += len(batch)
            most = max(most, batch.nbytes)
            length += sum(len(t.as_py()) for t in batch.column("block_text"))
        assert (rows, length) == (n, 12 * n * (n + 1) // 2), (rows, length)
        assert most < 40_000_000
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Memory pools of threads reserve addresses; the plain allocator takes what it needs.
    env = {**os.environ, "PYTHONPATH": root, "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
