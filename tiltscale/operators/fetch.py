"""Pages of requests, from a table of captured pages, and their article text."""

from dataclasses import replace

from pyspark.sql import functions as F

from tiltscale.fixed_values import INTERNAL_ERROR, NO_CONTENT, TIMED_OUT
from tiltscale.functions.html_blocks import block_rows, select_blocks
from tiltscale.functions.source import block_class, block_element, identify_source
from tiltscale.functions.text import article_text, is_blank
from tiltscale.operators.lookup import broadcast_bytes, key_hash, lookup, profile_keys, spread_small_input
from tiltscale.sources.captures import NO_PAGE_ID, count_last, indexed_last, near


# From this share of wanted pages on, parsing all of them in place costs less
# than shuffling the HTML of the wanted ones.
_MOST_PAGES = 0.25
# Bytes of a broadcast identifier beside those of its URL.
_ROW_OVERHEAD = 80


def _good_url(requests):
    """The URL of requests that are still good, null for the others."""
    return F.when(F.col("status").isNull(), F.col("url"))


def _fetch_outcome(pages):
    """Columns ``fetched`` and ``timed_out`` of a capture.

    A page table may record its HTTP status and time-outs; without them every
    captured page counts as fetched.
    """
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in pages.columns else F.lit(False)
    refused = (
        F.coalesce(F.col("http_status").between(400, 599), F.lit(False))
        if "http_status" in pages.columns
        else F.lit(False)
    )
    return (~timed_out & ~refused).alias("fetched"), timed_out.alias("timed_out")


def _mark_fetch(requests, profile):
    """Status and error of requests whose page did not come."""
    good = F.col("status").isNull()
    fetched = F.coalesce(F.col("fetched"), F.lit(False))
    late = F.coalesce(F.col("timed_out"), F.lit(False)) & F.lit(profile.own_timeout)
    why = F.concat(F.lit(profile.fetch_error_prefix + "no page for "), F.coalesce("url", F.lit("null")))
    failed = good & ~fetched
    return requests.withColumns({
        "status": F.when(failed & late, 504).when(failed, 500).otherwise(F.col("status")).cast("int"),
        "error": F.when(failed & late, TIMED_OUT).when(failed, why).otherwise(F.col("error")),
    })


def _repeats(last):
    """``[url, page_id]`` of last captures that share their number with others, or None where none do.

    Ready for a join that sorts nothing: broadcast where they are few.
    """
    repeated = last.where("n > 1").select("url", "page_id")
    row = repeated.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("url")).alias("size")).first()
    if not row.n:
        return None
    few = row.n * _ROW_OVERHEAD + (row.size or 0) <= broadcast_bytes(last.sparkSession)
    return F.broadcast(repeated) if few else repeated.hint("shuffle_hash")


def _one_each(captures, keys, column, repeated):
    """One of the captures that share ``keys``: one that came before one that did not, then by the MD5 of ``column``.

    Single captures pass as they are.  Of the others the best hash is found first, without what was
    hashed; copies that share it are told apart by nothing, and are made one by hashing them.
    """
    if repeated is None:
        return captures
    repeated = repeated.withColumnRenamed("url", "__url").select(*keys)
    # The second hash tells texts apart that were made to share the first.
    named = captures.withColumn("__hash", F.concat_ws("/", F.md5(column), F.sha2(column, 256)))
    several = named.join(repeated, keys, "left_semi")
    rank = F.struct((~F.col("fetched")).alias("missed"), "timed_out", "__hash")
    best = several.groupBy(*keys).agg(F.min(rank).alias("best"))
    best = best.select(*keys, (~F.col("best.missed")).alias("fetched"), "best.timed_out", "best.__hash")
    chosen = several.join(best.hint("shuffle_hash"), [*keys, "fetched", "timed_out", "__hash"], "left_semi")
    return captures.join(repeated, keys, "left_anti").unionByName(chosen.drop("__hash").distinct())


def _profile_by_page(urls, last):
    """The profile of the URLs as one of the pages they lead to.

    A hot URL may have been captured very often; salts must repeat its last
    capture only.  No more than the hot keys come to the driver.
    """
    if not urls.hot:
        return urls
    rows = dict(urls.hot)
    url_hash = key_hash(["url"])
    pages = last.where(url_hash.isin(*rows)).select(url_hash, key_hash(["page_id"])).collect()
    return replace(urls, hot=tuple((page, rows[url]) for url, page in pages))


def _attach(requests, pages, profile, carried, early=None, needs_text=None, urls=None, index=None):
    """Requests with ``carried``, a column over the last capture of their URL.

    ``carried`` may use ``needs_text``, which says whether any request of the URL
    needs it; ``early`` is the same column without that.  Three ways, by size:

    * Few URLs are broadcast, and the pages stay in place.
    * Where most pages are wanted, each is reduced to ``early`` in place, and the
      requests, which learn the page they want first, meet that.
    * Else the wanted pages are found in one shuffle keyed on URL and page, which
      spreads a URL captured very often, and joined by hashing the identifiers,
      so that no HTML is sorted.

    Captures that share the last ``(url, page_id)`` count once.  Whether there are any is
    asked of the identifiers, and only those are grouped.

    Of captures laid out by URL, only buckets with a wanted URL are read.  ``index``, of
    ``sources.captures.write_index``, says which capture is the last, so that no column of
    identifiers is read for that.

    Jobs run while the plan is built: one over the keys of the requests, unless ``urls`` is their
    profile, one over the last captures, and with laid out tables one for their buckets.
    """
    keyed = requests.withColumn("__url", _good_url(requests))
    pages = near(pages, keyed, "__url")
    # A capture without a number comes before all others, and counts if it is the only one.
    pages = pages.withColumn("page_id", F.coalesce("page_id", F.lit(NO_PAGE_ID)))
    urls = urls or profile_keys(requests, ["url"])
    size = urls.key_bytes + 8 * urls.keys
    few = size <= broadcast_bytes(pages.sparkSession)
    outcome = _fetch_outcome(pages)
    all_last = count_last(pages) if index is None else indexed_last(near(index, keyed, "__url"))
    if early is not None and not few and urls.keys >= _MOST_PAGES * pages.count():
        repeated = _repeats(all_last)
        last = all_last.drop("n")
        placed = lookup(keyed, last.withColumnRenamed("url", "__url"), ["__url"], profile=urls)
        reduced = pages.select(F.col("url").alias("__url"), "page_id", early, *outcome)
        reduced = _one_each(reduced, ["__url", "page_id"], reduced.columns[2], repeated)
        by_page = _profile_by_page(urls, last)
        joined = lookup(placed, reduced, ["__url", "page_id"], profile=by_page, measured=["page_id"]).drop("page_id")
        return _mark_fetch(joined, profile).drop("__url", "fetched", "timed_out")

    wanted = (
        keyed.where(F.col("__url").isNotNull())
        .groupBy(F.col("__url").alias("url"))
        .agg((F.lit(True) if needs_text is None else F.bool_or(needs_text)).alias("needs_text"))
    )
    if few:
        if index is None:
            all_last = count_last(pages.join(F.broadcast(wanted), "url", "left_semi"))
        wanted_last = F.broadcast(all_last.join(F.broadcast(wanted), "url"))
        spread = spread_small_input
    else:
        # Neither side of this join has a URL twice, and both are partitioned by it.
        wanted_last = all_last.join(wanted, "url").hint("shuffle_hash")

        def spread(df, judged):
            return df

    repeated = _repeats(wanted_last)
    # Pages meet the URLs where they are read; only those that are wanted are spread.
    captured = spread(pages.join(wanted_last.drop("n"), ["url", "page_id"]), judged=pages)
    captured = captured.select(F.col("url").alias("__url"), carried, *outcome)
    captured = _one_each(captured, ["__url"], captured.columns[1], repeated)
    joined = lookup(keyed, captured, ["__url"], profile=urls)
    return _mark_fetch(joined, profile).drop("__url", "fetched", "timed_out")


def attach_pages(requests, pages, profile, index=None):
    """Requests with the HTML of their URL; misses become status 500.

    Jobs over identifiers run while the plan is built, as ``_attach`` says.
    """
    return _attach(requests, pages, profile, F.col("html"), index=index)


def extract_blocks(pages, strict_www=False):
    """``[page_id, url, html]`` → the same without HTML, with source and blocks."""
    source = identify_source(F.col("url"), strict_www)
    return (
        spread_small_input(pages)
        .withColumn("source", source)
        .withColumn("blocks", select_blocks(F.col("html"), block_element(F.col("source")), block_class(F.col("source"))))
        .drop("html")
    )


def explode_blocks(pages, strict_www=False):
    """``[page_id, url, html]`` → a row per block without HTML: the other columns, source, ``block_no``, ``block_text``."""
    sourced = spread_small_input(pages).withColumn("source", identify_source(F.col("url"), strict_www))
    kept = [c for c in sourced.columns if c != "html"]
    return block_rows(sourced, F.col("html"), block_element(F.col("source")), block_class(F.col("source")), kept)


def attach_articles(requests, pages, profile, only_models=None, urls=None, index=None):
    """Requests with source and article text, each page fetched and parsed once.

    The HTML goes no further than the parser; requests are joined to text.  Pages
    asked for only with models outside ``only_models`` are not parsed, as their
    requests fail whatever the text.  ``urls`` is the profile of the requests' URLs,
    where it is known already, ``index`` that of the last captures.  Jobs over identifiers run
    while the plan is built, as ``_attach`` says.
    """
    needs_text = F.coalesce(F.col("model").isin(*only_models), F.lit(False)) if only_models else None
    source = identify_source(F.col("url"), profile.strict_www)

    def content(element):
        blocks = select_blocks(F.col("html"), element, block_class(source))
        return article_text(blocks, profile.drop_empty_blocks).alias("content")

    element = block_element(source)
    carried = content(F.when(F.col("needs_text"), element))
    attached = _attach(requests, pages, profile, carried, content(element), needs_text, urls, index)
    if needs_text is not None:
        # Whatever others asked of the page, and whichever way it came.
        attached = attached.withColumn("content", F.when(needs_text, F.col("content")))
    articles = attached.withColumn("source", source)

    good = F.col("status").isNull()
    unreadable = good & F.col("content").isNull()
    if only_models:
        unreadable = unreadable & needs_text
    blank = good & is_blank(F.col("content")) & F.lit(profile.reject_blank)
    return articles.withColumns({
        "status": F.when(unreadable, 500).when(blank, 400).otherwise(F.col("status")).cast("int"),
        "error": F.when(unreadable, INTERNAL_ERROR).when(blank, NO_CONTENT).otherwise(F.col("error")),
    })
