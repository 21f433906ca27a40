"""Tables laid out by URL, so that a few URLs read a few of their files.

Rows are dealt into buckets by the hash of their URL.  A bucket is a partition of the
table, and so is the number of buckets, which readers need and find there.  Captures of
pages are kept so, recorded answers, and the index of each URL's last capture.
"""

from pyspark.sql import functions as F

from tiltscale.operators.rating import settled

BUCKETS = 1024
# Partition columns of the layout.
OF, BUCKET = "capture_buckets", "capture_bucket"
# Stands for a page_id that is null: such a capture comes before all others.
NO_PAGE_ID = -(2**63)


def url_bucket(url, buckets):
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def write_by_url(rows, path, order, buckets=BUCKETS, mode="errorifexists"):
    """Write ``rows`` by bucket, in the order of URL and ``order``, and read them back.

    Tasks take ranges of that order, so a URL of very many rows is spread over several,
    and each file holds a narrow range of URLs.  Appending with another number of buckets
    is allowed; pruning then leaves those alone that it does not know.
    """
    by = [BUCKET, "url", *order]
    laid = rows.withColumns({OF: F.lit(buckets), BUCKET: url_bucket(F.col("url"), buckets)})
    laid.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy(OF, BUCKET).parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_captures(pages, path, buckets=BUCKETS, mode="errorifexists"):
    """Captures of pages by URL, in the order of their ``page_id``."""
    return write_by_url(pages, path, ["page_id"], buckets, mode)


def write_answers(responses, path, buckets=BUCKETS):
    """Recorded answers by URL, one for each URL and model."""
    return write_by_url(settled(responses), path, ["model"], buckets)


def _last(counted):
    last = counted.groupBy("url").agg(F.max(F.struct("page_id", "n")).alias("last"))
    return last.select("url", "last.page_id", "last.n")


def count_last(pages):
    """``[url, page_id, n]``: the last capture of each URL, and how many captures share its number.

    Settled on identifiers alone; a null ``page_id`` is the lowest.
    """
    page_id = F.coalesce("page_id", F.lit(NO_PAGE_ID)).alias("page_id")
    return _last(pages.select("url", page_id).groupBy("url", "page_id").agg(F.count(F.lit(1)).alias("n")))


def write_index(new_pages, path, buckets=BUCKETS):
    """Add captures to the index of last captures, of which only the new ones are read."""
    return write_by_url(count_last(new_pages), path, ["page_id"], buckets, mode="append")


def indexed_last(index):
    """``count_last`` of all captures that went into an index; reads as many rows as it has."""
    return _last(index.groupBy("url", "page_id").agg(F.sum("n").alias("n")))


def near(pages, urls, url="url"):
    """``pages``, or any table by URL, without the buckets that no URL of ``urls`` falls in.

    A table that is not laid out comes back as it is.

    A job over ``urls`` settles the buckets while the plan is built, of which there are as
    many as the layout has; the scan then lists no others.
    """
    if not {OF, BUCKET} <= set(pages.columns):
        return pages
    first = pages.select(OF).limit(1).first()
    if first is None or first[0] is None:
        return pages
    buckets = first[0]
    found = urls.where(F.col(url).isNotNull()).select(url_bucket(F.col(url), buckets).alias("b")).distinct().collect()
    if len(found) == buckets:
        return pages
    return pages.where((F.col(OF) != buckets) | F.col(BUCKET).isin([row.b for row in found]))
