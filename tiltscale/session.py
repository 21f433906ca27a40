"""Session settings the jobs are written for."""

import tempfile

from pyspark.sql import SparkSession

# An Arrow batch of 10,000 pages (Spark's default) would hold gigabytes of HTML
# in one Python worker; pages and prompts travel in batches bounded by both
# rows and bytes instead.
_DEFAULT_BATCH_ROWS = "10000"
_BATCH_ROWS = "256"
_BATCH_BYTES = str(32 * 1024 * 1024)

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": _BATCH_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": _BATCH_BYTES,
    # A speculative copy of a rating task would pay for its calls twice.
    "spark.speculation": "false",
}


def build_session(app_name="tiltscale", master=None, **settings):
    """A session with the settings above; ``settings`` use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def bound_arrow_batches(spark):
    """Bound Arrow batches on a session made elsewhere, unless it already does."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == _DEFAULT_BATCH_ROWS:
        spark.conf.set(rows, _BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    return spark


def shared_folder(spark):
    """The folder all executors can reach, for checkpoints and written tables.

    It is the cluster's ``spark.checkpoint.dir``.  Only a local session without
    that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="tiltscale-")
