"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose input and cores.  With
``BENCH_COMPARE=1`` it also times rating by a client that needs two
milliseconds an article, on the executors and in a loop on the driver.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_RUNS = 3

HEADLINE = [
    "blocks_p",
    "article_text_drop_empty",
    "page_fetch",
    "sync_answers",
    "async_outcomes",
    "end_to_end",
    "parse_score",
    "prompt_detailed",
    "rate_recorded",
    "rate_called",
    "result_messages",
    "decode_results",
    "rating_stream",
    "storage_stream",
    "intake_stream",
    "pk_violations",
    "fk_orphans",
]


def session():
    from pyspark.sql import SparkSession

    from tiltscale.session import SETTINGS

    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def median_seconds(run):
    run()
    return round(statistics.median(timed(run) for _ in range(WARM_RUNS)), 3)


def slow_client():
    def ask(prompt, options):
        time.sleep(0.002)
        return "!$*_&1!$*_&"

    return ask


def compare(spark):
    """Seconds for the same calls on the executors and in a driver loop."""
    from pyspark.sql import functions as F

    from tiltscale.operators.rating import called, rate_articles, rateable
    from tiltscale.plans.catalog import QUERIES

    articles = QUERIES["rateable"](spark, FOLDER).repartition(int(CPUS))

    def executors(threads):
        drain(rate_articles(articles, called(slow_client, calls_in_flight=threads)))

    def driver_loop():
        ask = slow_client()
        for row in rateable(articles).select("content", F.lit("{}")).collect():
            ask(*row)

    return {
        "executors": median_seconds(lambda: executors(1)),
        "executors_8_calls_in_flight": median_seconds(lambda: executors(8)),
        "driver_loop": round(timed(driver_loop), 3),
    }


def main():
    spark = session()
    from tiltscale.plans.catalog import QUERIES

    seconds = {name: median_seconds(lambda: drain(QUERIES[name](spark, FOLDER))) for name in HEADLINE}
    line = {
        "metric": "sum of median warm seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
    }
    if os.environ.get("BENCH_COMPARE"):
        line["compare"] = compare(spark)
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
