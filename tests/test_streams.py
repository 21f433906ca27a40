"""Streams give what the batch plans give, once, across restarts."""

import json
import os

import pytest

from tiltscale.fixed_values import ARTICLES_TOPIC
from tiltscale.operators.messages import decode_results
from tiltscale.operators.rating import called, recorded, stub
from tiltscale.sources.messages import (
    kafka_options,
    kafka_sink_options,
    publish,
    publish_stream,
    read_articles,
    read_messages,
    read_messages_batch,
    read_results,
)
from tiltscale.sources.sinks import append_results, write_once
from tiltscale.streaming import jobs

M = "!$*_&"


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as file:
        file.write("\n".join(lines) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def article(i, **changes):
    return json.dumps({"content": f"text {i}", "model": "gpt", "url": f"u{i}", **changes})


FIRST = [article(i) for i in range(20)] + ["not json", "[1]", '{"content":"cut', article(20, extra=1), article(21, content=7)]
FIRST += [article(30, model="other"), article(31, content=""), article(32, model=None), article(33, content=" ")]
SECOND = [article(i) for i in range(40, 50)]


@pytest.fixture
def responses(spark):
    rows = [(f"u{i}", "gpt", f"because {M}{i % 5 - 2}{M}") for i in range(60) if i % 7]
    return spark.createDataFrame(rows, "url string, model string, result string")


def results(spark, path):
    return sorted(map(tuple, decode_results(read_messages_batch(spark, "text", path)).collect()))


def run(spark, base, backend, **more):
    source = read_messages(spark, "text", f"{base}/in")
    query = jobs.rating_job(
        source, backend, f"{base}/checkpoint", fmt="text", path=f"{base}/out", trigger=jobs.DRAIN, **more
    )
    query.awaitTermination()


def test_rating_stream_equals_batch_and_resumes(spark, tmp_path, responses):
    base = str(tmp_path)
    write_lines(f"{base}/in", "a", FIRST)
    run(spark, base, recorded(responses))
    batch = decode_results(jobs.rated_messages(read_messages_batch(spark, "text", f"{base}/in"), recorded(responses)))
    first = results(spark, f"{base}/out")
    assert first == sorted(map(tuple, batch.collect()))
    assert len(first) == 20 + 3
    assert ("u7", "gpt", "Error processing article.", -999.0) in first

    run(spark, base, recorded(responses))  # nothing new: nothing is rated again
    assert results(spark, f"{base}/out") == first
    write_lines(f"{base}/in", "b", SECOND)
    run(spark, base, recorded(responses, unique=True))
    assert len(results(spark, f"{base}/out")) == len(first) + 10


def test_called_and_stub_backends_stream(spark, tmp_path):
    def client():
        def ask(prompt, options):
            if "text 3" in prompt:
                raise TimeoutError("late")
            return f"{M}{options['temperature']}{M}"

        return ask

    base = str(tmp_path)
    write_lines(f"{base}/in", "a", FIRST)
    run(spark, base, called(client, calls_in_flight=2))
    found = {row[0]: row[3] for row in results(spark, f"{base}/out")}
    assert len(found) == 23 and found["u3"] == -999.0 and found["u4"] == 0.0

    again = f"{base}/stub"
    write_lines(f"{again}/in", "a", FIRST)
    run(spark, again, stub(), any_model=True)
    found = results(spark, f"{again}/out")
    assert len(found) == 24 and {row[2:] for row in found} == {("dummy working", -999.0)}


def test_rejects_and_results_cover_all_messages(spark, tmp_path):
    base = str(tmp_path)
    write_lines(f"{base}/in", "a", FIRST)
    source = read_messages(spark, "text", f"{base}/in")
    jobs.reject_job(source, f"{base}/checkpoint", f"{base}/rejects", jobs.DRAIN).awaitTermination()
    rejects = spark.read.schema("value string, reason string").parquet(f"{base}/rejects")
    reasons = [row.reason for row in rejects.collect()]
    assert sorted(reasons) == ["malformed"] * 3 + ["nothing to rate"] * 2 + ["unknown model"]
    assert len(reasons) + 23 == len(FIRST)


def test_storage_stream(spark, tmp_path):
    base = str(tmp_path)
    lines = [json.dumps({"url": f"u{i}", "model": "gpt", "result": "r", "score": i / 2}) for i in range(5)]
    write_lines(f"{base}/in", "a", lines + ["broken", '{"url":"u"}'])

    def store():
        source = read_messages(spark, "text", f"{base}/in")
        jobs.storage_job(source, f"{base}/checkpoint", f"{base}/stored", jobs.DRAIN).awaitTermination()
        jobs.result_reject_job(source, f"{base}/checkpoint2", f"{base}/rejects", jobs.DRAIN).awaitTermination()
        stored = spark.read.parquet(f"{base}/stored")
        return stored.columns, sorted(row.bias_score for row in stored.collect())

    expected = (["url", "model", "result", "bias_score"], [0.0, 0.5, 1.0, 1.5, 2.0])
    assert store() == expected
    assert store() == expected
    assert spark.read.parquet(f"{base}/rejects").count() == 2


def test_intake_stream_repeats_nothing(spark, tmp_path):
    base = str(tmp_path)
    pages = spark.createDataFrame([(1, "https://x.org/a", "<p>a</p>"), (2, "https://x.org/b", "<p> </p>")],
                                  "page_id long, url string, html string")

    def intake():
        source = spark.readStream.schema("request_id long, body string").json(f"{base}/requests")

        def to_files(articles, number):
            articles.write.mode("overwrite").text(f"{base}/articles/batch={number}")

        jobs.intake_job(source, pages, f"{base}/checkpoint", base, to_files, trigger=jobs.DRAIN).awaitTermination()
        acks = spark.read.parquet(f"{base}/acknowledgements")
        articles = [row.value for row in read_messages_batch(spark, "text", f"{base}/articles").collect()]
        return sorted((row.request_id, row.status) for row in acks.collect()), articles

    def request(i, url):
        return json.dumps({"request_id": i, "body": json.dumps({"url": url})})

    write_lines(f"{base}/requests", "a", [request(1, "https://x.org/a"), request(2, "https://x.org/b"), request(3, "")])
    once = ([(1, 202), (2, 400), (3, 400)], ['{"url":"https://x.org/a","content":"a","model":"gpt"}'])
    assert intake() == once
    assert intake() == once
    write_lines(f"{base}/requests", "b", [request(4, "https://x.org/none")])
    assert intake()[0] == once[0] + [(4, 500)]


def test_batch_files(spark, tmp_path):
    path = str(tmp_path / "messages")
    df = spark.createDataFrame([("a",)], "value string")
    publish(df, "text", path)
    publish(df, "text", path)
    assert read_messages_batch(spark, "text", path).count() == 2
    rows = spark.createDataFrame([("u", "m", "r", 1.0)], "url string, model string, result string, score double")
    for _ in range(2):
        append_results(rows, str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 2
    table = write_once(rows, str(tmp_path / "once"), "model")
    assert table.first().asDict() == {"url": "u", "model": "m", "result": "r", "score": 1.0}
    with pytest.raises(Exception):
        write_once(rows, str(tmp_path / "once"))


def test_kafka_options():
    options = kafka_options("host:1", ARTICLES_TOPIC, "group", maxOffsetsPerTrigger="5", failOnDataLoss="false")
    assert options == {
        "kafka.bootstrap.servers": "host:1",
        "subscribe": "news_articles",
        "groupIdPrefix": "group",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "5",
        "failOnDataLoss": "false",
    }


def test_kafka_sink_options():
    assert kafka_sink_options("host:1", "t") == {"kafka.bootstrap.servers": "host:1", "topic": "t"}


@pytest.mark.parametrize("read", [read_articles, read_results])
def test_sources_read_files_as_they_read_topics(spark, tmp_path, read):
    write_lines(str(tmp_path / "in"), "a", FIRST)
    source = read(spark, fmt="text", path=str(tmp_path / "in"))
    assert source.isStreaming and source.columns == ["value"]


def test_publishing_needs_a_checkpoint(spark, tmp_path):
    write_lines(str(tmp_path / "in"), "a", FIRST)
    source = read_messages(spark, "text", str(tmp_path / "in"))
    with pytest.raises(TypeError):
        publish_stream(source, fmt="text", path=str(tmp_path / "out"))
