"""Where messages come from and go to: Kafka, or files with one message a line."""

from tiltscale.fixed_values import ARTICLES_GROUP, ARTICLES_TOPIC, RESULTS_GROUP, RESULTS_TOPIC

# A micro-batch is bounded at the source, so that a backlog, or one key in it,
# never has to be worked off in one go.
_KAFKA_BATCH = {"maxOffsetsPerTrigger": "1000000"}
_FILE_BATCH = {"maxFilesPerTrigger": "1000"}


def kafka_options(servers, topic, group, **more):
    """Source options for one topic, from its earliest message on.

    ``group`` prefixes the consumer groups that Spark makes; the position itself
    is in the query's checkpoint.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "groupIdPrefix": group,
        "startingOffsets": "earliest",
        **_KAFKA_BATCH,
        **more,
    }


def kafka_sink_options(servers, topic, **more):
    """Sink options for one topic."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, **more}


def read_messages(spark, fmt="kafka", path=None, **options):
    """Streaming ``[value]`` from Kafka (``kafka_options``) or a folder of text files.

    The position in the source lives in the checkpoint of the query that reads it.
    """
    defaults = {} if fmt == "kafka" else _FILE_BATCH
    reader = spark.readStream.format(fmt).options(**{**defaults, **options})
    return (reader.load(path) if path else reader.load()).select("value")


def read_messages_batch(spark, fmt="text", path=None, **options):
    """The same messages as a batch DataFrame."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.load(path) if path else reader.load()).select("value")


def read_articles(spark, servers=None, fmt="kafka", path=None, **options):
    """Article messages; see ``read_messages``."""
    if fmt == "kafka":
        options = kafka_options(servers, ARTICLES_TOPIC, ARTICLES_GROUP, **options)
    return read_messages(spark, fmt, path, **options)


def read_results(spark, servers=None, fmt="kafka", path=None, **options):
    """Result messages; see ``read_messages``."""
    if fmt == "kafka":
        options = kafka_options(servers, RESULTS_TOPIC, RESULTS_GROUP, **options)
    return read_messages(spark, fmt, path, **options)


def publish(messages, fmt="text", path=None, **options):
    """Write a batch of ``[value]`` messages."""
    writer = messages.write.format(fmt).options(**options).mode("append")
    writer.save(path) if path else writer.save()


def publish_stream(messages, checkpoint, fmt="kafka", path=None, trigger=None, **options):
    """Start a query that writes streaming ``[value]`` messages.

    The checkpoint is not optional: without it a restart would rate everything
    again.
    """
    writer = (
        messages.writeStream.format(fmt)
        .outputMode("append")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
    )
    return writer.start(path) if path else writer.start()
