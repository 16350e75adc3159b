"""Sources of log records. The broker connector is an optional JAR; files in the log's schema stand in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.schemas import ARCHIVE_ROW, LOG_RECORD


def broker_options(brokers: str, topic: str) -> dict[str, str]:
    """Everything from the start, headers included, and a failure instead of silent loss."""
    return {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "true", "includeHeaders": "true"}


def broker_stream(spark: SparkSession, brokers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**broker_options(brokers, topic)).load()


def broker_snapshot(spark: SparkSession, brokers: str, topic: str) -> DataFrame:
    """From the earliest to the latest offsets as they are when the read begins."""
    return spark.read.format("kafka").options(**broker_options(brokers, topic), endingOffsets="latest").load()


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def file_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG_RECORD).parquet(folder)


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive with its hour as text, leading zero kept."""
    return spark.read.schema(ARCHIVE_ROW).parquet(folder)


def frozen(records: DataFrame, folder: str) -> DataFrame:
    """A snapshot written once: later reads see the same rows, and no executor holds the only copy."""
    records.write.mode("overwrite").parquet(folder)
    return records.sparkSession.read.schema(records.schema).parquet(folder)


FEED = "connection_id string, arrival_no long, received_at timestamp, raw string"


def recorded_feed(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Feed messages recorded as JSON lines: the stand-in for a live socket, batch or stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FEED).json(folder)


def publish(records: DataFrame, brokers: str, topic: str, user: str | None = None, password: str | None = None) -> None:
    """Write (key, value, headers) to a topic, acknowledged by all replicas. A failed delivery fails the job."""
    options = {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "includeHeaders": "true"}
    if user is not None:
        login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{password}";'
        options |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}
    records.select("key", "value", "headers").write.format("kafka").options(**options).save()
