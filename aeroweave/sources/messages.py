"""Message streams and tables with the columns ``key``, ``value`` and ``timestamp``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import MESSAGE


def _source(reader, topic: str, format: str, options: dict[str, str] | None) -> DataFrame:
    options = dict(options or {})
    if format == "kafka":
        raw = reader.format("kafka").option("subscribe", topic).options(**options).load()
        offset = F.concat_ws("-", "topic", "partition", "offset")
        return raw.select(
            F.coalesce(F.col("key").cast("string"), offset).alias("key"),
            F.col("value").cast("string").alias("value"),
            "timestamp",
        )
    folders = f"{{{topic}}}" if "," in topic else topic
    path = f"{options.pop('path').rstrip('/')}/{folders}"
    # a topic may hold a folder per published batch
    return reader.format(format).schema(MESSAGE).options(**options).load(path).select(*MESSAGE.names)


def read_stream(
    spark: SparkSession, topic: str, format: str = "kafka", options: dict[str, str] | None = None
) -> DataFrame:
    """Unbounded messages of one topic, or of several separated by commas.

    ``kafka`` takes the broker options as they are, and a message without a key is named by its
    offset; a file format takes ``path``, below which every topic is a folder.
    """
    return _source(spark.readStream, topic, format, options)


def read_messages(
    spark: SparkSession, topic: str, format: str = "kafka", options: dict[str, str] | None = None
) -> DataFrame:
    """The same messages as a bounded table."""
    return _source(spark.read, topic, format, options)


def _envelope(df: DataFrame, topic: str | None) -> DataFrame:
    key = F.col("key").cast("string") if "key" in df.columns else F.lit(None).cast("string")
    columns = [key.alias("key"), F.col("value").cast("string").alias("value")]
    if topic is None:
        columns.append(F.col("topic"))
    if "timestamp" in df.columns:
        columns.append(F.col("timestamp"))
    return df.select(*columns)


def write_messages(
    df: DataFrame,
    topic: str | None = None,
    format: str = "kafka",
    options: dict[str, str] | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    batch_id: int | None = None,
) -> DataStreamWriter | None:
    """Publish ``value`` (and ``key``) to a topic.

    A bounded frame is written at once. A stream returns its writer, ready for ``start()``, and
    needs ``checkpoint``. Without ``topic`` every row names its own in a ``topic`` column, which
    gives one topic per region or client. With ``batch_id`` a file format writes a folder of that batch and
    replaces it if the batch is repeated; Kafka consumers drop repeated messages by key and value.
    """
    options = dict(options or {})
    if topic is None and format != "kafka":
        raise ValueError("per-row topics need the kafka format")
    if df.isStreaming and not checkpoint:
        raise ValueError("a streaming sink needs its own checkpoint location")
    out = _envelope(df, topic)
    if format == "kafka":
        if topic is not None:
            options["topic"] = topic
    else:
        options["path"] = f"{options['path'].rstrip('/')}/{topic}"
        if "timestamp" not in out.columns:
            out = out.withColumn("timestamp", F.current_timestamp())
    if not df.isStreaming:
        if batch_id is not None and format != "kafka":
            options["path"] = f"{options['path']}/batch_id={batch_id}"
            out.write.format(format).options(**options).mode("overwrite").save()
        else:
            out.write.format(format).options(**options).mode("append").save()
        return None
    writer = out.writeStream.format(format).options(**options).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"}))
