"""Position, operation and operation-message XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METRES_PER_DEGREE, OPERATION_MESSAGE_XML, OPERATION_XML, POSITION_XML
from .status import number


def _field(name: str) -> Column:
    return F.trim(F.col(f"`utm:{name}`"))


def _timestamp(name: str) -> Column:
    return F.try_to_timestamp(_field(name))


def _coordinates(geography: str, shape: str) -> Column:
    """GML coordinate text as ``array<struct<lon,lat>>``."""
    text = F.col(f"`utm:{geography}`.`gml:{shape}`.`gml:coordinates`.`_VALUE`")

    def point(token: Column) -> Column:
        parts = F.split(token, ",")
        return F.struct(
            number(F.get(parts, F.lit(0))).alias("lon"), number(F.get(parts, F.lit(1))).alias("lat")
        )

    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), point)


def _position_columns() -> list[Column]:
    point = F.get(_coordinates("location", "Point"), F.lit(0))
    return [
        _field("gufi").alias("gufi"),
        number(_field("heading")).alias("heading"),
        point["lon"].alias("lon"),
        point["lat"].alias("lat"),
        number(_field("speed")).alias("speed"),
        _timestamp("time_received").alias("time_received"),
        _timestamp("time_measured").alias("time_measured"),
    ]


def _operation_columns() -> list[Column]:
    texts = [
        "aircraft_type",
        "flight_number",
        "notify_url",
        "primary_contact_name",
        "primary_contact_phone",
        "primary_contact_email",
        "primary_phone",
        "aircraft_comments",
    ]
    return (
        [_field("unmanned").try_cast("boolean").alias("unmanned")]
        + [_field(t).alias(t) for t in texts]
        + [_timestamp(t).alias(t) for t in ("submit_time", "effective_time_begin", "effective_time_end")]
        + [_coordinates("flight_geography", "LineString").alias("flight_geography")]
        + [number(_field(t)).alias(t) for t in ("min_altitude", "max_altitude")]
    )


def _message_columns() -> list[Column]:
    return [
        _field("gufi").alias("gufi"),
        _field("message_id").try_cast("int").alias("message_id"),
    ]


def _decode(df: DataFrame, col: str, schema: T.StructType, columns: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    # a generator evaluates its input once, a plain projection would parse once per field
    parsed = df.select(*rest, F.inline(F.array(F.from_xml(F.col(col), schema))))
    return parsed.select(*rest, *columns)


def xml_documents(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Every ``<tag ...>...</tag>`` of the files as ``(value, complete)``, in whatever envelope, many or one per file.

    Files are cut at the opening tag, so a split holds whole records and no file is read as one row. A document that ends, or that
    the next one begins in, before its closing tag is not ``complete``; ``value`` is then all there is of it. What lies
    between documents is dropped. A tag that is quoted in a comment counts as one.
    """
    opening, closing = f"<{tag}", f"</{tag}>"
    # what follows the tag's name: attributes up to the bracket, and not the name of another tag
    pieces = spark.read.option("lineSep", opening).text(path).where(F.col("value").rlike(r"^(\s[^<]*)?/?>"))
    end = F.instr("value", closing)
    whole = F.substring("value", F.lit(1), end + len(closing) - 1)
    return pieces.select(
        F.concat(F.lit(opening), F.when(end > 0, whole).otherwise(F.col("value"))).alias("value"), (end > 0).alias("complete")
    )


def _read(spark: SparkSession, path: str, tag: str, schema: T.StructType, columns: list[Column]) -> DataFrame:
    """Fields of the documents, and ``reject``, the text; an incomplete document has no fields."""
    text = F.when(F.col("complete"), F.col("value"))
    documents = xml_documents(spark, path, tag).select(text.alias("value"), F.col("value").alias("reject"))
    return _decode(documents, "value", schema, columns)


def _window_ok() -> Column:
    return F.coalesce(F.col("effective_time_begin") <= F.col("effective_time_end"), F.lit(False))


def _named() -> Column:
    """A message that is not XML, or not of this kind, names no flight."""
    return F.coalesce(F.col("gufi") != "", F.lit(False))


def decode_positions_xml(df: DataFrame, col: str = "value") -> DataFrame:
    """Positions of messages that each hold one ``utm:positions`` element."""
    return _decode(df, col, POSITION_XML, _position_columns()).where(_named())


def _rejects(df: DataFrame, col: str, schema: T.StructType, columns: list[Column]) -> DataFrame:
    raw = df.withColumn("reject", F.col(col))
    return _decode(raw, col, schema, columns).where(~_named()).select(*[c for c in df.columns if c != col], "reject")


def position_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """Messages that :func:`decode_positions_xml` leaves out, as they came."""
    return _rejects(df, col, POSITION_XML, _position_columns())


def operation_message_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """Messages that :func:`decode_operation_messages_xml` leaves out, as they came."""
    return _rejects(df, col, OPERATION_MESSAGE_XML, _message_columns())


def decode_operations_xml(df: DataFrame, col: str = "value") -> DataFrame:
    """Operations of messages that each hold one ``utm:operations_proposed`` element."""
    return _decode(df, col, OPERATION_XML, _operation_columns()).where(_window_ok())


def decode_operation_messages_xml(df: DataFrame, col: str = "value") -> DataFrame:
    """Messages that each hold one ``utm:operation_messages`` element."""
    return _decode(df, col, OPERATION_MESSAGE_XML, _message_columns()).where(_named())


def operation_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """Operations whose window is missing or ends before it begins."""
    return _decode(df, col, OPERATION_XML, _operation_columns()).where(~_window_ok())


def _positions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "utm:positions", POSITION_XML, _position_columns())


def _operations(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "utm:operations_proposed", OPERATION_XML, _operation_columns())


def _messages(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "utm:operation_messages", OPERATION_MESSAGE_XML, _message_columns())


def read_positions_xml(spark: SparkSession, path: str) -> DataFrame:
    """Positions from XML files of one or many documents; see :func:`xml_documents`."""
    return _positions(spark, path).where(_named()).drop("reject")


def read_position_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Documents that :func:`read_positions_xml` leaves out, as ``reject``: cut off, not XML, or without a flight."""
    return _positions(spark, path).where(~_named()).select("reject")


def read_operations_xml(spark: SparkSession, path: str) -> DataFrame:
    """Operations from XML files of one or many documents; impossible time windows are left out."""
    return _operations(spark, path).where(_window_ok()).drop("reject")


def read_operation_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Documents that :func:`read_operations_xml` leaves out, as ``reject``."""
    return _operations(spark, path).where(~_window_ok()).select("reject")


def read_operation_messages_xml(spark: SparkSession, path: str) -> DataFrame:
    """Operation messages from XML files of one or many documents."""
    return _messages(spark, path).where(_named()).drop("reject")


def read_operation_message_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Documents that :func:`read_operation_messages_xml` leaves out, as ``reject``."""
    return _messages(spark, path).where(~_named()).select("reject")


def to_planar(positions: DataFrame, lon0: float = 0.0, lat0: float = 0.0) -> DataFrame:
    """Degrees to the planar metres of the engine, and headings from degrees to radians."""
    return (
        positions.withColumn("lat", (F.col("lat") - lat0) * METRES_PER_DEGREE)
        .withColumn("lon", (F.col("lon") - lon0) * METRES_PER_DEGREE)
        .withColumn("heading", F.radians("heading"))
    )
