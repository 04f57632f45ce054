"""Order stream: message envelope, and readers for a broker topic or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orderlens.functions.exprs import lenient_double, parse_order_date
from orderlens.session import use_utc
from orderlens.sources.orders import RAW_NAMES

# The twelve raw fields of a message and the topic name.
PAYLOAD = [
    "Order Id",
    "Order Item Id",
    "Product Card Id",
    "Order Region",
    "Category Name",
    "Supplier Name",
    "Order Item Product Price",
    "Order Item Quantity",
    "Days for shipping (real)",
    "Days for shipment (scheduled)",
    "Order Item Discount Rate",
    "order date (DateOrders)",
]
TOPIC = "factory-orders"

_OWN_NAME = {raw: own for own, raw in RAW_NAMES.items()} | {"Supplier Name": "supplier"}
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("payload", T.StructType([T.StructField(n, T.StringType()) for n in PAYLOAD])),
    ]
)


def envelope(orders: DataFrame, row_index: str) -> DataFrame:
    """One JSON ``value`` per order: raw fields only, no labels, no features."""
    fields = []
    for raw in PAYLOAD:
        own = _OWN_NAME[raw]
        if own not in orders.columns:
            continue
        c = F.col(own)
        if own == "order_date":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        fields.append(c.alias(raw))
    message = F.struct(
        F.col(row_index).cast("bigint").alias("row_index"),
        F.col("order_id").cast("string").alias("order_id"),
        F.struct(*fields).alias("payload"),
    )
    return orders.select(F.to_json(message).alias("value"))


def open_envelope(messages: DataFrame) -> DataFrame:
    """Typed orders from JSON messages; fields that do not parse are NULL.

    Orders without an item id or a date cannot be placed and are dropped.
    """
    m = F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA)
    opened = messages.select(m.alias("m"))
    field = lambda raw: F.col("m.payload").getField(raw)
    region = field("Order Region")
    return opened.select(
        F.col("m.row_index").alias("row_index"),
        F.coalesce(field("Order Id"), F.col("m.order_id")).try_cast("bigint").alias("order_id"),
        field("Order Item Id").alias("order_item_id"),
        field("Product Card Id").try_cast("bigint").alias("product_id"),
        region.alias("order_region"),
        F.coalesce(field("Supplier Name"), region).alias("supplier"),
        field("Category Name").alias("category_name"),
        *[
            lenient_double(field(RAW_NAMES[c])).alias(c)
            for c in ("price", "quantity", "days_real", "days_scheduled", "discount_rate")
        ],
        parse_order_date(field(RAW_NAMES["order_date"])).alias("order_date"),
    ).na.drop(subset=["order_item_id", "order_date"])


def read_topic(spark: SparkSession, servers: str, topic: str = TOPIC, per_trigger: int | None = None) -> DataFrame:
    """Order stream from a broker topic, from its earliest message.

    Needs the Kafka connector on the class path. Progress is kept in the query's
    checkpoint, so a restart continues where it stopped.
    """
    use_utc(spark)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return open_envelope(reader.load().select("value"))


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Order stream from JSON-lines files with the same envelope, oldest file first."""
    use_utc(spark)
    lines = (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return open_envelope(lines)
