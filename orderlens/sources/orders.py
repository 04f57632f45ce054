"""Order tables: declared schema, lenient CSV reader, star-schema view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orderlens.functions.exprs import lenient_double, parse_order_date
from orderlens.session import settle, use_utc

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("order_item_id", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("order_region", T.StringType()),
        T.StructField("supplier", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("days_real", T.DoubleType()),
        T.StructField("days_scheduled", T.DoubleType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("discount_rate", T.DoubleType()),
        T.StructField("order_date", T.TimestampType()),
    ]
)

# Order by event time; ties keep the order in which rows were numbered.
EVENT_ORDER = ["order_date", "order_id", "order_item_id"]
PRICE_KEYS = ["supplier", "category_name"]
PAIR_KEYS = ["product_id", "order_region"]

# Column names of the published order data set, and the order in
# which a stand-in for the supplier and for the event time is looked for.
RAW_NAMES = {
    "order_id": "Order Id",
    "order_item_id": "Order Item Id",
    "product_id": "Product Card Id",
    "order_region": "Order Region",
    "category_name": "Category Name",
    "price": "Order Item Product Price",
    "quantity": "Order Item Quantity",
    "days_real": "Days for shipping (real)",
    "days_scheduled": "Days for shipment (scheduled)",
    "discount": "Order Item Discount",
    "discount_rate": "Order Item Discount Rate",
    "order_date": "order date (DateOrders)",
}
SUPPLIER_NAMES = [
    "Supplier Name",
    "Supplier ID",
    "Supplier Country",
    "Supplier State",
    "Order Region",
    "Order Country",
]
TIME_NAMES = [
    "Order Date",
    "Shipping Date",
    "Order Created Date",
    "Order Date (DateOrders)",
    "order date (DateOrders)",
    "shipping date (DateOrders)",
    "Date",
]
OPTIONAL_RAW = {"discount"}


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def supplier_column(columns: list[str]) -> str:
    """First supplier-like column present."""
    for name in SUPPLIER_NAMES:
        if name in columns:
            return name
    raise ValueError(f"no supplier-like column; one of {SUPPLIER_NAMES} is needed")


def time_column(columns: list[str]) -> str:
    """First event-time column present."""
    for name in TIME_NAMES:
        if name in columns:
            return name
    raise ValueError(f"no time column; one of {TIME_NAMES} is needed")


def typed_orders(raw: DataFrame) -> DataFrame:
    """Rename and type a raw order table; bad numbers and dates become NULL."""
    time_name = time_column(raw.columns)
    needed = [v for k, v in RAW_NAMES.items() if k not in OPTIONAL_RAW | {"order_date"}]
    require_columns(raw, needed, "order table")
    quoted = {k: F.col(f"`{v}`") for k, v in RAW_NAMES.items() if v in raw.columns}
    quoted["order_date"] = F.col(f"`{time_name}`")
    quoted["supplier"] = F.col(f"`{supplier_column(raw.columns)}`")

    def typed(field: T.StructField):
        source = quoted.get(field.name, F.lit(None))
        if field.name == "order_date":
            is_text = dict(raw.dtypes)[time_name] == "string"
            value = parse_order_date(source) if is_text else source.cast("timestamp")
        elif isinstance(field.dataType, T.DoubleType):
            value = lenient_double(source)
        else:
            value = source.try_cast(field.dataType)
        return value.alias(field.name)

    return raw.select(*[typed(f) for f in ORDER_SCHEMA])


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 CSV with a header row. Columns are read as text and typed leniently."""
    use_utc(spark)
    raw = (
        spark.read.option("header", True)
        .option("encoding", "ISO-8859-1")
        .option("escape", '"')
        .csv(path)
    )
    return typed_orders(raw)


def dated_orders(orders: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Drop rows without an event time or one of ``keys``."""
    return orders.na.drop(subset=["order_date", *keys])


LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
]
DEALT_ROWS = 200_000  # line items a task, if they are dealt


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_orders(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """Order items built from the star schema; one row per line item.

    Line items that are read in fewer than ``tasks`` partitions are dealt by their order while they
    have few columns: whole rows dealt in turn would be sorted and shuffled at twice the size.

    Join sides carry no hints: Spark broadcasts a dimension only while its size
    is under ``spark.sql.autoBroadcastJoinThreshold`` and sorts or hashes above.
    Regions are computed first, as Spark takes the product of their three tables for their size.
    Headers come before names, so that line items meet them while their rows are short.
    """
    use_utc(spark)
    lines = star_table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    if lines.rdd.getNumPartitions() < tasks:
        lines = lines.repartition(max(tasks, math.ceil(lines.count() / DEALT_ROWS)), "l_orderkey")
    regions = settle(
        star_table(spark, sf_dir, "supplier")
        .join(star_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(star_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    headers = star_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority"
    )
    parts = star_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = (
        lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(regions, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("r_name").alias("order_region"),
        F.col("r_name").alias("supplier"),
        F.col("p_type").alias("category_name"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days_real"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("days_scheduled"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        F.col("l_discount").alias("discount_rate"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
    )
