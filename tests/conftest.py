import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("orderlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    from orderlens.session import materialise
    from orderlens.sources.orders import star_orders

    # Two items of the smallest table share all four key parts; ids must be unique.
    return materialise(star_orders(spark, DATA).dropDuplicates(["order_item_id"]), "orders")


@pytest.fixture(scope="session")
def skewed(spark, orders):
    """A third of all rows in one pair and group, half of those on one instant."""
    from pyspark.sql import functions as F

    from orderlens.session import materialise

    hot = F.col("order_id") % 3 == 0
    return materialise(
        orders.withColumns(
            {
                "product_id": F.when(hot, F.lit(1)).otherwise(F.col("product_id")),
                "order_region": F.when(hot, F.lit("ASIA")).otherwise(F.col("order_region")),
                "supplier": F.when(hot, F.lit("ASIA")).otherwise(F.col("supplier")),
                "category_name": F.when(hot, F.lit("PROMO")).otherwise(F.col("category_name")),
                "order_date": F.when(
                    hot & (F.col("order_id") % 2 == 0), F.lit("1997-01-01").cast("timestamp")
                ).otherwise(F.col("order_date")),
            }
        ),
        "skewed",
    )


def equal_rows(a, b, columns, key="order_item_id", places=6):
    """Same rows, doubles compared to ``places``."""
    from pyspark.sql import functions as F

    kinds = dict(a.dtypes)
    shown = lambda df: df.select(
        key, *[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
    )
    x, y = shown(a), shown(b)
    assert x.count() == y.count()
    assert x.exceptAll(y).count() == 0
    assert y.exceptAll(x).count() == 0
