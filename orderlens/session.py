"""Session helpers: UTC clock, and the shared folder where a plan is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A folder is made here only for a local master that names none (tests); on a
    cluster a missing setting is an error, because a driver-local path would not
    survive the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="orderlens-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps later passes column-pruned, and fixes values that a
    recomputation could change (range-partition numbers).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table now and keep it, so that its true size is known.

    A join against it is then broadcast by Spark only if that size is under
    ``spark.sql.autoBroadcastJoinThreshold``, before the large side is shuffled.
    Lost blocks are recomputed from the lineage.
    """
    df = df.persist()
    df.count()
    return df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orderlens-code-")) / "orderlens.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
