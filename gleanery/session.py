"""Session helpers: a tuned builder and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fallback folders of local sessions, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "gleanery", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs here are written for.

    Shuffle partitions start high and AQE coalesces them, which suits both a
    small test and a large cluster; pass ``spark_sql_shuffle_partitions`` style
    keywords (underscores for dots) to override.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Rows with long content: smaller batches keep Python workers small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        # Marks of a stream's files lie on disk, not in the executors' heaps.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    settings.update({key.replace("_", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if any(name.startswith("gleanery") for name in context._python_includes or []):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gleanery-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    context.addPyFile(archive)
    # The driver's process that plans a streaming source looks here alone.
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = f"{known}{os.pathsep}{archive}" if known else archive


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local session may fall back to a temporary folder: there, driver and
    executors are one process on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="gleanery-")
    return _LOCAL_FOLDERS[application]


def new_scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer knows to be empty."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).where(F.lit(False)).select(columns)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors. Mostly text is stored, of which
    this codec leaves two thirds of what the default one does.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else new_scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this program made, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
