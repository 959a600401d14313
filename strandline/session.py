"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "_strandline_shipped"


def local_session(cores: str = "8", name: str = "strandline") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate files below ``spark.checkpoint.dir``, which driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/strandline-{os.getuid()}"
    return f"{folder.rstrip('/')}/strandline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once a session, so that
    Python stages can import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, target = tempfile.mkstemp(prefix="strandline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("strandline", os.path.relpath(path, root)))
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)


def small_batches(spark: SparkSession) -> None:
    """Ship this package, and keep Arrow batches small, so that a Python worker's memory is bounded by bytes, not rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
