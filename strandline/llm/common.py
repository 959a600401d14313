"""Shared pieces: tables in the shared folder, sizes, connected components."""

from __future__ import annotations

import atexit
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import ship_package

#: Rows up to which a table of ids may be broadcast (8 bytes a row).
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a local one is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/strandline-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/strandline-{context.applicationId}"
    if getattr(context, "_strandline_folder", None) != folder:
        context._strandline_folder = folder
        atexit.register(_remove, context, folder)
    return folder


def _remove(context, folder: str) -> None:
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: the folder stays for the cluster's own cleaning
        pass


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one."""
    _remove(spark.sparkContext, folder)


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`table` that nothing will read any more."""
    for df in tables:
        _remove(df.sparkSession.sparkContext, df._strandline_path)


def table(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: if an executor is lost afterwards, only the tasks
    that read the files run again. Every call writes under a new name. ``files`` is
    how many files its rows are worth (see :func:`worth`), so that small tables aren't dust.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def worth(rows: int, each: int = 100_000) -> int:
    """Files for at most ``rows`` rows."""
    return 1 + rows // each


def arrow_rows(spark: SparkSession) -> None:
    """Ship this package, and keep Arrow batches small: rows can be long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; it looks at one row more at most a partition."""
    return df.limit(rows + 1).count() <= rows


#: Rows of a key from which it counts as hot; more where there are so many rows that hot keys could be too many to broadcast.
HOT_ROWS = 2000


def hot_keys(left: DataFrame, on: list[str]) -> DataFrame:
    """(on, __salts): keys of more than ``HOT_ROWS`` rows of a written table, and the parts to deal each over.

    The bound rises with the table, so that there are never more than ``BROADCAST_ROWS`` of them.
    """
    bound = max(HOT_ROWS, left.count() // BROADCAST_ROWS)
    counts = left.groupBy(*on).agg(F.count("*").alias("__n")).where(f"__n > {bound}")
    return counts.select(*on, F.ceil(F.col("__n") / bound).cast("int").alias("__salts"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join of a written table, whose keys may be hot, with one that holds each key once.

    Rows of a hot key are dealt by the column ``spread`` over parts, each with its copy of the right row.
    """
    hot = F.broadcast(hot_keys(left, on))
    own = left.join(hot, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    other = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return own.join(other, [*on, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that is reachable over ``edges`` (a, b).

    Alternating stars: each round hangs a node's larger neighbours below its
    smallest one, until nothing changes. A round moves at most one row an edge,
    whatever the degree of a node; group minima are combined before the shuffle.
    Ids without an edge are not in the result. ``edges`` is a written table.
    """
    files = worth(2 * edges.count())
    edge = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = table(edge, "edges", files)
    mark = _mark(state)
    while True:
        both = table(state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both", files)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = skew_join(both, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large.where("a <> b").distinct(), "large", files)
        drop(both)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = skew_join(large, low, ["a"], "b")
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, state = state, table(star.where("a <> b").distinct(), "edges", files)
        drop(last, large)
        now = _mark(state)
        if now == mark:
            break
        mark = now
    below = state.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    roots = state.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return below.unionByName(roots.join(below.select("id"), "id", "left_anti"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
