"""Structured Streaming ingest of FASTA files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import scan
from strandline.sources import fasta


def fasta_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(id, header, sequence, _corrupt) of arriving files."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", max_files).text(folder)
    return raw.where(F.trim("value") != "").select(*fasta.parsed(F.col("value")))


def append_records(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Append arriving records with ordinals that go on after the largest one before this batch.

    A batch goes to its own folder, overwritten if the batch is repeated, so each record counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        store = path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        last = -1
        if store.exists(path):
            held = session.read.parquet(target).where(F.col("batch") < number).agg(F.max("ordinal")).first()[0]
            last = -1 if held is None else held
        # ranked by hash: a reproducible order without sorting in one task
        keyed = batch.where("_corrupt is null").withColumn("__id", F.concat_ws("\n", "id", "sequence"))
        ranked = scan.shuffled_rank(keyed, 0, "__id").withColumn("ordinal", F.col("rank") + last + 1)
        ranked.select("ordinal", "id", "header", "sequence").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fasta_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
