"""FASTA text as a DataFrame source; plain, gzip, bzip2 and xz files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as sq


def parsed(record: Column, word_only: bool = False) -> list[Column]:
    """id, header, sequence and _corrupt of one record's text, with or without its leading mark."""
    text = F.regexp_replace(F.regexp_replace(record, "\r", ""), r"^>", "")
    title = F.split(text, "\n", 2)
    line, body = F.get(title, F.lit(0)), F.coalesce(F.get(title, F.lit(1)), F.lit(""))
    bad = ~F.get(title, F.lit(0)).rlike(r"^\S")
    return [sq.split_id(line).alias("id"), sq.split_header(line, word_only).alias("header"), F.regexp_replace(body, "\n", "").alias("sequence"), F.when(bad, record).alias("_corrupt")]


def read_fasta(spark: SparkSession, path: str, word_only: bool = False) -> DataFrame:
    """(file, offset_key, id, header, sequence, _corrupt): a row a record, split anywhere.

    ``offset_key`` orders the records of a file.
    """
    if path.endswith(".xz"):
        return _read_xz(spark, path, word_only)
    raw = spark.read.option("lineSep", "\n>").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return raw.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), at.alias("offset_key"), *parsed(F.col("value"), word_only))


def _read_xz(spark: SparkSession, path: str, word_only: bool) -> DataFrame:
    """Records of xz files, for which Spark has no codec: a task streams a file through Python."""
    files = spark.read.format("binaryFile").load(path).select("path")
    rows = files.mapInArrow(_xz_records, "path string, at long, value string")
    at = F.struct(F.lit(0).cast("long").alias("split"), F.col("at").alias("row"))
    return rows.where(F.trim("value") != "").select(F.col("path").alias("file"), at.alias("offset_key"), *parsed(F.col("value"), word_only))


def _xz_records(batches):
    import lzma

    import pyarrow as pa
    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("value", pa.string())])

    def flush(path, first, held):
        rows = [b"".join(x).decode("utf-8", "replace") for x in held]
        return pa.record_batch([pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.string())], schema=schema)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as raw, lzma.open(raw, "rb") as stream:
                held, first, size = [], 0, 0
                for line in stream:
                    if line.startswith(b">") or not held:
                        if size > 1 << 22:
                            yield flush(path, first, held)
                            first, held, size = first + len(held), [], 0
                        held.append([])
                    held[-1].append(line)
                    size += len(line)
                if held:
                    yield flush(path, first, held)


def numbered(records: DataFrame) -> DataFrame:
    """``records`` of a source with ``ordinal``: files by name, records in file order.

    Rows are counted by split; the table of splits is small, so no window spans all rows.
    """
    from pyspark.sql import Window

    own = records.withColumn("__split", F.col("offset_key.split"))
    counts = own.groupBy("file", "__split").agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("file", "__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("file", "__split").orderBy("offset_key.row"))
    return own.join(base, ["file", "__split"]).withColumn("ordinal", (F.col("__base") + inside - 1).cast("long")).drop("__split", "__base", "offset_key", "file")
