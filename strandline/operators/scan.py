"""Ordered, shuffled and split scans, and collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part of a shuffled order that is ranked in one task, on average at most.
PART_ROWS = 100_000


def linear(records: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns in the order of ordinals; other columns are not read."""
    return records.select(*(columns or records.columns)).orderBy("ordinal")


def shuffle_key(ordinal: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), ordinal.cast("string")))


def shuffled(records: DataFrame, seed: int, ordinal: str = "ordinal") -> DataFrame:
    """A reproducible random order: a range sort by a hash, the same in every engine."""
    return records.orderBy(shuffle_key(F.col(ordinal), seed))


def shuffled_rank(records: DataFrame, seed: int, ordinal: str = "ordinal") -> DataFrame:
    """``records`` with ``rank`` from 0 in shuffled order, ranked by the hash's first digits and then within them.

    The digits are as many as keep a part near ``PART_ROWS`` rows.
    """
    digits, rows = 1, records.count()
    while rows > PART_ROWS * 16**digits:
        digits += 1
    keyed = records.withColumn("__key", shuffle_key(F.col(ordinal), seed)).withColumn("__part", F.substring("__key", 1, digits))
    counts = keyed.groupBy("__part").agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return keyed.join(F.broadcast(base) if digits <= 4 else base, "__part").withColumn("rank", (F.col("__base") + inside - 1).cast("long")).drop("__key", "__part", "__base")  # 65,536 parts at most are sent


def split(records: DataFrame, training: float, seed: int, key: str = "id") -> DataFrame:
    """``records`` with ``part``, train or test, by a hash of the key: no shuffle, stable under growth."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return records.withColumn("part", F.when(share < training, "train").otherwise("test"))


def summary(records: DataFrame) -> DataFrame:
    """Entries, bases, and shortest, longest and mean record."""
    size = F.octet_length("sequence").cast("long")
    return records.agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bases"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.avg(size).alias("mean_length"))


def stats(records: DataFrame) -> DataFrame:
    """(ordinal, id, entries): every id with the number of records."""
    return records.select("ordinal", "id").withColumn("entries", F.lit(records.count()))


def bases(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum(F.octet_length("sequence").cast("long")), F.lit(0)).cast("long").alias("bases"))


def record_length(*streams: str) -> Column:
    """Bytes of a record over streams; the sequence alone by default."""
    total = F.lit(0).cast("long")
    for s in streams or ("sequence",):
        total = total + F.coalesce(F.octet_length(s).cast("long"), F.lit(0))
    return total
