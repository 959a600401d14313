"""Ordinals, prefix sums and block addresses, without a single-partition window over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as sq
from strandline.session import scratch, small_batches

#: Rows of a range of the key, which is numbered or summed in one task: at most, and at least where cores are free.
RANGE_ROWS, LEAST_ROWS = 200_000, 1000


def split_points(df: DataFrame, key: str, rows: int | None = None) -> list[float]:
    """Points that part a numeric ``key`` into ranges of about ``rows`` rows at most (``RANGE_ROWS`` by default)."""
    count = df.count()
    ranges = max(1 + count // (rows or RANGE_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, count // LEAST_ROWS))
    if ranges == 1:
        return []
    return sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))


def _ranged(df: DataFrame, key: str, points: list[float]) -> DataFrame:
    """``df`` with ``__range``, the number of ``points`` that are not above the key (a binary search on the JVM)."""
    if not points:
        return df.withColumn("__range", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-float("inf"), *points, float("inf")], inputCol="__number", outputCol="__bucket")
    found = cut.transform(df.withColumn("__number", F.col(key).cast("double")))
    return found.withColumn("__range", F.col("__bucket").cast("int")).drop("__number", "__bucket")


def _bases(own: DataFrame, *values: Column) -> list[list[int]]:
    """For each of ``values``, its sum over all ranges below each range, and the whole sum: one pass for all of them."""
    sums = [F.sum(v).alias(f"n{i}") for i, v in enumerate(values)]
    totals = {r.range: r for r in own.groupBy(F.col("__range").alias("range")).agg(*sums).collect()}  # a row a range
    out = [[0] for _ in values]
    for i in range(max(totals, default=0) + 1):
        for j, sums_below in enumerate(out):
            sums_below.append(sums_below[-1] + ((i in totals and totals[i][f"n{j}"]) or 0))
    return out


def running_totals(df: DataFrame, key: str, values: dict[str, Column], points: list[float] | None = None) -> DataFrame:
    """``df`` with the sum of each of ``values`` (by name) over all rows with a smaller numeric ``key`` (exclusive).

    Totals by key range give each range its base; one window for all values runs inside a range. It moves all
    columns of ``df``: hand over narrow ones.
    """
    own = _ranged(df.withColumns({f"__{n}": v.cast("long") for n, v in values.items()}), key, split_points(df, key) if points is None else points)
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    bases = _bases(own, *[F.col(f"__{n}") for n in values])
    total = {n: (F.get(F.array(*[F.lit(x).cast("long") for x in b]), F.col("__range")) + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0))).cast("long") for n, b in zip(values, bases, strict=True)}
    return own.withColumns(total).drop("__range", *[f"__{n}" for n in values])


def running_total(df: DataFrame, key: str, value: Column, name: str, points: list[float] | None = None) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, key, {name: value}, points)


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal", points: list[float] | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of a unique numeric ``key``; they come in that order.

    Each range of the key goes to the partition of its number, once, and is sorted there; a row's number is
    its place behind the rows of the ranges below, which a scan of the key counts.
    """
    points = split_points(df, key) if points is None else points
    own = _ranged(df, key, points)
    base = F.array(*[F.lit(n).cast("long") for n in _bases(own, F.lit(1))[0]])
    dealt = own.repartitionById(len(points) + 1, F.col("__range")).sortWithinPartitions(key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn(name, (F.get(base, F.col("__range")) + place).cast("long")).drop("__range")


def row_at(df: DataFrame, key: str, ordinal: int, points: list[float] | None = None) -> DataFrame:
    """The row of an ordinal in the order of a unique numeric ``key``: a scan of the key finds its range, and only that is read."""
    points = split_points(df, key) if points is None else points
    bases = _bases(_ranged(df.select(key), key, points), F.lit(1))[0]
    if not 0 <= ordinal < bases[-1]:
        return df.limit(0).withColumn("ordinal", F.lit(ordinal).cast("long"))
    at = max(i for i, n in enumerate(bases) if n <= ordinal)
    number = F.col(key).cast("double") if points else F.lit(0.0)
    low = number >= points[at - 1] if at else F.lit(True)
    high = number < points[at] if at < len(points) else F.lit(True)
    return df.where(low & high).orderBy(key).offset(ordinal - bases[at]).limit(1).withColumn("ordinal", F.lit(ordinal).cast("long"))


def records(df: DataFrame, id_col: str, sequence: Column, header: Column | None = None, scores: Column | None = None) -> DataFrame:
    """(ordinal, id, header, sequence, scores, n_bytes) of a table with a unique numeric id."""
    own = df.select(F.col(id_col).alias("__key"), F.col(id_col).cast("string").alias("id"), (F.lit(None).cast("string") if header is None else header).alias("header"), sequence.alias("sequence"), (F.lit(None).cast("string") if scores is None else scores).alias("scores"))
    return with_ordinal(own, "__key").withColumn("n_bytes", F.octet_length("sequence").cast("long")).select("ordinal", "id", "header", "sequence", "scores", "n_bytes")


def _pieces(at: DataFrame, block_size: int, *keep: str) -> DataFrame:
    """(*keep, piece, block, start, len) of stretches that begin at ``__at`` of their stream and hold ``__n`` characters."""
    block = F.expr(f"sequence(__at div {block_size}, (__at + __n - 1) div {block_size})")
    cut = at.where(F.col("__n") > 0).select(*keep, F.col("__at"), (F.col("__at") + F.col("__n")).alias("__to"), F.posexplode(block).alias("piece", "block"))
    low, high = F.greatest("__at", F.col("block") * block_size), F.least("__to", (F.col("block") + 1) * block_size)
    return cut.select(*keep, F.col("piece").cast("int").alias("piece"), F.col("block").cast("long").alias("block"), (low - F.col("block") * block_size).cast("long").alias("start"), (high - low).cast("long").alias("len"))


def pack_locs(lengths: DataFrame, block_size: int, key: str = "ordinal", length: str = "n") -> DataFrame:
    """(key, piece, block, start, len): where a stream of records lies in blocks of ``block_size``."""
    return _pieces(running_total(lengths.select(key, F.col(length).alias("__n")), key, F.col("__n"), "__at"), block_size, key)


#: Streams of a record and their columns; a mask counts a character each, other streams bytes or characters of their text.
STREAMS = ("ids", "headers", "sequence", "masking", "scores")


def streams(records: DataFrame, *keep: str) -> DataFrame:
    """(ordinal, *keep, stream, content) of (ordinal, id, header, sequence, scores): absent streams have no row."""
    sequence = F.col("sequence")
    parts = [F.col("id"), F.col("header"), sq.ascii_upper(sequence), sq.mask_or_null(sequence), F.col("scores")]
    held = F.array(*[F.struct(F.lit(n).alias("stream"), c.alias("content")) for n, c in zip(STREAMS, parts, strict=True)])
    return records.select("ordinal", *keep, F.explode(held).alias("s")).select("ordinal", *keep, "s.*").where("content <> ''")


def _sizes(ident: Column, header: Column, sequence: Column, scores: Column) -> list[Column]:
    """Characters of each stream of a record, 0 where it is absent; a mask has one for each of its sequence."""
    size = [F.length(ident), F.length(header), F.length(sequence), F.when(sq.is_masked(sequence), F.length(sequence)), F.length(scores)]
    return [F.coalesce(n, F.lit(0)).cast("long").alias(s) for s, n in zip(STREAMS, size, strict=True)]


def stream_sizes(df: DataFrame, id_col: str, sequence: Column, header: Column | None = None, scores: Column | None = None) -> DataFrame:
    """(ordinal, ids, headers, ...), the characters of each stream, of a table with a unique numeric id; its texts are read, but not moved."""
    none = F.lit(None).cast("string")
    own = df.select(F.col(id_col).alias("__key"), *_sizes(F.col(id_col).cast("string"), none if header is None else header, sequence, none if scores is None else scores))
    return with_ordinal(own, "__key").select("ordinal", *STREAMS)


def size_locs(sizes: DataFrame, block_size: int) -> DataFrame:
    """(ordinal, stream, piece, block, start, len) of :func:`stream_sizes`: :func:`pack_locs` for each stream of its own, all in one pass."""
    at = running_totals(sizes, "ordinal", {f"__at_{s}": F.col(s) for s in STREAMS})
    held = F.array(*[F.struct(F.lit(s).alias("stream"), F.col(f"__at_{s}").alias("__at"), F.col(s).alias("__n")) for s in STREAMS])
    return _pieces(at.select("ordinal", F.explode(held).alias("s")).select("ordinal", "s.*"), block_size, "ordinal", "stream")


def stream_locs(records: DataFrame, block_size: int) -> DataFrame:
    """:func:`size_locs` of (ordinal, id, header, sequence, scores)."""
    return size_locs(records.select("ordinal", *_sizes(*[F.col(c) for c in ("id", "header", "sequence", "scores")])), block_size)


def stream_blocks(locs: DataFrame, records: DataFrame) -> DataFrame:
    """(stream, block, data) of the streams' contents. A record's pointers meet it once; each content is cut in one pass."""
    small_batches(records.sparkSession)
    held = locs.groupBy("ordinal").agg(F.collect_list(F.struct("stream", "piece", "block", "start", "len")).alias("p"))
    own = streams(records.join(held, "ordinal"), "p").select("stream", "content", F.array_sort(F.filter("p", lambda x: x["stream"] == F.col("stream"))).alias("p"))
    parts = own.select("stream", "p", sq.cut(F.col("content"), F.col("p.len")).alias("s"))
    piece = parts.select("stream", F.explode(F.arrays_zip("p", "s")).alias("x")).select("stream", "x.p.block", "x.p.start", "x.s")
    return piece.groupBy("stream", "block").agg(F.array_sort(F.collect_list(F.struct("start", "s"))).alias("p")).select("stream", "block", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("data"))


def records_by_locs(locs: DataFrame, block_table: DataFrame) -> DataFrame:
    """(ordinal, id, header, sequence, scores), masks applied, of the records that pointer rows address."""
    small_batches(locs.sparkSession)
    part = locs.join(block_table, ["stream", "block"]).select("ordinal", "stream", "piece", F.substr("data", (F.col("start") + 1).cast("int"), F.col("len").cast("int")).alias("s"))
    whole = part.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("stream", "piece", "s"))).alias("p"))
    of = lambda stream: F.filter("p", lambda x: x["stream"] == stream)
    rows = whole.select("ordinal", *[of(s).alias(s) for s in STREAMS]).select("ordinal", *[F.when(F.size(s) > 0, F.array_join(F.transform(s, lambda x: x["s"]), "")).alias(s) for s in STREAMS])
    return rows.select("ordinal", F.col("ids").alias("id"), F.col("headers").alias("header"), sq.apply_mask(F.col("sequence"), F.col("masking")).alias("sequence"), "scores")


def presence(locs: DataFrame) -> DataFrame:
    """(ordinal, has_ids, has_headers, ...): which streams a record has pointers to."""
    return locs.groupBy("ordinal").agg(*[F.bool_or(F.col("stream") == s).alias(f"has_{s}") for s in STREAMS])


def pointer_ranges(locs: DataFrame) -> DataFrame:
    """(ordinal, stream, first, pointers): where a record's pointers lie in its stream's vector of pointers, by ordinal.

    Pointers are counted in one pass; a row a record is kept as a file, from which all ranges come.
    """
    spark, path = locs.sparkSession, scratch(locs.sparkSession)
    counts = locs.groupBy("ordinal").agg(*[F.count_if(F.col("stream") == s).alias(s) for s in STREAMS])
    counts.write.parquet(path)
    first = running_totals(spark.read.schema(counts.schema).parquet(path), "ordinal", {f"__at_{s}": F.col(s) for s in STREAMS})
    held = F.array(*[F.struct(F.lit(s).alias("stream"), F.col(f"__at_{s}").alias("first"), F.col(s).alias("pointers")) for s in STREAMS])
    return first.select("ordinal", F.explode(held).alias("s")).select("ordinal", "s.*").where("pointers > 0")


def stream_bytes(records: DataFrame) -> DataFrame:
    """(stream, records, bytes) that a collection holds."""
    return streams(records).groupBy("stream").agg(F.count("*").alias("records"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


def loc_slice(start: Column, length: Column, low: Column, high: Column) -> Column:
    """The part [low, high) of an address as (start, len); not clamped to the address, never below 0."""
    return F.struct((start + low).cast("long").alias("start"), F.greatest(high - low, F.lit(0)).cast("long").alias("len"))


def location_splits(locs: DataFrame, key: str = "ordinal") -> DataFrame:
    """``locs`` with the half-open range [split_start, split_end) of the record that each one holds."""
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long")
    return locs.withColumn("split_start", start).withColumn("split_end", F.col("split_start") + F.col("len"))


def slice_locs(locs: DataFrame, ranges: DataFrame, key: str = "ordinal") -> DataFrame:
    """Addresses of the parts of records that ``ranges`` (key, range_start, range_end) ask for."""
    split = location_splits(locs, key).join(ranges, key)
    low, high = F.greatest("split_start", "range_start"), F.least("split_end", "range_end")
    return split.where((F.col("split_start") < F.col("range_end")) & (F.col("split_end") > F.col("range_start"))).select(key, "piece", "block", (F.col("start") + low - F.col("split_start")).cast("long").alias("start"), (high - low).cast("long").alias("len"))


def blocks(locs: DataFrame, sequences: DataFrame, key: str = "ordinal", sequence: str = "sequence") -> DataFrame:
    """(block, data) of a stream; one block's pieces meet, so its size bounds a group."""
    part = location_splits(locs, key).join(sequences.select(key, sequence), key)
    piece = part.select("block", "start", F.substr(F.col(sequence), (F.col("split_start") + 1).cast("int"), F.col("len").cast("int")).alias("s"))
    return piece.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "s"))).alias("p")).select("block", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("data"))


def reassemble(locs: DataFrame, block_table: DataFrame, key: str = "ordinal") -> DataFrame:
    """(key, sequence) from addresses and block contents."""
    part = locs.join(block_table, "block").select(key, "piece", F.substr(F.col("data"), (F.col("start") + 1).cast("int"), F.col("len").cast("int")).alias("s"))
    return part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["s"]), "").alias("sequence"))


def block_stats(locs: DataFrame) -> DataFrame:
    """(block, records, used) of each block."""
    return locs.groupBy("block").agg(F.count("*").alias("records"), F.sum("len").cast("long").alias("used"))


def delta_encoded(df: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """Differences to the value before, the first one to 0, within a group."""
    return df.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(group).orderBy(key)))


def delta_decoded(df: DataFrame, key: str, group: str, delta: str = "delta") -> DataFrame:
    own = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum(delta).over(own).cast("long"))
