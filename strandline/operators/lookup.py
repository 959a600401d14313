"""Lookups by id and ordinal, for one or many requests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as sq

#: Requests up to which a list is sent to all tasks, after its size is checked; longer ones are shuffled.
BROADCAST_REQUESTS = 100_000
#: Requests up to which ids are literals of the plan.
LITERALS = 2000
#: Ranges of requested ids that reach the Parquet scan as a filter.
COVERS = 64


def find(records: DataFrame, name: str, id_case: str = "exact") -> DataFrame:
    """All records of an id; the comparison reaches the Parquet scan."""
    if id_case == "lower":
        return records.where(sq.ascii_lower(F.col("id")) == name.lower())
    return records.where(F.col("id") == name)


def by_ordinal(records: DataFrame, ordinal: int) -> DataFrame:
    return records.where(F.col("ordinal") == ordinal)


def requests(records: DataFrame, names: list[str]) -> DataFrame:
    """(pos, id) of a request list."""
    return records.sparkSession.createDataFrame(pa.table({"pos": pa.array(range(len(names)), pa.int64()), "id": pa.array(names, pa.string())}))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(names: list[str]) -> Column:
    """Whether id is one of ``names``, as one parsed expression."""
    return F.expr(f"id IN ({', '.join(map(_quoted, names))})") if names else F.lit(False)


def covered(names: list[str], parts: int = COVERS) -> Column:
    """A condition on id that all names meet, in at most ``parts`` ranges: statistics of sorted ids prune by it."""
    known = sorted(set(names), key=str.encode)
    step = -(-len(known) // parts) or 1
    runs = [known[i : i + step] for i in range(0, len(known), step)]
    each = [f"id = {_quoted(run[0])}" if len(run) == 1 else f"(id >= {_quoted(run[0])} AND id <= {_quoted(run[-1])})" for run in runs] or ["false"]
    while len(each) > 1:
        each = [f"({each[i]} OR {each[i + 1]})" if i + 1 < len(each) else each[i] for i in range(0, len(each), 2)]
    return F.expr(each[0])


def find_many(records: DataFrame, wanted: DataFrame, rows: int | None = None, on_missing: str = "null", first: bool = False) -> DataFrame:
    """Records for (pos, id) requests; a miss is a row with a null sequence, repeats are repeated.

    Up to BROADCAST_REQUESTS, which is checked, the requested ids go into the scan as ranges and the records are
    filtered where they are read, so only hits move. ``on_missing="error"`` raises for a miss, ``first=True`` keeps
    the record with the smallest ordinal of an id. ``rows``, the number of requests, is a hint.
    """
    hits = records
    if rows is None or rows <= BROADCAST_REQUESTS:
        names = [r.id for r in wanted.select("id").distinct().limit(BROADCAST_REQUESTS + 1).collect()]
        if len(names) <= BROADCAST_REQUESTS:
            names = [n for n in names if n is not None]
            hits = records.where(covered(names))
            if len(names) <= LITERALS:
                hits = hits.where(listed(names))
            else:
                hits = hits.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi")
    if on_missing == "error":
        lost = wanted.join(hits.select("id"), "id", "left_anti").limit(5).collect()
        if lost:
            raise KeyError(f"no record of {', '.join(sorted(str(r.id) for r in lost))}")
    if first:
        best = hits.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
        hits = hits.join(best, ["id", "ordinal"], "left_semi")
    return wanted.join(hits, "id", "left")


def missing_ids(records: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(records.select("id"), "id", "left_anti")


def member_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    return records.join(wanted.select("id"), "id", "left_semi")


def find_ranges(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Records, or parts of them, for requests like ``id`` or ``id:start-end`` (1-based, both ends in)."""
    asked = records.sparkSession.createDataFrame(list(enumerate(wanted)), "pos long, request string")
    shape = r"^(.*):(\d+)-(\d+)$"
    ranged = F.col("request").rlike(shape)
    asked = asked.select("pos", "request", F.when(ranged, F.regexp_extract("request", shape, 1)).otherwise(F.col("request")).alias("id"), F.when(ranged, F.regexp_extract("request", shape, 2).cast("int") - 1).alias("a"), F.when(ranged, F.regexp_extract("request", shape, 3).cast("int")).alias("b"))
    hits = find_many(records, asked, len(wanted))
    return hits.withColumn("sequence", F.when(F.col("a").isNull(), F.col("sequence")).otherwise(sq.subsequence(F.col("sequence"), F.col("a"), F.col("b"))))


def fasta_text(name: Column, header: Column, sequence: Column, width: int = 60, trailing_blank: bool = False) -> Column:
    """A FASTA record; null for a null sequence."""
    title = F.concat(F.lit(">"), name, F.when(header.isNotNull(), F.concat(F.lit(" "), header)).otherwise(F.lit("")), F.lit("\n"))
    return F.concat(title, sq.wrapped(sequence, width, trailing_blank))
