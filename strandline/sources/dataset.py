"""The dataset directory: Parquet records sorted by id, their order, and metadata."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codecs
from strandline.functions import sequence as sq
from strandline.operators import lookup
from strandline.session import small_batches
from strandline.sources import fasta, fastq

RECORDS = "ordinal long, id string, header string, sequence string, mask array<struct<start:int,len:int>>, scores string, n_bytes long"
#: The fields of a dataset's metadata.
METADATA = "created_by string, citation_doi string, citation_url string, citation_authors string, date_created long, title string, description string, notes string, download_url string, homepage_url string, version int, block_size int"
VERSION = 1


def write_dataset(records: DataFrame, path: str, preset: str = "default", codec: str | None = None, level: int | None = None, index: bool = True, metadata: dict | None = None, block_kib: int | None = None, bloom_ids: int | None = None) -> None:
    """Write (ordinal, id, header, sequence, scores); sequences upper-cased, masks as runs.

    With ``index`` records are sorted by id, so that the statistics of files, row groups and pages
    prune lookups, and a table of ids in order of ordinals is written beside them. ``bloom_ids``
    adds bloom filters for that many ids a row group.
    """
    small_batches(records.sparkSession)
    choice = codecs.resolve(preset, codec, level, block_kib)
    rows = records.select("ordinal", "id", "header", sq.ascii_upper(F.col("sequence")).alias("sequence"), sq.mask_runs("sequence").alias("mask"), "scores", F.octet_length("sequence").cast("long").alias("n_bytes"))
    # raw records are sorted, and become columns of a dataset where they are written
    if index:
        rows = records.repartitionByRange("id").sortWithinPartitions("id").select(*[F.col(c) for c in ("ordinal", "id", "header")], sq.ascii_upper(F.col("sequence")).alias("sequence"), sq.mask_runs("sequence").alias("mask"), "scores", F.octet_length("sequence").cast("long").alias("n_bytes"))
    writer = rows.write.mode("overwrite").options(**codecs.writer_options(choice))
    if bloom_ids:
        writer = writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(bloom_ids))
    writer.parquet(f"{path}/records")
    if index:
        order = records.sparkSession.read.schema(RECORDS).parquet(f"{path}/records").select("ordinal", "id")
        order.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.mode("overwrite").parquet(f"{path}/order")
    known = {"created_by": "strandline", "date_created": int(time.time()), "version": VERSION, "block_size": choice["block_kib"] << 10} | (metadata or {})
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [part.split() for part in METADATA.split(", ")]
    about = pa.table({name: pa.array([known.get(name)], kinds[kind]) for name, kind in fields})
    records.sparkSession.createDataFrame(about).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def metadata_from_yaml(path: str) -> dict:
    """Metadata fields of a YAML file on the driver; unknown names raise."""
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file) or {}
    names = {part.split()[0] for part in METADATA.split(", ")}
    if not set(found) <= names:
        raise ValueError(f"{path}: no metadata fields: {', '.join(sorted(set(found) - names))}")
    return found


def record_at(spark: SparkSession, path: str, ordinal: int) -> DataFrame:
    """The record of an ordinal: its id from the sorted order, then a pruned lookup by id."""
    found = spark.read.schema("ordinal long, id string").parquet(f"{path}/order").where(F.col("ordinal") == ordinal).first()
    records = read_dataset(spark, path)
    return records.where((F.col("id") == found.id) & (F.col("ordinal") == ordinal)) if found else records.limit(0)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).parquet(f"{path}/metadata").withColumn("created", F.timestamp_seconds("date_created"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of a dataset; another version is refused."""
    small_batches(spark)
    version = read_metadata(spark, path).select("version").first()
    if version is None or version[0] != VERSION:
        raise ValueError(f"{path}: version {version and version[0]} is not {VERSION}")
    return spark.read.schema(RECORDS).parquet(f"{path}/records")


def unmasked_text(mask: str = "mask", sequence: str = "sequence"):
    """The sequence with its runs in lower case again, in one pass over it."""
    return sq.apply_runs(F.col(sequence), F.col(mask))


def subsequences(records: DataFrame, start: int, end: int, mask: bool = True):
    """(id, part): characters start to end of records of a dataset, soft-masked or, without ``mask``, as stored."""
    own = unmasked_text() if mask else F.col("sequence")
    return records.select("id", sq.subsequence(own, start, end).alias("part"))


def convert(spark: SparkSession, path: str, target: str, flags: set[str] | None = None, level: int | None = None, block_kib: int | None = None, metadata_yaml: str | None = None, **options) -> None:
    """Turn FASTA or FASTQ text, told apart by its first character, into a dataset; bad records are left out.

    ``flags`` are names of presets and codecs, of which the last one in the fixed order counts.
    """
    if flags:
        choice = codecs.resolve_flags(flags, level, block_kib)
        options |= {"codec": choice["codec"], "level": choice["level"], "block_kib": choice["block_kib"]}
    else:
        options |= {k: v for k, v in (("level", level), ("block_kib", block_kib)) if v is not None}
    if metadata_yaml:
        options["metadata"] = metadata_from_yaml(metadata_yaml) | options.get("metadata", {})
    own = fasta.read_fasta(spark, path) if path.endswith(".xz") and not path.endswith(("fastq.xz", "fq.xz")) else None
    kind = "FASTA" if own is not None else None
    if kind is None and path.endswith((".fastq.xz", ".fq.xz")):
        kind = "FASTQ"
    if kind is None:
        head = spark.read.text(path).where("value <> ''").select(sq.sniff_format(F.col("value")).alias("kind")).first()
        kind = "FASTA" if head is None else head.kind
    if kind == "FASTA":
        own = (fasta.read_fasta(spark, path) if own is None else own).withColumn("scores", F.lit(None).cast("string"))
    elif kind == "FASTQ":
        own = fastq.read_fastq(spark, path)
        own = own.withColumn("offset_key", F.struct(F.expr(f"at div {64 << 20}").alias("split"), F.col("at").alias("row"))).drop("at")
    else:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    write_dataset(fasta.numbered(own.where("_corrupt is null")), target, **options)


def write_fasta(records: DataFrame, path: str, width: int = 60, compression: str | None = None) -> None:
    """One text record a row; the last line feed is the line separator's."""
    text = lookup.fasta_text(F.col("id"), F.col("header"), F.col("sequence"), width)
    writer = records.select(F.regexp_replace(text, r"\n$", "").alias("value")).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fastq(records: DataFrame, path: str, compression: str | None = None) -> None:
    """One record a row, of (id, header, sequence, scores); records without scores are left out."""
    title = F.concat(F.lit("@"), F.col("id"), F.coalesce(F.concat(F.lit(" "), "header"), F.lit("")))
    rows = records.where("scores is not null").select(F.concat_ws("\n", title, "sequence", F.lit("+"), "scores").alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_ids(records: DataFrame, path: str) -> None:
    records.orderBy("ordinal").select("id").write.mode("overwrite").text(path)
