"""Named queries over the driver tables, each with its SQL counterpart.

``documents`` plays a collection of records: doc_id is the id, lang and source the
header, text the sequence. ``benchmark`` stands for short records, ``events`` for numeric series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import codecs
from strandline.functions import sequence as sq
from strandline.operators import addressing, lookup, scan
from strandline.session import scratch, ship_package, small_batches
from strandline.sources import dataset, fasta, fastq

BLOCK = 512
WANTED = ["3", "7", "3", "99999999"]
RANGE_SQL = "(SELECT doc_id AS ordinal, 100 AS range_start, 700 AS range_end FROM documents)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without ordinals: queries that need none plan no window."""
    header = F.concat_ws(" ", "lang", "source")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), header.alias("header"), F.col("text").alias("sequence"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressing.records(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.concat_ws(" ", "lang", "source"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.length("text").cast("long").alias("n"))


def scan_linear(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    return addressing.with_ordinal(own, "doc_id").select("ordinal", "id", "sequence")


def scan_shuffled_rank(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"))
    return scan.shuffled_rank(own, 42)


def list_ids(spark, sf_dir):
    return _plain(spark, sf_dir).select("id")


def record_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


def index_len(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").agg(F.count("conv_id").alias("n"))


def find_one(spark, sf_dir):
    return lookup.find(_plain(spark, sf_dir), "7")


def find_missing(spark, sf_dir):
    return lookup.find(_plain(spark, sf_dir), "99999999")


def find_many_ordered(spark, sf_dir):
    own = _plain(spark, sf_dir)
    hits = lookup.find_many(own, lookup.requests(own, WANTED), len(WANTED))
    return hits.orderBy("pos").select("pos", "id", lookup.fasta_text(F.col("id"), F.col("header"), F.col("sequence")).alias("fasta"))


def find_ranges(spark, sf_dir):
    own = _plain(spark, sf_dir)
    return lookup.find_ranges(own, ["3:11-40", "7:1-5", "9"]).select("pos", "request", "sequence")


def missing_ids(spark, sf_dir):
    wanted = _table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 50_000_000).otherwise(0)).cast("string").alias("id"))
    return lookup.missing_ids(_plain(spark, sf_dir), wanted)


def member_ids(spark, sf_dir):
    wanted = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return lookup.member_records(_plain(spark, sf_dir), wanted).select("id", "header")


def by_ordinal(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", "lang", "source").alias("header"))
    return addressing.row_at(own, "doc_id", 41).select("ordinal", "id", "header")


def ascii_upper(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.ascii_upper(F.col("sequence")).alias("sequence"))


def ascii_lower(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.ascii_lower(F.col("sequence")).alias("sequence"))


def mask_string(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.mask_string(F.col("sequence")).alias("mask"))


def mask_has(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.is_masked(F.col("sequence")).alias("masked"))


def mask_count(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.mask_count(F.col("sequence")).alias("masked"))


def mask_runs(spark, sf_dir):
    """Runs leave as rows, in small batches."""
    small_batches(spark)
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(sq.mask_run_rows, "doc_id long, start long, len long")


def unmask_roundtrip(spark, sf_dir):
    small_batches(spark)
    own = F.col("sequence")
    back = sq.apply_mask(sq.ascii_upper(own), sq.mask_or_null(own))
    return _plain(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(back != own).alias("mismatches"))


def split_id_header(spark, sf_dir):
    line = F.regexp_replace("text", "\n", " ")
    return _table(spark, sf_dir, "documents").select("doc_id", sq.split_id(line).alias("id"), sq.split_header(line).alias("header"), sq.split_header(line, True).alias("word"))


def fasta_wrap60(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", lookup.fasta_text(F.col("id"), F.col("header"), F.col("sequence"), 60, True).alias("fasta"))


def fasta_wrap80(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", lookup.fasta_text(F.col("id"), F.col("header"), F.col("sequence"), 80).alias("fasta"))


def pack_locs(spark, sf_dir):
    return addressing.pack_locs(_lengths(spark, sf_dir), BLOCK)


def location_splits(spark, sf_dir):
    return addressing.location_splits(pack_locs(spark, sf_dir)).select("ordinal", "piece", "split_start", "split_end")


def block_stats(spark, sf_dir):
    return addressing.block_stats(pack_locs(spark, sf_dir))


def seqloc_rows(spark, sf_dir):
    locs = pack_locs(spark, sf_dir)
    return locs.groupBy("ordinal").agg(F.count("*").alias("pieces"), F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.sum("len").cast("long").alias("total"))


def _ranges(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.lit(100).cast("long").alias("range_start"), F.lit(700).cast("long").alias("range_end"))


def slice_locs(spark, sf_dir):
    return addressing.slice_locs(pack_locs(spark, sf_dir), _ranges(spark, sf_dir))


def slice_bytes(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", sq.subsequence(F.col("sequence"), 100, 700).alias("part"))


def reassemble(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("sequence"))
    locs = pack_locs(spark, sf_dir)
    return addressing.reassemble(locs, addressing.blocks(locs, own))


def seqloc_len_clean(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", scan.record_length().alias("len"))


def seqloc_len_all(spark, sf_dir):
    own = _plain(spark, sf_dir).withColumn("mask", sq.mask_or_null(F.col("sequence")))
    return own.select("id", scan.record_length("id", "header", "sequence", "mask").alias("len"))


def delta_encode(spark, sf_dir):
    return addressing.delta_encoded(_table(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", "event_id", "user_id").select("user_id", "event_id", "delta")


def delta_decode(spark, sf_dir):
    return addressing.delta_decoded(delta_encode(spark, sf_dir), "event_id", "user_id").select("user_id", "event_id", "value")


def level_clamp(spark, sf_dir):
    wanted = F.explode(F.array(*[F.lit(x) for x in (-3, 0, 5, 12, 23)])).alias("level")
    table = codecs.codec_table(spark).select("*", wanted)
    return table.select("codec", "level", codecs.clamped(F.col("level"), F.col("min_level"), F.col("max_level")).alias("clamped"))


def codec_table(spark, sf_dir):
    return codecs.codec_table(spark)


def presets(spark, sf_dir):
    return codecs.preset_table(spark)


def sniff_format(spark, sf_dir):
    head = F.concat(F.element_at(F.array(F.lit(">"), F.lit("@"), F.lit("PAR1"), F.lit("z")), (F.col("item_id") % 4 + 1).cast("int")), "text")
    return _table(spark, sf_dir, "benchmark").select("item_id", sq.sniff_format(head).alias("format"))


def sniff_compression(spark, sf_dir):
    heads = [*(m for m, _ in sq.MAGIC), "3E41"]
    content = F.unhex(F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("item_id") % len(heads) + 1).cast("int")), F.lit("0000000000")))
    return _table(spark, sf_dir, "benchmark").select("item_id", sq.sniff_compression(content).alias("codec"))


def output_path(spark, sf_dir):
    path = F.element_at(F.array(F.lit("a.fasta.gz"), F.lit("/x.y/a.fa"), F.lit("/x.y/plain")), (F.col("item_id") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "benchmark").select("item_id", sq.output_path(path, "strand").alias("path"))


def directory_check(spark, sf_dir):
    offsets = F.array(*[F.col("doc_id") % m for m in (3, 5, 7, 11)])
    return _table(spark, sf_dir, "documents").select("doc_id", sq.within(offsets, F.lit(8)).alias("sane"), sq.offset_or_null(F.col("doc_id") % 3).alias("offset"))


def summarize(spark, sf_dir):
    return scan.summary(_plain(spark, sf_dir))


def bp(spark, sf_dir):
    return scan.bases(_plain(spark, sf_dir))


def split_train_test(spark, sf_dir):
    return scan.split(_plain(spark, sf_dir), 0.8, 42).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("sequence").cast("long")).alias("bases"))


def hash32(spark, sf_dir):
    ship_package(spark)
    return _plain(spark, sf_dir).select("id", sq.hash32("id").alias("hash"))


def list_ids_ordered(spark, sf_dir):
    """The id list as written in order of ordinals; the test holds the files' order."""
    path = scratch(spark)
    dataset.write_ids(_records(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("id"))


def stats(spark, sf_dir):
    return scan.stats(_records(spark, sf_dir))


def _letters(spark, sf_dir):
    """Records of letters only, with a quality for each: what FASTA and FASTQ can hold. Files hold no ordinals, so none are made."""
    own = _plain(spark, sf_dir).withColumn("sequence", F.regexp_replace("sequence", "[^A-Za-z]", ""))
    return own.where("sequence <> ''").withColumn("scores", F.translate("sequence", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "!#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUV"))


def fasta_files(spark, sf_dir):
    """Records through FASTA files."""
    path = scratch(spark)
    dataset.write_fasta(_letters(spark, sf_dir), path, compression="gzip")
    return fasta.read_fasta(spark, path).select("id", "header", "sequence")


def fastq_files(spark, sf_dir):
    """Records with qualities through FASTQ files."""
    path = scratch(spark)
    dataset.write_fastq(_letters(spark, sf_dir), path)
    return fastq.read_fastq(spark, path).where("_corrupt is null").select("id", "header", "sequence", "scores")


def dataset_files(spark, sf_dir):
    """Records through a dataset directory: upper-cased, masked and restored."""
    path = scratch(spark)
    dataset.write_dataset(_records(spark, sf_dir), path, "fast")
    return dataset.read_dataset(spark, path).select("ordinal", "id", "header", dataset.unmasked_text().alias("sequence"), "n_bytes")


def dataset_unmasked_slices(spark, sf_dir):
    """Parts of a dataset's records without their masks."""
    path = scratch(spark)
    dataset.write_dataset(_records(spark, sf_dir), path, "fast", block_kib=2048)
    return dataset.subsequences(dataset.read_dataset(spark, path), 100, 700, mask=False)


def converted_files(spark, sf_dir):
    """FASTQ files converted to a dataset by flags, ordinals left out since files have no common order."""
    path = scratch(spark)
    dataset.write_fastq(_letters(spark, sf_dir), f"{path}/in")
    dataset.convert(spark, f"{path}/in", f"{path}/out", flags={"small", "gzip"}, level=4)
    return dataset.read_dataset(spark, f"{path}/out").select("id", "header", dataset.unmasked_text().alias("sequence"), "scores")


def stream_files(spark, sf_dir):
    """FASTA files through the streaming ingest; all ordinals are there once."""
    from strandline.streaming import ingest

    path = scratch(spark)
    dataset.write_fasta(_letters(spark, sf_dir), f"{path}/in")
    ingest.append_records(spark, f"{path}/in", f"{path}/out", f"{path}/log").awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.select("id", "header", "sequence", (F.col("ordinal").between(0, rows.count() - 1) & (F.count("*").over(Window.partitionBy("ordinal")) == 1)).alias("numbered"))


def stream_locs(spark, sf_dir):
    """Only the sizes of the streams are numbered and moved."""
    sizes = addressing.stream_sizes(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.concat_ws(" ", "lang", "source"))
    return addressing.size_locs(sizes, BLOCK)


def records_by_locs(spark, sf_dir):
    locs = stream_locs(spark, sf_dir)
    return addressing.records_by_locs(locs, addressing.stream_blocks(locs, _records(spark, sf_dir))).select("ordinal", "id", "header", "sequence")


def presence(spark, sf_dir):
    return addressing.presence(stream_locs(spark, sf_dir))


def pointer_ranges(spark, sf_dir):
    return addressing.pointer_ranges(stream_locs(spark, sf_dir))


def stream_bytes(spark, sf_dir):
    return addressing.stream_bytes(_records(spark, sf_dir))


def loc_slice(spark, sf_dir):
    part = addressing.loc_slice(F.col("start"), F.col("len"), F.lit(2), F.col("len") - 3)
    return pack_locs(spark, sf_dir).select("ordinal", "piece", part.alias("p")).select("ordinal", "piece", "p.start", "p.len")


def slice_raw_bytes(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", F.hex(sq.subsequence(F.col("sequence"), 100, 700, "byte")).alias("part"))


def find_first(spark, sf_dir):
    """The first record of each id of a list with repeats, from a table whose ids repeat."""
    own = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("conv_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    names = lookup.requests(own, WANTED[:3])
    return lookup.find_many(own, names, len(WANTED[:3]), first=True).select("pos", "id", "ordinal", "sequence")


_OWN = (scan_linear, scan_shuffled_rank, list_ids, record_count, index_len, find_one, find_missing, find_many_ordered, find_ranges, missing_ids, member_ids, by_ordinal, ascii_upper, ascii_lower, mask_string, mask_has, mask_count, mask_runs, unmask_roundtrip, split_id_header, fasta_wrap60, fasta_wrap80, pack_locs, location_splits, block_stats, seqloc_rows, slice_locs, slice_bytes, reassemble, seqloc_len_clean, seqloc_len_all, delta_encode, delta_decode, level_clamp, codec_table, presets, sniff_format, sniff_compression, output_path, directory_check, summarize, bp, split_train_test, hash32, list_ids_ordered, stats, fasta_files, fastq_files, dataset_files, dataset_unmasked_slices, converted_files, stream_files, stream_locs, records_by_locs, presence, pointer_ranges, stream_bytes, loc_slice, slice_raw_bytes, find_first)
QUERIES = {f.__name__: f for f in _OWN}

_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_R = "(SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang || ' ' || source AS header, text AS sequence FROM documents)"
_MASK = r"regexp_replace(regexp_replace(sequence, '[\x00-\x60]', '0', 'g'), '[^0]', '1', 'g')"
_LOCS = f"""(
    WITH a AS (SELECT doc_id AS ordinal, CAST(length(text) AS BIGINT) AS n,
                      CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM documents),
    b AS (SELECT ordinal, g, n, unnest(range(g // {BLOCK}, (g + n - 1) // {BLOCK} + 1)) AS block FROM a WHERE n > 0)
    SELECT ordinal, CAST(block - g // {BLOCK} AS INT) AS piece, CAST(block AS BIGINT) AS block,
           CAST(greatest(g, block * {BLOCK}) - block * {BLOCK} AS BIGINT) AS start,
           CAST(least(g + n, (block + 1) * {BLOCK}) - greatest(g, block * {BLOCK}) AS BIGINT) AS len FROM b)"""
_SPLITS = f"(SELECT *, CAST(e - len AS BIGINT) AS split_start, CAST(e AS BIGINT) AS split_end FROM (SELECT *, sum(len) OVER (PARTITION BY ordinal ORDER BY piece) AS e FROM {_LOCS}))"
_CLEAN = r"regexp_replace(sequence, '[\r\n]', '', 'g')"
_TITLE = "'>' || id || ' ' || header || chr(10)"
_HALF = "CAST(('0x' || substr(md5('42:' || id), 1, 8)) AS BIGINT) / 4294967296.0"

_CODECS = """(SELECT * FROM (VALUES ('ZSTD', 3, 1, 22), ('LZ4', 0, 0, 0), ('SNAPPY', 0, 0, 0), ('GZIP', 6, 0, 9), ('NONE', 0, 0, 0),
    ('XZ', 6, 0, 9), ('BROTLI', 9, 0, 11), ('BZIP2', 6, 0, 9)) t(codec, default_level, min_level, max_level))"""
_LETTERS = f"(SELECT id, header, regexp_replace(sequence, '[^A-Za-z]', '', 'g') AS sequence FROM {_R})"
_SCORES = """translate(sequence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '!#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUV')"""
_STREAMS = rf"""(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, header, translate(sequence, {_LOW}, {_UP}) AS sequence,
    CASE WHEN regexp_matches(sequence, '[^\x00-\x60]') THEN {_MASK} END AS mask FROM {_R})"""
_CONTENT = f"""(SELECT ordinal, 'ids' AS stream, id AS content FROM {_STREAMS} UNION ALL SELECT ordinal, 'headers', header FROM {_STREAMS}
    UNION ALL SELECT ordinal, 'sequence', sequence FROM {_STREAMS} UNION ALL SELECT ordinal, 'masking', mask FROM {_STREAMS})"""
_STREAM_LOCS = f"""(
    WITH a AS (SELECT ordinal, stream, length(content) AS n, CAST(coalesce(sum(length(content)) OVER (PARTITION BY stream ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
        FROM {_CONTENT} WHERE content <> ''),
    b AS (SELECT ordinal, stream, g, n, unnest(range(g // {BLOCK}, (g + n - 1) // {BLOCK} + 1)) AS block FROM a)
    SELECT ordinal, stream, CAST(block - g // {BLOCK} AS INT) AS piece, CAST(block AS BIGINT) AS block, CAST(greatest(g, block * {BLOCK}) - block * {BLOCK} AS BIGINT) AS start,
           CAST(least(g + n, (block + 1) * {BLOCK}) - greatest(g, block * {BLOCK}) AS BIGINT) AS len FROM b)"""

ORACLE_SQL = {
    "list_ids_ordered": f"SELECT id FROM {_R}",
    "stats": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, (SELECT count(*) FROM documents) AS entries FROM {_R}",
    "fasta_files": f"SELECT id, header, sequence FROM {_LETTERS} WHERE sequence <> ''",
    "fastq_files": f"SELECT id, header, sequence, {_SCORES} AS scores FROM {_LETTERS} WHERE sequence <> ''",
    "dataset_files": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, header, sequence, CAST(strlen(sequence) AS BIGINT) AS n_bytes FROM {_R}",
    "dataset_unmasked_slices": f"SELECT id, translate(substr(sequence, 101, 600), {_LOW}, {_UP}) AS part FROM {_R}",
    "converted_files": f"SELECT id, header, sequence, {_SCORES} AS scores FROM {_LETTERS} WHERE sequence <> ''",
    "stream_files": f"SELECT id, header, sequence, true AS numbered FROM {_LETTERS} WHERE sequence <> ''",
    "stream_locs": f"SELECT * FROM {_STREAM_LOCS}",
    "records_by_locs": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, nullif(header, '') AS header, nullif(sequence, '') AS sequence FROM {_R}",
    "presence": f"""SELECT ordinal, bool_or(stream = 'ids') AS has_ids, bool_or(stream = 'headers') AS has_headers, bool_or(stream = 'sequence') AS has_sequence,
        bool_or(stream = 'masking') AS has_masking, bool_or(stream = 'scores') AS has_scores FROM {_STREAM_LOCS} GROUP BY ordinal""",
    "pointer_ranges": f"""SELECT ordinal, stream, CAST(coalesce(sum(pointers) OVER (PARTITION BY stream ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, pointers
        FROM (SELECT ordinal, stream, count(*) AS pointers FROM {_STREAM_LOCS} GROUP BY 1, 2)""",
    "stream_bytes": f"SELECT stream, count(*) AS records, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM {_CONTENT} WHERE content <> '' GROUP BY stream",
    "loc_slice": f"SELECT ordinal, piece, start + 2 AS start, greatest(len - 3 - 2, 0) AS len FROM {_LOCS}",
    "slice_raw_bytes": f"SELECT id, substr(hex(encode(sequence)), 201, 1200) AS part FROM {_R}",
    "find_first": f"""
        WITH w(pos, id) AS (VALUES {', '.join(f"(CAST({i} AS BIGINT), '{x}')" for i, x in enumerate(WANTED[:3]))}),
        r AS (SELECT conv_id * 1000 + turn AS ordinal, CAST(conv_id AS VARCHAR) AS id, text FROM conversations)
        SELECT w.pos, w.id, f.ordinal, f.text AS sequence FROM w LEFT JOIN (SELECT id, min(ordinal) AS ordinal, arg_min(text, ordinal) AS text FROM r GROUP BY id) f ON w.id = f.id""",
    "scan_linear": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, sequence FROM {_R}",
    "scan_shuffled_rank": "SELECT doc_id AS ordinal, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS rank FROM documents",
    "list_ids": f"SELECT id FROM {_R}",
    "record_count": "SELECT count(*) AS n FROM documents",
    "index_len": "SELECT count(conv_id) AS n FROM conversations",
    "find_one": f"SELECT id, header, sequence FROM {_R} WHERE id = '7'",
    "find_missing": f"SELECT id, header, sequence FROM {_R} WHERE id = '99999999'",
    "find_many_ordered": f"""
        WITH w(pos, id) AS (VALUES {', '.join(f"(CAST({i} AS BIGINT), '{x}')" for i, x in enumerate(WANTED))})
        SELECT w.pos, w.id, '>' || w.id || ' ' || r.header || chr(10) || regexp_replace(regexp_replace({_CLEAN}, '(.{{60}})', '\\1' || chr(10), 'g') || chr(10), '\\n\\n$', chr(10)) AS fasta
        FROM w LEFT JOIN {_R} r ON w.id = r.id""",
    "find_ranges": f"""
        WITH w(pos, request, id, a, b) AS (VALUES (CAST(0 AS BIGINT), '3:11-40', '3', 11, 30), (1, '7:1-5', '7', 1, 5), (2, '9', '9', 1, 1000000000))
        SELECT pos, request, substr(sequence, a, b) AS sequence FROM w LEFT JOIN {_R} r ON w.id = r.id""",
    "missing_ids": f"SELECT w.id FROM (SELECT CAST(doc_id + CASE WHEN toxic = 1 THEN 50000000 ELSE 0 END AS VARCHAR) AS id FROM labels) w WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE r.id = w.id)",
    "member_ids": f"SELECT id, header FROM {_R} WHERE doc_id IN (SELECT doc_id FROM labels)",
    "by_ordinal": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, id, header FROM {_R}) WHERE ordinal = 41",
    "ascii_upper": f"SELECT id, translate(sequence, {_LOW}, {_UP}) AS sequence FROM {_R}",
    "ascii_lower": f"SELECT id, translate(sequence, {_UP}, {_LOW}) AS sequence FROM {_R}",
    "mask_string": f"SELECT id, {_MASK} AS mask FROM {_R}",
    "mask_has": rf"SELECT id, regexp_matches(sequence, '[^\x00-\x60]') AS masked FROM {_R}",
    "mask_count": rf"SELECT id, CAST(length(regexp_replace(sequence, '[\x00-\x60]', '', 'g')) AS BIGINT) AS masked FROM {_R}",
    "mask_runs": r"""
        WITH t AS (SELECT doc_id, string_split(text, '') AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM t),
        g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM u WHERE regexp_matches(ch, '[^\x00-\x60]'))
        SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS len FROM g GROUP BY doc_id, island""",
    "unmask_roundtrip": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM documents",
    "split_id_header": """
        WITH l AS (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents)
        SELECT doc_id, string_split(line, ' ')[1] AS id, CASE WHEN contains(line, ' ') THEN substr(line, instr(line, ' ') + 1) END AS header, string_split(line, ' ')[2] AS word FROM l""",
    "fasta_wrap60": f"SELECT id, {_TITLE} || regexp_replace({_CLEAN}, '(.{{60}})', '\\1' || chr(10), 'g') || chr(10) AS fasta FROM {_R}",
    "fasta_wrap80": f"SELECT id, {_TITLE} || regexp_replace(regexp_replace({_CLEAN}, '(.{{80}})', '\\1' || chr(10), 'g') || chr(10), '\\n\\n$', chr(10)) AS fasta FROM {_R}",
    "pack_locs": f"SELECT * FROM {_LOCS}",
    "location_splits": f"SELECT ordinal, piece, split_start, split_end FROM {_SPLITS}",
    "block_stats": f"SELECT block, count(*) AS records, CAST(sum(len) AS BIGINT) AS used FROM {_LOCS} GROUP BY block",
    "seqloc_rows": f"SELECT ordinal, count(*) AS pieces, min(block) AS first_block, max(block) AS last_block, CAST(sum(len) AS BIGINT) AS total FROM {_LOCS} GROUP BY ordinal",
    "slice_locs": f"""
        SELECT ordinal, piece, block, CAST(start + greatest(split_start, 100) - split_start AS BIGINT) AS start, CAST(least(split_end, 700) - greatest(split_start, 100) AS BIGINT) AS len
        FROM {_SPLITS} WHERE split_start < 700 AND split_end > 100""",
    "slice_bytes": f"SELECT id, substr(sequence, 101, 600) AS part FROM {_R}",
    "reassemble": "SELECT doc_id AS ordinal, text AS sequence FROM documents WHERE text <> ''",
    "seqloc_len_clean": f"SELECT id, CAST(strlen(sequence) AS BIGINT) AS len FROM {_R}",
    "seqloc_len_all": rf"SELECT id, CAST(strlen(id) + strlen(header) + strlen(sequence) + CASE WHEN regexp_matches(sequence, '[^\x00-\x60]') THEN length(sequence) ELSE 0 END AS BIGINT) AS len FROM {_R}",
    "delta_encode": "SELECT user_id, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events",
    "delta_decode": "SELECT user_id, event_id, event_id AS value FROM events",
    "level_clamp": f"SELECT codec, level, greatest(lo, least(hi, level)) AS clamped FROM (SELECT codec, min_level AS lo, max_level AS hi FROM {_CODECS}), (VALUES (-3), (0), (5), (12), (23)) v(level)",
    "codec_table": f"SELECT * FROM {_CODECS}",
    "presets": """SELECT * FROM (VALUES ('fastest', 8, 'ZSTD', 1, 'ZSTD', -3), ('fast', 16, 'ZSTD', 1, 'ZSTD', 1), ('default', 512, 'ZSTD', 9, 'ZSTD', 1),
        ('small', 2048, 'ZSTD', 22, 'ZSTD', 22), ('smallest', 8192, 'XZ', 9, 'XZ', 9)) t(preset, block_kib, data_codec, data_level, index_codec, index_level)""",
    "sniff_format": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'FASTA' WHEN 1 THEN 'FASTQ' WHEN 2 THEN 'CONTAINER' END AS format FROM benchmark",
    "sniff_compression": "SELECT item_id, ['GZIP', 'BZIP2', 'XZ', 'ZSTD', 'BROTLI', 'LZ4', 'SNAPPY', 'PLAIN'][item_id % 8 + 1] AS codec FROM benchmark",
    "output_path": "SELECT item_id, ['a.fasta.strand', '/x.y/a.strand', '/x.y/plain.strand'][item_id % 3 + 1] AS path FROM benchmark",
    "directory_check": "SELECT doc_id, list_max([doc_id % 3, doc_id % 5, doc_id % 7, doc_id % 11]) <= 8 AS sane, nullif(doc_id % 3, 0) AS \"offset\" FROM documents",
    "summarize": "SELECT count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bases, min(strlen(text)) AS shortest, max(strlen(text)) AS longest, avg(strlen(text)) AS mean_length FROM documents",
    "bp": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bases FROM documents",
    "split_train_test": f"SELECT CASE WHEN {_HALF} < 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(strlen(sequence)) AS BIGINT) AS bases FROM {_R} GROUP BY 1",
}
