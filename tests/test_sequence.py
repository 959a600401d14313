"""Golden cases of the scalar functions and addresses, and agreement with SQL."""

import gzip
import os
import re
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import codecs
from strandline.functions import sequence as sq
from strandline.operators import addressing, lookup, scan
from strandline.plans import catalogue
from strandline.sources import dataset, fasta, fastq

DATA = "/root/testdata/sf0.001"


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(("line", "word", "full"), [("Chr1 This is the chromosome", "This", "This is the chromosome"), ("Chr1", None, None), ("Chr1  two", "", " two")])
def test_id_and_header(spark, line, word, full):
    assert one(spark, sq.split_id(F.col("l")), l=line) == "Chr1"
    assert one(spark, sq.split_header(F.col("l"), True), l=line) == word
    assert one(spark, sq.split_header(F.col("l")), l=line) == full


def test_masks(spark):
    text = "aC1{é0gT"
    assert one(spark, sq.mask_string(F.col("s")), s=text) == "10011010"
    assert one(spark, sq.mask_or_null(F.col("s")), s="ACGT") is None
    assert [tuple(r) for r in one(spark, sq.mask_runs("s"), s=text)] == [(0, 1), (3, 2), (6, 1)]
    for own in ("aCgTTTaa", "ACGT", "", "acgt"):
        c = F.col("s")
        assert one(spark, sq.apply_mask(sq.ascii_upper(c), sq.mask_or_null(c)), s=own) == own


@pytest.mark.parametrize(("size", "lines", "blank"), [(0, "\n", "\n"), (3, "AAA\n", "AAA\n"), (4, "AAAA\n", "AAAA\n\n"), (5, "AAAA\nA\n", "AAAA\nA\n")])
def test_wrap(spark, size, lines, blank):
    assert one(spark, sq.wrapped(F.col("s"), 4), s="A" * size) == lines
    assert one(spark, sq.wrapped(F.col("s"), 4, True), s="A" * size) == blank


@pytest.mark.parametrize(("a", "b", "out"), [(0, 3, "ACG"), (2, 99, "GT"), (3, 3, ""), (5, 9, ""), (-2, 2, "AC")])
def test_subsequence(spark, a, b, out):
    assert one(spark, sq.subsequence(F.col("s"), a, b), s="ACGT") == out


def test_block_packing(spark):
    locs = addressing.pack_locs(spark.createDataFrame([(0, 16)], "ordinal long, n long"), 10)
    assert [tuple(r) for r in locs.select("block", "start", "len").orderBy("block").collect()] == [(0, 0, 10), (1, 0, 6)]


@pytest.mark.parametrize(
    ("locs", "a", "b", "out"),
    [([(i, 0, 10) for i in range(5)], 15, 35, [(1, 5, 5), (2, 0, 10), (3, 0, 5)]), ([(i, 0, 10) for i in range(5)], 10, 20, [(1, 0, 10)]), ([(3097440, 261735, 409), (3097441, 0, 1274)], 0, 20, [(3097440, 261735, 20)]), ([(1652696, 260695, 1449), (1652697, 0, 28424)], 2679, 2952, [(1652697, 1230, 273)]), ([(1652696, 260695, 1449), (1652697, 0, 28424)], 1400, 1500, [(1652696, 262095, 49), (1652697, 0, 51)])],
)
def test_slices(spark, locs, a, b, out):
    table = spark.createDataFrame([(0, i, *x) for i, x in enumerate(locs)], "ordinal long, piece int, block long, start long, len long")
    ranges = spark.createDataFrame([(0, a, b)], "ordinal long, range_start long, range_end long")
    assert [tuple(r) for r in addressing.slice_locs(table, ranges).orderBy("piece").select("block", "start", "len").collect()] == out


def test_running_total_has_no_gaps(spark):
    df = spark.range(1000).withColumn("n", F.pmod(F.col("id") * 7, F.lit(5)))
    rows = addressing.running_total(df, "id", F.col("n"), "before", [100.0, 100.5, 640.0]).orderBy("id").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.n


def test_codecs():
    assert codecs.resolve("default", "zstd", 23)["level"] == 22
    assert codecs.resolve("default", "brotli", 12)["level"] == 11
    assert codecs.resolve("fast", level=9) == {"codec": "ZSTD", "level": 1, "block_kib": 16}
    assert codecs.writer_options(codecs.resolve("smallest"))["compression"] == "zstd"


def test_flags_in_order():
    assert codecs.resolve_flags({"smallest", "fast"})["codec"] == "XZ"
    assert codecs.resolve_flags({"small", "zstd", "lz4"})["codec"] == "LZ4"
    assert codecs.resolve_flags(set(), level=3)["level"] == 9


def test_convert(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nacGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    (tmp_path / "a.fa").write_text(">s1\nAC\ngt\n>s2 h\nTT\n")
    dataset.convert(spark, str(tmp_path / "a.fastq"), str(tmp_path / "q"))
    dataset.convert(spark, str(tmp_path / "a.fa"), str(tmp_path / "f"), preset="fast", codec="gzip", level=4)
    own = [tuple(r) for r in scan.linear(dataset.read_dataset(spark, str(tmp_path / "q")), "ordinal", "id", "sequence", "scores").collect()]
    assert own == [(0, "r1", "ACGT", "IIII"), (1, "r2", "GG", "@@")]
    assert [(r.id, r.x) for r in dataset.read_dataset(spark, str(tmp_path / "f")).orderBy("ordinal").select("id", dataset.unmasked_text().alias("x")).collect()] == [("s1", "ACgt"), ("s2", "TT")]


def test_lookups(spark):
    own = spark.createDataFrame([(0, "a", "h", "ACGT"), (1, "b", None, "GG"), (2, "a", "h2", "TT")], "ordinal long, id string, header string, sequence string")
    hits = lookup.find_many(own, lookup.requests(own, ["b", "x", "b"]), 3).orderBy("pos").collect()
    assert [(r.pos, r.sequence) for r in hits] == [(0, "GG"), (1, None), (2, "GG")]
    assert lookup.find(own, "a").count() == 2 and lookup.find(own, "A").count() == 0 and lookup.find(own, "A", "lower").count() == 2
    assert [r.sequence for r in lookup.find_ranges(own, ["b", "a:2-3"]).orderBy("pos", "ordinal").collect()] == ["GG", "CG", "T"]
    parts = scan.split(own, 0.5, 1).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 3


def test_fasta_round_trip(spark, tmp_path):
    records = spark.createDataFrame([(i, f"s{i}", "some words" if i % 2 else None, "ACgt" * (i * 17), None) for i in range(40)], "ordinal long, id string, header string, sequence string, scores string")
    dataset.write_fasta(records, str(tmp_path / "out"), 60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    back = {r.id: r for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: (r.header, r.sequence) for k, r in back.items()} == {r.id: (r.header, r.sequence) for r in records.collect()}
    (tmp_path / "crlf.fa").write_bytes(b">a x y\r\nAC\r\nGT\r\n>b\r\nTT")
    with gzip.open(tmp_path / "z.fa.gz", "wb") as f:
        f.write(b">a x y\nAC\nGT\n>b\nTT\n")
    for name in ("crlf.fa", "z.fa.gz"):
        own = fasta.numbered(fasta.read_fasta(spark, str(tmp_path / name))).orderBy("ordinal").collect()
        assert [(r.ordinal, r.id, r.header, r.sequence) for r in own] == [(0, "a", "x y", "ACGT"), (1, "b", None, "TT")]


@pytest.mark.parametrize("size", [1 << 20, 40, 97])
def test_fastq_in_ranges(spark, tmp_path, size):
    rows = [(f"r{i}", "x=1", "ACGTN"[: 1 + i % 5] * 3, "@+I@!"[: 1 + i % 5] * 3) for i in range(30)]
    (tmp_path / "a.fastq").write_text("".join(f"@{a} {b}\n{c}\n+\n{d}\n" for a, b, c, d in rows))
    got = fastq.read_fastq(spark, str(tmp_path / "a.fastq"), size).orderBy("at").collect()
    assert [(r.id, r.header, r.sequence, r.scores, r._corrupt) for r in got] == [(*r, None) for r in rows]


def test_dataset(spark, tmp_path):
    records = spark.createDataFrame([(0, "a", None, "acGTtt", "IIIIII"), (1, "b", "h", "ACGT", None), (2, "c", "h", "", None)], "ordinal long, id string, header string, sequence string, scores string")
    path = str(tmp_path / "set")
    dataset.write_dataset(records, path, "small", metadata={"title": "t"})
    own = dataset.read_dataset(spark, path)
    assert [tuple(r) for r in own.orderBy("ordinal").select("id", dataset.unmasked_text(), "scores").collect()] == [("a", "acGTtt", "IIIIII"), ("b", "ACGT", None), ("c", "", None)]
    assert dataset.read_metadata(spark, path).first().title == "t"
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,a)]" in lookup.find(own, "a")._jdf.queryExecution().toString()


def test_streaming_ingest(spark, tmp_path):
    from strandline.streaming import ingest

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(2):
        (source / f"{n}.fa").write_text("".join(f">r{n}_{i}\nAC\nGT\n" for i in range(5)))
        ingest.append_records(spark, str(source), target, str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert sorted(r.ordinal for r in rows) == list(range(10)) and {r.sequence for r in rows} == {"ACGT"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    own = catalogue.QUERIES[name](spark, DATA)
    assert sorted(own.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in own.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_hash32_golden_values(spark):
    """XXH3-64 of the empty text is published; the hash is its low half, whatever the batch."""
    assert one(spark, sq.hash32("s"), s="") == 0x38D394C2
    import xxhash

    rows = spark.createDataFrame([("chr1",), ("é",), (None,)], "s string").select("s", sq.hash32("s").alias("h")).collect()
    assert [(r.s, r.h) for r in rows] == [("chr1", xxhash.xxh3_64(b"chr1").intdigest() % 2**32), ("é", xxhash.xxh3_64("é".encode()).intdigest() % 2**32), (None, None)]


def test_runs_of_a_batch():
    texts = ["aC1{é0gT", "", None, "ACGT", "acgt", "acgt", "日本A語"]
    row, start, size = sq.flat_runs(pa.array(texts))
    want = [(i, m.start(), len(m[0])) for i, t in enumerate(texts) for m in re.finditer("[^\x00-\x60]+", t or "")]
    assert list(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)) == want
    row, start, size = sq.flat_runs(pa.array(texts).slice(4))
    assert list(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)) == [(i - 4, a, n) for i, a, n in want if i >= 4]


@pytest.mark.parametrize("rows", [1, 7, 400, 5000])
def test_ordinals_over_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(addressing, "RANGE_ROWS", 300)
    df = spark.range(rows).select((F.col("id") * 37 % 10007).alias("k"), F.repeat(F.lit("x"), 5).alias("s")).repartition(7)
    keys = sorted(i * 37 % 10007 for i in range(rows))
    numbered = addressing.with_ordinal(df, "k").collect()
    assert [(r.ordinal, r.k) for r in numbered] == list(enumerate(keys))  # in order, too
    for at in (0, rows // 2, rows - 1):
        assert [(r.ordinal, r.k) for r in addressing.row_at(df, "k", at).collect()] == [(at, keys[at])]
    assert addressing.row_at(df, "k", rows).count() == addressing.row_at(df, "k", -1).count() == 0
    total = addressing.running_total(df.select("k"), "k", F.col("k"), "before").collect()
    assert {r.k: r.before for r in total} == {k: sum(keys[:i]) for i, k in enumerate(keys)}


def test_one_shuffle_of_text(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    own = plan(catalogue.QUERIES["scan_linear"](spark, DATA))
    physical = own[own.index("== Physical Plan =="):]
    assert physical.count("Exchange") == 1 and "Window" not in physical
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert "hashpartitioning" not in plan(addressing.row_at(docs, "doc_id", 5)) and "Window" not in plan(addressing.row_at(docs, "doc_id", 5)).split("== Physical Plan ==")[1]


def test_batch_lookups_prune(spark, tmp_path):
    records = spark.range(20_000).select(F.col("id").alias("ordinal"), F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit(None).cast("string").alias("header"), F.lit("ACGT").alias("sequence"), F.lit(None).cast("string").alias("scores"))
    dataset.write_dataset(records.repartition(4), str(tmp_path / "d"))
    own = dataset.read_dataset(spark, str(tmp_path / "d"))
    names = [f"r{i:06}" for i in range(0, 1000)]
    hits = lookup.find_many(own, lookup.requests(own, names))
    assert "GreaterThanOrEqual(id,r000000)" in hits._jdf.queryExecution().toString()
    assert hits.count() == 1000 and hits.where("sequence is null").count() == 0
    assert [r.id for r in dataset.record_at(spark, str(tmp_path / "d"), 77).collect()] == ["r000077"] and dataset.record_at(spark, str(tmp_path / "d"), 20_000).count() == 0
    with pytest.raises(KeyError, match="nope"):
        lookup.find_many(own, lookup.requests(own, ["r000001", "nope"]), on_missing="error")
    twice = own.unionByName(own.withColumn("ordinal", F.col("ordinal") + 50_000))
    assert [r.ordinal for r in lookup.find_many(twice, lookup.requests(own, ["r000003"]), first=True).collect()] == [3]


def test_golden_records(spark, tmp_path):
    """Ten records, ids that repeat, one line each and no final line feed: count, lookup, slices and order."""
    import random

    rnd = random.Random(1)
    sizes = [("test", 13544), ("test2", 171593), ("test3", 48598), ("test4", 10761), ("test5", 7784), ("test", 13544), ("test2", 171593), ("test3000", 48598), ("test4", 10761), ("test5", 7784)]
    rows = [(n, "".join(rnd.choice("ACGT") for _ in range(k))) for n, k in sizes]
    rows[2] = ("test3", rows[2][1][:-10] + "ATGTACAGCG")
    (tmp_path / "a.fasta").write_text("\n".join(f">{n}\n{x}" for n, x in rows))
    dataset.convert(spark, str(tmp_path / "a.fasta"), str(tmp_path / "d"))
    own = dataset.read_dataset(spark, str(tmp_path / "d"))
    assert own.count() == 10 and [(r.id, r.sequence) for r in own.orderBy("ordinal").collect()] == rows
    hit = lookup.find(own, "test3").collect()
    assert len(hit) == 1 and len(hit[0].sequence) == 48598 and hit[0].sequence.endswith("ATGTACAGCG") and hit[0].mask is None
    parts = lookup.find_ranges(own, ["test3:1-100", "test3:48001-48100"]).orderBy("pos").collect()
    assert [p.sequence for p in parts] == [rows[2][1][:100], rows[2][1][48000:48100]]
    with pytest.raises(ValueError):
        spark.createDataFrame([(2,)], "version int").selectExpr(*[f"cast(null as {p.split()[1]}) {p.split()[0]}" if p.split()[0] != "version" else "version" for p in dataset.METADATA.split(", ")]).write.mode("overwrite").parquet(str(tmp_path / "d/metadata"))
        dataset.read_dataset(spark, str(tmp_path / "d"))


def test_xz_yaml_and_flags(spark, tmp_path):
    import lzma

    with lzma.open(tmp_path / "a.fa.xz", "wb") as f:
        f.write(b">a x y\nAC\nGt\n>b\nTT\n>c \n")
    (tmp_path / "m.yaml").write_text("title: Ten\nnotes: none\n")
    dataset.convert(spark, str(tmp_path / "a.fa.xz"), str(tmp_path / "d"), flags={"fast", "gzip"}, level=2, block_kib=4096, metadata_yaml=str(tmp_path / "m.yaml"))
    own = dataset.read_dataset(spark, str(tmp_path / "d")).orderBy("ordinal")
    assert [tuple(r) for r in own.select("ordinal", "id", "header", dataset.unmasked_text()).collect()] == [(0, "a", "x y", "ACGt"), (1, "b", None, "TT"), (2, "c", "", "")]
    about = dataset.read_metadata(spark, str(tmp_path / "d")).first()
    assert (about.title, about.block_size) == ("Ten", 4096 << 10)
    assert {f.name.split(".")[-2] for f in (tmp_path / "d/records").iterdir() if f.name.endswith(".parquet")} == {"gz"}
    (tmp_path / "bad.yaml").write_text("colour: red\n")
    with pytest.raises(ValueError, match="colour"):
        dataset.metadata_from_yaml(str(tmp_path / "bad.yaml"))


def test_pointers_to_streams(spark):
    records = spark.createDataFrame([(0, "a", "h one", "acGT" * 9, None), (1, "bb", None, "", "II"), (2, "c", "x", "ACGT", "IIII")], "ordinal long, id string, header string, sequence string, scores string")
    locs = addressing.stream_locs(records, 10)
    back = addressing.records_by_locs(locs, addressing.stream_blocks(locs, records)).orderBy("ordinal").collect()
    assert [tuple(r) for r in back] == [(0, "a", "h one", "acGT" * 9, None), (1, "bb", None, None, "II"), (2, "c", "x", "ACGT", "IIII")]
    has = {r.ordinal: (r.has_headers, r.has_sequence, r.has_masking, r.has_scores) for r in addressing.presence(locs).collect()}
    assert has == {0: (True, True, True, False), 1: (False, False, False, True), 2: (True, True, False, True)}
    assert {(r.ordinal, r.first, r.pointers) for r in addressing.pointer_ranges(locs).collect() if r.stream == "sequence"} == {(0, 0, 4), (2, 4, 1)}


def test_ids_are_written_in_order(spark, tmp_path):
    records = spark.range(500).select((499 - F.col("id")).alias("ordinal"), F.col("id").cast("string").alias("id")).repartition(5)
    dataset.write_ids(records, str(tmp_path / "ids"))
    lines = [x for f in sorted((tmp_path / "ids").glob("part-*")) for x in f.read_text().split()]
    assert lines == [str(499 - i) for i in range(500)]


def test_masks_of_long_records(spark, tmp_path):
    """restoring a mask takes one pass over a record, however many runs it has."""
    text = "ab C" * 300_000
    records = spark.createDataFrame([(0, "a", None, text, None), (1, "b", None, None, None), (2, "c", None, "é{aÉA", None)], "ordinal long, id string, header string, sequence string, scores string")
    dataset.write_dataset(records, str(tmp_path / "d"), "fast")
    began = time.perf_counter()
    rows = dataset.read_dataset(spark, str(tmp_path / "d")).orderBy("ordinal").select(dataset.unmasked_text()).collect()
    assert [r[0] for r in rows] == [text, None, "é{aÉA"] and time.perf_counter() - began < 30


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_passes_over_odd_rows(size, monkeypatch):
    """numpy passes agree with plain Python, wherever a pass ends."""
    import random

    monkeypatch.setattr(sq, "PASS_BYTES", size)
    rnd = random.Random(size)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for _ in range(100):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("aAbZz{ é日\n😀" if rnd.random() < 0.5 else "aAbZ ") for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(6))]
        column, upper = pa.array([None, *texts], pa.string()).slice(1), [t and re.sub("[a-z]", lambda m: m[0].upper(), t) for t in texts]
        runs = sq.mask_runs.func(column)
        assert [r and [(x["start"], x["len"]) for x in r] for r in runs.to_pylist()] == [[(m.start(), len(m[0])) for m in re.finditer("[^\x00-\x60]+", t or "")] or None for t in texts]
        assert sq._run_text.func(pa.array(upper, pa.string()), runs).to_pylist() == texts
        masks = [t and "".join("01"[c > "\x60"] for c in t)[rnd.randrange(2) :] + "1é0"[: rnd.randrange(4)] for t in texts]
        want = [u and "".join(low(c) if m[i : i + 1] == "1" else c for i, c in enumerate(u)) for u, m in zip(upper, masks, strict=True)]
        assert sq._masked_text.func(pa.array(upper, pa.string()), pa.array(masks, pa.string())).to_pylist() == want
        sizes = [[rnd.randrange(4) for _ in range(rnd.randrange(5))] for _ in texts]
        parts = [[(t or "")[sum(z[:i]) : sum(z[: i + 1])] for i in range(len(z))] for t, z in zip(texts, sizes, strict=True)]
        assert sq.cut.func(column, pa.array(sizes, pa.list_(pa.int64()))).to_pylist() == parts


def test_memory_of_a_batch_of_masks():
    """temporaries of a batch are those of a pass, not of the whole batch."""
    import tracemalloc

    texts = pa.array(["ab " * 1000] * 4000)
    tracemalloc.start()
    sq.mask_runs.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def jobs_of(spark, run) -> int:
    group = f"counted-{time.perf_counter_ns()}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return jobs


@pytest.mark.parametrize("name", ["stream_locs", "presence", "pointer_ranges", "records_by_locs"])
def test_streams_are_addressed_in_one_pass(spark, name):
    """F2 to F5: planning runs a few jobs for all streams at once, not some for each stream, and moves no text for them."""
    own = []
    assert jobs_of(spark, lambda: own.append(catalogue.QUERIES[name](spark, DATA))) <= 16
    physical = own[0]._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") <= (3 if name == "records_by_locs" else 1)


def test_letters_take_no_shuffle(spark):
    """records for FASTA and FASTQ files are not numbered, since files hold no ordinals."""
    assert "Exchange" not in catalogue._letters(spark, DATA)._jdf.queryExecution().executedPlan().toString()
