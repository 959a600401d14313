"""The pipeline's stages in order, and the registered names."""

import os
from collections import Counter

import duckdb

import __spark_entry__
import corpus_pipeline
from strandline.llm import common, packing, queries

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and {"pipeline", *queries.QUERIES} <= set(__spark_entry__.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table(stage(spark, docs, SMALL), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.count())
        if name == "near_duplicates":
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "substring":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert seen[0] >= seen[1] >= seen[2] == seen[3] <= seen[4]
    rows = corpus_pipeline.packing_stage(spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_odd_rows(spark, edge, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows and a null id go through all stages; without labels nothing is toxic."""
    folder = f"file://{tmp_path}"
    edge.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table(stage(spark, docs, folder), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        ids[name] = Counter(r.doc_id for r in docs.collect())
    assert ids["toxicity"] == Counter([0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None])
    assert ids["near_duplicates"] == ids["substring"] == ids["mixing"] == Counter([0, 1, 2, 3, 4, 4, 6, 7, 9, None])
    token = packing.FastIds(packing.vocabulary())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(token._encode(r.text or "")) // 4 + 1
    got = Counter()
    for r in corpus_pipeline.packing_stage(spark, docs, folder).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    folder = f"file://{tmp_path}"
    empty.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        own = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
        assert sorted(map(repr, map(tuple, own))) == sorted(map(repr, want.fetchall()))
