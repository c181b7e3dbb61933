"""Registered queries next to their SQL, and the pipeline next to brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from catalog.base import NAMES
from rookery.llm import queries, toxicity
from rookery.session import shared_dir
from tools.check import compare, rows_of, rows_of_duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert compare(rows_of(queries.QUERIES[name](spark, FOLDER)), rows_of_duck(duck, queries.SQL[name])) is None


COLUMNS = {
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_html_text": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    table = "pages" if name == "op10_html_text" else "documents"
    key = got.columns[0]
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    rows = [r[0] for r in got.select(key).collect()]
    assert set(rows) == want and (len(rows) == len(want) or name == "op7_packing")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    seen = spark.createDataFrame([r for r in docs.collect()] + [(-1, None, None, None, None), (-2, " ", "en", "src", 1)], docs.schema)
    kept = steps["language_id"](spark, seen, FOLDER)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}

    near = brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], 5)
    got = steps["near_duplicates"](spark, docs, FOLDER)
    assert {r.doc_id for r in got.collect()} == {d for d, (_, c) in near.items() if c == d}

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    clean = set()
    for r in docs.collect():
        n, hit, _ = brute.contamination(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    assert {r.doc_id for r in steps["decontamination"](spark, docs, FOLDER).collect()} == clean

    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in steps["toxicity"](spark, docs, FOLDER).collect()} == want


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, FOLDER)
        assert docs.count() == 0


def test_pipeline_rows(spark):
    got = entry.queries()["pipeline"](spark, FOLDER)
    path = shared_dir(spark, "pieces")
    got.write.parquet(path)
    per_doc = spark.read.parquet(path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert per_doc.where("n <> all").count() == 0 and per_doc.count() > 50
