"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from mediasift.llm.queries import ORACLES, QUERIES
from mediasift.llm.toxicity import toxicity

from ..conftest import SMALL
from .brute import near_duplicate_classes

COLUMNS = {
    "op1": {"vec_id", "n_links", "component_id", "kept"},
    "op2": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3": {"doc_id", "held_out", "score", "predicted"},
    "op4": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5": {"doc_id", "held_out", "lang_pred", "score"},
    "op6": {"doc_id", "n_shingles", "component_id"},
    "op7": {"doc_id", "size", "source_size", "target", "taken", "shards"},
    "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op11": {"page_id", "host", "path", "rule", "verdict"},
    "op12": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}


def test_all_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == set(COLUMNS)
    assert QUERIES.keys() | {"pipeline"} <= entry_points.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    ordered = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert ordered(map(tuple, df.select(*names).collect())) == ordered(cursor.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SMALL}/labels.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        results[name, "in"] = docs
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        results[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rejected = {r["doc_id"] for r in toxicity(results["toxicity", "in"], labels).filter("predicted = 1").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(results["toxicity"]) == ids(results["toxicity", "in"]) - rejected
    _, classes = near_duplicate_classes(results["toxicity"].select("doc_id", "text").collect())
    assert ids(results["n-gram jaccard join"]) == set(classes.values())
    assert results["personal data"].count() == results["n-gram jaccard join"].count()
    assert results["personal data"].filter("text rlike '[a-z]@[a-z]+[.]'").count() == 0
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(results["mixing"]) - size(results["personal data"])) <= 20
    assert sum(r["length"] for r in results["packing"].collect()) > 0
    assert corpus_pipeline.ORACLE_SQL is None
