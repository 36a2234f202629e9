"""The queries of this package over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir
from .archives import page_records
from .conversations import damaged, repair_report
from .grid_join import vector_links
from .language import language
from .mixing import mix_report
from .oracles import PAGES_SQL, SHINGLES_SQL, VECTORS_SQL, urls_sql
from .packing import pack
from .periodic import periodic_runs, run_digests, with_planted_runs
from .personal import personal_spans, train
from .quality import quality
from .shingles import near_duplicates
from .token_files import token_digests, write_tokens
from .toxicity import toxicity
from .url_cascade import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


@query
def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op3_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_spans(docs, train(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query
def op5_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@query
def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_digests(spark, folder)


@query
def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(spark, table(spark, sf_dir, "pages"))


#: Address rules, and a block list of hosts for addresses without a rule. Fixed values.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


@query
def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    listed = spark.createDataFrame([(f"{name}.{domain}",) for name in LISTED_NAMES for domain in LISTED_DOMAINS], "key string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules, listed)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


@query
def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


ORACLES |= {
    "op1_epsilon_grid": VECTORS_SQL,
    "op6_ngram_jaccard": SHINGLES_SQL,
    "op10_arc_to_warc": PAGES_SQL,
    "op11_bloom_cascade": urls_sql(URL_RULES, [f"{name}.{domain}" for name in LISTED_NAMES for domain in LISTED_DOMAINS]),
}
