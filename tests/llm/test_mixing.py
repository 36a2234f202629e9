import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from mediasift.llm import mixing as m

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, source string, n_chars int, size string, place int"


def taken(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "", 0) for r in rows], SCHEMA)
    return docs, m.mix_report(docs, **sizes).collect()


def test_against_sql_with_many_shards(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = m.mix_report(rows, block_words=500, shard_blocks=8)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = duck.execute(m.MIX_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_documents_stand_in_the_shards_that_the_tree_gives_their_blocks(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = {"block_words": 500, "shard_blocks": 8}
    sums = m._prepared(rows, rows.count(), ["doc_id"]).groupBy("_queue", "_bucket").agg(F.sum("_size").alias("n"))
    sources = m.quotas(sums, 500).cache()
    counts = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"]).alias("counts"))
    n_blocks = sources.agg(F.sum("quota")).first()[0]
    tree = {r["lo"]: r["counts"] for r in m.splitting_tree(counts, -(-n_blocks // 8)).collect()}
    drawn: Counter = Counter()
    for r in m.copies(rows, **sizes).filter("_shard IS NOT NULL").select("_shard", "_place", "_pass", "_block").distinct().collect():
        drawn[r["_shard"], r["_place"]] += 1
    # Every block in which a document begins is one of those that its shard has drawn of the source.
    assert drawn and all(n <= tree[shard][place - 1] for (shard, place), n in drawn.items())
    got = m.mix_report(rows, **sizes).collect()
    assert len({s for r in got for s in r["shards"]}) > 3
    for r in got:
        assert len(r["shards"]) == (0 if not r["taken"] else -(-r["taken"] // r["size"]))


def test_columns_of_the_documents_meet_no_names(spark):
    docs = spark.createDataFrame(
        [(i, "a b c", "s", 77, 78, 79, "x") for i in range(20)],
        "doc_id long, text string, source string, _size int, _queue int, _bucket int, row string",
    )
    mix = m.mixed(docs)
    assert mix.columns == docs.columns and mix.count() >= 20
    assert {tuple(r)[3:] for r in mix.collect()} == {(77, 78, 79, "x")}


def test_null_ids_spread(spark):
    docs = spark.range(9000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', id) AS text", "'s' AS source")
    sizes = m._prepared(docs, 9000, ["doc_id"]).groupBy("_bucket").count().collect()
    assert len(sizes) == 3 and max(r["count"] for r in sizes) < 3500


def test_shards_draw_disjoint_blocks_of_every_quota(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sums = m._prepared(docs, 200, ["doc_id"]).groupBy("_queue", "_bucket").agg(F.sum("_size").alias("n"))
    sources = m.quotas(sums, 300).cache()
    quotas = {r["place"]: (r["quota"], r["blocks"]) for r in sources.collect()}
    counts = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"]).alias("counts"))
    total = sum(q for q, _ in quotas.values())
    tree = m.splitting_tree(counts, 7).collect()
    assert [sum(r["counts"][p - 1] for r in tree) for p in sorted(quotas)] == [quotas[p][0] for p in sorted(quotas)]
    assert {r["lo"] for r in tree} == set(range(7)) and max(abs(sum(r["counts"]) - total / 7) for r in tree) < 3
    blocks = m.drawn_blocks(sources, m.splitting_tree(counts, 7)).collect()
    assert len({(b["place"], b["pass"], b["block"]) for b in blocks}) == len(blocks) == total
    assert all(b["pass"] * quotas[b["place"]][1] + b["block"] < quotas[b["place"]][0] for b in blocks)


def test_hypergeometric_draws(spark):
    n, k, draws = 30, 12, 10
    u = (F.col("id") + 0.5) / 2000
    one = m.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(draws).cast("long"), u)
    got = Counter(r[0] for r in spark.range(2000).select(one).collect())
    for x in range(draws + 1):
        p = math.comb(k, x) * math.comb(n - k, draws - x) / math.comb(n, draws)
        assert abs(got[x] / 2000 - p) < 0.001
    edge = [m.hypergeometric(*(F.lit(v).cast("long") for v in a), F.lit(0.3)) for a in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5))]
    assert list(spark.range(1).select(*edge).first()) == [0, 3, 0, 2]


def test_targets_and_texts(spark):
    rows = [(i, "a b c d e " * 20, "s1") for i in range(30)] + [(100, "x y z", "s0"), (101, "x  y\nz w", None), (102, None, None)]
    rows += [(103, "", "s2"), (None, "no id", "s1"), (5, "a b c d e " * 20, "s1"), (200, "long " * 50_000, "s3")]
    docs, got = taken(spark, rows, block_words=64, shard_blocks=4)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_source: Counter = Counter()
    for r in got:
        by_source[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 1 for (_, target), n in by_source.items())
    assert abs(sum(r["taken"] for r in got) - sum(r["size"] for r in got)) <= 4
    mix = m.mixed(docs)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    assert sorted(map(str, m.mix_report(docs, 64, 4).collect())) == sorted(map(str, got))


def test_empty_table(spark):
    docs, got = taken(spark, [])
    assert got == [] and m.mixed(docs).collect() == []
    assert [r["taken"] for r in taken(spark, [(1, None, "a"), (2, " ", None)])[1]] == [0, 0]
