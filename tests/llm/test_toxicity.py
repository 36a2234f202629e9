import numpy as np

from mediasift.llm import toxicity as t

from ..conftest import SMALL

SF = SMALL.replace("0.001", "0.01")


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = t.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.02
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_learns_only_outside_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "quality", "IF(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0, 1 - toxic, toxic) AS toxic")
    one, two = t.train(docs, labels), t.train(docs, other)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def fitted(toxic, fine, base_rate):
    """Training in one place, without Spark."""
    rows = [t.features(x) for x in toxic + fine]
    pos, neg = (sum(np.bincount(r, minlength=1 << t.BITS) for r in part) for part in (rows[: len(toxic)], rows[len(toxic) :]))
    ratio = t.log_ratios(pos, neg, (pos.sum(), neg.sum()))
    used = np.flatnonzero((pos + neg >= t.LEAST_TEXTS) & (np.abs(ratio) >= t.LEAST_RATIO))
    columns = [np.searchsorted(used, r[np.isin(r, used)]) for r in rows]
    return t.fit(np.arange(len(rows)) < len(toxic), columns, used, ratio[used], base_rate)


def test_whole_text_counts():
    toxic, fine = ["you idiot " + "calm words here " * 3] * 8, ["calm words here " * 3] * 40
    model = fitted(toxic, fine, 8 / 48)
    long = "calm words here " * 100_000
    assert (model.score([long + "idiot", long, None, ""]) >= 0.5).tolist() == [True, False, False, False]
    parts = t.features("ab " * 10 + "x" * 7)
    old, t.CHARS = t.CHARS, 5
    try:
        assert (t.features("ab " * 10 + "x" * 7) == parts).all()
    finally:
        t.CHARS = old


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, toxic int"
    docs = spark.createDataFrame([(1, None, "", 1), (None, "a", "", 1), (2, "", "", 0), (2, "", "", 0)], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    assert len(t.toxicity(docs, labels).collect()) == 4
    assert [r["predicted"] for r in t.toxicity(docs, labels.limit(0)).collect()] == [0] * 4
    assert t.toxicity(docs.limit(0), labels).collect() == []
    assert t.nontoxic(docs, labels.limit(0)).columns == docs.columns


def test_stage_without_both_labels_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, None), (None, "fine"), (2, None), (3, "long " * 50_000)], "doc_id long, text string")
    for toxic in (1, 0):
        labels = spark.createDataFrame([(1, toxic), (2, toxic), (3, toxic)], "doc_id long, toxic int")
        assert sorted(map(str, t.nontoxic(docs, labels).collect())) == sorted(map(str, docs.collect()))
    assert t.nontoxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 5
