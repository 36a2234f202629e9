import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mediasift.llm import quality as q, words

from ..conftest import SMALL
from .brute import quality_counts

PIECE = st.sampled_from(["a", "b", "ab", "é", "中", " ", "  ", "\n", "\t", "\r", "\x0b", "#", "*|", "$", "<>", "word", "\x00", "\xa0"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECE, max_size=40).map("".join)), max_size=6))
def test_counts(texts):
    got = {k: [] for k in q.COUNTS}
    for _, part in words.batches(pa.array(texts, pa.string())):
        for k, v in q.measure(part).items():
            if k in got:
                got[k] += v.tolist()
    assert got == {k: [quality_counts(t)[k] for t in texts] for k in q.COUNTS}


def test_long_and_sliced_columns():
    texts = ["x y z " * 400_000, None, "", "tail text"]
    column = pa.array(["before", *texts]).slice(1)
    got = [q.measure(part)["n_words"].tolist() for _, part in words.batches(column)]
    assert sum(got, []) == [1_200_000, 0, 0, 2]


def test_query_against_plain_counts(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in q.quality(docs, labels).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = quality_counts(text)
        got = rows[doc_id].asDict()
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert {k: got[k] for k in want} == want and got["base_failed"] == failed
        assert not (failed and got["kept"])
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    assert np.mean([rows[d]["kept"] or rows[d]["base_failed"] for d in good]) > 0.95


def test_odd_labels_and_rows(spark):
    schema = "doc_id long, text string, quality int, n_words string"
    docs = spark.createDataFrame([(1, None, 0, "x"), (None, "a b", 1, "x"), (1, "", 1, "x"), (2, "w " * 60, 1, "x")], schema)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0), (2, 5)], "doc_id long, quality int")
    assert len(q.quality(docs, labels).collect()) == 4
    assert len(q.quality(docs, labels.limit(0)).collect()) == 4
    assert q.quality(docs.limit(0), labels).collect() == []


def test_forest_sets_apart_what_no_row_has():
    random = np.random.default_rng(1)
    good = np.column_stack([random.normal(0.5, 0.02, 500), np.zeros(500)])
    bad = np.column_stack([random.normal(0.5, 0.02, 50), np.full(50, 0.4)])
    forest = q.Forest.fit(good, np.concatenate([good, bad]))
    assert forest.score(bad).min() > np.quantile(forest.score(good), 0.98)
    limit = q.threshold(np.concatenate([forest.score(good), forest.score(bad)]), np.arange(550) < 500)
    assert (forest.score(good) >= limit).mean() <= 0.01


def test_patterned_lines_of_one_length():
    """Lines that meet under any polynomial modulo a power of two are not repeated lines."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word}\n{other}\n{word} {other}"
    (_, texts), = words.batches(pa.array([text]))
    got = {k: int(v[0]) for k, v in q.measure(texts).items()}
    want = quality_counts(text)
    assert {k: got[k] for k in want} == want and got["n_distinct"] == 2


def test_every_labelled_row_counts(spark):
    """20,000 good rows, more than any former sample: ranges and threshold see them all, each tree draws from all."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("id") % (7 + i)) for i in range(60))).alias("text"))
    odd = spark.range(n, n + 40).select("id", F.concat_ws(" ", *(F.concat(F.lit("#*$"), F.lit(str(i)), F.col("id")) for i in range(60))))
    labels = spark.range(n + 40).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("quality"))
    counts = q.measured(docs.unionAll(odd))
    table = q.labelled_rates(counts, labels).cache()
    assert table.count() == n + 40
    good = table.filter("good AND NOT apart")
    x, drawn = q.drawn_rows(good, good.count())
    ids = np.sort([r["doc_id"] for r in good.select("doc_id").collect()])
    for tree in (0, q.TREES - 1):
        want = ids[np.argsort(q._lots(ids, tree))[: q.SAMPLE]]
        assert len(drawn[tree]) == q.SAMPLE
        own = {tuple(r) for r in x[drawn[tree]]}
        assert own == {tuple(r[k] for k in q.RATES) for r in good.filter(F.col("doc_id").isin(want.tolist())).collect()}
    forest, limit = q.fitted(table)
    # Against the plain rule on every row of the other half.
    rows = table.filter("apart").collect()
    scores = q.graded(forest.score(np.array([[r[k] for k in q.RATES] for r in rows])))
    kinds = np.array([r["good"] for r in rows])
    assert limit == q.threshold(scores, kinds) <= 1
    assert (scores[kinds] >= limit).mean() <= q.FALSE_REJECTS and (scores[~kinds] >= limit).mean() > 0.9
    table.unpersist()
