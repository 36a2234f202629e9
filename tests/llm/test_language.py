import numpy as np
import pyarrow as pa

from mediasift.llm import language as l, words
from mediasift.llm.common import levelled_sample

from ..conftest import SMALL

SF = SMALL.replace("0.001", "0.01")


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = l.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", ""), (2, "", "en", ""), (3, "123 !?", "en", ""), (None, "plain words", None, ""), (4, "x" * 100_000, "en", ""), (4, "y", "en", "")]
    docs = spark.createDataFrame(rows, schema)
    got = l.language(docs).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert len(got) == 6
    assert {r["lang_pred"] for r in l.language(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang = 'z' or lang = ''")).collect()} <= {"und", ""}
    assert l.language(docs.limit(0)).collect() == []


def test_rare_language(spark):
    """One row in 10,000 is of a language of its own; all of these are learned, and the held-out ones told apart."""
    n = 200_000
    docs = spark.range(n).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 10000 = 7 THEN 'ru' WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang",
        "CASE WHEN id % 10000 = 7 THEN concat('это короткий текст о погоде ', id) WHEN id % 2 = 0 THEN concat('this is a short text about the weather ', id)"
        " ELSE concat('das ist ein kurzer Text zum Wetter ', id) END AS text",
    )
    known = docs.filter(l.remainder(docs.doc_id, l.FOLDS) != l.HELD_OUT)
    got = {r["lang"]: r["count"] for r in levelled_sample(known, 300, "lang", "doc_id").groupBy("lang").count().collect()}
    assert got["ru"] == known.filter("lang = 'ru'").count()
    assert 200 < sum(got.values()) < 400
    rows = l.language(docs).join(docs.filter("doc_id % 1000 = 7").select("doc_id", "lang"), "doc_id").collect()
    rare = [r for r in rows if r["lang"] == "ru"]
    assert len(rare) == n // 10_000
    assert {r["held_out"] for r in rare} == {True, False}
    assert all(r["lang_pred"] == r["lang"] for r in rows)


def test_each_language_gives_a_text(spark):
    rows = spark.range(10_000).selectExpr("id AS doc_id", "concat('l', id % 50) AS lang")
    kept = levelled_sample(rows, 20, "lang", "doc_id")
    assert kept.select("lang").distinct().count() == 50
    assert kept.count() < 100


def test_windows_hold_every_byte():
    texts = [b"a" * 600, b"", b"bc", b"d" * 256]
    for _, part in words.batches(pa.array([t.decode() for t in texts])):
        x, of, length = l.cut(part)
        for i, t in enumerate(texts):
            assert b"".join(bytes(r[:n]) for r, n in zip(x[of == i], length[of == i], strict=True)) == t


def test_slopes_are_those_of_the_loss():
    random = np.random.default_rng(3)
    net = l.Network.new(["a", "b", "c"], random)
    for name in ("vectors", "dense", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = {w: k.astype(float) for w, k in net.filters.items()}
    net.offsets = {w: k.astype(float) + 0.3 for w, k in net.offsets.items()}
    x, y = random.integers(97, 122, (6, 40)).astype(np.uint8), random.integers(0, 3, 6)

    def loss():
        return -np.log(net.predict(x)[np.arange(6), y]).mean()

    for value, slope in zip(net.values(), net.slopes(x, y), strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept = value[at]
        value[at] = kept + 1e-6
        up = loss()
        value[at] = kept - 1e-6
        down = loss()
        value[at] = kept
        assert abs((up - down) / 2e-6 - slope[at]) < 1e-4


def test_model_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).cache()
    one, two = (l.train(docs.repartition(n).sortWithinPartitions("text"), 40) for n in (1, 7))
    assert all((a == b).all() for a, b in zip(one.values(), two.values(), strict=True))
