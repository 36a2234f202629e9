import hashlib
import re

from hypothesis import given, settings, strategies as st

from mediasift.llm import personal as p
from mediasift.llm.queries import QUERIES

from ..conftest import SMALL

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


PIECE = st.sampled_from(
    ["a", "b.c", "@", "x@y.z", "é", " ", "-", ".", "+1", "(", ")", "1", "12", "255", "256.1.1.1", "10.0.0.1", "4111 1111 1111 1111",
     "4111111111111111", "+1 (555) 555-0100", "\n", "%", "007", ",", "@b", "Anna Meier", "tel "]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_base_spans(text):
    assert p.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@" * 150_000):
        p.candidates(text, p.base_spans(text))


def test_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op4_personal_spans"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in docs:
        want, got = plain(text), rows[doc_id]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        assert set(joined.split(",")) <= set(got["spans"].split(","))


def test_votes_tell_reliable_labelers():
    good, bad = (1, 1, 1, 0, 0, 0), (-1, -1, 0, -1, 0, 0)
    found = p.estimate({("name", good): 50, ("name", bad): 500, ("name", (0, -1, 0, 0, 0, 0)): 2000, ("number", good): 9})
    assert found["name", good] > 0.9 > 0.1 > found["name", bad]
    assert p.estimate({}) == {}


def test_sample_follows_from_the_candidates_alone(spark, monkeypatch):
    names = ["Anna", "Thomas", "Maria", "Peter", "Laura", "Simon"]
    texts = [(f"{names[i % 6]} {names[i % 5]}son{i} met Dr {names[i % 4]} Becker{i % 7} tel: 555 {100 + i} {2000 + i} on day {i}",) for i in range(600)]
    docs, seen, fit = spark.createDataFrame(texts, "text string"), [], p.Classifier.fit
    monkeypatch.setattr(p.Classifier, "fit", lambda rows, target: seen.append((rows, target.tolist())) or fit(rows, target))
    for parts in (1, 3, 16):
        p.train(docs.repartition(parts), 10)
    every = {c for (t,) in texts for c in ((c.kind, c.votes, c.features) for c in p.candidates(t, p.base_spans(t)))}
    assert len(every) > 40
    assert [len(rows) for rows, _ in seen] == [10] * 3
    assert seen[0] == seen[1] == seen[2]


def test_added_spans_and_masks(spark):
    cued = [f"Signed, Mr: Thomas Becker{i} call tel: 555 123 {1000 + i} now" for i in range(40)]
    rows = [(i, t.replace(str(i) + " call", " call"), "k") for i, t in enumerate(cued)]
    rows += [(100 + i, f"version 1234567{i} of Apache License", "k") for i in range(40)]
    rows += [(None, None, "k"), (7, "", "k"), (8, "a@b.cd +1 555 555 0100 é", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = p.train(docs)
    base, every = p.all_spans(rows[3][1], model)
    assert base == [] and {k for k, _, _ in every} >= {"number"}
    assert p.all_spans(rows[45][1], model)[1] == []
    masked = {r["doc_id"]: r["text"] for r in p.redacted(docs, model).collect()}
    assert masked[8] == "[EMAIL] [PHONE] é" and masked[7] == "" and masked[None] is None
    assert p.personal_spans(docs.limit(0), p.train(docs.limit(0))).collect() == []


def test_odd_rows_and_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "write to a.b@c.org", "x", 5), (1, "write to a.b@c.org", "x", 5), (None, "+49 30 1234567", "y", 6), (2, None, "z", 7), (3, "", "z", 8),
         (4, "long words " * 50_000 + "x@y.zz", "w", 9)],
        "doc_id long, text string, spans string, n_email int",
    )
    model = p.train(docs)
    got = sorted(map(tuple, p.personal_spans(docs, model).select("doc_id", "n_email", "n_phone", "base").collect()), key=str)
    rows = [(1, 1, 0, "email:9:18")] * 2 + [(None, 0, 1, "phone:0:14"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, "email:550000:550006")]
    assert got == sorted(rows, key=str)
    masked = p.redacted(docs, model)
    assert masked.columns == docs.columns and masked.filter("text LIKE '%@%'").count() == 0
    assert masked.filter("text IS NULL").count() == 1 and {r["n_email"] for r in masked.collect()} == {5, 6, 7, 8, 9}
    empty = docs.limit(0)
    assert p.redacted(empty, p.train(empty)).collect() == [] and p.personal_spans(empty, p.train(empty)).collect() == []
