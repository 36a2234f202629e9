import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mediasift.llm import periodic as p
from mediasift.llm.queries import QUERIES

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All runs by comparing every word with the one q words on, for every q."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and not any(r[0] <= start and r[0] + r[1] >= i + q for r in found if r[2] < q):
                found.append((start, i - start + q, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def damaged(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    return w


def plain_row(doc_id, w):
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def random_words(pick):
    out = []
    while len(out) < pick.randrange(1, 160):
        part = pick.choices("abc"[: pick.randint(1, 3)], k=pick.randint(1, 9))
        out += part * pick.choice([1, 1, 2, 3, 4, 5, 9]) + part[: pick.randrange(len(part))]
    return out


def test_against_all_comparisons():
    pick = random.Random(8)
    texts = [random_words(pick) for _ in range(1500)] + [["x"] * 5, ["x"] * 6, [], ["x"], ["x", "y"] * 4, ["x", "y"] * 3 + ["x"]]
    firsts = np.cumsum([0, *map(len, texts)])
    numbers = np.array([ord(w) for t in texts for w in t])
    got = [[] for _ in texts]
    for start, length, period in p.find_runs(numbers, firsts):
        i = int(np.searchsorted(firsts, start, "right")) - 1
        got[i].append((start - firsts[i], length, period))
    want = list(map(plain_runs, texts))
    assert got == want and sum(map(len, want)) > 1000


def test_words_with_few_different_grams():
    """Every gram of a Fibonacci word occurs often; only grams as long as the period tell the periods apart."""
    a, b = "a", "ab"
    while len(b) < 89:
        a, b = b, b + a
    for w in (list(b * 4), list(b * 5 + "x" + b * 3), list((b + "ba") * 6)):
        assert p.find_runs(np.array([ord(x) for x in w]), np.array([0, len(w)])) == plain_runs(w)


def test_one_word_very_often():
    n = 300_000
    w = np.ones(n, np.int64)
    assert p.find_runs(w, np.array([0, n])) == [(0, n, 1)]
    w[n // 2] = 2
    assert p.find_runs(w, np.array([0, n])) == [(0, n // 2, 1), (n // 2 + 1, n - n // 2 - 1, 1)]


@pytest.mark.parametrize("words", [p.WORDS, 40])
def test_odd_rows(spark, monkeypatch, words):
    monkeypatch.setattr(p, "WORDS", words)
    row = "go\tstop " * 9
    texts = [None, "", " \t\n", "a", row, row, "a\x0ba\x0ca\ra a a ", "İ " * 20 + "i " * 7, "x y " * 5 + "z " * 6, "w" * 100_000 + " b" * 30]
    rows = [(i, t, "a", 0) for i, t in enumerate(texts)] + [(None, row, "b", 1), (4, row, "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n long")
    got = sorted(map(tuple, p.run_digests(p.periodic_runs(docs)).collect()), key=str)
    assert got == sorted((plain_row(i, WORD.findall(t or "")) for i, t, _, _ in rows), key=str)
    planted = sorted(map(tuple, p.run_digests(p.periodic_runs(p.with_planted_runs(docs))).collect()), key=str)
    assert planted == sorted((plain_row(i, damaged(i, t)) for i, t, _, _ in rows), key=str)


def test_text_after_damage(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50)) + "\n") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: WORD.findall(r["text"]) for r in p.with_planted_runs(docs).collect()}
    assert got == {i: damaged(i, t) for i, t in rows}
    assert any(got[i] != WORD.findall(t) for i, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert p.run_digests(p.periodic_runs(p.with_planted_runs(docs))).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    query = next(f for name, f in QUERIES.items() if name.startswith("op12_"))
    rows = sorted(map(tuple, query(spark, SMALL).collect()))
    short = {r["doc_id"]: damaged(*r) for r in docs if len(r["text"] or "") < 9000}
    assert len(rows) == len(docs) and len(short) > 150
    assert [r for r in rows if r[0] in short] == sorted(plain_row(i, w) for i, w in short.items())
    assert sum(r[1] for r in rows) > 10
