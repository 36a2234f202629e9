import random

import numpy as np

from mediasift.llm import shingles as s
from mediasift.llm.components import components

from ..conftest import SMALL
from .brute import near_duplicate_classes, smallest_reachable

SCHEMA = "doc_id long, text string, component_id string, batch int"


def check(spark, rows):
    got = {r["doc_id"]: r for r in s.near_duplicates(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()}
    sets, classes = near_duplicate_classes(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), classes[i]) for i in sets}


def test_groups_of_near_copies_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(s, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(s, "BUCKET_GRAMS", 2_000)
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = pick.choices(words, k=60)
    rows = []
    for base in range(6):
        text = pick.choices(words, k=120)
        for _ in range(12):
            copy = list(text)
            for _ in range(pick.randrange(6)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            rows.append(copy if base % 2 else passage + copy)
    # A chain in which only neighbours link, and texts of passage and little else.
    text = pick.choices(words, k=200)
    for i in range(10):
        rows.append(text[i * 12 :] + pick.choices(words, k=i * 12))
    rows += [passage + pick.choices(words, k=k) for k in (0, 3, 8, 14, 20, 60, 90)]
    rows += [["one"], ["One"], ["one", "two"], ["one", "two", "three", "four"], ["one", "two", "three", "four", "five"]]
    pick.shuffle(rows)
    check(spark, [(i * 7 % 1009, " ".join(r)) for i, r in enumerate(rows)])


def test_given_documents(spark):
    check(spark, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long.upper()), (6, long + " end"), (None, long), (None, None), (8, long)]
    rows += [(9, "a b c d e f g h"), (9, long)]
    got = s.near_duplicates(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    classes = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert len(got) == len(rows)
    assert classes[1, 0] == 1 and classes[3, 0] == 3 and classes[None, 0] is None
    assert {classes[i, 59_996] for i in (4, 5, 8)} == {4} and classes[6, 59_997] == 4 and classes[None, 59_996] is None
    assert classes[9, 59_996] == 4
    assert s.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gaps():
    for top in (1 << 10, 1 << 40, 1 << 62):
        values = np.unique(np.random.default_rng(1).integers(0, top, 500).astype(np.uint64))
        assert (s.unpack_gaps(s.pack_gaps(values)) == values).all()
    assert len(s.unpack_gaps(s.pack_gaps(np.empty(0, np.uint64)))) == 0


def test_suffix_filter_never_drops_what_is_near():
    pick = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(pick.integers(0, 60, 30)).astype(np.uint64)
        y = np.unique(pick.integers(0, 60, 30)).astype(np.uint64)
        apart = len(np.setxor1d(x, y))
        assert not s._apart(x, y, apart)


def test_components(spark):
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1200)] + [(5000, 5000)]
    links += [(pick.randrange(2000, 2400), pick.randrange(2000, 2400)) for _ in range(180)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable({x for p in links for x in p}, links)
    assert got == {i: want[i] for i in got} and all(i in got or want[i] == i for i in want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_patterned_words_of_one_length(spark):
    """The Thue-Morse word and its complement have one value under any polynomial modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, f"{word} {word}"), (2, f"{other} {other}"), (3, word), (4, other), (5, word[:1024]), (6, other[:1024])])


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, `class` int")
    out = s.without_near_duplicates(docs)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_duplicates_go_row_by_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(30))
    near = text + " end"
    assert kept(spark, [(1, text), (2, text), (2, other)]) == [(1, text), (2, other)]
    assert kept(spark, [(None, text), (None, text), (None, other)]) == sorted([(None, text), (None, other)], key=str)
    assert kept(spark, [(None, text), (7, near), (3, other), (3, other), (3, other)]) == [(3, other), (7, near)]
    # Texts without words are in no group; repeated ones stay.
    assert kept(spark, [(1, None), (1, None), (2, ""), (3, " "), (3, " ")]) == sorted([(1, None), (1, None), (2, ""), (3, " "), (3, " ")], key=str)
    # A tie of equal ids goes by the digest of the text: one of the two stays.
    assert len(kept(spark, [(5, text), (5, near)])) == 1
    assert kept(spark, [(4, "one two"), (9, "one two"), (8, "one two three")]) == [(4, "one two"), (8, "one two three")]
    assert kept(spark, []) == []


def test_repeated_rows_that_differ_elsewhere(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (2, text, "c")], "doc_id long, text string, source string")
    assert [tuple(r) for r in s.without_near_duplicates(docs).collect()] == [(1, text, "a")]
