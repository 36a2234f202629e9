"""Jaccard join of documents on their word n-grams: rare-first prefixes, filters, one check per pair.

1. Document frequencies. Texts are dealt into batches by id. A batch sends each of its
   distinct n-gram hashes once, with the number of its documents that have it, to the
   hash's bucket; the bucket adds up and answers every batch with the hashes that
   occur in two documents or more. So a common n-gram costs one entry a batch, not one a document.
2. Rare-first order. n-grams of one document only come first and can match nothing.
   A document with under 75 % shared n-grams cannot link and goes no further.
   Of the others, equal sets become one.
3. Prefixes. Sets that link share an n-gram among the first n - ceil(3n/4) + 1. Each
   prefix n-gram's sets are compared with the least of them first; only sets that
   this leaves in different components are then paired, so a group of copies never makes all its pairs.
   Pairs pass a length and a positional filter, are made distinct, pass a suffix
   filter, and are verified on the whole sets.

Frequencies may count two n-grams as one where their shortened hashes meet. That
changes the order only; sets are compared by 56 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words
from .common import written
from .components import components

SIZE = 5
#: Text bytes of a batch and n-grams of a bucket, on average; both are held by one task.
BATCH_BYTES = 4 << 20
BUCKET_GRAMS = 1 << 20
U64 = np.uint64
LOW56 = U64((1 << 56) - 1)


def pack_gaps(values: np.ndarray) -> bytes:
    """Ascending whole numbers as gaps of seven bits a byte, the lowest first."""
    gaps = np.diff(values, prepend=U64(0))
    length = np.ones(len(gaps), np.int64)
    for bits in range(7, 64, 7):
        length += gaps >= U64(1 << bits)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(length.max()) if len(length) else 0):
        has = length > k
        part = (gaps[has] >> U64(7 * k)) & U64(127)
        out[(ends - length)[has] + k] = part + (np.uint64(128) * (length[has] > k + 1))
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    firsts = np.append(0, last[:-1] + 1) if len(last) else last
    shift = (np.arange(len(raw)) - np.repeat(firsts, last - firsts + 1)) * 7
    parts = (raw & 127).astype(U64) << shift.astype(U64)
    return np.cumsum(np.add.reduceat(parts, firsts)) if len(firsts) else np.empty(0, U64)


def grams(texts: words.Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text and the text of each, ascending by text.

    A text of fewer words is one n-gram as a whole; without words it has none.
    """
    starts, ends, firsts = texts.words()
    hashes = texts.hashes(starts, ends, lower=True)
    found, of = words.windows(hashes, firsts, size)
    counts = np.diff(firsts)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), n, U64)
            for k in range(n):
                total = words.mix(total + hashes[firsts[:-1][short] + k])
            found, of = np.append(found, total), np.append(of, short)
    keep = np.unique(words.within(found, of), return_index=True)[1]
    keep = keep[np.argsort(of[keep], kind="stable")]
    return found[keep], of[keep]


def text_digest() -> Column:
    """Tells rows of one doc_id with different texts apart; null is an empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _documents(docs: DataFrame, batches: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    return rows.withColumns({"batch": batch, "digest": text_digest()})


def gram_sets(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, a key that equal sets share (null: no n-gram), and, where 75 % are shared
    with other documents, ``keys``: the shared n-grams as ascending 64-bit numbers, the rarer the lower."""
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_batches = max(1, -(-n_bytes // BATCH_BYTES))
    n_grams = max(1, n_bytes // 6)
    n_buckets = max(1, -(-n_grams // BUCKET_GRAMS))
    # Enough bits that few n-grams of one document meet another's; gaps between hashes stay short.
    drop = U64(64 - min(60, n_grams.bit_length() + 5))
    rows = _documents(docs, n_batches)

    def send(table: pa.Table) -> pa.Table:
        parts = []
        for column in table["text"].chunks:
            for _, texts in words.batches(column):
                parts.append(np.unique(grams(texts)[0] >> drop, return_counts=True))
        all_, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U64), np.empty(0, np.int64))
        hashes, back = np.unique(all_, return_inverse=True)
        times = np.bincount(back, times, len(hashes)).astype(np.int64)
        # The bucket grows with the hash, so that each is a slice.
        bucket = (((hashes << drop) >> U64(32)) * U64(n_buckets)) >> U64(32)
        edges = np.flatnonzero(np.diff(bucket, prepend=U64(1 << 63)))
        ends = np.append(edges[1:], len(hashes))[: len(edges)]
        out: list[list] = [[], [], [], []]
        for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
            out[0].append(int(bucket[a]))
            out[1].append(pack_gaps(hashes[a:b]))
            several = np.flatnonzero(times[a:b] > 1)
            out[2].append(pack_gaps(several.astype(U64)))
            out[3].append(times[a:b][several].astype("<u4").tobytes())
        of = [table["batch"][0].as_py()] * len(out[0]) if table.num_rows else []
        return pa.table(
            {
                "bucket": pa.array(out[0], pa.int32()), "batch": pa.array(of, pa.int32()), "hashes": pa.array(out[1], pa.binary()),
                "several": pa.array(out[2], pa.binary()), "times": pa.array(out[3], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        lists = [unpack_gaps(x.as_py()) for x in table["hashes"]]
        hashes = np.concatenate(lists)
        times = np.ones(len(hashes), np.int64)
        at = 0
        for x, several, n in zip(lists, table["several"], table["times"], strict=True):
            places = unpack_gaps(several.as_py()).astype(np.int64)
            times[at + places] = np.frombuffer(n.as_py(), "<u4")
            at += len(x)
        each, back = np.unique(hashes, return_inverse=True)
        frequency = np.bincount(back, times, len(each))[back]
        rank = np.minimum(255, 8 * np.log2(frequency)).astype(np.uint8)
        out, at = [[], [], []], 0
        for x, batch in zip(lists, table["batch"].to_pylist(), strict=True):
            shared = frequency[at : at + len(x)] > 1
            if shared.any():
                out[0].append(batch)
                out[1].append(pack_gaps(x[shared]))
                out[2].append(rank[at : at + len(x)][shared].tobytes())
            at += len(x)
        return pa.table({"batch": pa.array(out[0], pa.int32()), "shared": pa.array(out[1], pa.binary()), "ranks": pa.array(out[2], pa.binary())})

    def sets(table: pa.Table, replies: pa.Table) -> pa.Table:
        known = [unpack_gaps(x.as_py()) for x in replies["shared"]]
        known = np.concatenate(known) if known else np.empty(0, U64)
        ranks = b"".join(x.as_py() for x in replies["ranks"])
        ranks = np.frombuffer(ranks, np.uint8).astype(U64)
        order = np.argsort(known)
        known, ranks = known[order], ranks[order]
        out: list[list] = [[], [], []]
        for column in table["text"].chunks:
            for _, texts in words.batches(column):
                hashes, of = grams(texts)
                short = hashes >> drop
                at = np.minimum(np.searchsorted(known, short), max(len(known) - 1, 0))
                shared = known[at] == short if len(known) else np.zeros(len(short), bool)
                n = np.bincount(of, minlength=len(texts))
                m = np.bincount(of[shared], minlength=len(texts))
                ends = np.cumsum(n)
                keys = (hashes & LOW56) | ((ranks[at] << U64(56)) if len(known) else U64(0))
                twice = words.mix(hashes + U64(1))
                for i in range(len(texts)):
                    a, b = ends[i] - n[i], ends[i]
                    out[0].append(int(n[i]))
                    digest = np.array([hashes[a:b].sum(), twice[a:b].sum() ^ U64(n[i])], U64).tobytes() if n[i] else None
                    out[1].append(digest)
                    can = n[i] > 0 and 4 * m[i] >= 3 * n[i]
                    out[2].append(np.sort(keys[a:b][shared[a:b]]).tobytes() if can else None)
        return pa.table(
            {
                "doc_id": table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64()),
                "digest": table["digest"].combine_chunks() if table.num_rows else pa.array([], pa.binary()),
                "n_shingles": pa.array(out[0], pa.int64()), "set": pa.array(out[1], pa.binary()), "keys": pa.array(out[2], pa.binary()),
            }
        )

    sent = rows.groupBy("batch").applyInArrow(send, "bucket int, batch int, hashes binary, several binary, times binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "batch int, shared binary, ranks binary")
    return rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        sets, "doc_id long, digest binary, n_shingles long, set binary, keys binary"
    )


def _postings(sets: DataFrame) -> DataFrame:
    """The prefix of each set, a row for each of its n-grams that others share."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys, places = [], [], []
            for i, (n, raw) in enumerate(zip(batch["n"].to_pylist(), batch["keys"].to_pylist(), strict=True)):
                shared = np.frombuffer(raw, U64)
                alone = n - len(shared)
                take = max(0, n - -(-3 * n // 4) + 1 - alone)
                of.append(np.full(take, i))
                keys.append(shared[:take])
                places.append(alone + np.arange(take))
            if of:
                of = pa.array(np.concatenate(of).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)), batch["set"].take(of), batch["id"].take(of),
                        batch["n"].take(of), pa.array(np.concatenate(places)),
                    ],
                    ["gram", "set", "id", "n", "place"],
                )

    return sets.select("set", "id", "n", "keys").mapInArrow(prefix, "gram long, set binary, id long, n long, place long")


def _pairs(one: DataFrame, two: DataFrame, also: Column, *bands: str) -> DataFrame:
    """Distinct pairs of sets that meet in a prefix n-gram (and ``bands``) and pass the length and positional filters."""
    x, y = one.alias("x"), two.alias("y")
    least, most = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    reach = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("gram", *bands)]).filter(
        also & (4 * least >= 3 * most) & (7 * reach >= 3 * (F.col("x.n") + F.col("y.n")))
    )
    first = F.col("x.set") < F.col("y.set")
    return met.select(
        F.when(first, F.col("x.set")).otherwise(F.col("y.set")).alias("one"),
        F.when(first, F.col("y.set")).otherwise(F.col("x.set")).alias("two"),
    ).distinct()


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> bool:
    """Whether two ascending arrays surely differ in more than ``most`` numbers, by
    splitting both at a middle number and comparing the lengths of the parts."""

    def least(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        bound = abs(len(x) - len(y))
        if not depth or not len(x) or not len(y):
            return bound
        middle = len(y) // 2
        at = int(np.searchsorted(x, y[middle]))
        same = at < len(x) and x[at] == y[middle]
        return least(x[:at], y[:middle], depth - 1) + least(x[at + same :], y[middle + 1 :], depth - 1) + (not same)

    return least(x, y, depth) > most


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of sets that are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch[k].to_pylist() for k in ("x_keys", "y_keys", "x_n", "y_n")), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                need = -(-3 * (n + m) // 7)
                # What is in one set only: the n-grams nobody shares, and the rest.
                if _apart(x, y, n + m - 2 * need - (n - len(x)) - (m - len(y))):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                keep.append(int((both[1:] == both[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("set").alias("one"), F.col("id").alias("a"), F.col("n").alias("x_n"), F.col("keys").alias("x_keys"))
    two = sets.select(F.col("set").alias("two"), F.col("id").alias("b"), F.col("n").alias("y_n"), F.col("keys").alias("y_keys"))
    return pairs.join(one, "one").join(two, "two").select("a", "b", "x_n", "y_n", "x_keys", "y_keys").mapInArrow(verify, "a long, b long")


def _classes(sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(set, class) of distinct sets (set, id, n, keys): the smallest id that links between sets,
    and the links ``known`` (a, b) between ids, lead to."""
    postings = written(_postings(sets), "postings")
    leaders = postings.groupBy("gram").agg(
        F.min(F.struct("id", "set", "n", "place")).alias("s"), F.count("*").alias("c")
    ).filter("c > 1").select("gram", "s.*")
    led = _verified(_pairs(leaders, postings, F.col("x.set") != F.col("y.set")), sets)
    links = written(led if known is None else led.unionByName(known), "led")
    first = components(links)

    # Sets of one n-gram that are still apart, its leader being compared with all already.
    marked = postings.join(first, "id", "left").withColumn("class", F.coalesce("component_id", "id"))
    rest = written(marked.join(leaders.select("gram", "set"), ["gram", "set"], "left_anti").drop("component_id"), "rest")
    several = rest.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("gram")
    # Sets that link are at most a third apart in length, so with bands a little wider they fall into the same or neighbouring bands.
    band = F.floor(F.log(1.35, "n")).cast("int")
    open_ = rest.join(several, "gram").withColumn("band", band)
    near = open_.withColumn("band", F.explode(F.array(*(band + k for k in (-1, 0, 1)))))
    more = _verified(_pairs(open_, near, F.col("x.class") < F.col("y.class"), "band"), sets)
    whole = components(links.unionByName(more))
    return sets.select("set", "id").join(whole, "id", "left").select("set", F.coalesce("component_id", "id").alias("class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text).

    A null text has no words, and a document without words or without doc_id links with
    nothing; without doc_id its component is null. Rows that repeat a doc_id each have
    their set, and their links all count for that doc_id. Equal similarity is no tie: all that reaches 75 % links.
    Further columns are ignored, very long texts taken whole; an empty table gives no rows.
    """
    found = written(gram_sets(docs), "gram-sets")
    linkable = found.filter("keys is not null and doc_id is not null")
    sets = written(
        linkable.groupBy("set").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")),
        "sets",
    )
    # Rows that repeat a doc_id are one document of several sets.
    same = linkable.groupBy("doc_id").agg(F.count_distinct("set").alias("c")).filter("c > 1").select("doc_id")
    repeated = linkable.join(same, "doc_id").select("set", F.col("doc_id").alias("b")).join(sets.select("set", F.col("id").alias("a")), "set")
    classes = _classes(sets, repeated.select("a", "b")).withColumnRenamed("class", "_class")
    return found.join(classes, "set", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id")).alias("component_id")
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows, all columns, without near-duplicates: of each group of texts that links join, one row stays.

    It is the one of the smallest doc_id (null ids come last), of several texts with that id the one of the
    least digest, of equal ones the least in all columns. What counts is a row's own text: another text under the id of a
    duplicate stays, and rows without doc_id are compared as well. Texts without words are in no group and stay.
    Very long texts are taken whole, columns of any name are kept, an empty table gives no rows.
    """
    found = written(gram_sets(docs), "gram-sets")
    linkable = found.filter("keys is not null")
    least_id = F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("doc_id")
    sets = linkable.groupBy("set").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), least_id)
    # Numbers of their own that keep the order of the ids: leaders are those that ``near_duplicates`` takes.
    ordered = sets.repartitionByRange("doc_id", "set").sortWithinPartitions("doc_id", "set")
    sets = written(ordered.withColumn("id", F.monotonically_increasing_id()).drop("doc_id"), "sets")
    texts = linkable.join(_classes(sets), "set").groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n"))
    texts = written(texts, "grouped-texts")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    kept = texts.groupBy("class").agg(least.alias("kept"), F.sum("n").alias("all")).filter("all > 1").select("class", "kept.*")
    kept = kept.withColumnsRenamed({"doc_id": "kept_id", "digest": "kept_digest"})
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    judged = texts.join(kept, "class").select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "n", stays.alias("stays"))
    judged = written(judged.filter("NOT stays OR n > 1"), "duplicates")

    own = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    out = rows.join(judged, own, "left_anti").select("row.*")
    again = judged.filter("stays")
    if again.isEmpty():
        return out
    # Rows that are repeated as they are, or but for other columns: rare, and reduced before they meet.
    one = rows.join(again, own, "left_semi").groupBy("doc_id", "digest").agg(F.min("row").alias("row")).select("row.*")
    return out.unionByName(one)
