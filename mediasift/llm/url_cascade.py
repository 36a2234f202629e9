"""Address filter by cascades of Bloom filters.

A list of keys (host and beginning of a path) is held as filters of alternate meaning: the
first holds the listed keys, the second all other keys of the corpus that pass the first, the third the listed
keys that pass the second, and so on until none passes wrongly. The key universe
is complete, so membership of its keys is exact, and asking needs no join: each task holds
the filters and tests the few keys that an address has.

Filters are built where the keys are; words of bits meet in a hash aggregate.
Only the finished bits come to the driver to be broadcast. A list whose filters would be larger
than ``CASCADE_BYTES`` is dealt into shards by key, and the addresses pass one shard after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written
from .words import mix

U64 = np.uint64
#: Bytes of filters broadcast at once, and levels after which a cascade is held to be broken.
CASCADE_BYTES, MOST_LEVELS = 64 << 20, 64
#: From the second filter on, one key in so many passes wrongly.
LATER = 16
ALLOW, BLOCK, LISTED = "allow", "block", "listed"
LISTS = (ALLOW, BLOCK, LISTED)
KEYS = "list string, key string, h1 long, h2 long"


@dataclass
class Bloom:
    bits: np.ndarray  # words of 64 bits
    tests: int

    def passes(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in places(h1, h2, level, self.tests, len(self.bits) * 64):
            out &= (self.bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
        return out


def places(h1: np.ndarray, h2: np.ndarray, level: int, tests: int, size: int) -> Iterator[np.ndarray]:
    """Bits of each key in the filter of a level. Levels differ, so that keys that meet in one part again."""
    salt = U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    first, step = mix(h1.view(U64) + salt), mix(h2.view(U64) ^ salt) | U64(1)
    for i in range(tests):
        yield mix(first + U64(i) * step) % U64(size)


@dataclass
class Cascade:
    """Filters of one list, the odd ones (from 0) for keys that are not listed."""

    levels: list[Bloom] = field(default_factory=list)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The first filter that a key does not pass decides; one that passes all is what the last one holds."""
        out, alive = np.full(len(h1), len(self.levels) % 2 == 1), np.ones(len(h1), bool)
        for i, level in enumerate(self.levels):
            stays = alive & level.passes(h1, h2, i)
            out[alive & ~stays] = i % 2 == 1
            alive = stays
        return out


def hashed(key: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit(7), key)}


def bits_a_key(rate: float) -> float:
    return math.log2(1 / rate) / math.log(2)


def add_level(cascades: dict[str, Cascade], keys: DataFrame, level: int, rates: dict[str, float]) -> set[str]:
    """Encodes the keys (KEYS) of each list as its filter of this level; returns lists that have keys."""
    sizes = {r["list"]: r["count"] for r in keys.groupBy("list").count().collect()}
    shapes = {
        name: (max(1, round(-math.log2(rates[name]))), 64 * max(1, math.ceil(n * bits_a_key(rates[name]) / 64)))
        for name, n in sizes.items()
    }

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch["list"].to_pylist(), object)
            for name in sorted(set(names)):
                own = names == name
                h1, h2 = (batch[c].to_numpy()[own] for c in ("h1", "h2"))
                tests, size = shapes[name]
                at = np.unique(np.concatenate(list(places(h1, h2, level, tests, size))))
                words, starts = np.unique(at >> U64(6), return_index=True)
                bits = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(words)), pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))],
                    ["list", "word", "bits"],
                )

    words = keys.mapInArrow(encode, "list string, word long, bits long").groupBy("list", "word").agg(F.bit_or("bits").alias("bits"))
    # At most CASCADE_BYTES of bits for all lists and levels together.
    found = words.toArrow()
    names = np.asarray(found["list"].to_pylist(), object)
    for name, (tests, size) in shapes.items():
        bits, own = np.zeros(size // 64, U64), names == name
        bits[found["word"].to_numpy()[own]] = found["bits"].to_numpy()[own].view(U64)
        cascades[name].levels.append(Bloom(bits, tests))
    return set(sizes)


def passing(keys: DataFrame, cascades: dict[str, Cascade], level: int, lists: set[str], labelled: bool = True) -> DataFrame:
    """Keys that pass the filter of ``level`` of their list, or (``labelled`` is false) of each of the lists."""
    filters = keys.sparkSession.sparkContext.broadcast({name: cascades[name].levels[level] for name in lists})

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            names = np.asarray(batch["list"].to_pylist(), object) if labelled else None
            for name, bloom in filters.value.items():
                hit = bloom.passes(h1, h2, level)
                if labelled:
                    hit &= names == name
                kept = batch.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * kept.num_rows, pa.string()), kept["key"], kept["h1"], kept["h2"]], ["list", "key", "h1", "h2"]
                )

    return keys.mapInArrow(test, KEYS)


def build(listed: DataFrame, universe: DataFrame, universe_size: int) -> dict[str, Cascade]:
    """A cascade for each list, exact for all keys of ``universe``.

    ``listed``: distinct (list, key, h1, h2). ``universe``: (key, h1, h2), repeats allowed; its rows
    are tested before anything is shuffled, so what meets by key is about as much as is listed.
    """
    cascades = {name: Cascade() for name in LISTS}
    inside = listed
    rates = {
        r["list"]: min(1 / LATER, r["count"] / max(universe_size, 1)) for r in inside.groupBy("list").count().collect()
    }
    lists = add_level(cascades, inside, 0, rates)
    if not lists:
        return cascades
    passed = passing(universe, cascades, 0, lists, labelled=False).withColumn("member", F.lit(0))
    both = passed.unionByName(inside.withColumn("member", F.lit(1)))
    outside = both.groupBy("list", "key", "h1", "h2").agg(F.max("member").alias("member")).filter("member = 0").drop("member")
    outside, rates = written(outside, "cascade-outside"), dict.fromkeys(LISTS, 1 / LATER)
    for level in range(1, MOST_LEVELS, 2):
        lists = add_level(cascades, outside, level, rates)
        if not lists:
            return cascades
        inside = written(passing(inside, cascades, level, lists), "cascade-inside")
        lists = add_level(cascades, inside, level + 1, rates)
        if not lists:
            return cascades
        outside = written(passing(outside, cascades, level + 1, lists), "cascade-outside")
    raise RuntimeError("keys with equal hashes: the cascade does not end")


def with_keys(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """page_id, host, path and the keys of an address, longest first.

    A key is the host's last labels and the path's first characters, for the numbers of both that listed keys have.
    """
    scheme = F.instr("url", "://")
    rest = F.when(scheme > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = pages.select(F.col("page_id").cast("long"), rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    if not shapes:
        return parts.withColumn("keys", F.array().cast("array<string>"))
    forms = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("size")) for a, b in shapes))
    fits = F.filter(
        forms, lambda x: (x["labels"] <= 1 + F.length("host") - F.length(F.replace("host", F.lit(".")))) & (x["size"] <= F.length("path"))
    )
    found = parts.withColumn("fits", F.when(F.col("host") == "", F.filter(fits, lambda x: x["labels"] <= 1)).otherwise(fits))
    keys = "transform(fits, x -> concat(substring_index(host, '.', -x.labels), left(path, x.size)))"
    ranked = f"transform({keys}, (k, i) -> struct(length(k) AS size, fits[i].labels AS labels, k AS key))"
    return found.select(
        "page_id", "host", "path", F.expr(f"transform(reverse(array_sort({ranked})), x -> x.key)").alias("keys")
    )


def probe(rows: DataFrame, cascades: dict[str, Cascade], shard: int, shards: int) -> DataFrame:
    """Adds what these filters know of the shard's keys: place of the first one with a rule, whether it blocks, whether any is listed."""
    filters = rows.sparkSession.sparkContext.broadcast(cascades)

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["h1"]
            h1, h2 = lists.flatten().to_numpy(), batch["h2"].flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = h2 % shards == shard
            allow, block, listed = (own & filters.value[name].member(h1, h2) for name in LISTS)
            rule = np.flatnonzero(allow | block)
            _, first = np.unique(row[rule], return_index=True)
            rule = rule[first]
            at, blocks = batch["rule_at"].to_numpy(zero_copy_only=False).copy(), np.array(batch["blocks"], bool)
            # Shards of a list hold different keys; the longest key of all counts.
            rule = rule[(at[row[rule]] < 0) | (place[rule] < at[row[rule]])]
            at[row[rule]], blocks[row[rule]] = place[rule], block[rule]
            named = np.array(batch["listed"], bool)
            named[row[listed]] = True
            out = [batch[c] for c in ("page_id", "host", "path", "keys", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(at), pa.array(blocks), pa.array(named)], batch.schema.names)

    return rows.mapInArrow(test, rows.schema)


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, cascade_bytes: int = CASCADE_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every address.

    ``rules`` (rule, verdict): host and path in one text; of those that fit the longest wins,
    of equal length the one with more labels; a rule that stands for both blocks. Without
    rule, an address is blocked if a key of it stands in ``listed`` (key), a list of hosts, with or without path.

    A null url and one without ``://`` have an empty host and path, no rule and verdict allow.
    Null ids stay null; repeated rows are judged each; null rules and keys are left out.
    Other columns are ignored, empty tables give no rows, long addresses cost what their keys cost.
    """
    keys = rules.select(F.col("verdict").alias("list"), F.col("rule").alias("key")).filter(F.col("verdict").isin(ALLOW, BLOCK))
    keys = keys.unionByName(listed.select(F.lit(LISTED).alias("list"), "key")).filter("key IS NOT NULL").distinct()
    keys = written(keys.select("list", "key", *(c.alias(n) for n, c in hashed(F.col("key")).items())), "url-keys")
    host = F.substring_index("key", "/", 1)
    labels = 1 + F.length(host) - F.length(F.replace(host, F.lit(".")))
    # Numbers of labels times lengths of paths, however long the lists are.
    shapes = keys.select(labels.alias("labels"), (F.length("key") - F.length(host)).alias("size")).distinct().collect()
    shapes = sorted((r["labels"], r["size"]) for r in shapes)
    n, universe_size = keys.count(), pages.count() * max(1, len(shapes))
    need = n * (bits_a_key(min(1 / LATER, max(n, 1) / max(universe_size, 1))) + 2 * bits_a_key(1 / LATER)) / 8
    shards = max(1, math.ceil(need / cascade_bytes))
    rows = with_keys(pages, shapes).withColumns(
        {
            "h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(F.lit(7), k)),
            "rule_at": F.lit(-1), "blocks": F.lit(False), "listed": F.lit(False),
        }
    )
    each = with_keys(pages, shapes).select(F.explode("keys").alias("key")).withColumns(hashed(F.col("key")))
    for shard in range(shards):
        own = F.pmod(F.col("h2"), F.lit(shards)) == shard
        rows = probe(rows, build(keys.filter(own), each.filter(own), universe_size // shards), shard, shards)
        if shards > 1:
            rows = written(rows, "url-verdicts")
    rule = F.when(F.col("rule_at") >= 0, F.get("keys", F.col("rule_at")))
    verdict = F.when(F.when(rule.isNotNull(), F.col("blocks")).otherwise(F.col("listed")), BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
