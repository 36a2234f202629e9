"""The cache table as a log of runs.

A batch adds one run: its entries, one a key, in files by bucket of the key, sorted by key. The runs that count are
named in one manifest file; a new manifest takes the place of the last by one rename, so a reader sees a batch or a
compaction whole or not at all. Runs of one level are merged into one of the next when they are ``FAN``, so a lookup
reads a number of runs that grows with the logarithm of the history, and of these only those whose
key range and filter let a wanted key through, and only the wanted buckets.

The batch number orders the writers. A batch that runs again replaces its own run: compaction merges runs of
earlier batches only, so such a batch still finds the table as it was before it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cache import valid_key
from ..schemas import ANALYSIS

BUCKETS, FAN = 16, 4
#: Bits and tests of a run's filter. A run of more keys than a filter serves has none and is always looked into.
FILTER_BITS, FILTER_TESTS, FILTER_KEYS = 1 << 20, 4, 100_000
STORED = "cache_key string, output string, batch long, bucket int"
WORDS = "run string, word long, bits long"


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    first: int  # batches
    last: int
    rows: int
    least: str
    greatest: str
    filtered: bool


def bucket() -> Column:
    return F.conv(F.left("cache_key", F.lit(4)), 16, 10).cast("int") % BUCKETS


def _places() -> Column:
    """The bits of a key in a filter."""
    one = lambda i: F.pmod(F.xxhash64(F.lit(i), "cache_key"), F.lit(FILTER_BITS))
    return F.array(*map(one, range(FILTER_TESTS)))


class CacheLog:
    """Entries (cache_key, output) below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._file("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifest ---
    def _versions(self) -> list[int]:
        folder = self._file("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _load(self, version: int) -> list[Run]:
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{version}.json", 1).first()[1]
        return [Run(**r) for r in json.loads(text)]

    def runs(self) -> list[Run]:
        versions = self._versions()
        return self._load(versions[-1]) if versions else []

    def _commit(self, runs: list[Run]) -> None:
        """One new manifest. What only manifests before the last one name is deleted, so that readers of the last can end."""
        versions = self._versions()
        data = json.dumps([asdict(r) for r in runs]).encode()
        temporary, target = self._file(f"manifests/{uuid.uuid4().hex}.tmp"), self._file(f"manifests/{(versions or [0])[-1] + 1}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(data))
        out.close()
        if not self._fs.rename(temporary, target):
            raise RuntimeError("another writer has committed to this cache")
        if len(versions) > 1:
            kept = {r.name for r in runs} | {r.name for r in self._load(versions[-1])}
            for old in versions[:-1]:
                for run in self._load(old):
                    if run.name not in kept:
                        self._fs.delete(self._file(f"runs/run={run.name}"), True)
                        self._fs.delete(self._file(f"filters/run={run.name}"), True)
                self._fs.delete(self._file(f"manifests/{old}.json"), False)

    # --- writing ---
    def _write(self, entries: DataFrame, level: int, first: int, last: int) -> Run | None:
        """Entries (cache_key, output, batch) as a run, the greatest output of a key; None without any.

        They are dealt by bucket once; inside a bucket one sort serves both the choice and the file.
        """
        name = f"{last}-{level}-{uuid.uuid4().hex[:12]}"
        files = f"{self.path}/runs/run={name}"
        dealt = entries.withColumn("bucket", bucket()).repartition("bucket").groupBy("bucket", "cache_key").agg(
            F.max("output").alias("output"), F.max("batch").alias("batch")
        )
        writer = dealt.sortWithinPartitions("bucket", "cache_key").write.partitionBy("bucket").option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#cache_key", "true").parquet(files)
        keys = self.spark.read.schema(STORED).parquet(files).select("cache_key")
        found = keys.agg(F.count("*").alias("n"), F.min("cache_key").alias("least"), F.max("cache_key").alias("greatest")).first()
        if not found["n"]:
            return None
        if filtered := found["n"] <= FILTER_KEYS:
            bits = keys.select(F.explode(_places()).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
            words = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
            words.coalesce(1).write.parquet(f"{self.path}/filters/run={name}")
        return Run(name, level, first, last, found["n"], found["least"], found["greatest"], filtered)

    def _compacted(self, runs: list[Run]) -> list[Run]:
        level = 0
        while any(r.level >= level for r in runs):
            own = [r for r in runs if r.level == level]
            if len(own) >= FAN:
                rest = [r for r in runs if r.level != level]
                merged = self._write(self._newest(own), level + 1, min(r.first for r in own), max(r.last for r in own))
                runs = [*rest, *([merged] if merged else [])]
            level += 1
        return runs

    def put(self, puts: DataFrame, batch: int) -> None:
        """Adds the entries of a batch: (cache_key, output); outputs are stored as JSON text."""
        runs = [r for r in self.runs() if (r.first, r.last) != (batch, batch)]
        if any(r.first <= batch <= r.last for r in runs):
            return  # merged already: later batches have been added since
        entries = puts.filter(valid_key()).select(
            "cache_key", F.to_json("output").alias("output"), F.lit(batch).cast("long").alias("batch")
        )
        added = self._write(entries, 0, batch, batch)
        self._commit(self._compacted(runs) + ([added] if added else []))

    # --- reading ---
    def _newest(self, runs: list[Run], wanted: Column | None = None) -> DataFrame:
        """Last writer per key of some runs. Batches of runs do not overlap, so the greatest batch decides."""
        if not runs:
            return self.spark.createDataFrame([], "cache_key string, output string, batch long")
        paths = [f"{self.path}/runs/run={r.name}" for r in runs]
        stored = self.spark.read.schema(STORED).option("basePath", f"{self.path}/runs").parquet(*paths)
        stored = stored.filter(wanted) if wanted is not None else stored
        if len(runs) == 1:  # one entry a key
            return stored.select("cache_key", "output", "batch")
        newest = stored.groupBy("cache_key").agg(F.max("batch").alias("batch"))
        return stored.select("cache_key", "output", "batch").join(newest, ["cache_key", "batch"], "left_semi")

    def _candidates(self, runs: list[Run], keys: DataFrame) -> tuple[list[Run], list[int]]:
        """Runs that may hold one of the keys, and the buckets of the keys."""
        facts = keys.agg(F.min("cache_key").alias("least"), F.max("cache_key").alias("greatest"), F.collect_set(bucket()).alias("buckets")).first()
        if facts["least"] is None:
            return [], []
        runs = [r for r in runs if r.least <= facts["greatest"] and facts["least"] <= r.greatest]
        filtered = [r for r in runs if r.filtered]
        if not filtered:
            return runs, facts["buckets"]
        paths = [f"{self.path}/filters/run={r.name}" for r in filtered]
        words = self.spark.read.schema(WORDS).option("basePath", f"{self.path}/filters").parquet(*paths)
        bits = keys.select("cache_key", F.explode(_places()).alias("at")).withColumn("word", F.shiftright("at", 6))
        set_ = F.expr("(shiftright(bits, cast(at & 63 as int)) & 1) = 1")
        hits = bits.join(words, "word").filter(set_).groupBy("run", "cache_key").agg(F.count("*").alias("n"))
        # No more rows than runs, of which there are as many as digits of the number of batches.
        passed = {r["run"] for r in hits.filter(F.col("n") == FILTER_TESTS).select("run").distinct().collect()}
        return [r for r in runs if not r.filtered or r.name in passed], facts["buckets"]

    def entries(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """(cache_key, output), last writer per key; unreadable entries are left out and so count as misses.

        With ``keys`` (cache_key) what can hold none of them is not read; entries of other keys may still be
        among the result. With ``before`` only entries of earlier batches count.
        """
        runs = [r for r in self.runs() if before is None or r.last < before]
        wanted = None
        if keys is not None:
            keys = keys.filter(valid_key()).select("cache_key").distinct()
            runs, buckets = self._candidates(runs, keys)
            wanted = F.col("bucket").isin(buckets)
        return self._newest(runs, wanted).select("cache_key", F.from_json("output", ANALYSIS).alias("output")).filter(
            F.col("output.pipeline_version").isNotNull()
        )


@dataclass(frozen=True)
class CacheView:
    """A cache as it stood before a batch, looked up by key."""

    log: CacheLog
    before: int | None = None

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        return self.log.entries(keys, self.before)


