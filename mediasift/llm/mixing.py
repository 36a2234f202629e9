"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

A source's documents, in the order of a hash, are a stream of words cut into
blocks. A source's target in words says how many whole passes over its stream and
how much of one more the mix takes: an exact quota of blocks. A binary tree over the
output shards splits the quotas: at each node the left half's share of every
source is a draw from the multivariate hypergeometric distribution, as if all
blocks had been shuffled together, without listing them. Each leaf then owns its
ranks of each source's permuted blocks, no block twice, and orders its documents by a hash.

Everything is DataFrame functions. Only the number of documents and of blocks come
to the driver. Texts meet in no group: a source's running word count goes by hash buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import let
from .common import WORD, source_key, written

BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 64
#: Documents of a bucket, on average; a bucket's running sum is one window.
BUCKET_ROWS = 4_000
SEED = 7
MOST = 3
#: A draw is looked for within so many standard deviations; beyond lies less than 1e-30.
REACH = 12


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*keys: Column) -> Column:
    """A number inside (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _prepared(docs: DataFrame, n_docs: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of a document in one struct, ``row``, beside size, queue (source key), order hash, tie and
    bucket, so that no column of the documents meets a name of this module. Order and bucket follow id and text: rows
    without id, or with one id, fall apart unless they are equal."""
    buckets = max(1, -(-n_docs // BUCKET_ROWS))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{SEED}:"), text("doc_id"), F.lit(":"), text("text")).cast("binary"))
    lead = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), words_of(F.col("text")).alias("_size"),
        source_key(F.col("source")).alias("_queue"), order.alias("_order"), F.xxhash64("text").alias("_tie"),
    ).withColumn("_bucket", F.shiftright(lead * F.lit(buckets), 32))


def quotas(sums: DataFrame, block_words: int) -> DataFrame:
    """One row per source: place, target, passes over all its words, rest in words, blocks of a pass, quota.

    ``sums``: source key and words. Weights 1, 2, 3 repeat in code-point order,
    null last. A source whose share exceeds ``MOST`` times its words gets
    that; the others share what is left by weight. In ascending order of the
    limit per weight, a source is limited iff its share, with all before it limited, exceeds its limit.
    """
    sources = sums.groupBy("_queue").agg(F.sum("n").alias("w"))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy("_queue")))
    placed = placed.withColumn("weight", (F.col("place") - 1) % 3 + 1)
    # MOST * words / weight in sixths, so that it stays whole.
    by_limit = Window.orderBy(F.expr(f"w * {MOST} * (6 div weight)"), "place")
    everything = Window.partitionBy()
    shared = placed.withColumns(
        {
            "total": F.sum("w").over(everything),
            "limited_before": F.coalesce(
                F.sum(F.col("w") * MOST).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
            ),
            "weights_from": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn(
        "limited", (F.col("total") - F.col("limited_before")) * F.col("weight") > F.col("w") * MOST * F.col("weights_from")
    )
    left = shared.withColumns(
        {
            "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("w") * MOST)).over(everything), F.lit(0)),
            "sharing": F.coalesce(F.sum(F.when(~F.col("limited"), F.col("weight"))).over(everything), F.lit(0)),
        }
    )
    target = F.when(F.col("limited"), (F.col("w") * MOST).cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / F.col("sharing")
    )
    out = left.select("_queue", "place", F.col("w").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"))
    want = F.round("target").cast("long")
    some = F.col("source_size") > 0
    return (
        out.withColumns(
            {
                "passes": F.when(some, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).cast("long"),
                "more": F.when(some, want % F.col("source_size")).otherwise(0).cast("long"),
                "blocks": F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"),
            }
        )
        .withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("more") / F.lit(block_words)).cast("long"))
    )


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` items from a population are marked, by inversion at ``u``."""
    f = F.lit

    def at_bounds(bounds: Column) -> Column:
        low, high = bounds["low"], bounds["high"]

        def step(x: Column) -> Column:
            """log of p(x) / p(x - 1)"""
            ways = (marked - x + 1).cast("double") * (draws - x + 1).cast("double")
            return F.when(x == low, f(0.0)).otherwise(
                F.log(ways) - F.log(x.cast("double") * (population - marked - draws + x).cast("double"))
            )

        def add(acc: Column, x: Column) -> Column:
            log = acc["log"] + step(x)
            top = F.greatest(acc["top"], log)
            return F.struct(
                log.alias("log"), top.alias("top"),
                (acc["sum"] * F.exp(acc["top"] - top) + F.exp(log - top)).alias("sum"),
            )

        start = F.struct(f(0.0).alias("log"), f(0.0).alias("top"), f(0.0).alias("sum"))
        places = F.sequence(low, high)

        def look(total: Column) -> Column:
            def walk(acc: Column, x: Column) -> Column:
                log = acc["log"] + step(x)
                sum_ = acc["sum"] + F.exp(log - total["top"])
                found = F.coalesce(acc["found"], F.when(sum_ >= u * total["sum"], x))
                return F.struct(log.alias("log"), sum_.alias("sum"), found.alias("found"))

            empty = F.struct(f(0.0).alias("log"), f(0.0).alias("sum"), f(None).cast("long").alias("found"))
            return F.aggregate(places, empty, walk, lambda acc: F.coalesce(acc["found"], high))

        return let(F.aggregate(places, start, add), look)

    share = marked / F.greatest(population, f(1))
    spread = F.sqrt(
        draws * share * (f(1.0) - share) * (population - draws) / F.greatest(population - 1, f(1))
    )
    low = F.greatest(f(0), draws - population + marked, F.floor(draws * share - spread * REACH - 1)).cast("long")
    high = F.least(marked, draws, F.ceil(draws * share + spread * REACH + 1)).cast("long")
    return let(F.struct(F.least(low, high).alias("low"), high.alias("high")), at_bounds)


def _halves() -> Column:
    """The two halves of a node with ``lo``, ``hi`` and ``counts``, with their blocks of every source."""
    lo, hi = F.col("lo"), F.col("hi")
    middle = F.expr("lo + (hi - lo) div 2")

    def draw(state: Column, marked: Column) -> Column:
        u = _uniform(F.lit(SEED), lo, hi, F.size(state["left"]))
        return let(
            hypergeometric(state["population"], marked, state["draws"], u),
            lambda n: F.struct(
                (state["population"] - marked).alias("population"), (state["draws"] - n).alias("draws"),
                F.concat(state["left"], F.array(n)).alias("left"),
            ),
        )

    def split(total: Column) -> Column:
        share = F.floor(total * (middle - lo) / (hi - lo)).cast("long")
        start = F.struct(total.alias("population"), share.alias("draws"), F.array().cast("array<bigint>").alias("left"))
        return let(
            F.aggregate("counts", start, draw, lambda s: s["left"]),
            lambda left: F.array(
                F.struct(lo.alias("lo"), middle.alias("hi"), left.alias("counts")),
                F.struct(middle.alias("lo"), hi.alias("hi"), F.zip_with("counts", left, lambda x, y: x - y).alias("counts")),
            ),
        )

    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(hi - lo > 1, let(total, split)).otherwise(F.array(F.struct("lo", "hi", "counts")))


def splitting_tree(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: ``lo`` its number, ``counts`` its blocks of every source.

    ``counts`` is one row with the quotas. A level of the tree is one projection; every
    node draws its left half's blocks, source by source, from what is not drawn yet.
    """
    tree = counts.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts")
    for level in range(max(0, (shards - 1).bit_length())):
        tree = tree.select(F.inline(_halves()))
        if level % 8 == 7:
            tree = tree.repartition("lo")
    return tree.select("lo", "counts")


def _coprime(n: Column, key: Column) -> Column:
    """A multiplier below n without common divisor: i -> i * it mod n is a permutation."""

    def divisor(x: Column) -> Column:
        pair = F.struct(x.alias("a"), n.alias("b"))
        turn = lambda s, _: F.when(s["a"] == 0, s).otherwise(F.struct((s["b"] % s["a"]).alias("a"), s["a"].alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(96)), pair, turn, lambda s: s["b"])

    tries = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.pmod(F.xxhash64(F.lit(SEED), key, j), n) + 1)
    return F.coalesce(F.get(F.filter(tries, lambda x: divisor(x) == 1), F.lit(0)), F.lit(1).cast("long"))


def drawn_blocks(sources: DataFrame, tree: DataFrame) -> DataFrame:
    """Every block that a shard takes: place of the source, pass, block, shard."""
    each = tree.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("i", "n"))
    until = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = each.withColumn("until", F.sum("n").over(until)).filter("n > 0")
    ranks = ranges.select("shard", (F.col("i") + 1).alias("place"), F.explode(F.expr("sequence(until - n, until - 1)")).alias("rank"))
    spin = sources.filter("quota > 0").select("place", "blocks", "quota", _coprime(F.col("quota"), F.col("place")).alias("turn"))
    item = (F.col("rank") * F.col("turn") + F.col("place")) % F.col("quota")
    return ranks.join(spin, "place").select("place", item.alias("item"), "blocks", "shard").select(
        "place", F.expr("item div blocks").alias("pass"), (F.col("item") % F.col("blocks")).alias("block"), "shard"
    )


def copies(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, keep: list[str] | None = None
) -> DataFrame:
    """Every document once per copy that the mix takes: ``row`` with its columns (or those named in ``keep``), ``_words``
    of it, ``_shard`` and ``_key`` to order a shard by.

    Documents without a copy stay, once, with a null shard and no words. A null text has no words, a null
    source is a source of its own; null ids spread by their texts. Repeated rows are documents of their own; which of
    equal rows comes first makes no difference. Very long texts are documents of many words; an empty table gives no rows. Reruns agree.

    There is one row for each source where quotas are found and the tree is built: sources are names of data sets.
    """
    rows = _prepared(docs, docs.count(), keep or docs.columns)
    sums = written(rows.groupBy("_queue", "_bucket").agg(F.sum("_size").alias("n")), "mix-sums")
    sources = written(quotas(sums, block_words), "mix-quotas")
    n_blocks = sources.agg(F.sum("quota")).first()[0] or 0
    counts = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"]).alias("counts"))
    tree = splitting_tree(counts, max(1, -(-n_blocks // shard_blocks)))
    blocks = written(drawn_blocks(sources, tree), "mix-blocks")

    earlier = Window.partitionBy("_queue").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_queue", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("_base"))
    inside = Window.partitionBy("_queue", "_bucket").orderBy("_order", "_size", "_tie")
    before = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    names = {c: f"_{c}" for c in ("place", "source_size", "target", "passes", "more")}
    wide = sources.select("_queue", *(F.col(c).alias(n) for c, n in names.items()))
    placed = (
        rows.join(bases, ["_queue", "_bucket"])
        .withColumns({"_at": F.col("_base") + F.coalesce(before, F.lit(0)), "_row": F.row_number().over(inside)})
        .join(wide, "_queue")
    )
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_more") - F.col("_at")))
    taken = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_passes")),
        lambda p: F.struct(p.alias("_pass"), F.when(p < F.col("_passes"), F.col("_size")).otherwise(part).alias("_words")),
    )
    each = placed.select("*", F.inline_outer(F.filter(taken, lambda c: c["_words"] > 0)))
    each = each.withColumn("_block", F.expr(f"_at div {block_words}"))
    drawn = blocks.toDF("_place", "_pass", "_block", "_shard")
    key = F.xxhash64(F.lit(SEED), "_shard", "_pass", "_queue", "_at", "_row")
    return each.join(drawn, ["_place", "_pass", "_block"], "left").withColumn("_key", key)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: columns of ``docs``, a row per copy, shard by shard in shuffled order.

    Of a document that is taken in part, its first words with all that stands between them.
    """
    rows = copies(docs).filter(F.col("_shard").isNotNull())
    text, words, whole = F.col("row")["text"], F.col("_words").cast("int"), F.col("_words") == F.col("_size")
    parts = F.split(text, rf"(?<={WORD[:-1]})(?=[\x20\x09-\x0D])", words + 1)
    row = F.col("row").withField("text", F.when(whole, text).otherwise(F.array_join(F.slice(parts, F.lit(1), words), "")))
    rows = rows.withColumn("_row", row)
    if "n_chars" in docs.columns:
        n_chars = F.when(whole, F.col("row")["n_chars"]).otherwise(F.length(F.col("_row")["text"]))
        rows = rows.withColumn("_row", F.col("_row").withField("n_chars", n_chars.cast(dict(docs.dtypes)["n_chars"])))
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_key").select("_row.*")


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (the words of its copies) and shards (where they are)."""
    drawn = F.when(F.col("_shard").isNotNull(), F.col("_words")).otherwise(0)
    return (
        copies(docs, block_words, shard_blocks, ["doc_id"])
        .groupBy("_queue", "_bucket", "_row", F.col("row")["doc_id"].cast("long").alias("doc_id"))
        .agg(
            F.first("_size").alias("size"), F.first("_source_size").alias("source_size"),
            F.first("_target").alias("target"), F.sum(drawn).cast("long").alias("taken"),
            F.sort_array(F.collect_list("_shard")).alias("shards"),  # one for each copy
        )
        .drop("_queue", "_bucket", "_row")
    )


#: All but the shards: the order of the hash says which documents one more pass takes.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), p AS (
  SELECT *, (place - 1) % 3 + 1 AS weight FROM s
), q AS (
  SELECT *, CAST(sum(w) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(3 * w) OVER (ORDER BY 3 * w * (6 // weight), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(weight) OVER (ORDER BY 3 * w * (6 // weight), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM p
), l AS (
  SELECT *, (total - before) * weight > 3 * w * weights AS limited FROM q
), r AS (
  SELECT *, total - CAST(coalesce(sum(CASE WHEN limited THEN 3 * w END) OVER (), 0) AS BIGINT) AS rest,
    CAST(coalesce(sum(CASE WHEN NOT limited THEN weight END) OVER (), 0) AS BIGINT) AS sharing
  FROM l
), t AS (
  SELECT source, w, CASE WHEN limited THEN CAST(3 * w AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(sharing AS DOUBLE) END AS target FROM r
), o AS (
  SELECT doc_id, source, size,
    CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM d
)
SELECT doc_id, size, w AS source_size, target,
  CASE WHEN w = 0 THEN 0 ELSE CAST(CAST(round(target) AS BIGINT) // w * size
    + greatest(0, least(size, CAST(round(target) AS BIGINT) % w - begins)) AS BIGINT) END AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
