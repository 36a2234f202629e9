"""Raw site records: flattening, capping, filtering, normalizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import casts
from ..functions.core import empty_array, let
from ..functions.urls import http_url

ENTRIES = "array<variant>"
OPENED = f"struct<entries: {ENTRIES}>"
NODES = f"array<struct<path: array<int>, node: variant, opened: {OPENED}>>"
#: So many levels are opened before anything is counted.
FIRST_LEVELS = 16


def _opened(node: Column) -> Column:
    """A node's child list, null unless ``entries`` is a list; as a whole null unless the node is an object.

    One look at a node answers both, and builds nothing but the children.
    """
    return F.try_variant_get(node, "$", OPENED)


def _leaves(record: Column) -> Column:
    """All leaves of a record with their positions: array<struct<path, node, opened>>.

    A work list inside the row: every step opens all nodes that hold a list, and puts what holds none aside.
    It takes as many steps as the record is deep. A record still open after the first levels has no more levels below than
    its open nodes have lists; only then are these counted.
    """

    def node(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("node"), _opened(value).alias("opened"))

    def children(x: Column) -> Column:
        placed = F.transform(x["opened"]["entries"], lambda n, i: node(F.concat(x["path"], F.array(i)), n))
        return F.filter(placed, lambda c: c["opened"].isNotNull())

    def holds(x: Column) -> Column:
        return x["opened"]["entries"].isNotNull()

    def sorted_out(nodes: Column, done: Column) -> Column:
        return F.struct(
            F.filter(nodes, holds).cast(NODES).alias("open"),
            F.concat(done, F.filter(nodes, lambda x: ~holds(x))).cast(NODES).alias("done"),
        )

    def step(state: Column, _: Column) -> Column:
        found = let(F.flatten(F.transform(state["open"], children)), lambda nodes: sorted_out(nodes, state["done"]))
        return F.when(F.size(state["open"]) == 0, state).otherwise(found)

    def rest(state: Column) -> Column:
        # Strings have their quotes escaped, so only keys are counted.
        text = F.to_json(F.transform(state["open"], lambda x: x["node"]))
        lists = F.sequence(F.lit(1), F.regexp_count(text, F.lit('"entries"')))
        more = F.aggregate(lists, state, step, lambda s: s["done"])
        return F.when(F.size(state["open"]) == 0, state["done"]).otherwise(more)

    root = F.array(node(empty_array("int"), record)).cast(NODES)
    start = let(root, lambda nodes: sorted_out(nodes, F.array().cast(NODES)))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_LEVELS)), start, step), rest)


def flatten_entries(records: DataFrame, record: str = "record") -> DataFrame:
    """Replaces each record by its leaves, depth first; adds ``path`` (positions
    from the root), whose order is the order of the leaves.

    All work is inside the row, at any depth, so nothing is shuffled, the input is read once, and every
    value stays the VARIANT it was parsed to.
    """
    others = [c for c in records.columns if c != record]
    found = records.filter(F.col(record).isNotNull()).select(*others, F.explode(_leaves(F.col(record))).alias("_leaf"))
    return found.select(*others, F.col("_leaf.path").alias("path"), F.col("_leaf.node").alias(record))


def cap_items(items: DataFrame, cap: Column | int, *order: str) -> DataFrame:
    """First ``cap`` items per request. Compared with a literal the rank filter
    is applied before the shuffle too (window group limit), so that a request
    with very many items sends only ``cap`` rows per task."""
    window = Window.partitionBy("request_id").orderBy(*order)
    ranked = items.withColumn("item_no", F.row_number().over(window))
    return ranked.filter(F.col("item_no") <= cap)


def duration_ok(duration: Column, maximum: Column | int) -> Column:
    """Unknown durations pass."""
    return F.coalesce(duration <= maximum, F.lit(True))


def record_duration_ok(record: Column, maximum: Column | int) -> Column:
    return duration_ok(casts.number(casts.field(record, "duration")), maximum)


def original_images(extractor: Column, thumbnails: Column, cover: Column) -> Column:
    """struct<thumbnails, thumbnail>: for one extractor keep only originals, cover = last
    kept; everything stays when none is marked."""
    kept = F.filter(thumbnails, lambda t: F.lower(t["url"]).contains(fixed.ORIGINAL_IMAGE_MARK))
    apply = (F.lower(extractor) == fixed.ORIGINAL_IMAGE_EXTRACTOR) & (F.size(kept) > 0)
    return F.struct(
        F.when(apply, kept).otherwise(thumbnails).alias("thumbnails"),
        F.when(apply, F.element_at(kept, -1)["url"]).otherwise(cover).alias("thumbnail"),
    )


def record_cover(record: Column) -> Column:
    """Cover address of a raw record after the original-image rule."""
    field = casts.field
    thumbs = F.transform(
        F.try_variant_get(record, "$.thumbnails", ENTRIES),
        lambda t: F.struct(F.try_variant_get(t, "$.url", "string").alias("url")),
    )
    plain = casts.web_address(field(record, "thumbnail"))
    extractor = F.try_variant_get(record, "$.extractor_key", "string")
    chosen = original_images(F.coalesce(extractor, F.lit("")), thumbs, plain)["thumbnail"]
    return F.when(thumbs.isNull(), plain).otherwise(http_url(chosen))


def record_source_url(record: Column, source_url: Column) -> Column:
    return F.coalesce(
        F.when(source_url != "", source_url), casts.any_text(casts.field(record, "webpage_url")), F.lit("")
    )


def record_media_id(record: Column, source_url: Column) -> Column:
    return F.coalesce(
        casts.any_text(casts.field(record, "id")),
        F.left(F.sha2(record_source_url(record, source_url), 256), F.lit(24)),
    )


def record_extractor(record: Column) -> Column:
    return F.coalesce(
        casts.any_text(casts.field(record, "extractor_key")),
        casts.any_text(casts.field(record, "extractor")),
        F.lit("unknown"),
    )


def normalize_media_info(record: Column, source_url: Column) -> dict[str, Column]:
    """The 15 columns of a normalized record."""
    field = casts.field
    return {
        "source_url": record_source_url(record, source_url),
        "webpage_url": casts.web_address(field(record, "webpage_url")),
        "extractor": record_extractor(record),
        "media_id": record_media_id(record, source_url),
        "title": casts.text(field(record, "title"), 2_000),
        "description": casts.text(field(record, "description"), 20_000),
        "uploader": casts.text(field(record, "uploader"), 1_000),
        "uploader_id": casts.text(field(record, "uploader_id"), 1_000),
        "upload_date": casts.upload_date(field(record, "upload_date")),
        "duration_seconds": casts.number(field(record, "duration")),
        "thumbnail_url": record_cover(record),
        "view_count": casts.integer(field(record, "view_count")),
        "like_count": casts.integer(field(record, "like_count")),
        "repost_count": casts.integer(field(record, "repost_count")),
        "comment_count": casts.integer(field(record, "comment_count")),
    }
