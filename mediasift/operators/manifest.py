"""Artifact manifests: paths, files, sizes, first error per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import col, empty_array, text_array

MB = 1024 * 1024
# Checks of one artifact in the order in which they are made.
CHECKS = (
    ("invalid_artifact", fixed.MSG_MISSING_FILE),
    ("invalid_artifact", fixed.MSG_OUTSIDE_ROOT),
    ("invalid_artifact", fixed.MSG_NOT_REGULAR),
    ("invalid_artifact", fixed.MSG_SIZE),
    ("hash_mismatch", fixed.MSG_HASH),
)


def _error(rank: Column) -> Column:
    """struct<rank, code, message> of a failed check."""
    codes, messages = (text_array(c[k] for c in CHECKS) for k in (0, 1))
    return F.struct(
        rank.alias("rank"),
        F.get(codes, rank - 1).alias("code"),
        F.get(messages, rank - 1).alias("message"),
    )


def resolved_path(path: Column | str, root: str) -> Column:
    """Absolute path with ``.`` and ``..`` resolved; relative paths start at ``root``."""
    path = col(path)
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(absolute, "/"), empty_array("string"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def below_root(resolved: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (resolved == root) | resolved.startswith(root + "/")


def explode_artifacts(requests: DataFrame, *keep: str) -> DataFrame:
    """One row per artifact with its 1-based index."""
    return requests.select(
        "request_id", *keep, F.posexplode("artifacts").alias("pos", "artifact")
    ).select(
        "request_id", *keep, (F.col("pos") + 1).alias("artifact_index"), "artifact.*"
    )


def zip_positional(requests: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Pairs two arrays by position; ``length_mismatch`` marks rows of unequal length,
    whose pairs are left null."""
    same = F.size(left) == F.size(right)
    return requests.withColumns(
        {
            "length_mismatch": ~F.coalesce(same, F.lit(False)),
            out: F.when(same, F.arrays_zip(left, right)),
        }
    )


def verify_manifest(artifacts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Adds ``error`` (struct<rank, code, message>, null when fine) and ``actual_size``.

    ``artifacts``: request_id, artifact_index, path, size_bytes, sha256;
    ``files``: path, length, sha256, is_regular — one row per path. The join is
    on the resolved path; requests that name one file over and over make a
    skewed left side, which the adaptive skew join splits.
    """
    found = files.select(
        F.col("path").alias("resolved"),
        F.col("length").alias("actual_size"),
        F.lower("sha256").alias("actual_sha256"),
        F.col("is_regular"),
    )
    left = artifacts.withColumn("resolved", resolved_path("path", root))

    rank = (
        F.when(F.col("actual_size").isNull(), 1)
        .when(~below_root(F.col("resolved"), root), 2)
        .when(~F.col("is_regular"), 3)
        .when(F.col("actual_size") != F.col("size_bytes"), 4)
        .when(F.col("actual_sha256") != F.lower("sha256"), 5)
    )
    verdict = F.when(rank.isNotNull(), _error(rank))
    return left.join(found, "resolved", "left").withColumn("error", verdict)


def first_error(checked: DataFrame) -> DataFrame:
    """Per request: the first failing check in artifact order, then check order,
    and the total size.

    Index and rank are packed into one number, so that both aggregates are
    plain hash aggregates that combine before the shuffle.
    """
    place = F.col("artifact_index").cast("bigint") * 10 + F.col("error.rank")
    grouped = checked.groupBy("request_id").agg(
        F.min(place).alias("_place"), F.sum("actual_size").alias("total_size")
    )
    found = F.struct(
        F.floor(F.col("_place") / 10).cast("bigint").alias("artifact_index"),
        *[_error((F.col("_place") % 10).cast("int"))[f].alias(f) for f in ("rank", "code", "message")],
    )
    return grouped.select("request_id", F.when(F.col("_place").isNotNull(), found).alias("first"), "total_size")


def size_limits(artifacts: DataFrame, *, file_cap_mb: Column | None = None, total_cap_mb: Column) -> DataFrame:
    """Per request: ``limit_exceeded`` when one artifact or their sum is over its cap (strictly)."""
    grouped = artifacts.groupBy("request_id").agg(
        F.max("size_bytes").alias("largest"),
        F.sum("size_bytes").alias("total"),
        F.max(file_cap_mb if file_cap_mb is not None else F.lit(None).cast("bigint")).alias("file_cap"),
        F.max(total_cap_mb).alias("total_cap"),
    )
    over_file = F.coalesce(F.col("largest") > F.col("file_cap") * MB, F.lit(False))
    over_total = F.col("total") > F.col("total_cap") * MB
    return grouped.withColumns(
        {
            "error_code": F.when(over_file | over_total, "limit_exceeded"),
            "message": F.when(over_file, fixed.MSG_DOWNLOADED_FILE_SIZE).when(
                over_total, fixed.MSG_DOWNLOADED_TOTAL_SIZE
            ),
        }
    ).drop("file_cap", "total_cap")


def sorted_artifacts(artifacts: Column) -> Column:
    """A request's artifacts in path order (at most 100 by contract)."""
    return F.array_sort(
        artifacts,
        lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0),
    )
