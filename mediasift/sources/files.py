"""Files as tables."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.media import guess_media_type
from ..session import work_dir

LISTED = "path string, size_bytes long, modified long, is_regular boolean, folder boolean"
#: Rows of a listing handed on together.
TOGETHER = 10_000


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                yield e.path, 0, 0, False, True
            # A link to a file is listed, but is not regular; other links and devices are left out.
            elif e.is_file() and PurePosixPath(e.name).suffix != ".part":
                found = e.stat()
                yield e.path, found.st_size, found.st_mtime_ns // 1_000_000, not e.is_symlink(), False


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in LISTED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    for batch in batches:
        for folder in batch["path"].to_pylist():
            entries = list(_entries(folder))
            for at in range(0, len(entries), TOGETHER):
                columns = zip(*entries[at : at + TOGETHER], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path, regular in zip(batch["path"].to_pylist(), batch["is_regular"].to_pylist(), strict=True):
            if not regular:
                hashes.append(None)
                continue
            with open(path, "rb") as file:
                hashes.append(hashlib.file_digest(file, "sha256").hexdigest())
        yield batch.set_column(batch.schema.names.index("sha256"), "sha256", pa.array(hashes, pa.string()))


def _known_hashes(listed: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds ``sha256`` of files that an earlier table (path, size_bytes, modified, sha256) has with this size and time."""
    if known is None:
        return listed.withColumn("sha256", F.lit(None).cast("string"))
    old = known.select("path", F.col("size_bytes").alias("_size"), F.col("modified").alias("_modified"), F.col("sha256").alias("_sha256"))
    same = (F.col("size_bytes") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    return listed.join(old, "path", "left").select(*listed.columns, F.when(same, F.col("_sha256")).alias("sha256"))


def _local_files(spark: SparkSession, root: str, known: DataFrame | None) -> DataFrame:
    """Lists level by level in tasks, each level written so that it is read once from the disk."""
    tasks = spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while not levels or not folders.isEmpty():
        path = work_dir(spark, "listing")
        folders.repartition(tasks, "path").mapInArrow(_list_folders, LISTED).write.parquet(path)
        level = spark.read.schema(LISTED).parquet(path)
        levels.append(level.filter(~F.col("folder")).drop("folder"))
        folders = level.filter("folder").select("path")
    files = _known_hashes(reduce(DataFrame.unionAll, levels), known)
    # Only files that are new or have changed are opened.
    new = files.filter(F.col("sha256").isNull()).repartition(4 * tasks, "path")
    return files.filter(F.col("sha256").isNotNull()).unionByName(new.mapInArrow(_with_digests, files.schema))


def _stored_files(spark: SparkSession, fs, root, known: DataFrame | None) -> DataFrame:
    """Files of a store that only Spark reads: listed by its driver. Empty files and names that Spark's file
    source does not list are hashed there too, all others in tasks, where a file must fit in one row (2 GiB)."""
    jvm, rows, folders = spark._jvm, [], [(root, False)]
    while folders:
        folder, above = folders.pop()
        for status in fs.listStatus(folder):
            path = status.getPath()
            name = path.getName()
            hidden = above or name.startswith(("_", ".")) or name.endswith("._COPYING_")
            if status.isDirectory():
                folders.append((path, hidden))
            elif PurePosixPath(name).suffix != ".part":
                digest = None
                if not status.isSymlink() and (hidden or status.getLen() == 0):
                    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
                    stream = jvm.java.security.DigestInputStream(fs.open(path), sha)
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 16, True)
                    digest = bytes(sha.digest()).hex()
                rows.append((path.toString(), status.getLen(), status.getModificationTime(), not status.isSymlink(), digest))
    listed = spark.createDataFrame(rows, "path string, size_bytes long, modified long, is_regular boolean, digest string")
    listed = _known_hashes(listed, known)
    wanted = [root.toString()]
    if known is not None:
        new = listed.filter("sha256 IS NULL AND digest IS NULL AND is_regular").select("path").collect()
        # The listing is here anyway; a path with signs of a pattern cannot be named alone.
        if not any(set("*?[]{}\\\\") & set(r["path"]) for r in new):
            wanted = [r["path"] for r in new]
    if not wanted:
        return listed.drop("digest").select("path", "size_bytes", "modified", "is_regular", "sha256")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted)
    hashed = read.select("path", F.sha2("content", 256).alias("_hash"))
    return listed.join(hashed, "path", "left").select(
        "path", "size_bytes", "modified", "is_regular",
        F.when(F.col("is_regular"), F.coalesce("sha256", "digest", "_hash")).alias("sha256"),
    )


def _files(spark: SparkSession, directory: str, known: DataFrame | None) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(root)
    if root.toUri().getScheme() == "file":
        return _local_files(spark, root.toUri().getPath(), known)
    return _stored_files(spark, fs, root, known)


def snapshot(spark: SparkSession, directory: str, known: DataFrame | None = None) -> DataFrame:
    """path, size_bytes, modified (milliseconds), is_regular and sha256 of every file and every link to one.

    With the snapshot of an earlier scan as ``known``, files of the same path, size and time keep their hash unread.
    """
    return _files(spark, directory, known).select("path", "size_bytes", "modified", "is_regular", "sha256")


def scan_artifacts(spark: SparkSession, directory: str, known: DataFrame | None = None) -> DataFrame:
    """Every regular file below a folder except ``.part`` files and links: path, size_bytes,
    sha256, media_type. File contents are read only when the hash column is used, and not for files that ``known``, an
    earlier snapshot, has unchanged."""
    return _files(spark, directory, known).filter("is_regular").select(
        "path", "size_bytes", "sha256", guess_media_type("path").alias("media_type")
    )


def file_table(spark: SparkSession, directory: str, known: DataFrame | None = None) -> DataFrame:
    """The same files, and links to files as not regular, in the shape manifests are verified against."""
    return _files(spark, directory, known).select("path", F.col("size_bytes").alias("length"), "sha256", "is_regular")


def scan_images(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded images: path, width, height, image, error_code (undecodable files)."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(directory)
    bad = F.col("image.width") < 1
    # The origin is an encoded address, in which a plus sign stands for itself.
    origin = F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return images.filter(~origin.endswith(".part")).select(
        origin.alias("path"),
        F.when(~bad, F.col("image.width")).alias("width"),
        F.when(~bad, F.col("image.height")).alias("height"),
        "image",
        F.when(bad, "unsupported_media").alias("error_code"),
    )
