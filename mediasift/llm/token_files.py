"""Token ids in ORC files, ordered by document id.

One row per document holds its ids as an integer array, which ORC writes as run
lengths in stripes. Row indexes keep the least and greatest document id of
each group of rows, Bloom filters its set of ids: a reader of some documents skips
files, stripes and row groups by their metadata. Stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import part_bases, written
from .tokens import encoder, forget, vocabulary

END = 2
FORMAT = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Writes the ids of each text and the end id, in ascending doc_id order over all files.

    A null text is empty. Null doc_ids come first; rows with one doc_id are
    ordered by a hash of their text, so that a doc_id with very many rows
    still spreads over files. An empty table gives files without rows, a text of any length one row.
    ``before`` is the number of ids before the document in its own file.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, tool = TaskContext.get().partitionId(), 0, encoder(path, False)
        for big in batches:
            for batch, flat, starts in tool.batches(big, end):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"], pa.array([part] * batch.num_rows, pa.int32()), pa.array(before + starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    ],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(starts[-1])

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**FORMAT).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the files; a filter on doc_id reaches indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(folder)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = read_tokens(spark, folder)
    bases = written(part_bases(files, "n_tokens", []), "file-bases")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch["ids"]
            flat = ids.values.to_numpy(zero_copy_only=True)
            offsets = ids.offsets.to_pylist()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            sizes = [b - a for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = files.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids")
    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
