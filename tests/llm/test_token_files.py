import zlib

import numpy as np
import pyarrow.orc as orc
from pathlib import Path

from mediasift.llm.token_files import read_tokens, token_digests, write_tokens
from mediasift.llm.tokens import encoder, vocabulary
from mediasift.session import work_dir

SCHEMA = "doc_id long, text string, ids string, part string"


def test_round_trip(spark):
    rows = [(7, "Some  Words\n", "", ""), (3, None, "", ""), (5, "", "", ""), (None, "no id", "", ""), (5, "again", "", ""), (5, "again", "", "")]
    rows += [(100 + i, f"text number {i} " * (i % 40), "", "") for i in range(500)] + [(2, "long " * 200_000, "", "")]
    folder = work_dir(spark, "test-orc")
    write_tokens(spark.createDataFrame(rows, SCHEMA), folder)
    got = sorted(token_digests(spark, folder).collect(), key=lambda r: r["start"])
    tool = encoder(vocabulary("word_bpe_49k.json"), False)
    ids = [(r[0], next(tool.encode([r[1]], 2)).astype("<u4").tobytes()) for r in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (str(d), len(b) // 4, zlib.crc32(b)) for d, b in ids
    )
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_reads_of_some_documents_use_the_metadata(spark):
    folder = work_dir(spark, "test-orc")
    write_tokens(spark.createDataFrame([(i, f"t {i}", "", "") for i in range(4000)], SCHEMA), folder)
    some = read_tokens(spark, folder).filter("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in some._jdf.queryExecution().toString()
    assert [r["n_tokens"] for r in some.collect()] == [4]
    files = [orc.ORCFile(p) for p in Path(folder.removeprefix("file:")).glob("part-*.orc")]
    assert sum(f.nrows for f in files) == 4000 and all(f.row_index_stride == 2000 for f in files if f.nrows)


def test_empty_table(spark):
    folder = work_dir(spark, "test-orc")
    write_tokens(spark.createDataFrame([], SCHEMA), folder)
    assert token_digests(spark, folder).collect() == []
    assert np.dtype("<u4").itemsize == 4
