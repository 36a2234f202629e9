import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mediasift.llm.packing import pack
from mediasift.llm.token_files import token_digests, write_tokens
from mediasift.llm.tokens import Encoder, vocabulary
from mediasift.session import work_dir

NAMES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
CASES = [(Encoder(vocabulary(name), spaced), Tokenizer.from_file(vocabulary(name))) for name, spaced in NAMES.items()]
PIECES = st.sampled_from(
    [" ", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", chr(0x2003), chr(0x3000), "\0", "a", "Word", "it's", "'ll",
     ".", ",", "!?", "12", "3", "é", "É", "e" + chr(0x301), chr(0x301), "ß", "ΑΣ", "İ", chr(0x958), "<|endoftext|>", "<|startoftext|>", "<|", "中文", "🙂",
     chr(0x200B)]
)


def plain(tool, texts, end):
    return [[*x.ids, end] for x in tool.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("encoder, tool", CASES)
@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=4))
def test_chunks_encode_as_in_the_text(encoder, tool, texts):
    assert [x.tolist() for x in encoder.encode(texts, 7)] == plain(tool, texts, 7)


@pytest.mark.parametrize("encoder, tool", CASES)
def test_every_character_before_a_mark(encoder, tool):
    texts = [f"a{chr(i)}{mark} {chr(i)}{mark}b {chr(i)}" for i in range(1, 0x32000) if not 0xD800 <= i < 0xE000 for mark in ".,"]
    for low in range(0, len(texts), 50_000):
        some = texts[low : low + 50_000]
        got, want = [x.tolist() for x in encoder.encode(some, 7)], plain(tool, some, 7)
        assert [t for t, a, b in zip(some, got, want, strict=True) if a != b] == []


def test_special_names_are_what_the_library_takes_them_for():
    assert [x.tolist() for x in CASES[0][0].encode(["a <|endoftext|> b"], 1)] == [[64, 220, 50256, 275, 1]]
    assert plain(CASES[0][1], ["a <|endoftext|> b"], 1) == [[64, 220, 50256, 275, 1]]


def test_cache_is_bounded():
    encoder = Encoder(vocabulary("byte_bpe_50k.json"), True, cached=5)
    for i in range(50):
        (ids,) = encoder.encode([f"word{i} other{i}"], 1)
        assert ids.dtype == np.dtype("<u2")
        assert len(encoder.known) <= 7
    assert [x.tolist() for x in encoder.encode([None, ""], 1)] == [[1], [1]]


def test_operators_against_the_library(spark):
    texts = [None, "", "a <|endoftext|> b", "İ. x", "two  blanks\n\nand   three \n", "Word, word. WORD", "long text " * 30_000]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, ids string")
    wide = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    folder = work_dir(spark, "test-orc")
    write_tokens(docs, folder)
    want = [wide(x) for x in plain(CASES[1][1], [t or "" for t in texts], 2)]
    assert [r["ids_crc32"] for r in sorted(token_digests(spark, folder).collect())] == want
    ids = plain(CASES[0][1], [t or "" for t in texts], 1)
    for r in pack(docs).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == wide(own[r["start"] : r["start"] + r["length"]])
