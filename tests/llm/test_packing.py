import zlib
from collections import defaultdict

import numpy as np
import pytest

from mediasift.llm.packing import UNIT, Queues, pack
from mediasift.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, source string, sequence_id string, part int"
ROWS = [
    (1, "alpha beta gamma " * 900, "a", "x", 1), (2, "one two three. " * 300, "b", "x", 1), (3, None, "b", "x", 1),
    (4, "", None, "x", 1), (None, "no id here", None, "x", 1), (5, "repeated row", "c", "x", 1), (5, "repeated row", "c", "x", 1),
    (6, "z" * 30000, "a", "x", 1),
]


def served(totals, quanta, block):
    """Deficit round robin, step by step: (queue, block) in the order in which blocks are sent."""
    left, deficit, sent = [t // block for t in totals], [0] * len(totals), [0] * len(totals)
    out = []
    while any(left):
        for q in range(len(totals)):
            deficit[q] += quanta[q]
            while left[q] and deficit[q] >= block * UNIT:
                deficit[q] -= block * UNIT
                out.append((q, sent[q]))
                sent[q] += 1
                left[q] -= 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 2, "d": 1, "e": 3}])
def test_places_are_those_of_the_rounds(weights):
    totals = {"a": 100_000, "b": 9_000, "c": 255, "d": 0, "e": 41_234}
    queues = Queues.of(totals, weights, 256, 2048)
    order = served(queues.totals, queues.quanta, 256)
    for q in range(len(totals)):
        blocks = np.arange(queues.totals[q] // 256)
        assert queues.places(q, blocks).tolist() == [256 * order.index((q, b)) for b in blocks]


def test_windows_keep_the_shares():
    queues = Queues.of({"a": 600_000, "b": 300_000, "c": 100_000}, None, 256, 2048)
    place = np.concatenate([queues.places(q, np.arange(queues.totals[q] // 256)) for q in range(3)])
    queue = np.repeat([0, 1, 2], queues.totals // 256)
    for end in range(8, 3800, 8):
        got = np.bincount(queue[place < end * 256], minlength=3)
        assert np.abs(got - end * np.array([0.6, 0.3, 0.1])).max() <= 1.5


def test_every_id_lies_in_one_piece(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    pieces = pack(docs, sequence=512, block=64, with_ids=True).collect()
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] for p in pieces)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(sum(n for _, n in p) < 512 for p in sequences.values()) <= 1
    tool = encoder(vocabulary("byte_bpe_50k.json"), True)
    want = defaultdict(int)
    for doc_id, text, *_ in ROWS:
        (ids,) = tool.encode([text], 1)
        want[doc_id, tuple(ids.tolist())] += 1
    spread = defaultdict(list)
    for p in pieces:
        spread[p["doc_id"], p["doc_tokens"]].append(p)
    for (doc_id, ids), times in want.items():
        own = spread[doc_id, len(ids)]
        assert sum(p["length"] for p in own) == len(ids) * times
        if times == 1:
            assert sum((p["ids"] for p in sorted(own, key=lambda p: p["start"])), []) == list(ids)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
