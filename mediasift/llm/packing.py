"""Packing documents into sequences with a controlled mixture of sources.

Each source is a queue of tokens: its documents one after the other, cut into
blocks of ``block`` tokens. Deficit round robin serves the queues: in every
round a queue's deficit grows by its quantum, its share of a sequence, and it
sends whole blocks while the deficit covers them; what is left is carried into the
next round. The blocks sent fill the sequences one after the other, without gap.

A queue has sent ``floor(r * quantum / block)`` blocks after r rounds (or all it
has), whatever was sent before. So the place of every block follows from the
queues' totals alone: each task finds the places of its own blocks, the
deficits it starts from being those that the tasks before it leave, and no task waits
for another. The last part of each queue, shorter than a block, follows at the end.

Only token totals per (source, task) and per source leave the tasks. A source
is a name of a data set: their totals are one row each, and are the only thing collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import part_bases, source_key, written
from .tokens import encoder, forget, vocabulary

SEQUENCE = 2048
BLOCK = 256
END = 1
#: Fixed-point unit of a quantum, in parts of a token.
UNIT = 1 << 16
ROWS = 1000

TOKENS = "doc_id long, source string, queue string, part int, before long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


@dataclass(frozen=True)
class Queues:
    """Totals and quanta of the queues, in serving order."""

    names: list[str]
    totals: np.ndarray
    quanta: np.ndarray
    block: int
    sequence: int

    @classmethod
    def of(cls, totals: dict[str, int], weights: dict[str, float] | None, block: int, sequence: int) -> Queues:
        """Without weights a queue's share is its share of all tokens, so that all
        queues end together. A queue that ends early leaves its share to the others."""
        names = sorted(totals)
        sizes = np.array([totals[n] for n in names], np.int64)
        shares = np.array([(weights or totals).get(n, 0) for n in names], float)
        shares = shares / shares.sum() if shares.sum() > 0 else shares
        quanta = np.maximum(1, np.round(shares * sequence * UNIT)).astype(np.int64)
        return cls(names, sizes, quanta, block, sequence)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Blocks that each queue (column) has sent after so many rounds."""
        full, cost = self.totals // self.block, self.block * UNIT
        # No queue takes part in more rounds than it needs, which also bounds the product.
        needed = -(-full * cost // self.quanta)
        return np.minimum(full, np.minimum(rounds[:, None], needed) * self.quanta // cost)

    def places(self, queue: int, blocks: np.ndarray) -> np.ndarray:
        """Token offset in the whole output at which these blocks of a queue begin."""
        full = self.totals // self.block
        rounds = -(-(blocks + 1) * self.block * UNIT // self.quanta[queue])
        each, back = np.unique(rounds, return_inverse=True)
        before, after = self.sent(each - 1), self.sent(each)
        # Earlier rounds of all queues, and this round of the queues served before this one.
        base = before.sum(1) + (after[:, :queue] - before[:, :queue]).sum(1) - before[:, queue]
        place = (base[back] + blocks) * self.block
        tails = self.totals % self.block
        rest = full.sum() * self.block + tails[:queue].sum()
        return np.where(blocks < full[queue], place, rest)


def token_table(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Token ids of every document and where it begins in its task's part of its queue."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent, tool = TaskContext.get().partitionId(), {}, encoder(path, True)
        for big in batches:
            for batch, flat, starts in tool.batches(big, end):
                before, sizes = [], np.diff(starts)
                for queue, n in zip(batch["queue"].to_pylist(), sizes.tolist(), strict=True):
                    before.append(sent.get(queue, 0))
                    sent[queue] = before[-1] + n
                ends = pa.array((starts * flat.itemsize).astype(np.int32))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"], batch["source"], batch["queue"], pa.array([part] * len(sizes), pa.int32()),
                        pa.array(before, pa.int64()), pa.array(sizes), ids,
                    ],
                    ["doc_id", "source", "queue", "part", "before", "doc_tokens", "ids"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), source_key(F.col("source")).alias("queue"), "text"
    )
    return rows.mapInArrow(encode, TOKENS)


def _pieces(queues: Queues, queue: int, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in the document, length and place of the pieces of a document that
    begins at ``start`` of its queue. Neighbours in the output are one piece."""
    block, sequence = queues.block, queues.sequence
    blocks = np.arange(start // block, (start + size - 1) // block + 1)
    lows = np.maximum(blocks * block, start)
    highs = np.minimum((blocks + 1) * block, start + size)
    places = queues.places(queue, blocks) + lows - blocks * block
    # The short ends of the queues stand one after the other and may cross a sequence.
    cut = sequence - places % sequence
    if (over := highs - lows > cut).any():
        lows, highs, places = (
            np.concatenate([lows, lows[over] + cut[over]]),
            np.concatenate([np.where(over, lows + cut, highs), highs[over]]),
            np.concatenate([places, places[over] + cut[over]]),
        )
    first = np.ones(len(lows), bool)
    first[1:] = (highs[:-1] != lows[1:]) | (places[1:] - places[:-1] != lows[1:] - lows[:-1]) | (places[1:] % sequence == 0)
    at = np.flatnonzero(first)
    ends = highs[np.append(at[1:] - 1, len(highs) - 1)]
    return lows[at] - start, ends - lows[at], places[at]


def pack(
    docs: DataFrame,
    path: str | None = None,
    weights: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    block: int = BLOCK,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents (doc_id, text, source) with their place in the sequences.

    A null text is empty: its document is the end id alone. A null source is a
    queue of its own, served last. Null or repeated doc_ids are documents as any
    other: each row is packed once. Further columns are ignored. An empty
    table gives no piece. Very long texts are cut into blocks as all others. Only the last sequence is shorter
    than ``sequence``. Which of two rows that are equal goes first follows from the order they are read in.
    ``weights`` maps sources to shares; ``with_ids`` adds each piece's ids.
    """
    if sequence % block:
        raise ValueError("block must divide sequence")
    tokens = written(token_table(docs, path or vocabulary("byte_bpe_50k.json")), "tokens")
    bases = written(part_bases(tokens, "doc_tokens", ["queue"]), "token-bases")
    totals = {r["queue"]: r["n"] for r in tokens.groupBy("queue").agg(F.sum("doc_tokens").alias("n")).collect()}
    named = None if weights is None else {"0" + k if k is not None else "1": v for k, v in weights.items()}
    queues = Queues.of(totals, named, block, sequence)
    number = {name: i for i, name in enumerate(queues.names)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                of, starts, sizes, crcs, parts, kept = [], [], [], [], [], []
                rows = zip(batch["queue"].to_pylist(), batch["start"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"], strict=True)
                for i, (queue, begin, n, ids) in enumerate(rows):
                    raw = ids.as_buffer()
                    wide = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4")
                    low, length, spot = _pieces(queues, number[queue], begin, n)
                    of.append(np.full(len(low), i))
                    starts.append(low)
                    sizes.append(length)
                    parts.append(spot)
                    for a, b in zip(low.tolist(), (low + length).tolist(), strict=True):
                        crcs.append(zlib.crc32(wide[a:b]))
                        if with_ids:
                            kept.append(wide[a:b].astype(np.int32))
                if not of:
                    continue
                of, spot = pa.array(np.concatenate(of)), np.concatenate(parts)
                columns = [
                    batch["doc_id"].take(of), batch["source"].take(of),
                    pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes)), pa.array(crcs, pa.int64()),
                    batch["doc_tokens"].take(of), pa.array(spot // sequence), pa.array(spot % sequence),
                ]
                names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    start: Column = F.col("base") + F.col("before")
    return (
        tokens.join(bases, ["part", "queue"])
        .select("doc_id", "source", "queue", start.alias("start"), "doc_tokens", "ids")
        .mapInArrow(place, PIECES + (", ids array<int>" if with_ids else ""))
    )
