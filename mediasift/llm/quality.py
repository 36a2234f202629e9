"""Quality rules on whole texts, and an isolation forest over what they measure.

The rules count words, symbols, repeated lines and repeated word windows. The
forest is fitted on rates of labelled rows: a row that few random splits
set apart from the others is anomalous. From what score on a row is rejected follows from the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words
from .common import known_labels, remainder, written

#: Each tree draws so many rows of all, as the method has it; the ranges of its cuts and the threshold come from every row.
TREES, SAMPLE, DEPTH = 200, 256, 10
#: Scores are told apart to one part in so many, so that they can be counted.
GRID = 100_000
#: Largest share of good labelled rows that the threshold may reject.
FALSE_REJECTS = 0.003
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL = _marks(SYMBOLS)
_UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _marks("0123456789")
_MARK = _marks("!?.,;:\"'()[]{}-_=+/\\~^`@")


def measure(texts: words.Texts) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, n = texts.data, len(texts)
    starts, ends, firsts = texts.words()
    hashes = texts.hashes(starts, ends)
    out = {"n_words": np.diff(firsts)}
    out["word_chars"] = texts.counts(~words.BLANK[data] & ((data & 0xC0) != 0x80))
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = texts.counts(table[data])

    feeds = np.flatnonzero(data == 10)
    cuts = np.union1d(feeds + 1, texts.offsets)
    lows, highs = cuts[:-1], cuts[1:]
    highs = highs - (data[highs - 1] == 10) if len(highs) else highs
    filled = np.concatenate([[0], np.cumsum(~words.BLANK[data])])
    real = filled[highs] > filled[lows]
    lows, highs = lows[real], highs[real]
    of = np.searchsorted(texts.offsets, lows, "right") - 1
    lines = np.unique(words.within(texts.hashes(lows, highs), of), return_index=True)[1]
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[lines], minlength=n)

    runs, run_of = words.windows(hashes, firsts, 3)
    _, back, times = np.unique(words.within(runs, run_of), return_inverse=True, return_counts=True)
    at = firsts[:-1][run_of] + np.arange(len(run_of)) - np.searchsorted(run_of, run_of)
    covered = np.zeros(len(hashes), bool)
    twice = at[times[back] > 1]
    for k in range(3):
        covered[twice + k] = True
    word_of = np.repeat(np.arange(n), np.diff(firsts))
    out["n_repeat_words"] = np.bincount(word_of[covered], minlength=n)
    distinct = np.unique(words.within(hashes, word_of), return_index=True)[1]
    out["n_distinct"] = np.bincount(word_of[distinct], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def measured(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns ``kept`` and the counts of every text; null has none of anything."""
    names = [*COUNTS, *MORE]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.batches(batch["text"]):
                counts = measure(texts)
                keys = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(keys[k] for k in ("doc_id", *kept)), *(pa.array(counts[k]) for k in names)],
                    ["doc_id", *kept, *names],
                )

    types = dict(docs.dtypes)
    keys = ", ".join(f"{k} {types[k]}" for k in ("doc_id", *kept))
    return docs.select("doc_id", *kept, "text").mapInArrow(rows, f"{keys}, " + ", ".join(f"{k} long" for k in names))


def rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: a column for each rule, free of the text's length but for the first."""
    c = {k: v.astype(float) for k, v in counts.items()}
    w, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            np.minimum(np.log1p(c["n_words"]), np.log1p(100)), np.minimum(c["word_chars"] / w, 40) / 10,
            *(np.sqrt(c[k] / chars) for k in ("n_symbols", "n_upper", "n_digits", "n_marks")),
            c["n_dup_lines"] / lines, c["n_repeat_words"] / w, 1 - (c["n_distinct"] / w) ** 0.5,
        ]
    )


@dataclass
class Forest:
    """Arrays (trees, nodes); a leaf has feature -1 and its path length in ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    scale: float

    @classmethod
    def fit(cls, x: np.ndarray, seen: np.ndarray, seed: int = 7, drawn: list[np.ndarray] | None = None) -> Forest:
        """Trees over rows ``x``. Cuts are drawn over the range that ``seen`` has, not only ``x``:
        what no row of ``x`` has is then set apart by the first cut before it. ``drawn``: the rows of each tree, if chosen before."""
        random = np.random.Generator(np.random.PCG64(seed))
        size = min(SAMPLE, len(x)) if drawn is None else max(map(len, drawn))
        feature = np.full((TREES, 2 ** (DEPTH + 1)), -1, np.int16)
        cut = np.zeros(feature.shape)
        for t in range(TREES):
            own = random.choice(len(x), size, replace=False) if drawn is None else drawn[t]
            nodes = [(1, x[own], seen.min(0), seen.max(0), 0)]
            while nodes:
                i, rows, low, high, depth = nodes.pop()
                split = np.flatnonzero(high > low)
                if depth == DEPTH or len(rows) < 2 or not len(split):
                    cut[t, i] = depth + average_path(len(rows))
                    continue
                feature[t, i] = f = random.choice(split)
                cut[t, i] = at = random.uniform(low[f], high[f])
                left, below, above = rows[:, f] < at, high.copy(), low.copy()
                below[f], above[f] = at, at
                nodes += [(2 * i, rows[left], low, below, depth + 1), (2 * i + 1, rows[~left], above, high, depth + 1)]
        return cls(feature, cut, average_path(size))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the fewer splits set the row apart."""
        at, tree, row = np.ones((len(x), TREES), np.int64), np.arange(TREES), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[tree, at]
            down = 2 * at + (x[row, np.maximum(f, 0)] >= self.cut[tree, at])
            at = np.where(f >= 0, down, at)
        return 2.0 ** (-self.cut[tree, at].mean(1) / max(self.scale, 1e-9))


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def threshold(scores: np.ndarray, good: np.ndarray, times: np.ndarray | None = None) -> float:
    """The score from which on rows are rejected: most bad labelled rows caught
    while at most ``FALSE_REJECTS`` of the good ones go. Above 1 without labels of both kinds. ``times``: how many rows each is."""
    times = np.ones(len(scores)) if times is None else times
    if not times[good].sum() or not times[~good].sum():
        return 2.0
    cuts, at = np.unique(scores, return_inverse=True)
    lost, caught = (np.cumsum(np.bincount(at, times * of, len(cuts))[::-1])[::-1] / times[of].sum() for of in (good, ~good))
    if lost[-1] > FALSE_REJECTS:
        return 2.0
    return float(cuts[int(np.argmax(np.where(lost <= FALSE_REJECTS, caught - lost, -np.inf)))])


def graded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * GRID) / GRID


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


RATES = [f"x{i}" for i in range(9)]


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch[k].to_numpy() for k in RATES])


def labelled_rates(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, apart and rates of every labelled document that the rules keep. Of an id's texts that with the least counts counts.

    ``apart`` marks the half, by ids, that the forest does not see and the threshold is found on.
    """
    one = (
        counts.join(known_labels(labels, "quality"), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS, *MORE)).alias("c")).select("doc_id", "quality", "c.*")
        .filter(~base_failed())
        .select("doc_id", (F.col("quality") == 1).alias("good"), (remainder(F.col("doc_id"), 2) == 1).alias("apart"), *COUNTS, *MORE)
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rates({k: batch[k].to_numpy() for k in (*COUNTS, *MORE)})
            keys = ["doc_id", "good", "apart"]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *(pa.array(c) for c in x.T)], [*keys, *RATES])

    return one.mapInArrow(rows, "doc_id long, good boolean, apart boolean, " + ", ".join(f"{k} double" for k in RATES))


def _lots(ids: np.ndarray, tree: int) -> np.ndarray:
    """What each row draws for a tree; the rows with the least lots are its own."""
    return words.mix(words.mix(ids.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % 2**64))


def drawn_rows(rows: DataFrame, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rates of rows that some tree may draw, and the rows of each tree: those with its ``SAMPLE`` least lots of all n rows.

    Lots are equally spread, so that a tree's least lie below a bound which few more do: about 350 rows a tree come
    to the driver, however many there are.
    """
    share = (SAMPLE + 6 * SAMPLE**0.5) / n
    bound = np.uint64(2**64 - 1) if share >= 1 else np.uint64(int(share * 2**64))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hit = batch["doc_id"].to_numpy(), np.zeros(batch.num_rows, bool)
            for tree in range(TREES):
                hit |= _lots(ids, tree) <= bound
            yield batch.filter(pa.array(hit))

    columns = rows.select("doc_id", *RATES)
    found = columns.mapInArrow(near, columns.schema).toArrow().sort_by("doc_id")
    ids = found["doc_id"].to_numpy()
    return _matrix(found), [np.argsort(_lots(ids, tree), kind="stable")[:SAMPLE] for tree in range(TREES)]


def fitted(table: DataFrame) -> tuple[Forest | None, float]:
    """Forest and threshold from all of ``labelled_rates``."""
    sizes = {(r["apart"], r["good"]): r["n"] for r in table.groupBy("apart", "good").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, 2.0
    both = len({apart for apart, _ in sizes}) == 2
    seen, asked = (table.filter(~F.col("apart")), table.filter("apart")) if both else (table, table)
    of = {good: sum(n for (apart, g), n in sizes.items() if g == good and not (both and apart)) for good in (True, False)}
    # Good rows are the background against which a row is anomalous.
    background, n = (seen.filter("good"), of[True]) if of[True] else (seen, of[False])
    x, drawn = drawn_rows(background, n)
    ends = seen.agg(*(f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in RATES)).first()
    forest = Forest.fit(x, np.array(ends, float).reshape(2, len(RATES)), drawn=drawn)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(graded(forest.score(_matrix(batch)))), batch["good"]], ["score", "good"])

    # At most GRID scores of each kind come to the driver.
    counted = asked.mapInArrow(scored, "score double, good boolean").groupBy("score", "good").agg(F.count("*").alias("n")).toArrow()
    return forest, threshold(counted["score"].to_numpy(), counted["good"].to_numpy(), counted["n"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document (doc_id, text).

    base_failed: under 50 words, or over half of the words in repeated windows.
    kept: not base_failed and not anomalous. Null and empty texts fail. Rows
    without label, labels without document, null labels, repeated rows and further
    columns are harmless; without usable labels nothing counts as anomalous. Very long texts are counted whole; a
    row as anomalous as the threshold is rejected; an empty table gives no rows.
    """
    # Every text is measured once; the fit and the verdicts read its counts.
    counted = written(measured(docs.select(F.col("doc_id").cast("long"), "text")), "quality-counts")
    forest, limit = fitted(written(labelled_rates(counted, labels), "quality-rates"))

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = {k: batch[k].to_numpy() for k in (*COUNTS, *MORE)}
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            scores = np.zeros(len(failed)) if forest is None else forest.score(rates(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[k] for k in ("doc_id", *COUNTS)), pa.array(failed),
                    pa.array(~failed & (graded(scores) < limit)), pa.array(scores),
                ],
                ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"],
            )

    out = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return counted.mapInArrow(verdict, out)
