"""A linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed;
what is not a letter counts as one blank, so that n-grams know where words begin
and end. Each feature is scaled by the log ratio of its smoothed share of the
toxic and of the other training texts; logistic regression weighs the scaled features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import labelled_sample, remainder, written

#: About so many training rows of each label value, by a hash of their ids.
FIT_ROWS = 2500
LENGTHS = (3, 4, 5, 6)
BITS = 20
#: A feature counts if at least so many training texts have it, and its log ratio is so large.
LEAST_TEXTS = 4
LEAST_RATIO = 1.0
#: Strength of the penalty on the sum of absolute weights, and training steps.
PENALTY = 5e-4
STEPS = 120
SMOOTHING = 1.0
FOLDS = 5
#: Characters taken at once; a longer text is taken in overlapping parts.
CHARS = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str, weighed: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a whole text; only those marked in ``weighed``, if given."""
    plain = f" {_OTHER.sub(' ', text.lower())} "
    found = []
    for at in range(0, max(len(plain), 1), CHARS):
        part = plain[at : at + CHARS + LENGTHS[-1] - 1].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, "<u4")
        total = np.zeros(len(codes), np.uint32)
        for n in range(1, LENGTHS[-1] + 1):
            if len(codes) < n:
                break
            total = total[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in LENGTHS:
                hashed = total ^ (total >> np.uint32(15))
                place = ((hashed * np.uint32(0x2C1B3C6D)) ^ np.uint32(n * 0x9E37)) >> np.uint32(32 - BITS)
                found.append(place if weighed is None else place[weighed[place]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """``weights`` already holds ratio times learned weight, by hashed feature."""

    weights: np.ndarray
    bias: float
    #: Whether the training rows had both labels; else the score says nothing of a text.
    learned: bool = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        weighed = self.weights != 0
        sums = [float(self.weights[features(t or "", weighed)].sum()) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(sums) + self.bias, -30, 30)))


def log_ratios(pos: np.ndarray, neg: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Naive Bayes log-count ratio of features with these counts; ``totals`` are those of all features."""
    room = SMOOTHING * (1 << BITS)
    return np.log((pos + SMOOTHING) / (totals[0] + room)) - np.log((neg + SMOOTHING) / (totals[1] + room))


def fit(toxic: np.ndarray, columns: list[np.ndarray], used: np.ndarray, ratio: np.ndarray, base_rate: float) -> Model:
    """Training by full-batch proximal gradient steps. ``columns``: for each row, which of the features
    ``used`` (with their ratios) it has. ``base_rate``: share of toxic texts where the model is applied; the sample may hold more."""
    weights = np.zeros(1 << BITS, np.float32)
    column, of = np.concatenate(columns), np.repeat(np.arange(len(toxic), dtype=np.int32), [len(c) for c in columns])
    target = toxic.astype(float)
    # Rows weigh so that the sample has the base rate.
    share = target.mean()
    row_weight = np.where(toxic, base_rate / share, (1 - base_rate) / (1 - share))
    row_weight = row_weight / row_weight.sum()
    w, b, m, v = np.zeros(len(used)), np.log(base_rate / (1 - base_rate)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(of, (w * ratio)[column], minlength=len(toxic)) + b
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * row_weight
        slope = np.append(np.bincount(column, miss[of], minlength=len(used)) * ratio, miss.sum())
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope * slope
        rate = 0.05 / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        moved = np.append(w, b) - rate * m / (1 - 0.9**step)
        # Weights the penalty outweighs become zero: features that are noise drop out.
        w, b = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate[:-1] * PENALTY, 0), moved[-1]
    weights[used] = w * ratio
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled documents outside the held-out fold.

    Features are counted and chosen where the rows are; the driver gets the counts of features that enough
    texts have (at most 2 ** BITS rows of three numbers), and of each training row the chosen features only.
    """
    learnable = labels.filter(remainder(F.col("doc_id"), FOLDS) != 0)
    sample = labelled_sample(docs, learnable, "toxic", fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [features(t or "").astype("<u4").tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(found, pa.binary())], ["toxic", "found"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, found in zip(batch["toxic"].to_pylist(), batch["found"], strict=True):
                counts[0 if toxic == 1 else 1, np.frombuffer(found.as_buffer(), "<u4")] += 1
        seen = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *(pa.array(c[seen]) for c in counts)], ["feature", "pos", "neg"]
        )

    table = written(sample.select("toxic", "text").mapInArrow(extract, "toxic int, found binary"), "toxic-features")
    known = learnable.filter(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    base_rate = min(max(known or 0.0, 0.01), 0.99)
    of_label = {r["toxic"]: r["count"] for r in table.groupBy("toxic").count().collect()}
    if len(of_label) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 10.0 if 1 in of_label else -10.0, learned=False)
    sums = [F.sum(c).cast("long").alias(c) for c in ("pos", "neg")]
    counts = written(table.mapInArrow(tally, "feature int, pos int, neg int").groupBy("feature").agg(*sums), "toxic-counts")
    totals = tuple(x or 0 for x in counts.agg(*sums).first())
    frequent = counts.filter(F.col("pos") + F.col("neg") >= LEAST_TEXTS).toArrow().sort_by("feature")
    used, pos, neg = (frequent[c].to_numpy() for c in ("feature", "pos", "neg"))
    ratio = log_ratios(pos, neg, totals)
    used, ratio = used[np.abs(ratio) >= LEAST_RATIO], ratio[np.abs(ratio) >= LEAST_RATIO]
    chosen = docs.sparkSession.sparkContext.broadcast(used)  # at most 4 MB

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[chosen.value] = np.arange(len(chosen.value), dtype=np.int32)
        for batch in batches:
            own = (number[np.frombuffer(x.as_buffer(), "<u4")] for x in batch["found"])
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([c[c >= 0].tobytes() for c in own], pa.binary())], ["toxic", "own"])

    rows = table.mapInArrow(choose, "toxic int, own binary").toArrow()
    columns = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["own"]]
    return fit(rows["toxic"].to_numpy() == 1, columns, used, ratio, base_rate)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (doc_id, text).

    A null text scores as an empty one: with the model's bias. Null labels, labels
    of unknown documents, repeated rows and further columns are harmless. With
    no training rows, or rows of one label only, every text gets that label (none: 0).
    """
    session = docs.sparkSession
    model = session.sparkContext.broadcast(train(docs, labels, fit_rows))  # 4 MB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.value.score(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def nontoxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents, all columns, whose score is under one half.

    Without training rows of both labels nothing is known of any text, and all stay. A null or empty text has the
    score of the model's bias; rows with null ids, repeated rows and very long texts are judged as all others, each row
    alone; an empty table stays empty.
    """
    trained = train(docs, labels, fit_rows)
    if not trained.learned:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(model.value.score(part["text"].to_pylist()) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
