"""A byte convolutional network that tells languages.

Bytes have learned vectors; filters of several widths slide over a window of
bytes, each filter's largest value over the window goes into a softmax over
the languages. A text is all its windows; its prediction is their mean, weighed by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import levelled_sample, remainder

#: About so many training texts, shared evenly among the languages, by a hash of their ids, and at most so many windows taken from each at random places.
FIT_ROWS = 2500
FIT_WINDOWS = 3
WINDOW = 256
VECTOR, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
BATCH, EPOCHS, RATE = 64, 4, 4e-3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Windows scored together.
TOGETHER = 256


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # (256, VECTOR)
    filters: dict[int, np.ndarray]  # by width: (width, VECTOR, FILTERS)
    offsets: dict[int, np.ndarray]
    dense: np.ndarray  # (FILTERS * widths, languages)
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], random: np.random.Generator) -> Network:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            languages,
            draw(256, VECTOR, scale=0.5),
            {w: draw(w, VECTOR, FILTERS, scale=(w * VECTOR) ** -0.5) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            draw(FILTERS * len(WIDTHS), len(languages), scale=0.2),
            np.zeros(len(languages), np.float32),
        )

    def values(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters.values(), *self.offsets.values(), self.dense, self.bias]

    def responses(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """By width, each filter's value at each place of each window."""
        out = {}
        for w, kernel in self.filters.items():
            # A byte's share in a filter's value is looked up, not multiplied anew.
            shares = self.vectors @ kernel
            places = x.shape[1] - w + 1
            total = shares[0][x[:, :places]]
            for k in range(1, w):
                total += shares[k][x[:, k : k + places]]
            out[w] = total
        return out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        pooled = [r.max(1) + self.offsets[w] for w, r in self.responses(x).items()]
        return self.probabilities(np.maximum(np.concatenate(pooled, 1), 0))

    def slopes(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log loss, in the order of ``values``."""
        n, best, pooled = len(x), {}, []
        for w, r in self.responses(x).items():
            best[w] = r.argmax(1)
            pooled.append(np.take_along_axis(r, best[w][:, None], 1)[:, 0] + self.offsets[w])
        raw = np.concatenate(pooled, 1)
        p = self.probabilities(np.maximum(raw, 0))
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (raw > 0)
        of_vectors, of_filters, of_offsets = np.zeros_like(self.vectors), [], []
        for i, w in enumerate(self.filters):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            of_offsets.append(g.sum(0))
            kernel = np.empty_like(self.filters[w])
            for k in range(w):
                seen = np.take_along_axis(x, best[w] + k, 1)
                kernel[k] = np.einsum("nf,nfv->vf", g, self.vectors[seen])
                np.add.at(of_vectors, seen, g[:, :, None] * self.filters[w][k].T[None])
            of_filters.append(kernel)
        return [of_vectors, *of_filters, *of_offsets, np.maximum(raw, 0).T @ p, p.sum(0)]


def fit(windows: np.ndarray, labels: list[str], seed: int = 11) -> Network:
    random = np.random.Generator(np.random.PCG64(seed))
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    net = Network.new(languages, random)
    first = [np.zeros_like(v) for v in net.values()]
    second = [np.zeros_like(v) for v in net.values()]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take, step = order[at : at + BATCH], step + 1
            for value, slope, m, v in zip(net.values(), net.slopes(windows[take], y[take]), first, second, strict=True):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def cut(texts: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, zero bytes behind a text's end; the text and the length of each."""
    sizes = np.diff(texts.offsets)
    counts = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), counts)
    inner = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    length = np.minimum(sizes[of] - inner, WINDOW)
    at = (texts.offsets[of] + inner)[:, None] + np.arange(WINDOW)
    data = np.append(texts.data, np.zeros(WINDOW, np.uint8))
    return np.where(np.arange(WINDOW) < length[:, None], data[at], 0).astype(np.uint8), of, length


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """Learns from texts with a language outside the held-out fold; which ones follows from their ids."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    # Ids first: only chosen texts move.
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    few = F.broadcast(levelled_sample(ids, fit_rows, "lang", "doc_id").select("doc_id"))
    rows = known.join(few, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("s")).select("doc_id", "s.*")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy().astype(np.int64).view(np.uint64)
            for at, texts in words.batches(batch["text"]):
                x, of, _ = cut(texts)
                # Some windows of each text, each as likely as the others; which ones follows from id and place alone.
                place = (np.arange(len(of)) - np.searchsorted(of, of)).astype(np.uint64)
                order = np.lexsort([words.mix(words.mix(ids[at + of]) + place), of])
                rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
                chosen = order[rank < FIT_WINDOWS]
                yield pa.RecordBatch.from_arrays(
                    [batch["lang"].take(pa.array(of[chosen] + at)), pa.array([r.tobytes() for r in x[chosen]], pa.binary())],
                    ["lang", "window"],
                )

    found = rows.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(windows, "lang string, window binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in found), np.uint8).reshape(-1, WINDOW)
    return fit(x, [r["lang"] for r in found])


def language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, and so is all
    when no text has a language. Null langs teach nothing; of a repeated id one row does. Repeated rows are
    predicted alike; of languages with one score the first by name is taken. Very long texts are read in all their
    windows; an empty table gives no rows. Further columns are ignored.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, fit_rows))  # some 20 KB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            for at, texts in words.batches(batch["text"]):
                keys = batch.slice(at, len(texts))
                known = lettered[at : at + len(texts)]
                scores = np.zeros((len(texts), 1))
                names = [UNKNOWN]
                if model is not None:
                    names = model.languages
                    scores = np.zeros((len(texts), len(names)))
                    x, of, length = cut(texts)
                    for a in range(0, len(x), TOGETHER):
                        p = model.predict(x[a : a + TOGETHER]) * length[a : a + TOGETHER, None]
                        np.add.at(scores, of[a : a + TOGETHER], p)
                    scores /= np.maximum(np.diff(texts.offsets), 1)[:, None]
                best = scores.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys["doc_id"], keys["held_out"],
                        pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.where(known, np.minimum(scores.max(1), 1.0), 0.0)),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long"),
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        "text",
    )
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
