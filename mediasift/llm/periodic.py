"""Periodic runs of words inside a text: seeds on diagonals, extended once.

Words ``lag`` apart that are equal form a diagonal. A run of period q and at least
max(LEAST, TIMES * q) words covers at least that many words less q of the diagonal with lag q. So for all
lags from 2**j to 2**(j + 1) - 1 the grams of the overlap that is guaranteed there are indexed, and each
occurrence with the next one of the same text is a seed. Such a gram is no shorter than the
period, so inside a run its next occurrence is one period away: neighbours in the index are enough,
and a text has at most one seed a word and class of lags, however often a gram repeats.

Grams are numbered by pairs of numbers of half as long ones, never by a hash, and only
where both halves occur more than once. A table of how far each lag is covered keeps seeds
of one diagonal from being extended again.

All work is inside a row, without a shuffle; a task holds about ``WORDS`` words, or one longer text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD

LEAST, TIMES = 6, 4
#: Words taken together.
WORDS = 1 << 19
_WORD = re.compile(WORD)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def numbered(keys: np.ndarray) -> np.ndarray:
    """A number for each different key, -1 where the key occurs once."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(times[number] > 1, number, -1)


class Grams:
    """Numbers of the grams of 1, 2, 4, ... words at each place; -1 where a gram is not repeated in its text."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray) -> None:
        self.n = len(words)
        self.text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        self.end = firsts[1:][self.text]
        self.of = [numbered(self.text * (int(words.max(initial=0)) + 1) + words)]

    def joined(self, head: np.ndarray, tail: np.ndarray, shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a repeated head is followed by a repeated tail ``shift`` words on, and a key of the two."""
        at = np.flatnonzero(head[: max(self.n - shift, 0)] >= 0)
        at = at[(tail[at + shift] >= 0) & (at + size <= self.end[at])]
        return at, head[at] * self.n + tail[at + shift]

    def doubled(self, m: int) -> np.ndarray:
        """Numbers of the grams of 2**m words."""
        while len(self.of) <= m:
            half = 1 << len(self.of) - 1
            at, key = self.joined(self.of[-1], self.of[-1], half, 2 * half)
            out = np.full(self.n, -1, np.int64)
            out[at] = numbered(key)
            self.of.append(out)
        return self.of[m]

    def seeds(self, j: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and lags, from 2**j to 2**(j + 1) - 1, of grams and their next occurrence; with the grams' size."""
        size = max(LEAST - 1, (TIMES - 1) << j)
        half = 1 << (size.bit_length() - 1)
        at, key = self.joined(self.doubled(half.bit_length() - 1), self.doubled((size - half).bit_length() - 1), half, size)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        lag = at[1:] - at[:-1]
        found = np.flatnonzero((key[1:] == key[:-1]) & (lag >= 1 << j) & (lag < 2 << j))
        at, lag = at[found], lag[found]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # Seeds side by side lie on one diagonal: the first is enough.
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        return at[new], lag[new], size


def equal_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements are equal, looking at about twice as many."""
    done, step, n = 0, 32, min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done : min(done + step, n)] != b[done : min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


def find_runs(words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``words``: numbers of the words of some
    texts, one after the other; ``firsts``: first word of each text, and the number of all."""
    runs, grams, j = [], Grams(words, firsts), 0
    longest = int(np.diff(firsts).max(initial=0))
    while max(LEAST, TIMES << j) <= longest:
        covered: dict[int, int] = {}
        places, lags, size = grams.seeds(j)
        for at, lag in zip(places.tolist(), lags.tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            text = grams.text[at]
            first, end = int(firsts[text]), int(firsts[text + 1])
            right = at + size + equal_length(words[at + size : end - lag], words[at + size + lag : end])
            left = at - equal_length(words[first:at][::-1], words[first + lag : at + lag][::-1])
            covered[lag] = right
            if right - left + lag >= max(LEAST, TIMES * lag):
                runs.append((left, right - left + lag, lag))
        j += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def slices(texts: Iterable[str | None]) -> Iterator[list[list[str]]]:
    """Words of the texts, about ``WORDS`` together."""
    held, n = [], 0
    for text in texts:
        words = _WORD.findall(text or "")
        if held and n + len(words) > WORDS:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def collapsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for texts in slices(x.as_py() for x in batch["text"]):
            firsts = np.cumsum([0, *map(len, texts)])
            numbers = pa.array([w for words in texts for w in words], pa.large_string()).dictionary_encode().indices
            runs = find_runs(numbers.to_numpy().astype(np.int64), firsts)
            keep = np.ones(int(firsts[-1]), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            whole = np.ones(len(texts), bool)
            whole[np.searchsorted(firsts, np.flatnonzero(~keep), "right") - 1] = False
            out = [
                " ".join(words if whole[i] else [w for w, k in zip(words, keep[firsts[i] : firsts[i + 1]], strict=True) if k])
                for i, words in enumerate(texts)
            ]
            start, length, period = np.array(runs, np.int64).reshape(-1, 3).T
            of = np.searchsorted(firsts, start, "right") - 1
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start - firsts[of]), pa.array(length), pa.array(period)], fields=list(RUN)),
            )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(row, len(texts)), lists, pa.array(out, pa.string())], ["doc_id", "runs", "collapsed"]
            )
            row += len(texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs and collapsed text of every document.

    A run is a stretch of words with smallest period q and at least max(6, 4 * q) words that no
    neighbouring word extends; ``runs`` has them by start, then period, words counted from 0. ``collapsed`` has
    the words that no run holds after its first q, joined by one blank.

    A null or empty text has no runs and an empty collapsed text. Null and repeated ids are rows of their own;
    other columns are ignored; an empty table gives no rows. Texts of any length are taken whole,
    with about 100 bytes of memory a word of the longest.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(collapsed, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id as text ends in the digit 0, the text's end repeats with some period.

    With h that crc32, g = h // 10, n words, a = g mod n, p = 1 + (n - a) // (3 + g mod 8): word i >= a
    is word a + (i - a) mod p. A text without words, and one whose id is null, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("CASE WHEN n > 0 THEN 1 + (n - a) DIV (3 + g % 8) END"))
    place = "CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS INT)"
    changed = F.expr(f"array_join(transform(sequence(0, n - 1), i -> words[{place}]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period) and SHA-256 of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("at"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    sha = lambda text: F.sha2(text, 256)
    ended: Column = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.at").alias("start"), F.col("best.length").alias("length"),
        F.col("best.q").alias("period"), F.expr("1000 * best.length DIV best.q").alias("exponent_milli"),
        sha(ended).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
