"""Personal data in texts: exact base patterns, and spans found by weak supervision.

Base spans follow fixed patterns. Further candidates (numbers, handles, names) have no
labels; regex, gazetteer and context labelers vote on each. Expectation maximisation
over the corpus-wide counts of vote patterns estimates how reliable each labeler
is and how likely a candidate with given votes is personal. A logistic classifier
trained on these probabilities then decides on every candidate from its form and surroundings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: About so many candidates, by a hash, train the final classifier.
FIT_ROWS = 4000
FEATURES = 1 << 14
ROUNDS = 60

BASE = ("email", "ip", "card", "phone")
ADDED = ("handle", "name", "number")
KINDS = BASE + ADDED

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NON_DIGIT = re.compile(r"[^0-9]+")
_ANY_DIGIT = re.compile(r"[0-9]")

_NUMBER = re.compile(r"(?<![0-9A-Za-z+.,])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")
_HANDLE = re.compile(r"(?<![\w@.])@[A-Za-z_][A-Za-z0-9_]{2,29}(?![\w@.])")
_NAME = re.compile(r"\b(?:[A-Z][a-zà-ÿ]{1,19})\x20(?:[A-Z][a-zà-ÿ]{1,19})\b")

# Given names, cue words.
_GIVEN = frozenset(
    "alice anna anne antonio barbara carlos carmen charles claire daniel david elena elizabeth emily emma eva"
    " francois george hans heinrich helen isabel jack jacques james jane javier jean jennifer john jose joseph"
    " juan julia karen karl klaus laura linda louis lucia luis manuel margaret maria marie martin mary michael"
    " miguel monika nicole olivia patricia paul pedro peter petra pierre richard robert sarah sofia stefan susan"
    " thomas ursula william wolfgang".split()
)
_FOR = frozenset(
    "account birth call cell contact dear email fax follow from handy herr frau id kontakt konto madame mail mobile"
    " monsieur mr mrs ms mit name nom nombre numero passport phone signed senor senora ssn tel telefon telefono"
    " telephone user username whatsapp written by".split()
)
_AGAINST = frozenset(
    "version license chapter section page article isbn issn figure table build release year total sum price"
    " model public apache kapitel seite version capitulo pagina chapitre".split()
)
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every match holds one @ with its whole run of local characters before it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start. A match that fails its check is dropped, without a second try inside it."""
    out = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            out += [
                ("ip", *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            ]
        for m in _CARD.finditer(text):
            digits = _NON_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    features: tuple[int, ...]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FEATURES


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Spans that may be personal and touch no base span, with votes: 1 personal, -1 not, 0 no opinion."""
    found = [("name", *m.span()) for m in _NAME.finditer(text)]
    if "@" in text:
        found += [("handle", *m.span()) for m in _HANDLE.finditer(text)]
    if _ANY_DIGIT.search(text):
        found += [("number", *m.span()) for m in _NUMBER.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    tops = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out = []
    for kind, start, end in found:
        i = int(np.searchsorted(starts, end))
        if i and tops[i - 1] > start:
            continue
        near = int(np.searchsorted(starts, end + 80)) - int(np.searchsorted(tops, start - 80))
        out.append(_candidate(text, kind, start, end, near > 0))
    return out


def _candidate(text: str, kind: str, start: int, end: int, near_base: bool) -> Candidate:
    span = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-3:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 25])][:1]
    digits = _NON_DIGIT.sub("", span)
    words = [w.lower() for w in _WORD.findall(span)]
    groups = [len(g) for g in re.split("[^0-9]+", span) if g]
    shape = 0
    if kind == "number":
        shape = 1 if len(groups) >= 3 and len(digits) in (9, 10, 11) and max(groups) <= 4 else -1 if len(groups) == 1 else 0
    elif kind == "handle":
        shape = 1 if any(c.isdigit() or c == "_" for c in span) else 0
    elif words[0] == words[1]:
        shape = -1
    given = 0 if kind != "name" else 1 if words[0] in _GIVEN else -1
    cue = 1 if _FOR.intersection(before) else 0
    counter_cue = -1 if _AGAINST.intersection(before) or _AGAINST.intersection(words) else 0
    opener = text[start - 1] if start else "\n"
    edge = -1 if kind == "name" and opener == "\n" else 1 if opener in ":(<\"" else 0
    votes = (shape, given, cue, counter_cue, edge, 1 if near_base else 0)
    form = re.sub("[0-9]", "9", re.sub("[a-zà-ÿ]+", "a", re.sub("[A-Z]", "A", span)))
    names = [
        f"kind {kind}", f"form {kind} {form[:24]}", f"size {kind} {len(span) // 3}", f"groups {kind} {groups[:5]}",
        f"opener {kind} {opener}", f"closer {kind} {text[end : end + 1]}", f"given {kind} {given}", f"near {kind} {near_base}",
        *(f"before {kind} {w}" for w in before), *(f"after {kind} {w}" for w in after), *(f"word {kind} {w}" for w in words),
    ]
    return Candidate(kind, start, end, votes, tuple(sorted({_hash(n) for n in names})))


def estimate(patterns: dict[tuple[str, tuple[int, ...]], int]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a candidate with this kind and votes is personal.

    Expectation maximisation of a two-class model in which labelers vote
    independently given the class; it starts from the balance of the votes.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    votes = np.array([v for _, v in keys]) + 1
    kinds = np.array([ADDED.index(k) for k, _ in keys])
    balance = (votes - 1).sum(1)
    p = 1 / (1 + np.exp(-(1.5 * balance - 1.0)))
    for _ in range(ROUNDS):
        logs = []
        for weight in (counts * (1 - p), counts * p):
            total = np.bincount(kinds, weight, len(ADDED)) + 1
            log = np.log(total)[kinds]
            for j in range(votes.shape[1]):
                seen = np.bincount(kinds * 3 + votes[:, j], weight, 3 * len(ADDED)).reshape(-1, 3) + 0.5
                # No opinion says nothing about the class.
                log += np.where(votes[:, j] == 1, 0, np.log(seen / seen.sum(1, keepdims=True))[kinds, votes[:, j]])
            logs.append(log)
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        # A labeler is better than chance: without a vote in favour nothing is personal.
        p = np.where((votes == 2).any(1), p, np.minimum(p, 0.05))
    return dict(zip(keys, p.tolist(), strict=True))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[tuple[int, ...]], target: np.ndarray) -> Classifier:
        w, b = np.zeros(FEATURES), -2.0
        if not rows:
            return cls(w, -10.0)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = np.concatenate([np.array(r, np.int64) for r in rows])
        for _ in range(300):
            z = np.bincount(of, w[column], minlength=len(rows)) + b
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            w -= 1.0 * (np.bincount(column, miss[of], minlength=FEATURES) / len(rows) + 1e-4 * w)
            b -= 1.0 * miss.mean()
        return cls(w, b)

    def accepts(self, candidate: Candidate) -> bool:
        return bool(self.weights[list(candidate.features)].sum() + self.bias >= 0)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Votes are counted over all texts; the classifier is fitted on the fit_rows distinct candidates of lowest rank."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            best: list[tuple[int, str, tuple[int, ...], tuple[int, ...]]] = []
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                for c in candidates(text, base_spans(text)):
                    counts[c.kind, c.votes] += 1
                    # Ranks equal candidates alike, wherever they stand.
                    best.append((zlib.crc32(repr((c.kind, c.features)).encode()), c.kind, c.votes, c.features))
            best = sorted(set(best))[:fit_rows]
            rows = [(k, v, n, None, None) for (k, v), n in counts.items()] + [(k, v, None, r, f) for r, k, v, f in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)],
                ["kind", "votes", "n", "rank", "features"],
            )

    types = [pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = "kind string, votes array<int>, n long, rank long, features array<int>"
    rows = docs.select("text").mapInArrow(vote, schema)
    # At most 3 ** labelers patterns a kind come to the driver, and fit_rows candidates.
    counted = F.sum("n").alias("n")
    sampled: Column = F.min(F.struct("rank", "votes")).alias("s")
    each = rows.groupBy("kind", "votes", "features").agg(counted, sampled)
    table = written(each, "candidates")
    patterns = dict(sorted(((r["kind"], tuple(r["votes"])), r["n"]) for r in table.filter("n is not null").collect()))
    # No batch cuts a candidate of the lowest fit_rows overall, so that these are found whatever the batches.
    # Their last rank comes from counts of ranges of ranks, at most 2 ** 16 rows.
    shaped, part = table.filter("features is not null"), F.shiftright("s.rank", 16)
    most, n = -1, 0
    for r in sorted(shaped.groupBy(part.alias("part")).count().collect()):
        most, n = r["part"], n + r["count"]
        if n >= fit_rows:
            break
    found = shaped.filter(part <= most).collect()
    sample = sorted(found, key=lambda r: (r["s"]["rank"], r["kind"], r["votes"], r["features"]))[:fit_rows]
    personal = estimate(patterns)
    return Classifier.fit(
        [tuple(r["features"]) for r in sample],
        np.array([personal.get((r["kind"], tuple(r["votes"])), 0.0) for r in sample]),
    )


def all_spans(text: str | None, classifier: Classifier) -> tuple[list[Span], list[Span]]:
    """Base spans; and these with the accepted candidates, by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    added = [(c.kind, c.start, c.end) for c in candidates(text, base) if classifier.accepts(c)]
    return base, base + sorted(added)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_spans(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, counts of base spans by kind, ``base`` and ``spans`` as text, for every document.

    A null text is empty and has none. Ids may be null or repeat: each row is searched alone; further columns are
    ignored, also those named as a result. Very long texts are searched whole; an empty table gives no rows. Of an added span
    that overlaps a base span, the base span stays as well.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # 128 KB

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, model.value) for t in batch["text"].to_pylist()]
            kinds = [Counter(k for k, _, _ in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], *(pa.array([c[k] for c in kinds], pa.int64()) for k in BASE),
                    pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)


def redact(text: str | None, classifier: Classifier) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the widest run goes as one."""
    if not text:
        return text
    spans = sorted((s, e, k) for k, s, e in all_spans(text, classifier)[1])
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    cuts = [0, *(x for s, e, _ in merged for x in (s, e)), len(text)]
    plain = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return plain[0] + "".join(f"[{m[2].upper()}]{p}" for m, p in zip(merged, plain[1:], strict=True))


def redacted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The documents with all spans masked. All rows stay, and other columns too; n_chars, if there, follows the text.

    Null texts stay null, empty ones empty; ids do not matter; very long texts are masked whole; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t, model.value) for t in batch["text"].to_pylist()], pa.string())
            batch = batch.set_column(place, "text", texts)
            if length is not None:
                sizes = pc.cast(pc.utf8_length(texts), batch.schema.field(length).type)
                batch = batch.set_column(length, "n_chars", pc.if_else(pc.is_null(texts), batch["n_chars"], sizes))
            yield batch

    return docs.mapInArrow(mask, docs.schema)
