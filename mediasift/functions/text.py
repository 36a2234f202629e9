"""Text functions: whitespace, summaries, sentences, language, keywords."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .. import fixed
from .core import col, fits, let, sql_text

_LATIN_TOKEN = "[a-z][a-z0-9_-]{2,}"
_CJK_TOKEN = f"[{fixed.CJK}]{{2,8}}"


def collapse_ws(text: Column | str) -> Column:
    """Runs of blanks of any kind as one space. Single spaces, mostly all blanks, stay as they are, and
    visible ASCII is told apart by one range, before the wide class is asked."""
    return F.trim(F.regexp_replace(col(text), f"[[^ -~]&&[{fixed.WS}]][{fixed.WS}]*| [{fixed.WS}]+", " "))


def compact_collapsed(norm: Column, maximum: int = fixed.SUMMARY_CHARS) -> Column:
    return F.when(fits(norm, maximum), norm).otherwise(
        F.concat(F.rtrim(F.left(norm, F.lit(maximum - 1))), F.lit("…"))
    )


def compact_summary(text: Column | str, maximum: int = fixed.SUMMARY_CHARS) -> Column:
    return let(collapse_ws(text), lambda norm: compact_collapsed(norm, maximum))


def first_sentence_collapsed(norm: Column) -> Column:
    end = fixed.SENTENCE_END
    head = F.regexp_extract(norm, f"^[^{end}]*[{end}]", 0)
    return F.left(F.when(head == "", norm).otherwise(head), F.lit(fixed.SUMMARY_CHARS))


def first_sentence(text: Column | str) -> Column:
    return let(collapse_ws(text), first_sentence_collapsed)


def _removed(text: Column, run: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, run, ""))


def letter_counts(text: Column | str) -> tuple[Column, Column]:
    """(CJK, Latin) letter counts; whole runs are removed and lengths compared,
    which is cheaper than one regex match per letter."""
    text = col(text)
    return _removed(text, f"[{fixed.CJK}]+"), _removed(text, "[A-Za-z]+")


def language_of_counts(cjk: Column, latin: Column) -> Column:
    return (
        F.when(cjk > latin * F.lit(0.25), "zh").when(latin > 0, "en").otherwise("unknown")
    )


def detect_language(text: Column | str) -> Column:
    """Letters are counted only where there are CJK ones; else one Latin letter decides."""
    text = col(text)
    plain = F.when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")
    return F.when(~text.rlike(f"[{fixed.CJK}]"), plain).otherwise(language_of_counts(*letter_counts(text)))


def latin_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(_LATIN_TOKEN), F.lit(0))


def cjk_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(_CJK_TOKEN), F.lit(0))


def union_tokens(text: Column | str) -> Column:
    """Latin tokens in text order, then CJK chunks in text order (bag union)."""
    return F.concat(latin_tokens(text), cjk_tokens(text))


def _word_counter() -> Callable[[str], tuple[list[str], Counter[str]]]:
    """A function that holds all it needs, so that workers need no package but Spark's."""
    latin, cjk, stop = re.compile(_LATIN_TOKEN), re.compile(_CJK_TOKEN), fixed.STOP_WORDS

    def words(text: str) -> tuple[list[str], Counter[str]]:
        """Tokens as ``union_tokens`` gives them, and how often each occurs that is no stop word, first seen first."""
        found = latin.findall(text.lower())
        if not text.isascii():
            found += cjk.findall(text)
        counts = Counter(found)
        for word in stop:
            counts.pop(word, None)
        return found, counts

    return words


_words = _word_counter()


@F.arrow_udf(T.ArrayType(T.StructType([
    T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()),
])))
def _counted(texts: pa.Array) -> pa.Array:
    ends, n, places, words = [0], [], [], []
    for text in texts.to_pylist():
        if text is not None:
            found, counts = _words(text)
            first = dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
            n += counts.values()
            places += map(first.__getitem__, counts)
            words += counts
        ends.append(len(words))
    rows = pa.StructArray.from_arrays(
        [pa.array(n, pa.int32()), pa.array(places, pa.int32()), pa.array(words, pa.string())], ["n", "pos", "word"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=texts.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _best(texts: pa.Array, maximum: pa.Array) -> pa.Array:
    # Of words that are as frequent the first stays first.
    best = [
        None if text is None else [word for word, _ in _words(text)[1].most_common(most)]
        for text, most in zip(texts.to_pylist(), maximum.to_pylist())
    ]
    return pa.array(best, pa.list_(pa.string()))


def keyword_counts(text: Column | str) -> Column:
    """array<struct<n,pos,word>>: frequency and first position of each token
    that is no stop word, in no particular order.

    Row-local and linear in the text: an Arrow UDF counts the tokens. Not for use inside a lambda.
    """
    return _counted(col(text))


def top_keywords(counts: Column, maximum: int = fixed.TOPICS) -> Column:
    """array<struct<n,pos,word>> best first: by count descending, then first position."""
    ranked = F.sort_array(
        F.transform(
            counts,
            lambda k: F.struct((-k["n"]).alias("n"), k["pos"].alias("pos"), k["word"].alias("word")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, maximum),
        lambda k: F.struct((-k["n"]).alias("n"), k["pos"].alias("pos"), k["word"].alias("word")),
    )


def keywords(text: Column | str, maximum: int = fixed.TOPICS) -> Column:
    """The best words, by the order of ``top_keywords``. Not for use inside a lambda."""
    return _best(col(text), F.lit(maximum))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Full case folding from the standard library: the characters that fold to
    one other character, their folds, and the pairs that fold to several."""
    changed = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c]
    single = [(c, f) for c, f in changed if len(f) == 1]
    several = tuple((c, f) for c, f in changed if len(f) > 1)
    return "".join(c for c, _ in single), "".join(f for _, f in single), several


def fold_case(text: Column | str) -> Column:
    """Full case folding, for comparing tag labels."""
    sources, targets, several = _folds()
    simple = F.translate(col(text), sources, targets)
    starts = "".join(c for c, _ in several)
    pairs = ", ".join(f"{sql_text(c)}, {sql_text(f)}" for c, f in several)

    def expand(folded: Column) -> Column:
        table = F.expr(f"map({pairs})")
        parts = F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.when(folded.rlike(f"[{starts}]"), F.array_join(parts, "")).otherwise(folded)

    return let(simple, expand)


def redact_urls(message: Column | str, maximum: int = 500) -> Column:
    """Addresses as ``[url]``, then the first ``maximum`` characters.

    An address ends at a blank of any kind. Its visible ASCII, mostly all of it, is passed over as one range, without
    asking the wide class for each character; the match is that of ``https?://[^blank]+``.
    """
    address = f"https?://(?=[^{fixed.WS}])[!-~]*[^{fixed.WS}]*"
    return F.left(F.regexp_replace(col(message), address, "[url]"), F.lit(maximum))
