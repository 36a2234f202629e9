"""Small Column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import WS


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A lambda variable is bound to a computed value, so the optimizer cannot
    inline the expression into each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once, here.

    Like ``withColumns``, but the values come out of a one-row generator, which
    filters are not pushed through and projections are not merged with. A plain
    chain of projections would let a filter on a late column copy every
    expression below it into its condition, many times over.
    """
    bundle = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(bundle)))


def strip(value: Column | str) -> Column:
    # The look-behind keeps long inner runs of blanks from being scanned repeatedly; visible ASCII is passed over by one range.
    return F.regexp_replace(col(value), f"^[{WS}]+|(?=[^!-~])(?<![{WS}])[{WS}]+$", "")


def nonempty(value: Column) -> Column:
    return F.when(value != "", value)


def fits(text: Column, maximum: int) -> Column:
    """Whether a text has at most so many characters. These are counted only where the bytes leave it open."""
    size = F.octet_length(text)
    return (size <= maximum) | ((size <= 4 * maximum) & (F.length(text) <= maximum))


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def sql_text(value: str) -> str:
    """A string as an SQL literal. Constant tables are handed over as one SQL
    expression: building them value by value costs a call to the JVM each."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def text_array(values: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")


def int_array(values: Iterable[int]) -> Column:
    return F.expr(f"cast(array({', '.join(str(v) for v in values)}) AS array<int>)")


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def all_true(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def unique_texts(values: Column) -> Column:
    """Collapse whitespace, drop blanks, keep first occurrences in order (array in, array out)."""
    from .text import collapse_ws

    return F.array_distinct(F.filter(F.transform(values, collapse_ws), lambda x: x != ""))
