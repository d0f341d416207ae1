"""Text expressions with one fixed meaning, used by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Rows of a declared table (rules, lexicon) that may be broadcast to the texts.
MOST_DECLARED = 10_000


def declared(rows: DataFrame) -> DataFrame:
    """A declared table, to be broadcast; one that is not small raises."""
    if len(rows.limit(MOST_DECLARED + 1).select(F.lit(1)).collect()) > MOST_DECLARED:
        raise ValueError(f"over {MOST_DECLARED} declared rows")
    return F.broadcast(rows)


def cnt(text: str | Column, keyword: str) -> Column:
    """Occurrences of a keyword that do not overlap. Bytes are compared, as their number is known without reading the text."""
    t = col(text)
    gone = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(keyword), F.lit("")))
    return F.coalesce((gone / len(keyword.encode())).cast("int"), F.lit(0))


def has(text: str | Column, keyword: str) -> Column:
    return F.coalesce(F.contains(col(text), F.lit(keyword)), F.lit(False))


def has_any(text: str | Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | has(text, k)
    return out


#: White space as Unicode has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: str | Column) -> Column:
    """Without white space of any kind at both ends. No pattern: one would look for the end from each blank on."""
    return F.trim(col(text), F.lit(WHITE))


def first_present(text: str | Column, keywords: list[str]) -> Column:
    """The first keyword, in list order, that the text holds; else null."""
    return F.coalesce(*[F.when(has(text, k), F.lit(k)) for k in keywords])


def matches(text: str | Column, pattern: str, group: int = 0) -> Column:
    """All matches of a literal pattern; a dot stops at line feeds only."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(f"(?d){pattern}"), F.lit(group)), F.array().cast("array<string>"))


def alternation(keywords: list[str]) -> str:
    return "|".join(rf"\Q{k}\E" for k in keywords)


def one_of(marks: str) -> str:
    """A pattern for any of some marks; a single one is quoted, as Java splits by such a mark without a pattern."""
    return rf"\{marks}" if len(marks) == 1 and not marks.isalnum() else f"[{marks}]"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def compact(*items: Column) -> Column:
    """The items that are not null, in order."""
    return F.array_compact(F.array(*items))


def mean_of(items: Column, default: float) -> Column:
    """Mean of an array of numbers; the default where it is empty."""
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(default))
