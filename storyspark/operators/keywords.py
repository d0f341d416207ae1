"""All keywords of a table in one pass over each text, by an Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

from ..functions.batches import small_batches

#: Characters of keywords in one automaton; a table with more is gone through in several passes.
MOST_CHARS = 32 << 20


class Automaton:
    """Counts of keywords in a text; a keyword's occurrences are counted from the left without overlaps."""

    def __init__(self, keywords: list[str]) -> None:
        self.size = len(keywords)
        own = ahocorasick.Automaton()
        for i, k in enumerate(keywords):
            own.add_word(k, i)
        if keywords:
            own.make_automaton()
        self.own, self.lengths = own, np.array([len(k) for k in keywords], np.int64)
        self.folds = np.array([self._folds(k) for k in keywords], bool)

    @staticmethod
    def _folds(keyword: str) -> bool:
        """Whether two occurrences can overlap: the keyword begins as it ends."""
        return keyword[:1] in keyword[1:] and any(keyword.endswith(keyword[:n]) for n in range(1, len(keyword)))

    def hits(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keywords that occur, ascending, and how often."""
        none = np.zeros(0, np.int64)
        if not text or not self.size:
            return none, none
        found = np.fromiter(chain.from_iterable(self.own.iter(text)), np.int64)
        if not len(found):
            return none, none
        ends, ids = found[0::2], found[1::2]
        if (double := self.folds[ids]).any():
            good = ~double
            last: dict[int, int] = {}
            for at in np.flatnonzero(double).tolist():
                k, end = int(ids[at]), int(ends[at])
                if end - last.get(k, -1 << 60) >= self.lengths[k]:
                    good[at] = True
                    last[k] = end
            ids = ids[good]
        return np.unique(ids, return_counts=True)


class Owned(Automaton):
    """Keywords of groups: a group may list a keyword at several places, and several groups may list it."""

    def __init__(self, entries: list[tuple[str, int, int]]) -> None:
        rows = sorted(entries)
        words = sorted({r[0] for r in rows})
        super().__init__(words)
        self.words = pa.array(words, pa.string())
        self.group, self.place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        number = {w: i for i, w in enumerate(words)}
        self.many = np.bincount([number[r[0]] for r in rows], minlength=len(words)).astype(np.int64)
        self.begin = np.cumsum(self.many) - self.many

    def by_group(self, text: str | None) -> tuple[np.ndarray, ...]:
        """Of each group with a hit: number, occurrences, listed keywords that occur, and the first place of one."""
        ks, ns = self.hits(text)
        many = self.many[ks]
        at = np.repeat(self.begin[ks] - np.cumsum(many) + many, many) + np.arange(many.sum())
        groups, where = np.unique(self.group[at], return_inverse=True)
        first = np.full(len(groups), np.iinfo(np.int64).max)
        np.minimum.at(first, where, self.place[at])
        return groups, np.bincount(where, np.repeat(ns, many), len(groups)).astype(np.int64), np.bincount(where, minlength=len(groups)), first


#: The automaton of this worker process, by the name of its list.
_HELD: dict[str, Owned] = {}


def _owned(name: str, shared: Broadcast) -> Owned:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Owned(shared.value)
    return _HELD[name]


def _lists(entries: DataFrame, by: str) -> Iterator[list[tuple[str, int, int]]]:
    """``(keyword, group, place)`` in lists that one automaton holds; null and empty keywords never occur."""
    own = entries.where("keyword != ''").select("keyword", "group", "place")
    n = max(1, -(-(own.agg(F.sum(F.length("keyword"))).first()[0] or 0) // MOST_CHARS))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64(by), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def _udf(entries: list[tuple[str, int, int]], spark: SparkSession, told: Callable[[Owned, str | None], tuple], fields: list[tuple[str, DataType, pa.DataType]]) -> Callable[[Column], Column]:
    """A function of a text that lists what ``told`` finds in it."""
    small_batches(spark)
    shared, name = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

    def of(texts: pa.Array) -> pa.Array:
        own = _owned(name, shared)
        found = [told(own, x) for x in texts.to_pylist()]
        ends = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(fields))]
        arrays = [own.words.take(pa.array(c)) if kind == pa.string() else pa.array(c, kind) for c, (_, _, kind) in zip(cols, fields, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, [f[0] for f in fields]))

    return F.arrow_udf(of, ArrayType(StructType([StructField(n, t) for n, t, _ in fields])))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str = "novel_id", text: str = "text") -> DataFrame:
    """``(key, keyword, n)`` of the keywords that each text holds; ``n`` counts occurrences that do not overlap.

    ``keywords`` has a ``keyword`` column; repeats, nulls and empty strings in it do not matter. Each text is read
    once, however many keywords there are, up to ``MOST_CHARS`` of them together: their list is
    broadcast, and each worker builds the automaton once. More are gone through in several passes. Rows of
    texts are not put together: a repeated key has the hits of each of its rows. A null text has none.
    """
    entries = keywords.select("keyword").distinct().select("keyword", F.lit(0).alias("group"), F.lit(0).alias("place"))
    fields = [("keyword", StringType(), pa.string()), ("n", LongType(), pa.int64())]
    out = []
    for own in _lists(entries, "keyword"):
        f = _udf(own, texts.sparkSession, Owned.hits, fields)
        out.append(texts.select(key, F.explode(f(F.col(text))).alias("h")).select(key, "h.*"))
    return _union(out)


def group_hits(texts: DataFrame, entries: DataFrame, key: str = "novel_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``(key, group, n, present, first)`` of the groups of keywords that have a hit in a text.

    ``entries`` has ``(keyword, group, place)``. ``n`` sums the occurrences of a group's keywords, ``present`` counts its entries that
    occur, ``first`` is the least place of one. See ``keyword_hits``; groups are kept ``whole`` in one pass, unless the caller adds up.
    """
    fields = [(n, LongType(), pa.int64()) for n in ("group", "n", "present", "first")]
    out = []
    for own in _lists(entries, "group" if whole else "keyword"):
        f = _udf(own, texts.sparkSession, Owned.by_group, fields)
        out.append(texts.select(key, F.explode(f(F.col(text))).alias("h")).select(key, "h.*"))
    return _union(out)
