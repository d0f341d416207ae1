"""Benchmark decontamination by spaced seeds.

A mask keeps some of the tokens of a window and ignores the others; windows of training texts and of
benchmark items are hashed under the same masks and joined by hash. Around a hit the texts are laid
over each other along its diagonal, and the best stretch is scored with a penalty for each differing
token; any 12 aligned tokens with ``LEAST`` matches count too. ``MASKS`` were chosen so that any 12 aligned
tokens with at most two substitutions hold a hit. An item of fewer than ``LEAST`` tokens is found where a
text holds all of it, word for word; ``SHORT`` are the masks of items that are shorter than ``MASKS``.

The corpus is read once. A bit filter of the benchmark's hashes, of bounded size, tells which windows take
part in the join; a larger benchmark lets more through, nothing is lost. Places at which a hash occurs
travel as series (start, gap, number), so texts of repeated tokens give few rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, arrow_rows, slices, written

#: Kept (1) and ignored (0) tokens.
MASKS = ("11111", "110111", "111011", "1100111", "1101101", "1110011", "1011011", "11010011")
SHORT = ("1", "11", "111", "1111")
#: Bits of the filter: for each hash, at least and at most (as powers of two), and how many a hash sets.
FILTER_EACH, FILTER_LEAST, FILTER_MOST, PROBES = 64, 16, 29, 6
#: Parts into which the rows of a hash or an item are dealt where these are too many to be broadcast.
SALTS = 16
#: Bytes of text that a task cuts into tokens at once.
SLICE_BYTES = 8 << 20
#: Matching tokens that an overlap needs; of a shorter item, all.
LEAST = 10
#: Aligned tokens among which so many matches are enough, wherever the differing ones stand.
SPAN = 12
#: What a differing token costs, where a matching one gives 1.
PENALTY = 3

_ALL = MASKS + SHORT
#: Scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, Han, kana, bopomofo.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_FACTORS = np.random.default_rng(5).integers(1 << 62, dtype=np.uint64, size=(len(_ALL), 16)) * np.uint64(2) + np.uint64(1)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; single characters of scripts without spaces."""
    return _WORD.findall((text or "").lower())


def _hashes(parts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))


def masked(hashes: np.ndarray, which: int) -> np.ndarray:
    """Hash of the window from each place, under one mask."""
    mask = _ALL[which]
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out += hashes[k : k + n] * _FACTORS[which, k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


def overlap(ours: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best stretch of the item laid over the text from ``shift``: matches, start, end in the item."""
    a, b = max(0, -shift), min(len(item), len(ours) - shift)
    same = ours[a + shift : b + shift] == item[a:b]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(total[: end + 1].argmin())
    n = int(same[start:end].sum())
    if n < LEAST <= len(same):
        span = min(SPAN, len(same))
        sums = np.concatenate([[0], np.cumsum(same)])
        sums = sums[span:] - sums[:-span]
        if sums.max() >= LEAST:
            start = int(sums.argmax())
            n, end = int(sums[start]), start + span
    return n, a + start, a + end


def series(group: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of each key of a group as series: group, key, start, gap, number of places."""
    order = np.lexsort((at, keys, group))
    group, keys, at = group[order], keys[order], at[order].astype(np.int64)
    linked = (group[1:] == group[:-1]) & (keys[1:] == keys[:-1])
    gaps, links = np.diff(at), np.flatnonzero(linked)
    new = np.ones(len(links), bool)
    new[1:] = (np.diff(links) > 1) | (gaps[links[1:]] != gaps[links[:-1]])
    cuts = np.flatnonzero(new)
    alone = np.flatnonzero(~np.append(linked, False) & ~np.append(False, linked)) if len(at) else links
    first = np.concatenate([links[cuts], alone])
    gap = np.concatenate([gaps[links[cuts]], np.ones(len(alone), np.int64)])
    n = np.concatenate([np.diff(np.append(cuts, len(links))) + 1, np.ones(len(alone), np.int64)])
    return group[first], keys[first], at[first], gap, n


def _windows(parts: list[np.ndarray], short: bool, chosen: Callable[[np.ndarray], np.ndarray] = lambda keys: np.arange(len(keys))) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The masked hashes of several token lists, as far as they are chosen: list, hash, place.

    ``short``: masks of short items for these alone.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    joined = np.concatenate([*parts, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(parts)), sizes)
    out = []
    for which, mask in enumerate(_ALL):
        keys = masked(joined, which)
        at = chosen(keys)
        at = at[at + len(mask) <= ends[owner[at]]]
        if short and which >= len(MASKS):
            at = at[sizes[owner[at]] == len(mask)]
        out.append((owner[at], keys[at], at - (ends - sizes)[owner[at]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Each gives the bit of a hash that a probe looks at: the upper bits of the product.
_FACTOR = [np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(PROBES)]


_SERIES = "key long, start int, gap int, n int"


def _items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct items ``(item, item_id, size, tokens)``. Those without text or id take no part."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_hashes(tokens(x)) for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "size", "tokens"])

    return written(rows.mapInArrow(told, "item_id long, size int, tokens binary").withColumn("item", F.monotonically_increasing_id()), "items")


def _postings(items: DataFrame) -> DataFrame:
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, *rest = series(*_windows([np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()], short=True))
            cols = [batch.column(0).take(pa.array(group)), pa.array(rest[0].view(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest[1:])]
            yield pa.RecordBatch.from_arrays(cols, ["item", "key", "start", "gap", "n"])

    return written(items.select("item", "tokens").mapInArrow(told, f"item long, {_SERIES}"), "postings")


def _filter(postings: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The filter of all hashes and its size as a power of two: a byte for each bit, a large one eight bits a byte.

    It reaches the driver as words of 64 bits, whose number is bounded.
    """
    power = int(np.clip(np.ceil(np.log2(max(n, 1) * FILTER_EACH)), FILTER_LEAST, FILTER_MOST))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([(keys * f) >> np.uint64(64 - power) for f in _FACTOR]))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = postings.select("key").mapInArrow(told, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << power - 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little") if power <= 24 else out.view(np.uint8), power


def _passed(table: np.ndarray, power: int, keys: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be the benchmark's."""
    at = np.arange(len(keys))
    for factor in _FACTOR:
        own = (keys[at] * factor) >> np.uint64(64 - power)
        at = at[(table[own] if len(table) >> power else table[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8) & 1) > 0]
    return at


def _beside(left: DataFrame, right: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """Join to a table of the benchmark: by broadcast under a checked number of rows, else dealt by key and salt."""
    if n <= MAX_BROADCAST_ROWS:
        return left.join(right.hint("broadcast"), key)
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return left.join(right.hint("merge"), [key, "salt"]).drop("salt")


def _shifts() -> Column:
    """All shifts at which two series of places meet: of the text (start, gap, n), and of the item (at, step, m)."""
    base = F.col("start") - F.col("at")
    gap, step = F.when(F.col("n") == 1, F.col("step")).otherwise(F.col("gap")), F.when(F.col("m") == 1, F.col("gap")).otherwise(F.col("step"))
    line = F.sequence(base - step * (F.col("m") - 1), base + gap * (F.col("n") - 1), gap)
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: base + gap * i - step * j)))
    return F.when(gap == step, line).otherwise(grid)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, a, b, item id, tokens of text, tokens of item, shifts) rows those with an overlap."""
    for batch in batches:
        at, matched, shares = [], [], []
        for i, (ours, item, shifts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
            ours, item = np.frombuffer(ours, np.uint64), np.frombuffer(item, np.uint64)
            covered, most = np.zeros(len(item), bool), 0
            for n, a, b in (overlap(ours, item, s) for s in shifts):
                if n >= min(LEAST, len(item)):
                    covered[a:b] = True
                    most = max(most, n)
            if most:
                at.append(i)
                matched.append(most)
                shares.append(float(covered.mean()))
        cols = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(matched, pa.int32()), pa.array(shares, pa.float64())], ["id", "a", "b", "item_id", "matched", "share"])


def _text_name(text: str) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b")]


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """Items found: ``(id, a, b, item_id, matched, share)``; a and b stand for the text."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    kind = docs.schema[id_col].dataType.simpleString() if id_col else "long"
    items = _items(benchmark)
    postings = _postings(items)
    n = postings.count()
    table, power = _filter(postings, n)
    shared = spark.sparkContext.broadcast(table)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE_BYTES):
            parts = [_hashes(tokens(x)) for x in batch.column(3).to_pylist()]
            text, keys, at = _windows(parts, False, lambda x: _passed(shared.value, power, x))
            if not len(keys):
                continue
            text, keys, *rest = series(text, keys, at)
            order = np.argsort(text, kind="stable")
            own, first = np.unique(text[order], return_index=True)
            cuts = pa.array(np.append(first, len(order)).astype(np.int32))
            cols = [batch.column(c).take(pa.array(own)) for c in range(3)] + [pa.array([parts[i].tobytes() for i in own], pa.binary())]
            cols += [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (keys.view(np.int64), *(y.astype(np.int32) for y in rest))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "a", "b", "tokens", "key", "start", "gap", "n"])

    own = F.col(id_col) if id_col else F.lit(0).cast("long")
    rows = docs.select(own.alias("id"), *_text_name(text_col), F.col(text_col).alias("text"))
    form = f"id {kind}, a long, b long, tokens binary, key array<long>, start array<int>, gap array<int>, n array<int>"
    hits = written(rows.mapInArrow(told, form).withColumn("row", F.monotonically_increasing_id()), "hits")
    flat = hits.select("row", F.inline(F.arrays_zip("key", "start", "gap", "n")))
    theirs = postings.select("key", "item", F.col("start").alias("at"), F.col("gap").alias("step"), F.col("n").alias("m"))
    pairs = _beside(flat, theirs, "key", n, "row").select("row", "item", F.explode(_shifts()).alias("shift"))
    pairs = written(pairs.groupBy("row", "item").agg(F.collect_set("shift").alias("shifts")), "pairs")
    pairs = _beside(pairs, items.select("item", "item_id", F.col("tokens").alias("theirs")), "item", items.count(), "row")
    both = pairs.join(hits.select("row", "id", "a", "b", "tokens").hint("merge"), "row").select("id", "a", "b", "item_id", "tokens", "theirs", "shifts")
    return written(both.mapInArrow(_verified, f"id {kind}, a long, b long, item_id long, matched int, share double"), "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold parts of benchmark items: ``(<id_col>, item_ids, matched, share)``.

    One row for each id that has a hit: the items in ascending order, the most matching tokens in one
    stretch, and the largest share of an item that is covered. Rows that repeat an id are told
    together, as are those without one. Null and empty texts have no hit; an empty benchmark or table
    gives an empty result. Only the named columns are read (the benchmark's are item_id and text).
    """
    found = _found(docs, benchmark, id_col, text_col)
    return found.groupBy(F.col("id").alias(id_col)).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("matched").alias("matched"),
        F.max("share").alias("share"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no part of a benchmark item; columns as they are.

    Texts that do are known by two 64-bit hashes, so equal texts go together and ids play no part.
    """
    bad = written(_found(docs, benchmark, None, text_col).select("a", "b").distinct(), "bad")
    how = "broadcast" if bad.count() <= MAX_BROADCAST_ROWS else "merge"
    a, b = _text_name(text_col)
    return docs.join(bad.hint(how), (a == bad["a"]) & (b == bad["b"]), "left_anti")
