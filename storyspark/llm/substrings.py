"""Removal of repeated word windows, found through difference-cover anchors.

``COVER`` holds residues modulo ``PERIOD`` whose differences give every residue. So for any two places
i and j of an equal run of words there is an offset below the period at which both places plus the
offset are cover positions. Hence an equal window of ``length`` words holds, for both of its places,
one aligned anchor of ``length - PERIOD + 1`` words, and only anchors at cover positions are hashed.

1. Anchors are hashed and grouped; those that occur once are done with.
2. Around the others the match is extended: each full window that holds a repeated anchor is hashed
   (96 bits) and grouped. A window whose hash occurs again is repeated.
3. The words that repeated windows cover are removed.

No pairs are made: a group is only told whether it has a second member. Each map task thins out what
repeats among its own rows (one witness goes on under the hash, the others are known to repeat and are
dealt out evenly), so a passage that a third of all documents share loads no single task.

The texts are written once, each row with a number of its own, and stay where they are: what was found is
dealt out by the files of that table, and a task that gets a file's findings reads that file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, passing_shuffles, written
from .files import seekable

#: A perfect difference set: every residue modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
LENGTH = 35
#: Hashes that a map task looks through at once for repeats of its own.
CHUNK = 1 << 21

_RANDOM = np.random.default_rng(20240801)
_FACTORS = _RANDOM.integers(1 << 62, dtype=np.uint64, size=(2, 512)) * np.uint64(2) + np.uint64(1)
_INT = (1 << 31) - 1


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, unchanged."""
    return (text or "").encode("utf-8").split()


def _factors(which: int, length: int) -> np.ndarray:
    if length <= _FACTORS.shape[1]:
        return _FACTORS[which, :length]
    return np.random.default_rng(which).integers(1 << 62, dtype=np.uint64, size=length) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``length`` consecutive word hashes from each place in ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k, f in enumerate(_factors(which, length)):
        out += hashes[at + k] * f
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def cover_positions(n: int) -> np.ndarray:
    """Cover positions below ``n``, ascending."""
    base = np.arange(0, n, PERIOD)
    at = (base[:, None] + np.array(COVER)).ravel()
    return at[at < n]


class _Out:
    """Gathers (key, check, row, pos) rows and yields them with their kind, in bounded pieces."""

    names = ("key", "check", "row", "pos", "kind")
    types = (np.uint64, np.int32, np.int64, np.int32)

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, key: np.ndarray, check: np.ndarray, row: int, pos: np.ndarray) -> None:
        self.parts.append((key, check, np.full(len(pos), row, np.int64), pos))
        self.n += len(pos)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        cols = [np.concatenate([p[i] for p in self.parts]).astype(t, copy=False) for i, t in enumerate(self.types)]
        self.parts, self.n = [], 0
        order = np.lexsort((cols[1], cols[0]))
        key, check = cols[0][order], cols[1][order]
        new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        several = np.repeat(size > 1, size)
        kind = np.empty(len(key), np.int32)  # 0: once here; 1: witness of several here; 2: known to repeat
        kind[order] = np.where(several, np.where(new, 1, 2), 0)
        known = kind == 2
        cols[0][known] = np.arange(known.sum(), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cols[0] = cols[0].view(np.int64)
        cols.append(kind)
        for a in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in cols], list(self.names))


_ROWS = "key long, check int, row long, pos int, kind int"


def _hashed(text: str | None) -> np.ndarray:
    parts = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def _anchors(length: int):
    size = length - PERIOD + 1

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = _hashed(text.as_py())
                if len(hashes) >= length:
                    at = cover_positions(len(hashes) - size + 1)
                    out.add(window_hashes(hashes, at, size), np.zeros(len(at), np.int32), row, at)
                if out.n >= CHUNK:
                    yield from out.batches()
        yield from out.batches()

    return told


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The rows of files of texts, each with its runs: starts and ends. Batches are (path, runs)."""
    for batch in batches:
        for path, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {r["row"]: (r["starts"], r["ends"]) for r in runs or []}
            with seekable(path) as file:
                for part in pq.ParquetFile(file).iter_batches(500, columns=columns):
                    for row, *rest in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                        yield *rest, row, *found.get(row, ([], []))


def _windows(length: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for text, row, starts, ends in _read(batches, ["row", "text"]):
            if not starts:
                continue
            hashes = _hashed(text)
            last = len(hashes) - length + 1
            at = np.concatenate([np.arange(max(a, 0), min(b, last)) for a, b in zip(starts, ends, strict=True)])
            check = (window_hashes(hashes, at, length, 1) >> np.uint64(33)).astype(np.int32)
            out.add(window_hashes(hashes, at, length), check, row, at)
            if out.n >= CHUNK:
                yield from out.batches()
        yield from out.batches()

    return told


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, check), those whose group has a second member."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        starts = np.flatnonzero(new)
        end = int(starts[-1])
        yield from _told([c[:end] for c in cols], starts[:-1])
        held = [c[end:] for c in cols]
    if held is not None:
        yield from _told(held, np.zeros(1, np.int64))


def _told(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(cols[0])
    if not n:
        return
    kind = cols[4]
    owners = np.add.reduceat((kind < 2).astype(np.int64), starts)
    hit = (kind > 0) | np.repeat(owners > 1, np.diff(np.append(starts, n)))
    if hit.any():
        yield pa.RecordBatch.from_arrays([pa.array(cols[i][hit]) for i in (2, 3)], ["row", "pos"])


def merged(starts: np.ndarray, width_left: int, width_right: int) -> tuple[np.ndarray, np.ndarray]:
    """Unions of [s - width_left, s + width_right) over sorted starts."""
    low, high = starts - width_left, starts + width_right
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    return low[np.append(0, cut)], high[np.append(cut - 1, len(low) - 1)]


def _runs(left: int, right: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [merged(np.sort(np.array(x.as_py(), np.int64)), left, right) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i].tolist() for p in pairs], pa.list_(pa.int32())) for i in (0, 1))], ["row", "starts", "ends"])

    return told


def _found(rows: DataFrame, left: int, right: int, name: str) -> DataFrame:
    """Per document the merged runs around the places of repeated hashes."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "check")
    places = dealt.mapInArrow(_repeated, "row long, pos int")
    lists = places.groupBy("row").agg(F.collect_list("pos").alias("pos"))
    return written(lists.mapInArrow(_runs(left, right), "row long, starts array<int>, ends array<int>"), name)


def _part(row: str) -> Column:
    """The task that wrote a row, and so its file: the upper bits of the number it got."""
    return F.shiftright(row, 33).alias("part")


def _beside(files: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Files ``(path, runs)``, each with its rows' runs, one file a task."""
    told = runs.groupBy(_part("row")).agg(F.collect_list(F.struct("row", "starts", "ends")).alias("runs"))
    return files.join(told.hint("merge"), "part", how).select("path", "runs").repartition(max(1, files.count()))


def _removed(with_text: bool):
    kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(kinds)[: 4 + with_text]
        rows = _read(batches, ["row", "id", "none", "text"])
        while some := list(islice(rows, 500)):
            out: list[tuple] = []
            for doc, none, text, _, starts, ends in some:
                parts = words(text)
                gone = 0
                for a, b in zip(reversed(starts), reversed(ends), strict=True):
                    gone += len(parts[a:b])
                    del parts[a:b]
                kept = b" ".join(parts)
                out.append((None if none else doc, len(parts) + gone, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[c]) for i, c in enumerate(names)], names)

    return told


def _plain(path: Column) -> Column:
    """A local file's path as it is named: Spark tells it with signs escaped. Other stores take escaped URIs."""
    return F.when(F.startswith(path, F.lit("file:")), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Remove each word that lies in a window of ``length`` words which also starts elsewhere.

    Returns ``(<id_col>, n_words, n_removed, kept_sha256)`` and, ``with_text``, the kept words joined by
    one space as ``kept``: one row for each input row. Windows are judged on the input texts. A null
    or wordless text has no words (the hash is that of the empty text). Rows that repeat an id, or
    have none, are documents of their own. Only the two named columns are read. ``length`` must
    exceed the period of the cover.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    arrow_rows(docs.sparkSession, 1000)
    kind = docs.schema[id_col].dataType.simpleString()
    own = F.col(id_col)
    rows = docs.select(own.cast("long").alias("id"), own.isNull().alias("none"), F.col(text_col).alias("text"))
    texts = written(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    files = written(texts.select(_part("row"), _plain(F.col("_metadata.file_path")).alias("path")).distinct(), "files")
    with passing_shuffles(docs.sparkSession):
        near = _found(texts.select("row", "text").mapInArrow(_anchors(length), _ROWS), PERIOD - 1, 1, "anchors")
        runs = _found(_beside(files, near, "inner").mapInArrow(_windows(length), _ROWS), 0, length, "windows")
    text = ", kept string" if with_text else ""
    out = _beside(files, runs, "left").mapInArrow(_removed(with_text), f"id long, n_words long, n_removed long, kept_sha256 string{text}")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
