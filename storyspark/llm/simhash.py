"""SimHash near-duplicate groups by pigeonhole blocks.

Texts get a 64-bit fingerprint of their three-word shingles. Two fingerprints that differ in at most
three bits agree in at least three of six blocks, so every close pair meets in one of the 20 choices
of three blocks; within a bucket the Hamming distance is verified. Only distinct fingerprints are
compared, and a bucket yields a spanning set of links, never all its pairs. Buckets over ``limit``
fingerprints are divided once more by the same rule on the bits that are still free, before the
shuffle; what then remains has at most 16 free bits, so at most 65,536 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, arrow_rows, tree_links, unused, written
from .components import components

BITS, MAX_BITS, BLOCKS = 64, 3, 6
SEED = 42
#: Fingerprints in a bucket before it is divided again.
LIMIT = 2000


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than ASCII white space."""
    return text.encode("utf-8").lower().split()


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of three-word shingles, repeats counted; 0 for a text without words."""
    parts = words(text or "")
    if not parts:
        return 0
    if len(parts) < 3:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    counts = np.zeros(BITS, np.int64)
    n = len(parts) - 2
    for at in range(0, n, 1 << 16):
        piece = parts[at : at + (1 << 16) + 2]
        grams = map(b" ".join, zip(piece, piece[1:], piece[2:], strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column(1)]
        fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])


def _masks(free: list[int], blocks: int = BLOCKS, keep: int = BLOCKS - MAX_BITS) -> list[int]:
    """Masks of each choice of ``keep`` of the blocks into which the bit positions are cut."""
    cut = [int(m) for m in (sum(1 << int(b) for b in part) for part in np.array_split(free, blocks))]
    return [sum(c) for c in combinations(cut, keep)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _rest(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def spanning(fps: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links that join exactly what chains of at most ``MAX_BITS`` differing bits join."""
    left, found = np.arange(len(fps)), []
    while len(left):
        front, group, left = [left[0]], [int(nodes[left[0]])], left[1:]
        while front and len(left):
            close = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= MAX_BITS
            if close.any():
                front += left[close].tolist()
                group += nodes[left[close]].tolist()
                left = left[~close]
        found += tree_links(group)
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (how, key); a group may run over several batches."""
    held: list[np.ndarray] = []
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def told(rows: np.ndarray, found: list) -> None:
        cuts = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(rows))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            found += spanning(rows[a:b, 2].view(np.uint64), rows[a:b, 3])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        if held and (held[-1][-1, :2] == rows[-1, :2]).all():
            held.append(rows)  # the group goes on
            continue
        rows = np.concatenate([*held, rows])
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        end = int(last[-1]) + 1 if len(last) else 0
        found: list[tuple[int, int]] = []
        if end:
            told(rows[:end], found)
        held = [rows[end:]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)
    found = []
    if held:
        told(np.concatenate(held), found)
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Spanning links ``(u, v)`` between the rows ``(fp, node)`` of distinct fingerprints."""
    first = _masks(list(range(BITS)))
    keys = F.explode(
        F.array(*[F.struct(F.lit(i).alias("how"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(first)])
    )
    at = nodes.select("fp", "node", keys.alias("b")).select("fp", "node", "b.how", "b.key")
    heavy = written(at.groupBy("how", "key").count().where(F.col("count") > limit).select("how", "key", F.lit(True).alias("big")), "heavy")
    how = "broadcast" if heavy.count() <= MAX_BROADCAST_ROWS else "merge"
    at = at.join(heavy.hint(how), ["how", "key"], "left")
    finer = F.lit(None).cast("array<struct<how:int,key:bigint>>")
    for i, m in enumerate(first):
        second = [(100 * (i + 1) + j, _signed(m | s)) for j, s in enumerate(_masks(_rest(m)))]
        choices = F.array(*[F.struct(F.lit(k).alias("how"), F.col("fp").bitwiseAND(F.lit(s)).alias("key")) for k, s in second])
        finer = F.when(F.col("how") == i, choices).otherwise(finer)
    whole = F.array(F.struct(F.col("how").alias("how"), F.col("key").alias("key")))
    spread = at.select("fp", "node", F.explode(F.when(F.col("big"), finer).otherwise(whole)).alias("b"))
    spread = spread.select(F.col("b.how").cast("long").alias("how"), "b.key", "fp", "node")
    dealt = spread.repartition("how", "key").sortWithinPartitions("how", "key")
    return dealt.mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Fingerprint and group of each row: ``(<id_col>, fingerprint, component_id)``.

    Only the two named columns are read, so other columns and their names do not matter. One row
    comes back for each input row, repeated ids included; ``component_id`` is the smallest id that
    is reachable through links, the row's own included. A null or wordless text has fingerprint
    zero and is linked like any other. A row with a null id keeps its fingerprint, takes no part in
    groups and has a null ``component_id``. An empty table gives an empty result. Texts are used
    whole, however long.
    """
    arrow_rows(docs.sparkSession, 2000)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(_fingerprints, "id long, fp long"), "fingerprints")
    nodes = rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    nodes = written(nodes, "nodes")
    found = components(links(nodes, limit))
    names = nodes.join(found.hint("merge"), "node", "left").select(
        F.col("fp").alias("of_fp"), F.coalesce("component", "node").alias("component")
    )
    out = rows.join(names.hint("merge"), F.col("fp") == F.col("of_fp"), "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).cast(kind).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id stays."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col)


def keep_least(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose ``component_id`` among ``rows`` is their own id.

    Columns stay as they are. Of rows that repeat an id one stays, the one whose values have the smallest
    hash; rows with a null id stay. The texts are shuffled once, by id.
    """
    own, n = unused("kept_id", docs.columns), unused("kept_n", docs.columns)
    kept = rows.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(own)).agg(F.count("*").alias(n))
    kept = written(kept, "kept")
    once = docs.join(kept.where(F.col(n) == 1).hint("merge"), F.col(id_col) == F.col(own), "left_semi")
    several = docs.join(kept.where(F.col(n) > 1).hint("merge"), F.col(id_col) == F.col(own), "left_semi")
    row = F.struct(*docs.columns)
    least = several.groupBy(F.col(id_col).alias(own)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    out = once.unionByName(least).unionByName(docs.where(F.col(id_col).isNull()))
    return out.select(*docs.columns)
