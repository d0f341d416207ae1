"""Near copies: candidates by SimHash, links by exact similarity.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of ``LEAST`` or
more. A shingle gives each bit of a text's SimHash a weight between -1 and 1, a byte of a hash; a bit is set if
the weights of the set sum up to more than zero. Sets of a similarity of 0.8 differ in 15 % of the bits, and the
bits that differ are mostly those whose sums are near zero. So a band of ``WIDE`` bits has its ``OPEN`` least sure
bits both ways, as eight keys, and texts that share a key of one of ``BANDS`` bands are linked if ``CHECK``
further bits differ in ``RADIUS`` places at most. A pair of similarity 0.8 misses all bands with a chance of
4 in 100,000 and the radius with 3 in 100,000; one that is more alike, far less often.

What such links join is a group of candidates: there the sets themselves are compared, and a group yields
a spanning set of links. A group whose sets hold over ``BLOCK`` shingles is cut into parts, and each two
parts meet in a task of their own.

Within a task only texts are compared that share one of their rarest shingles: sets of a similarity of
0.8 share at least one of the rarest fifth of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import FAN, MAX_BROADCAST_ROWS, arrow_rows, tree_links, written
from .components import components

SIZE = 5
#: Least Jaccard similarity, as a fraction.
LEAST = (4, 5)
#: Bits of a band, those of them that are put both ways, bands, further bits, and how many of these may differ.
WIDE, OPEN, BANDS, CHECK, RADIUS = 20, 3, 22, 128, 36
#: Shingles in the sets of a group that one task compares.
BLOCK = 4_000_000
#: Texts in a bucket that are compared all at once; a larger one is gone through text by text.
FEW = 256
#: Pairs that a task holds before they are reduced to trees.
HELD = 500_000
_HASHES = (WIDE * BANDS + CHECK) // 8
_XOR, _TIMES = np.random.default_rng(11).integers(1 << 63, dtype=np.uint64, size=(2, _HASHES))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)
_FOLD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x00FF00FF00FF00FF)
_WAYS = np.array([[way >> i & 1 for i in range(OPEN)] for way in range(1 << OPEN)])


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles, repeats included; of the whole text where it has fewer words."""
    parts = simhash.words(text or "")
    n = max(1, len(parts) - SIZE + 1) if parts else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + SIZE]), simhash.SEED) for i in range(n)), np.uint64, n)


def sums(own: np.ndarray) -> np.ndarray:
    """The sums of weights, one for each bit of the SimHash, of a set of shingles."""
    total = np.zeros((2, _HASHES, 4), np.int64)
    for at in range(0, len(own), 256):  # 256 bytes fit into the 16 bits that each gets
        x = (own[at : at + 256, None] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(32)
        x *= _FOLD
        x ^= x >> np.uint64(29)
        total[0] += (x & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
        total[1] += (x >> np.uint64(8) & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
    return 2 * total.ravel() - 255 * len(own)


def prints(found: np.ndarray) -> np.ndarray:
    """What is kept of rows of sums: the bits of the SimHash, and the places of each band's least sure bits; bytes."""
    banded = np.abs(found[:, : WIDE * BANDS]).reshape(-1, BANDS, WIDE)
    least = np.argsort(banded, axis=2, kind="stable")[:, :, :OPEN].astype(np.uint8)
    return np.concatenate([np.packbits(found > 0, axis=1, bitorder="little"), least.reshape(len(found), -1)], axis=1)


def keys(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows of ``prints``, and the bits that are checked, as two 64-bit numbers."""
    bits = np.unpackbits(kept[:, : WIDE * BANDS // 8], axis=1, bitorder="little").reshape(-1, BANDS, WIDE).astype(np.int32)
    least = kept[:, _HASHES:].reshape(-1, BANDS, OPEN).astype(np.int64)
    np.put_along_axis(bits, least, 0, axis=2)
    fixed = bits @ (1 << np.arange(WIDE, dtype=np.int32)) + (np.arange(BANDS, dtype=np.int32) << WIDE)
    found = fixed[:, :, None] + ((1 << least)[:, :, None, :] * _WAYS).sum(axis=3)
    check = np.ascontiguousarray(kept[:, WIDE * BANDS // 8 : _HASHES]).view(np.int64)
    return found.reshape(len(kept), -1).astype(np.int32), check


def _name(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes that stand for a set."""
    raw = own.tobytes()
    return tuple(np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)], np.uint64).view(np.int64).tolist())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(shingles(x.as_py())) for x in batch.column(1)]
        names, sizes = [_name(x) for x in found], [len(x) for x in found]
        kept = prints(np.array([sums(x) for x in found]).reshape(-1, WIDE * BANDS + CHECK))
        cols = [batch.column(0), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in kept], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "a", "b", "size", "print"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found, check = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
        n = found.shape[1]
        cols = [found.ravel(), *(np.repeat(x, n) for x in (batch.column(0).to_numpy(), check[:, 0], check[:, 1]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "node", "f", "g"])


def alike(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether SimHashes are near, by the bits that they have apart (signed numbers: a count would take their absolute value)."""
    return np.bitwise_count(f.view(np.uint64)) + np.bitwise_count(g.view(np.uint64)) <= RADIUS


def forest(links: np.ndarray) -> np.ndarray:
    """Links, smaller node first, that join as shallow trees what the given ones join: fewer than there are nodes."""
    nodes, ends = np.unique(links, return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    order = np.argsort(root, kind="stable")
    place = np.arange(len(order))
    first = np.searchsorted(root[order], root[order])
    above = first + (place - first - 1) // FAN
    rest = place > first
    return np.stack([nodes[order[above[rest]]], nodes[order[rest]]], 1)


def near(key: np.ndarray, node: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Links between rows sorted by key that join what near SimHashes join within any bucket: fewer than there are nodes, not all pairs."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    found = []
    left = np.repeat(ends, ends - starts) - np.arange(len(key)) - 1  # rows of the bucket that follow
    at = np.flatnonzero(np.repeat(ends - starts <= FEW, ends - starts) & (left > 0))
    step, held = 1, 0
    while len(at):
        both = at[alike(f[at] ^ f[at + step], g[at] ^ g[at + step])]
        found.append(np.stack([node[both], node[both + step]], 1))
        held += len(both)
        if held > HELD:
            found = [forest(np.concatenate(found))]
            held = 0
        step += 1
        at = at[left[at] >= step]
    for a, b in zip(starts[ends - starts > FEW].tolist(), ends[ends - starts > FEW].tolist(), strict=True):
        rest = np.arange(a, b)
        while len(rest):
            front, group, rest = [rest[0]], [int(node[rest[0]])], rest[1:]
            while front and len(rest):
                now = front.pop()
                close = alike(f[rest] ^ f[now], g[rest] ^ g[now])
                if close.any():
                    front += rest[close].tolist()
                    group += node[rest[close]].tolist()
                    rest = rest[~close]
            found.append(np.array(tree_links(group), np.int64).reshape(-1, 2))
    return forest(np.concatenate([*found, np.zeros((0, 2), np.int64)]))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a bucket may run over several batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[pa.RecordBatch] = []
    size = 0

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        links = near(*(c.to_numpy() for c in rows.columns))
        return pa.RecordBatch.from_arrays([pa.array(links[:, i]) for i in (1, 0)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 50_000 or held[0].column(0)[0] == batch.column(0)[-1]:
            continue
        rows = pa.concat_batches(held)
        end = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
        yield told(rows.slice(0, end))
        held, size = [rows.slice(end)], size - end
    if held:
        yield told(pa.concat_batches(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(shingles(x.as_py())) for x in batch.column(1)]
        names = [_name(x) for x in found]
        cols = [*(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array([x.tobytes() for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["a", "b", "own"])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def spanning(sets: list[np.ndarray], nodes: list[int]) -> list[tuple[int, int]]:
    """Links that join exactly what chains of near copies join."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    begin = np.cumsum(sizes) - sizes
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(n), sizes)
    own = rank[place]
    own = own[np.lexsort((own, owner))]  # each set from its rarest shingle on
    rare = sizes - (sizes * LEAST[0] + LEAST[1] - 1) // LEAST[1] + 1
    first = _spread(begin, np.minimum(rare, sizes))
    order = first[np.argsort(own[first], kind="stable")]
    holders, many = owner[order], np.bincount(own[first], minlength=len(times))
    listed = np.cumsum(many) - many
    alive, marked, found = np.ones(n, bool), np.zeros(len(times), bool), []
    left = n
    for seed in range(n):
        if not alive[seed]:
            continue
        alive[seed], left = False, left - 1
        front, group = [seed], [nodes[seed]]
        while front and left:
            at = front.pop()
            mine = own[begin[at] : begin[at] + sizes[at]]
            keys = mine[: rare[at]]
            if many[keys].sum() < left:
                near = holders[_spread(listed[keys], many[keys])]
                near = np.unique(near[alive[near]])
            else:
                near = np.flatnonzero(alive)
            near = near[(sizes[near] * LEAST[1] >= len(mine) * LEAST[0]) & (len(mine) * LEAST[1] >= sizes[near] * LEAST[0])]
            if not len(near):
                continue
            marked[mine] = True
            both = np.add.reduceat(marked[own[_spread(begin[near], sizes[near])]].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            marked[mine] = False
            new = near[both * LEAST[1] >= (len(mine) + sizes[near] - both) * LEAST[0]].tolist()
            alive[new], left = False, left - len(new)
            front += new
            group += [nodes[x] for x in new]
        found += tree_links(group)
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, left, right); a group may run over several batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    now, sets, nodes = None, [], []

    def told() -> pa.RecordBatch:
        found = spanning(sets, nodes)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    for batch in batches:
        for *group, node, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now:
                if len(nodes) > 1:
                    yield told()
                now, sets, nodes = group, [], []
            sets.append(np.frombuffer(own, np.uint64))
            nodes.append(node)
    if len(nodes) > 1:
        yield told()


def _blocks(block: int) -> list:
    """Parts of a group of candidates as pairs (left, right) in which a row takes part: its own part with each."""
    n = F.ceil(F.col("total") / block).cast("int")
    mine = F.pmod(F.xxhash64("a", "b"), n).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(mine, k).alias("left"), F.greatest(mine, k).alias("right")))
    return [F.explode(F.when(n > 1, with_each).otherwise(F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"))))).alias("part")]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Group of each row: ``(<id_col>, component_id)``, the smallest id that near copies lead to.

    One row comes back for each input row, repeated ids included. Texts without words are alike. A row
    with a null id takes no part in groups and has a null ``component_id``.
    """
    arrow_rows(docs.sparkSession, 500)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(_keyed, "id long, a long, b long, size long, print binary"), "keyed")
    nodes = written(rows.where("id is not null").groupBy("a", "b").agg(F.min("id").alias("node"), F.min("size").alias("size"), F.min("print").alias("print")), "nodes")
    spelled = nodes.where("size > 0").select("node", "print").mapInArrow(_spelled, "key int, node long, f long, g long")
    linked = components(spelled.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates, "u long, v long"))
    root = F.col("component").alias("key")
    members = linked.select(root, "node").unionByName(linked.select(root, F.col("component").alias("node")).distinct())
    members = written(members.join(nodes.select("node", "a", "b", "size").hint("merge"), "node"), "members")
    totals = members.groupBy("key").agg(F.sum("size").alias("total"))
    wanted = members.select(F.col("node").alias("id"))
    how = "broadcast" if wanted.count() <= MAX_BROADCAST_ROWS else "merge"
    sets = written(texts.join(wanted.hint(how), "id", "left_semi").mapInArrow(_sets, "a long, b long, own binary"), "sets").dropDuplicates(["a", "b"])
    spread = members.join(totals.hint("merge"), "key").select("key", "a", "b", "node", *_blocks(block)).select("key", "a", "b", "node", "part.left", "part.right")
    dealt = spread.join(sets.hint("merge"), ["a", "b"]).select("key", "left", "right", "node", "own")
    dealt = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    found = components(dealt.mapInArrow(_links, "u long, v long"))
    names = nodes.join(found.hint("merge"), "node", "left").select("a", "b", F.coalesce("component", "node").alias("component"))
    out = rows.join(names.hint("merge"), ["a", "b"], "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.when(F.col("id").isNotNull(), F.col("component")).cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies, as ``simhash.keep_one`` keeps them of its groups."""
    return simhash.keep_least(docs, groups(docs, id_col, text_col), id_col)
