"""Nearest vectors: exact search by block-matrix products, and a navigable small-world graph in each shard."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors, and queries, that one scan of the rows serves; queries in one matrix product.
MOST_BYTES, MOST_QUERIES, BLOCK = 64 << 20, 200_000, 1024
#: How far a matrix product's rounding may lie off: such scores are computed again pair by pair.
SLACK = 1e-9
#: Pairs that are found before they are put among a query's best.
PENDING = 1_000_000

Queries = list[tuple[np.ndarray, np.ndarray]]
#: From unit rows and unit queries to groups ``(rows, queries)`` by place, in ascending order: which rows are compared with which queries.
Groups = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def unit_matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors that have ``size`` places, all of them numbers, and where these stand. Zero vectors stay."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    kept = vectors.filter(fits)
    flat = np.asarray(kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(len(at), size)
    whole = np.isfinite(flat).all(axis=1)
    flat, at = flat[whole], at[whole]
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(length == 0, 1, length), at


class Best:
    """The k best of each query so far: highest score first, then the smaller id; ``distinct`` ids once, with their best score."""

    def __init__(self, queries: int, k: int, distinct: bool) -> None:
        self.k, self.distinct = k, distinct
        self.floor = np.full(queries, -np.inf)
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def hold(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keep pairs until there are many, as adding sorts all."""
        self.pending.append((q, ids, score))
        if sum(len(p[0]) for p in self.pending) >= PENDING:
            self.settle()

    def settle(self) -> None:
        if self.pending:
            pending, self.pending = self.pending, []
            self.add(*(np.concatenate(p) for p in zip(*pending, strict=True)))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        if self.distinct:
            order = np.lexsort((-score, ids, q))
            q, ids, score = q[order], ids[order], score[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
            q, ids, score = q[new], ids[new], score[new]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        good = place < self.k
        self.q, self.id, self.score = q[good], ids[good], score[good]
        full = place == self.k - 1
        self.floor[q[full]] = score[full]


def _scan(best: Best, asked: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
    """Put the rows' best into ``best``, for the queries of one block, which stand at ``asked``; ``ids`` are in ascending order."""
    got = unit @ block.T
    begin, end = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for j in np.flatnonzero(end > begin).tolist():
        got[begin[j] : end[j], j] = -np.inf  # no query finds its own id
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if best.distinct else np.arange(len(ids))
    top = np.maximum.reduceat(got, starts, axis=0) if best.distinct else got
    k = min(best.k, len(starts))
    least = np.maximum(np.partition(top, len(starts) - k, axis=0)[len(starts) - k], best.floor[asked]) - SLACK
    row, j = np.nonzero((got >= least) & np.isfinite(got))
    if len(row):
        best.hold(asked[j], ids[row], (unit[row] * block[j]).sum(axis=1))


def exact(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, distinct: bool = False, max_queries: int = MOST_QUERIES, groups: Groups | None = None) -> DataFrame:
    """``(query_id, place, <key>, score)``: the highest inner products of unit vectors, ties by the smaller key.

    ``queries`` has ``(query_id, vector)``. Each Arrow batch of rows is multiplied with blocks of the queries, and a task keeps
    the best of each query. All queries are served by one scan, up to ``max_queries`` of them or ``MOST_BYTES`` of
    vectors, which is checked; more take another scan each. No row is its own neighbour. Keys are whole numbers; a vector that is
    null, of another length than the query's, or holds a null or non-finite number takes no part. ``groups`` says which rows are
    compared with which queries, each pair at most once; without it all are.
    """
    found = None
    for asked in query_sets(queries, max_queries):
        shared = rows.sparkSession.sparkContext.broadcast(asked)

        def told(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [Best(len(ids), k, distinct) for ids, _ in shared.value]
            for batch in batches:
                for own, (query_ids, matrix) in zip(best, shared.value, strict=True):
                    unit, at = unit_matrix(batch.column(1), matrix.shape[1])
                    if not len(at):
                        continue
                    ids = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False)
                    order = np.argsort(ids, kind="stable")
                    ids, unit = ids[order], unit[order]
                    for among, asked in groups(unit, matrix) if groups else [(np.arange(len(ids)), np.arange(len(query_ids)))]:
                        near, near_ids = (unit[among], ids[among]) if groups else (unit, ids)
                        for b in range(0, len(asked) if len(among) else 0, BLOCK):
                            at = asked[b : b + BLOCK]
                            _scan(own, at, query_ids[at], matrix[at], near_ids, near)
                    own.settle()
            for own, (query_ids, _) in zip(best, shared.value, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[own.q]), pa.array(own.id), pa.array(own.score)], ["query_id", key, "score"])

        plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
        part = plain.mapInArrow(told, f"query_id long, `{key}` long, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, key, distinct)


def by_lists(centres: np.ndarray, probe: int) -> Groups:
    """Rows in the list of their nearest centre, with the queries whose ``probe`` nearest centres are among them.

    Vectors of another length than the centres' are one list.
    """
    half = (centres * centres).sum(axis=1) / 2

    def groups(unit: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if unit.shape[1] != centres.shape[1]:
            yield np.arange(len(unit)), np.arange(len(matrix))
            return
        cell = (half - unit @ centres.T).argmin(axis=1)
        probed = np.argsort(half - matrix @ centres.T, axis=1, kind="stable")[:, :probe]
        for c in np.unique(cell).tolist():
            yield np.flatnonzero(cell == c), np.flatnonzero((probed == c).any(axis=1))

    return groups


def by_buckets(width: float, tables: int, seed: int) -> Groups:
    """Rows with the queries that share a bucket with them in one of the tables: places on random directions, in steps of ``width``."""

    def groups(unit: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        drawn = np.random.default_rng(seed).standard_normal((unit.shape[1], tables))
        drawn /= np.sqrt((drawn * drawn).sum(axis=0))
        own, asked = (np.floor(v @ drawn / width).astype(np.int64) for v in (unit, matrix))
        kinds, kind = np.unique(own, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        for i, buckets in enumerate(kinds):
            yield np.flatnonzero(kind == i), np.flatnonzero((asked == buckets).any(axis=1))

    return groups


def ranked(found: DataFrame, k: int, key: str, distinct: bool = False) -> DataFrame:
    """The k best of each query among what the tasks have found."""
    if distinct:
        found = found.groupBy("query_id", key).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", key, "score")


def query_sets(queries: DataFrame, max_queries: int = MOST_QUERIES) -> Iterator[Queries]:
    """The queries as unit matrices, one for each length of vectors, in sets of bounded size."""
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("query_id is not null")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    parts = max(1, -(-n // max_queries), -(-size * 8 // MOST_BYTES))
    for p in range(parts):
        table = (own if parts == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)).toArrow().combine_chunks()
        vectors = table["vector"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        out: Queries = []
        for size in sorted({x for x in pc.list_value_length(vectors).to_pylist() if x}):
            matrix, at = unit_matrix(vectors, size)
            if len(at):
                out.append((table["query_id"].to_numpy()[at], matrix))
        yield out


# --- the graph

#: Rows of a shard; links of a node (twice as many in the lowest layer), candidates for them.
SHARD, LINKS, CANDIDATES = 8192, 16, 64


def _layer_links(unit: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of each node: near ones that are nearer to it than to those chosen before, and back.

    A link that another chosen node already leads to is left out, so that links go in all directions.
    """
    n = len(unit)
    near, score = np.zeros((n, min(CANDIDATES, n - 1)), np.int64), np.zeros((n, min(CANDIDATES, n - 1)))
    for b in range(0, n, 1024):
        got = unit[b : b + 1024] @ unit.T
        got[np.arange(len(got)), b + np.arange(len(got))] = -np.inf
        at = np.argpartition(-got, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else np.zeros((len(got), 0), np.int64)
        s = np.take_along_axis(got, at, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near[b : b + 1024], score[b : b + 1024] = np.take_along_axis(at, order, axis=1), np.take_along_axis(s, order, axis=1)
    out: list[dict[int, float]] = []
    for i in range(n):
        among = unit[near[i]] @ unit[near[i]].T
        chosen: list[int] = []
        for c in range(near.shape[1]):
            if len(chosen) == most:
                break
            if not chosen or score[i, c] > among[c, chosen].max():
                chosen.append(c)
        rest = [c for c in range(near.shape[1]) if c not in chosen][: most - len(chosen)]
        out.append({int(near[i, c]): float(score[i, c]) for c in chosen + rest})
    both = [dict(x) for x in out]
    for i, x in enumerate(out):
        for j, s in x.items():
            both[j].setdefault(i, s)
    return [np.array(sorted(x, key=lambda j: -x[j])[: 2 * most], np.int64) for x in both]


class Graph:
    """Layers of links over the unit vectors of one shard; each layer holds a sixteenth of the one below."""

    def __init__(self, unit: np.ndarray, layers: list[dict[int, np.ndarray]]) -> None:
        self.unit, self.layers, self.distances = unit, layers, 0

    @classmethod
    def built(cls, unit: np.ndarray, ids: np.ndarray, links: int = LINKS) -> Graph:
        """Levels depend on the ids alone, so that a repeated task builds the same graph."""
        chance = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(chance, 1e-18)) / np.log(links)).astype(np.int64)
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level >= k)
            layers.append({n: at[x] for n, x in zip(at.tolist(), _layer_links(unit[at], links), strict=True)})
        return cls(unit, layers)

    def search(self, query: np.ndarray, k: int, width: int, skip: np.ndarray | None = None) -> list[tuple[float, int]]:
        """``(score, node)`` of the nearest found, best first; ``skip`` marks nodes that are not reported."""
        entry = min(self.layers[-1])
        score = float(self.unit[entry] @ query)
        self.distances += 1
        for links in reversed(self.layers[1:]):
            while len(links[entry]):
                got = self.unit[links[entry]] @ query
                self.distances += len(got)
                best = int(got.argmax())
                if got[best] <= score:
                    break
                entry, score = int(links[entry][best]), float(got[best])
        links = self.layers[0]
        seen = {entry}
        ahead, found = [(-score, entry)], [(score, entry)]
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(found) >= width and -s < found[0][0]:
                break
            new = [j for j in links[node].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            self.distances += len(new)
            for x, j in zip((self.unit[new] @ query).tolist(), new, strict=True):
                if len(found) < width:
                    heapq.heappush(found, (x, j))
                    heapq.heappush(ahead, (-x, j))
                elif x > found[0][0]:
                    heapq.heapreplace(found, (x, j))
                    heapq.heappush(ahead, (-x, j))
        return [(s, n) for s, n in sorted(found, reverse=True) if skip is None or not skip[n]][:k]


_INDEX = "shard long, pos long, id long, vector array<double>, layers array<array<long>>"


def _build(links: int) -> Callable[[pa.Table], pa.Table]:
    def told(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        vectors = rows["vector"].combine_chunks()
        lengths = pc.list_value_length(vectors).to_pylist()
        out = []
        pos = 0
        for size in sorted({x for x in lengths if x}):  # usually one length
            unit, at = unit_matrix(vectors, size)
            if not len(at):
                continue
            ids = rows["id"].to_numpy()[at]
            graph = Graph.built(unit, ids, links)
            layers: list[list[list[int]]] = [[] for _ in at]
            for own in graph.layers:
                for n, x in own.items():
                    layers[n].append((x + pos).tolist())
            out += [{"shard": rows["shard"][0].as_py(), "pos": pos + i, "id": int(ids[i]), "vector": unit[i].tolist(), "layers": layers[i]} for i in range(len(at))]
            pos += len(at)
        kind = pa.schema([("shard", pa.int64()), ("pos", pa.int64()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("layers", pa.list_(pa.list_(pa.int64())))])
        return pa.Table.from_pylist(out, kind)

    return told


def graph_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", links: int = LINKS, shard: int = SHARD) -> DataFrame:
    """``(shard, pos, id, vector, layers)``: unit vectors and their links in each layer they are in, to be stored.

    Rows are dealt to shards of about ``shard`` by the hash of their key; every shard has a graph of its own. Vectors that are
    null, empty or hold a null or non-finite number are left out.
    """
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null and vector is not null")
    n = max(1, -(-own.count() // shard))
    return own.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("shard").applyInArrow(_build(links), _INDEX)


def _loaded(rows: pa.Table) -> list[tuple[np.ndarray, Graph]]:
    """The graphs of one shard, one for each length of vectors, and their ids."""
    rows = rows.sort_by("pos").combine_chunks()
    vectors = rows["vector"].combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy()
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        first = int(at[0])
        unit = vectors.filter(pa.array(sizes == size)).flatten().to_numpy().reshape(len(at), size)
        held = rows["layers"].combine_chunks().take(pa.array(at)).to_pylist()
        layers = [{i: np.array(x[k], np.int64) - first for i, x in enumerate(held) if len(x) > k} for k in range(max(map(len, held)))]
        out.append((rows["id"].to_numpy()[at], Graph(unit, layers)))
    return out


def _searched(shared: Broadcast, k: int, key: str, width: int) -> Callable[[pa.Table], pa.Table]:
    def told(rows: pa.Table) -> pa.Table:
        q, ids, score = [], [], []
        for own_ids, graph in _loaded(rows):
            for query_ids, matrix in shared.value:
                if matrix.shape[1] != graph.unit.shape[1]:
                    continue
                for query, vector in zip(query_ids.tolist(), matrix, strict=True):
                    for _, n in graph.search(vector, k, max(width, k + 1), own_ids == query):
                        q.append(query)
                        ids.append(int(own_ids[n]))
                        score.append(float((graph.unit[n] * vector).sum()))
        return pa.table([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", key, "score"])

    return told


def graph_search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", width: int = 40, max_queries: int = MOST_QUERIES) -> DataFrame:
    """``(query_id, place, <key>, score)`` of the nearest that a ``graph_index`` finds.

    Each shard is searched with ``width`` candidates kept; the shards' best are ranked by their exact inner products. The
    queries are a stated set, see ``exact``. ``graph_costs`` tells how many vectors the searches compare.
    """
    found = None
    for asked in query_sets(queries, max_queries):
        shared = index.sparkSession.sparkContext.broadcast(asked)
        part = index.groupBy("shard").applyInArrow(_searched(shared, k, key, width), f"query_id long, `{key}` long, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, key)


def graph_costs(index: DataFrame, queries: DataFrame, k: int = 10, width: int = 40) -> DataFrame:
    """``(shard, vectors, queries, looked_at)``: how many comparisons the searches of each shard take."""
    (asked,) = query_sets(queries, 1 << 60)
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def told(rows: pa.Table) -> pa.Table:
        n = looked = asked = 0
        for own_ids, graph in _loaded(rows):
            n += len(own_ids)
            for _, matrix in shared.value:
                for vector in matrix if matrix.shape[1] == graph.unit.shape[1] else ():
                    graph.search(vector, k, max(width, k + 1))
                    asked += 1
            looked += graph.distances
        return pa.table([[rows["shard"][0].as_py()], [n], [asked], [looked]], ["shard", "vectors", "queries", "looked_at"])

    return index.groupBy("shard").applyInArrow(told, "shard long, vectors long, queries long, looked_at long")
