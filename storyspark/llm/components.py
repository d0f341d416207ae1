"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, written

#: Larger neighbours of a node from which on its edges are no longer dealt by it.
HEAVY = 200


def _onward(edges: DataFrame, most: int) -> DataFrame:
    """Each edge's smaller end replaced by that end's own smallest neighbour, if it has a smaller one.

    Edges are dealt by their smaller end, but for ends with over ``HEAVY`` edges: of these there are at
    most as many as a ``HEAVY``-th of the edges, and they are looked up by broadcast while that is small.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    if most <= HEAVY:
        return edges.join(least.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    ends = edges.groupBy("v").count().where(F.col("count") > HEAVY).select("v")
    heavy = written(ends.join(least.hint("merge"), "v", "left").select("v", F.coalesce("m", "v").alias("m")), "heavy")
    how = "broadcast" if heavy.count() <= MAX_BROADCAST_ROWS else "merge"
    known = edges.join(heavy.hint(how), "v").select("u", F.col("m").alias("v"))
    other = edges.join(heavy.select("v").hint(how), "v", "left_anti").join(least.hint("merge"), "v", "left")
    return known.unionByName(other.select("u", F.coalesce("m", "v").alias("v")))


def _round(edges: DataFrame, most: int) -> DataFrame:
    large = _onward(edges, most).distinct()
    near = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(near.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.where("u > v").unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each linked node to the smallest node it can reach.

    ``edges`` has two columns of one integer type, ``u`` and ``v``; direction and repeats do not
    matter, self-links and nulls are ignored. Returns ``(node, component)`` for every node that is
    not itself the smallest of its component. No group is gathered in one task: a round is two
    minimum aggregations and two joins, and its result is written to the shared folder. The rounds
    grow with the logarithm of the largest component; ``max_rounds`` is a guard that raises.
    """
    edges = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = written(edges.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        ends = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        n, most, total = ends.agg(F.sum("n"), F.max("n"), F.sum("h")).first()
        if not n or seen == (n, total):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (n, total)
        edges = written(_round(edges, most), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
