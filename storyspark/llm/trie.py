"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a sequence of turns that some conversation starts with. It is found by a 128-bit hash: the
exclusive or of hashes of (position, role, text), a running value that long conversations are dealt over
many tasks for. A node's key is its smallest member and its depth.

Subtree totals go up by rounds of joins. A round rakes all leaves (their totals are done and are added
to their parents) and compresses unary chains: of a chain's nodes about half, no two of them
neighbours, are taken out, and each leaves the node below with its share. Then the nodes taken out
come back in reverse order, each with the total of the node below and what lay between. Every join is
on keys that both sides have once, so that a parent with any number of children is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from .common import MAX_BROADCAST_ROWS, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Children of a node from which on they look up its key apart; ids in one piece of a list of members.
HEAVY, PIECE = 10_000, 50_000
_KEY, _UP, _HASH = ["conv", "depth"], ["up_conv", "up_depth"], ["h1", "h2"]


def _xor(name: str) -> tuple[str, Column]:
    """A hash of position and turn; the two differ in their first value."""
    return "xor", F.xxhash64(F.lit(name), "depth", "t1", "t2")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv, pos, t1, t2, words)``: each turn's place, hashes and number of words.

    Rows stand by turn, null first; rows of one turn by the first 64 characters of role and text and then by a hash.
    A null role or text is empty. Rows without ``conv_id`` are left out; all other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.substr(role, F.lit(1), F.lit(64)).alias("role"),
        F.substr(text, F.lit(1), F.lit(64)).alias("head"),
        F.xxhash64(F.lit("a"), role, text).alias("t1"),
        F.xxhash64(F.lit("b"), role, text).alias("t2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    by = ["turn", "role", "head", "t1"]
    rows = scan.prefixes(scan.dealt(rows, ["conv"], by, written), ["conv"], by, {"pos": ("sum", F.lit(1))})
    return rows.select("conv", "pos", "t1", "t2", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """``(conv, side, pos, t1, t2, words)``: each conversation c behind the first h turns of c - c % ``group``.

    h is the unsigned crc32 of the decimal c modulo ``most``; c's own first h turns go.
    """
    head = F.crc32(F.col("conv").cast("string")) % most
    own = turns.where(F.col("pos") > head).withColumn("side", F.lit(1))
    asked = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), head.alias("h")).where("h > 0")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    shared = asked.join(first.hint("merge"), "base").where("pos <= h").withColumn("side", F.lit(0))
    names = ["conv", "side", "pos", "t1", "t2", "words"]
    return shared.select(*names).unionByName(own.select(*names))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, h1, h2, u1, u2, words)``: the hash of each prefix of each rebuilt conversation, and of the one before."""
    rows = scan.dealt(rebuilt(turns), ["conv"], ["side", "pos"], written)
    rows = scan.prefixes(rows, ["conv"], ["side", "pos"], {"depth": ("sum", F.lit(1))})
    rows = scan.prefixes(rows, ["conv"], ["side", "pos"], {"h1": _xor("a"), "h2": _xor("b")})
    u1, u2 = (F.col(h).bitwiseXOR(_xor(n)[1]) for h, n in (("h1", "a"), ("h2", "b")))
    zero = F.lit(0).cast("long")
    roots = turns.select("conv").distinct().select("conv", zero.alias("depth"), *(zero.alias(n) for n in ("h1", "h2", "u1", "u2", "words")))
    return written(rows.select("conv", F.col("depth").cast("long").alias("depth"), "h1", "h2", u1.alias("u1"), u2.alias("u2"), "words").unionByName(roots), "prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """``(conv, depth, up_conv, up_depth, h1, h2, n_convs, words)`` of every node; the root has no upper node."""
    nodes = prefixes.groupBy("h1", "h2", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first("u1").alias("u1"), F.first("u2").alias("u2"))
    nodes = written(nodes, "nodes")
    upper = nodes.select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("up_conv"))
    by = ["u1", "u2", "depth"]
    below = nodes.where("depth > 0")
    # a node with very many children is looked up apart: of such nodes there is one for HEAVY others at most
    many = below.groupBy(*by).count().where(F.col("count") > HEAVY).select(*by)
    heavy = written(many.join(upper.hint("merge"), by), "heavy")
    how = "broadcast" if heavy.count() <= MAX_BROADCAST_ROWS else "merge"
    known = below.join(heavy.hint(how), by)
    other = below.join(heavy.select(*by).hint(how), by, "left_anti").join(upper.hint("merge"), by)
    root = nodes.where("depth = 0").withColumn("up_conv", F.lit(None).cast("long"))
    names = ["conv", "depth", "up_conv", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"), "h1", "h2", "n_convs", "words"]
    return written(reduce(DataFrame.unionByName, (x.select(*names) for x in (known, other, root))), "tree")


def _coin(conv: str, depth: str, turn: int, bits: int) -> Column:
    """One bit of each node: in a chain neighbours differ in the bits of their depths, later by chance."""
    if turn < bits:
        return F.shiftright(F.col(depth), turn).bitwiseAND(F.lit(1))
    return F.xxhash64(F.lit(turn), conv, depth).bitwiseAND(F.lit(1))


def subtree_totals(tree: DataFrame, values: list[str], max_rounds: int = 300) -> DataFrame:
    """``(conv, depth, <values>)``: the sums of ``values`` over each node's subtree, its top included.

    ``tree`` has ``(conv, depth, up_conv, up_depth)`` and the values, as longs; a root has null in ``up_conv``. The rounds grow
    with the logarithm of the number of nodes; ``max_rounds`` is a guard that raises. Each round writes
    what is left, about half, so the work of all rounds is that of a few.
    """
    add = [f"add_{v}" for v in values]
    zero = F.lit(0).cast("long")
    active = tree.select(*_KEY, *_UP, *values, *[zero.alias(a) for a in add])
    bits = int(tree.agg(F.max("depth")).first()[0] or 0).bit_length()
    done: list[DataFrame] = []
    taken: list[DataFrame] = []
    for turn in range(max_rounds):
        below = active.groupBy(*_UP).agg(F.count("*").alias("n"), F.min(F.struct(*_KEY)).alias("only"))
        below = below.select(*[F.col(u).alias(k) for u, k in zip(_UP, _KEY, strict=True)], "n", "only")
        now = written(active.join(below.hint("merge"), _KEY, "left"), "round")
        leaves = now.where("n is null")
        done.append(leaves.select(*_KEY, *values))
        raked = leaves.groupBy(*_UP).agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(a)).alias(f"up_{v}") for v, a in zip(values, add, strict=True)])
        raked = raked.select(*[F.col(u).alias(k) for u, k in zip(_UP, _KEY, strict=True)], "gone", *[f"up_{v}" for v in values])
        rest = now.where("n is not null").join(raked.hint("merge"), _KEY, "left")
        alone = (F.col("n") == 1) & F.col("gone").isNull() & F.col("up_conv").isNotNull()
        out = alone & (_coin("conv", "depth", turn, bits) == 1) & (_coin("up_conv", "up_depth", turn, bits) == 0)
        rest = rest.select(*_KEY, *_UP, *[(F.col(v) + F.coalesce(f"up_{v}", zero)).alias(v) for v in values], *add, "only", F.coalesce(out, F.lit(False)).alias("out"))
        rest = written(rest, "raked")
        if rest.isEmpty():
            break
        # a node that is taken out hands its upper node and its values to its only child
        hand = rest.where("out").select(
            F.col("only.conv").alias("conv"), F.col("only.depth").alias("depth"), F.struct(*_KEY).alias("was"), *[F.col(u).alias(f"to_{u}") for u in _UP],
            *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(a).alias(f"own_{a}") for a in add],
        )
        moved = rest.where("not out").join(hand.hint("merge"), _KEY, "left")
        got = F.col("was").isNotNull()
        moved = moved.select(
            *_KEY, *[F.when(got, F.col(f"to_{u}")).otherwise(F.col(u)).alias(u) for u in _UP], *values,
            *[(F.col(a) + F.coalesce(f"own_{v}", zero) + F.coalesce(f"own_{a}", zero)).alias(a) for v, a in zip(values, add, strict=True)],
            "was", *[F.when(got, F.col(f"own_{v}") + F.col(a)).alias(f"more_{v}") for v, a in zip(values, add, strict=True)],
        )
        moved = written(moved, "moved")
        taken.append(moved.where("was is not null").select(*_KEY, "was", *[f"more_{v}" for v in values]))
        active = moved.select(*_KEY, *_UP, *values, *add)
    else:
        raise RuntimeError(f"the tree was not contracted in {max_rounds} rounds")
    # nodes that were taken out in a round stood above nodes that stayed longer; these are few
    later = done[len(taken)]
    for turn in reversed(range(len(taken))):
        back = taken[turn].join(later.hint("merge"), _KEY)
        back = written(back.select("was.conv", "was.depth", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values]), "back")
        later = later.unionByName(back).unionByName(done[turn])
    return later


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the members' decimal ids, from rows in order of node and id."""
    now, first, held = None, None, []

    def piece() -> pa.RecordBatch:
        cols = [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])]
        return pa.RecordBatch.from_arrays(cols, ["h1", "h2", "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (a, b) or len(held) >= PIECE:
                if held:
                    yield piece()
                now, first, held = (a, b), conv, []
            held.append(str(conv))
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order; only the hash's state is held."""
    now, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["h1", "h2", "ends_sha256"])

    for batch in batches:
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (a, b):
                if state:
                    yield told()
                now, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
    if state:
        yield told()


def ends(prefixes: DataFrame) -> DataFrame:
    """``(h1, h2, ends_sha256)`` of the nodes at which conversations end."""
    last = prefixes.groupBy("conv").agg(F.max_by(F.struct(*_HASH), "depth").alias("h")).select("h.h1", "h.h2", "conv")
    dealt = last.repartitionByRange("h1", "h2", "conv").sortWithinPartitions("h1", "h2", "conv")
    pieces = written(dealt.mapInArrow(_listed, "h1 long, h2 long, first long, ids string"), "members")
    return pieces.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(_hashed, "h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``. See
    ``turns_of`` for nulls and ties, ``rebuilt`` for the conversations. Repeated rows are turns of their own. A
    conversation that is left without turns ends at the root. An empty table has no nodes.
    """
    prefixes = _prefixes(written(turns_of(conversations), "turns"))
    tree = _nodes(prefixes)
    kids = tree.groupBy(*_UP).agg(F.count("*").alias("n_children")).select(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth"), "n_children")
    tree = tree.join(kids.hint("merge"), _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves")
    tree = written(tree.select(*_KEY, *_UP, *_HASH, "n_convs", "n_children", leaf, saved), "tree")
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    out = tree.drop("n_leaves", "saved_tokens").join(totals.hint("merge"), _KEY)
    out = out.join(written(ends(prefixes), "ends").hint("merge"), _HASH, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
