"""The prefix trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from storyspark.llm import queries, trie

from .test_operators import SF, clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """All nodes by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves, saved = (0 if kids.get(node) else 1), (len(members[node]) - 1) * words
        for k in kids.get(node, []):
            leaves, saved = leaves + totals[k][0], saved + totals[k][1]
        totals[node] = (leaves, saved)
    out = []
    for node, cs in members.items():
        ended = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), up, len(cs), len(kids.get(node, [])), *totals[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def made(n, seed, long=0):
    """Conversations that share turns, some copies of others, with nulls, ties and one very long."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 6)):
            rows.append((rng.choice([c, c, c, -c]), rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, " x  y\tz "])))
    rows += [(None, 1, "user", "lost")] + [(77_000_003, t, "user", f"turn {t % 3}") for t in range(long)]
    return rows


@pytest.mark.parametrize("n,long", [(60, 0), (120, 150)])
def test_made_conversations(spark, n, long):
    rows = made(n, n, long)
    assert told(trie.prefix_trie(clashing(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_common_conversation_and_pieces(spark, monkeypatch):
    """One text of half of all conversations, members in many pieces, a node with many children apart."""
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "HEAVY", 5)
    rows = [(c, t, "user", f"same {t}" if c % 2 else f"own {c} {t}") for c in range(200) for t in range(3)]
    assert told(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op13_trie(spark, SF)) == brute(rows)


def test_totals_of_chains_and_random_trees(spark):
    """A chain, a comb and a random tree, in few rounds."""
    rng = random.Random(2)
    for up in ([k - 1 for k in range(300)], [k - 1 if k % 2 else max(k - 2, 0) for k in range(200)], [rng.randint(0, k - 1) if k else -1 for k in range(300)]):
        depth = [0] * len(up)
        for k in range(1, len(up)):
            depth[k] = depth[up[k]] + 1
        total = [k % 7 for k in range(len(up))]
        for k in range(len(up) - 1, 0, -1):
            total[up[k]] += total[k]
        rows = [(k, depth[k], up[k] if k else None, depth[up[k]] if k else None, k % 7) for k in range(len(up))]
        tree = spark.createDataFrame(rows, "conv long, depth long, up_conv long, up_depth long, v long")
        got = {r.conv: r.v for r in trie.subtree_totals(tree, ["v"], max_rounds=30).collect()}
        assert got == dict(enumerate(total))
        assert trie.subtree_totals(tree.where(F.lit(False)), ["v"]).count() == 0
