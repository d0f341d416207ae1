"""Conversation repair against a plain recursion over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from storyspark.llm import queries, repair

from .test_operators import SF, clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost, letters and turns of the best edits; ``rows`` are (role, text, fault)."""
    fit = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, last, more):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, out = best(i + 1, last, 4)
            options.append((c + 4, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                first = role[:1]
                if first == fit[last] or (first == "s" and last == ""):
                    c, a, out = best(i + 1, first, 4)
                    options.append((c + extra, "K" + a, ((role, text), *out)))
                to = fit[last]
                c, a, out = best(i + 1, to, 4)
                options.append((c + extra + 3, "R" + a, (({"u": "user", "a": "assistant"}[to], text), *out)))
        if more:
            to = fit[last]
            c, a, out = best(i, to, more - 1)
            options.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[to], ""), *out)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 4)


def brute(table):
    rows = {}
    for c, t, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        own = rows.setdefault(c, [])
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(t, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = []
    for c, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[0][:1] for r in told]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, said = cheapest(tuple(told))
        faults = [sum(f == r[2] for r in told) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.withColumnRenamed("conv", "conv_id").select(*COLUMNS).collect()), key=repr)


def made(n, seed, hot=0):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Well.", "Yes!", "no end", "so?", " \t", "", None, "cut off\n", "End.\r\n ", "é。"]
    rows = [(rng.choice([c, c, c, None]) if c % 9 == 0 else c, rng.choice([t, t, t, None, 3]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 9))]
    return rows + [(-5, t, rng.choice(roles), f"{rng.choice(texts)}{t % 97}.") for t in range(hot)]


@pytest.mark.parametrize("seed", [1, 2])
def test_made_conversations(spark, seed):
    rows = made(80, seed)
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert told(repair.repair(repair.damaged(frame))) == brute(rows)


def test_a_conversation_over_many_tasks_and_pieces(spark, monkeypatch):
    """Most rows are of one conversation, in many tasks, each in many pieces."""
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    rows = made(20, 5, hot=250)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
        assert told(out) == brute(rows)
        for r in out.collect():
            assert hashlib.sha256("\n".join(r.repaired).encode()).hexdigest() == r.repaired_sha256
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_and_powers():
    """Long runs: costs by powers equal those row by row; edits fit the pattern and the cost."""
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("xsuaoSUAO") * rng.randint(1, 70) for _ in range(rng.randint(1, 6)))
        after = repair.END
        for mark in reversed(symbols):
            after = repair.before(repair.power(mark, 0), after)
        assert repair.costs(symbols, repair.END)[0] == after == repair.before(repair.matrix(symbols), repair.END)
        audit, state = repair.unrolled(symbols, repair.END)
        audit += repair.closing(state)
        names = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
        said = repair.lines(audit, [names.get(m.lower(), "user") for m in symbols], ["t"] * len(symbols))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
        spent, rows = 0, iter(symbols)
        for edit in audit:
            mark = "" if edit == "I" else next(rows)
            spent += {"K": 0, "R": 3, "D": 4, "I": 3}[edit] + 3 * (edit in "KR" and mark.isupper())
        assert spent == after[0]


def test_empty_table(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op11_repair(spark, SF)) == brute(rows)
