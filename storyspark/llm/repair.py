"""Repair of conversation structure by the cheapest edits, as a run-length dynamic programme.

A conversation should read as an optional system turn and then pairs of user and assistant, or be empty.
A row is one symbol: its role's initial and its fault. What a row can do to the state of the pattern is a
4 x 4 matrix of costs (rows of inserted turns before it included), and rows one after the other multiply in the
min-plus sense. Equal symbols in a row are one run, which the powers M, M^2, M^4 ... of its matrix carry
the costs over in a logarithm of steps. Going back over the runs gives the cost to the end from every
state; going forward, the least letter that keeps the cost is the next edit.

Rows are dealt by ranges of (conversation, turn), so that a conversation with a third of all rows lies in
many tasks. A task finishes the conversations that lie inside its range. The first and the last may go
on elsewhere: their pieces are stored with the product of their matrices, and the costs behind each piece
and the state before it are then carried from piece to piece as a few numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from .common import written

BLANK = " \t\n\x0b\x0c\r"
#: States of the pattern (nothing yet, after system, user, assistant), and where a role's initial leads.
STATES, START = 4, 0
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that a turn inserted or re-roled in each state gets.
FITTING = {0: "user", 1: "user", 2: "assistant", 3: "user"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Costs from each state to a good end.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a stored piece of a conversation.
PIECE_ROWS, PIECE_CHARS = 20_000, 4 << 20

Matrix = tuple[tuple[int, ...], ...]


def symbol(role: str, text: str, repeated: bool) -> str:
    """``x``: must go; else the role's initial if it is s, u or a, or ``o``; upper case where the text is cut off."""
    said = text.rstrip(BLANK)
    if not said or repeated:
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return kind if said[-1] in ".!?" else kind.upper()


def moves(mark: str, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, state)`` of a row in a state, by letter; at most one for each letter."""
    out = [("D", DELETE, state)]
    if mark == "x":
        return out
    more = TRUNCATED if mark.isupper() else 0
    if (to := NEXT.get(mark.lower(), {}).get(state)) is not None:
        out.append(("K", more, to))
    out.append(("R", REROLE + more, NEXT[FITTING[state][0]][state]))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, min(x + b[k][j] for k, x in enumerate(row))) for j in range(STATES)) for row in a)


@lru_cache(maxsize=1)
def _inserts() -> Matrix:
    """Cost of getting from state to state by inserted turns alone."""
    out = [[NEVER] * STATES for _ in range(STATES)]
    for state in range(STATES):
        at, cost = state, 0
        while cost < out[state][at]:
            out[state][at] = cost
            at, cost = NEXT[FITTING[at][0]][at], cost + INSERT
    return tuple(map(tuple, out))


@lru_cache(maxsize=1024)
def power(mark: str, bit: int) -> Matrix:
    """The matrix of 2^bit rows of one symbol."""
    if bit:
        half = power(mark, bit - 1)
        return product(half, half)
    own = [[NEVER] * STATES for _ in range(STATES)]
    for state in range(STATES):
        for _, cost, to in moves(mark, state):
            own[state][to] = min(own[state][to], cost)
    return product(_inserts(), tuple(map(tuple, own)))


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(mark, sum(1 for _ in own)) for mark, own in groupby(symbols)]


def _bits(n: int) -> list[int]:
    return [b for b in range(n.bit_length()) if n >> b & 1]


def matrix(symbols: str) -> Matrix:
    """The product of all rows' matrices, run by run."""
    out: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(STATES)) for i in range(STATES))
    for mark, n in runs(symbols):
        for bit in _bits(n):
            out = product(out, power(mark, bit))
    return out


def before(m: Matrix, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from each state, given those behind."""
    return tuple(min(x + after[k] for k, x in enumerate(row)) for row in m)


@lru_cache(maxsize=1 << 16)
def _step(mark: str, bit: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return before(power(mark, bit), after)


def _back(mark: str, bit: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """``before`` with the least cost set to 0 for the lookup: the differences have few values."""
    least = min(after)
    return tuple(v + least for v in _step(mark, bit, tuple(v - least for v in after)))


@lru_cache(maxsize=1 << 16)
def _choice(mark: str, here: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """Edits up to and with one row, least letters first, and the state behind it."""
    out = ""
    while True:
        options = {edit: (cost, to) for edit, cost, to in moves(mark, state)}
        for letter in "DIKR":
            if letter == "I":
                to = NEXT[FITTING[state][0]][state]
                if INSERT + here[to] == here[state]:
                    out, state = out + "I", to
                    break
            elif letter in options:
                cost, to = options[letter]
                if cost + after[to] == here[state]:
                    return out + letter, to


def costs(symbols: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to the end before each run, and ``after``."""
    out = [after]
    for mark, n in reversed(runs(symbols)):
        for bit in _bits(n):
            after = _back(mark, bit, after)
        out.append(after)
    return out[::-1]


def unrolled(symbols: str, after: tuple[int, ...], state: int = START) -> tuple[str, int]:
    """The edits of the rows from a state, and the state behind them; runs are laid out one at a time."""
    out = []
    behind = costs(symbols, after)[1:]
    for (mark, n), end in zip(runs(symbols), behind, strict=True):
        inner = [end]
        for _ in range(n):
            inner.append(_back(mark, 0, inner[-1]))
        for k in range(n, 0, -1):
            least = min(inner[k - 1])
            edits, state = _choice(mark, tuple(v - least for v in inner[k]), tuple(v - least for v in inner[k - 1]), state)
            out.append(edits)
    return "".join(out), state


def closing(state: int) -> str:
    """The inserted turns behind the last row."""
    return "I" * (END[state] // INSERT)


def lines(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[str]:
    """``role:text`` of the repaired turns."""
    out = []
    rows = iter(zip(roles, texts, strict=True))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = role if edit == "K" else FITTING[state]
        state = NEXT[role[0]][state]
        out.append(f"{role}:{text}")
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is run inside; the session's setting is then put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, lost)``: rows with faults put in by crc32(``conv_id:turn``) % 20.

    0 drops the row (``lost``), 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes its role user. A null role or
    text is one blank, as is a null id or turn in the hash.
    """
    named = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).alias("how"),
    )
    text: Column = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("lost"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_PIECE = (
    "conv long, done boolean, part long, place long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, "
    "first string, last string, cost long, audit string, repaired_sha256 string, symbols string, roles array<string>, texts array<string>, matrix array<long>, repaired array<string>"
)


class _Piece:
    """Rows of one conversation in order, as far as they lie in one task."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.roles, self.texts, self.turns, self.repeated, self.chars = conv, [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.repeated.append(False)
        self.chars += len(role) + len(text)

    def told(self, done: bool, part: int, place: int, with_turns: bool) -> dict:
        marks, own = [], dict.fromkeys(_COUNTS, 0)
        for role, text, again in zip(self.roles, self.texts, self.repeated, strict=True):
            marks.append(symbol(role, text, again))
            if marks[-1] == "x":
                own["duplicate" if text.strip(BLANK) else "blank"] += 1
            elif marks[-1].isupper():
                own["truncated"] += 1
        initials = [r[:1] for r in self.roles]
        own["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        known = [t for t in self.turns if t is not None]
        own["turns"] = len(set(known))
        own |= {"least": known[0] if known else None, "most": known[-1] if known else None}
        symbols = "".join(marks)
        out = own | {"conv": self.conv, "done": done, "part": part, "place": place}
        if done:
            audit, state = unrolled(symbols, END)
            audit += closing(state)
            said = lines(audit, self.roles, self.texts)
            digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
            return out | {"cost": costs(symbols, END)[0][START], "audit": audit, "repaired_sha256": digest, "repaired": said if with_turns else None}
        ends = {"first": initials[0], "last": initials[-1]} if initials else {}
        return out | ends | {"symbols": symbols, "roles": self.roles, "texts": self.texts, "matrix": [x for row in matrix(symbols) for x in row]}


def _pieces(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a task's range, and pieces of its first and last."""
    part, place = TaskContext.get().partitionId(), 0
    kind = _arrow(_PIECE)
    held: list[dict] = []
    now: _Piece | None = None
    inner = False  # whether the conversation began in this task, behind another

    def closed(done: bool) -> None:
        nonlocal place
        held.append(now.told(done, part, place, with_turns))
        place += 1

    for batch in batches:
        for conv, turn, role, text, mark in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "mark")), strict=True):
            if now is None or conv != now.conv:
                if now:
                    closed(inner)
                inner = now is not None
                now = _Piece(conv)
            if mark == 1:
                now.repeated[-1] = True
            elif mark == 0:
                if not inner and (len(now.roles) >= PIECE_ROWS or now.chars > PIECE_CHARS):
                    closed(False)
                    now = _Piece(conv)
                now.add(turn, role, text)
        if len(held) > 500:
            yield pa.RecordBatch.from_pylist(held, kind)
            held = []
    if now:
        closed(False)
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema string with the few types used here."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


_AFTER = "part long, place long, after array<long>"
_BEFORE = "part long, place long, state long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _costs_behind(pieces: pa.Table) -> pa.Table:
    """The costs behind each piece of one conversation, from the last back."""
    after, out = END, []
    for r in sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["place"]), reverse=True):
        out.append({"part": r["part"], "place": r["place"], "after": list(after)})
        m = r["matrix"]
        after = before(tuple(tuple(m[i : i + STATES]) for i in range(0, STATES * STATES, STATES)), after)
    return pa.Table.from_pylist(out, _arrow(_AFTER))


def _states_before(pieces: pa.Table) -> pa.Table:
    """The state before each piece of one conversation, and the conversation's counts."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["place"]))
    sums = {c: sum(r[c] for r in rows) for c in _COUNTS}
    known = [r for r in rows if r["least"] is not None]
    gaps = 0
    if known:
        shared = sum(a["most"] == b["least"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["most"] - known[0]["least"] + 1 - sums["turns"] + shared
    told = [r for r in rows if r["first"] is not None]
    sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(told, told[1:], strict=False))
    state, out = START, []
    for r in rows:
        out.append({"part": r["part"], "place": r["place"], "state": state, "gaps": gaps, "cost": rows[0]["from_start"], **{c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}})
        state = r["ends"][state]
    return pa.Table.from_pylist(out, _arrow(_BEFORE))


def _unroll_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits from each state that may stand before it."""
    for batch in batches:
        out = []
        for part, place, symbols, after in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "symbols", "after")), strict=True):
            found = [unrolled(symbols, tuple(after), s) for s in range(STATES)]
            out.append({"part": part, "place": place, "ends": [f[1] for f in found], "audits": [f[0] for f in found], "from_start": costs(symbols, tuple(after))[0][START]})
        yield pa.RecordBatch.from_pylist(out, _arrow("part long, place long, ends array<long>, audits array<string>, from_start long"))


_RESULT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<string>"


def _joined(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose pieces come in order; of the texts only the hash's state is held, unless they are wanted."""
    last, state, audit, begun, end, said = None, None, [], False, START, []

    def told() -> pa.RecordBatch:
        tail = closing(end)
        add(lines(tail, [], [], end))
        row = {c: last[c] for c in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        return pa.RecordBatch.from_pylist([row | {"audit": "".join(audit) + tail, "repaired_sha256": state.hexdigest(), "repaired": said if with_turns else None}], _arrow(_RESULT))

    def add(rows: list[str]) -> None:
        nonlocal begun
        if rows:
            state.update((("\n" if begun else "") + "\n".join(rows)).encode())
            begun = True
            if with_turns:
                said.extend(rows)

    for batch in batches:
        for row in batch.to_pylist():
            if last is None or row["conv"] != last["conv"]:
                if last:
                    yield told()
                state, audit, begun, said = hashlib.sha256(), [], False, []
            last = row
            own = row["audits"][row["state"]]
            audit.append(own)
            add(lines(own, row["roles"], row["texts"], row["state"]))
            end = row["ends"][row["state"]]
    if last:
        yield told()


def _ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with a number of their own and the columns by which they are put in order."""
    cut = lambda c: F.substr(c, F.lit(1), F.lit(64))
    hashes = [F.xxhash64(F.lit(x), "role", "text").alias(x) for x in ("d1", "d2")]
    return rows.select("*", cut("role").alias("r"), cut("text").alias("h"), *hashes, F.monotonically_increasing_id().alias("own"))


def repair(rows: DataFrame, with_turns: bool = True) -> DataFrame:
    """Repair conversations, given ``(conv, turn, role, text, lost)`` rows without null roles or texts.

    Returns ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256[, repaired])`` for every ``conv``, null included; one
    that has only ``lost`` rows is empty. ``repaired`` lists the turns as ``role:text``, in one row for each conversation. Rows stand by turn, nulls first; rows of one turn by the first 64 characters of role and text,
    then by a hash, so that equal rows are neighbours. Whole texts are compared (by 128 bits) and hashed.
    """
    spark = rows.sparkSession
    by = ["conv", "turn", "r", "h", "d1", "own"]
    rows = written(_ordered(rows), "damaged")
    kept = rows.where("not lost")
    # rows whose role and text stood earlier: a light scan, whose finds go beside their rows
    light = kept.select("conv", "d1", "d2", "turn", "r", "h", "own")
    light = scan.dealt(light, ["conv", "d1", "d2"], ["turn", "r", "h", "own"], written)
    again = scan.prefixes(light, ["conv", "d1", "d2"], ["turn", "r", "h", "own"], {"n": ("sum", F.lit(1))}).where("n > 1")
    none = F.lit(None).cast("string")
    marks = again.select(*by, none.alias("role"), none.alias("text"), F.lit(1).alias("mark"))
    lost = rows.where("lost").select(*by, none.alias("role"), none.alias("text"), F.lit(2).alias("mark"))
    together = kept.select(*by, "role", "text", F.lit(0).alias("mark")).unionByName(marks).unionByName(lost)
    dealt = together.repartitionByRange(*by).sortWithinPartitions(*by, "mark").select("conv", "turn", "role", "text", "mark")
    with small_batches(spark, 1000):
        found = written(dealt.mapInArrow(partial(_pieces, with_turns=with_turns), _PIECE), "pieces")
    at = ["part", "place"]
    open_ = found.where("not done")
    behind = written(open_.select("conv", *at, "matrix").groupBy("conv").applyInArrow(_costs_behind, _AFTER), "behind")
    with small_batches(spark, 20):
        edits = open_.select(*at, "symbols").join(behind.hint("merge"), at)
        edits = written(edits.mapInArrow(_unroll_all, "part long, place long, ends array<long>, audits array<string>, from_start long"), "edits")
        light = open_.select("conv", *at, *_COUNTS, "least", "most", "first", "last").join(edits.select(*at, "ends", "from_start").hint("merge"), at)
        states = written(light.groupBy("conv").applyInArrow(_states_before, _BEFORE), "states")
        parts = open_.select("conv", *at, "roles", "texts").join(edits.select(*at, "ends", "audits").hint("merge"), at).join(states.hint("merge"), at)
        joined = written(parts.repartition("conv").sortWithinPartitions("conv", *at).mapInArrow(partial(_joined, with_turns=with_turns), _RESULT), "joined")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    whole = found.where("done").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired")
    out = whole.unionByName(joined)
    return out if with_turns else out.drop("repaired")
