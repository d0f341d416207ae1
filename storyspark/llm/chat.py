"""Chat formatting of heterogeneous JSON records, in DataFrame functions only.

The nested field paths of a record are hashed to a fingerprint; the fingerprint selects one of the
declared layouts, which says how the record becomes turns of role and text. Turns are written under a
template in which control strings inside texts are escaped, so that the formatted string can be cut
into the same turns again, with spans of code points for the texts that count for the loss.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: JSON strings may be as long as a value can be.
_OPTIONS = {"maxStringLen": str((1 << 31) - 1)}
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a record, and its turns. A list layout names its list and the two fields of an
    entry; a flat one lists (role, fields), whose non-empty texts are joined by a line end."""

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            return sorted(f"{self.items[0]}[].{f}" for f in self.items[1:])
        return sorted(f for _, names in self.fields for f in names)


LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_only", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def fingerprint(top: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the field paths that any layout knows; ``top`` maps a record's fields to their JSON."""
    lists = [x.items[0] for x in layouts if x.items]
    known = F.array(*[F.lit(p) for x in layouts for p in x.paths()])

    def of(entry: Column) -> Column:
        inner = F.from_json(entry["value"], "array<map<string,string>>", _OPTIONS)
        names = F.array_distinct(F.flatten(F.transform(inner, lambda m: F.map_keys(m))))
        listed = F.transform(names, lambda n: F.concat(entry["key"], F.lit("[]."), n))
        return F.when(entry["key"].isin(lists), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(entry["key"]))

    paths = F.flatten(F.transform(F.map_entries(top), of))
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n"))


def _turns(layout: Layout, top: Column) -> Column:
    if layout.items:
        name, role, text = layout.items
        rows = F.from_json(top[name], f"array<struct<`{role}`:string,`{text}`:string>>", _OPTIONS)

        def renamed(r: Column) -> Column:
            return reduce(lambda c, p: F.when(r == p[0], p[1]).otherwise(c), layout.roles, r)

        return F.transform(rows, lambda m: F.struct(F.coalesce(renamed(m[role]), F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    said = []
    for role, names in layout.fields:
        parts = F.filter(F.array(*[F.coalesce(top[n], F.lit("")) for n in names]), lambda x: x != "")
        said.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n").alias("text")))
    return F.array(*said)


def canonical(records: DataFrame, json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` to JSON records.

    Fields that no layout knows are ignored. A record that is null, is not a JSON object or fits no
    layout keeps its row with null in both. Columns of those names that were there are replaced.
    """
    record = F.col(json_col)
    own, mark = unused("top", records.columns), unused("print", records.columns)
    top = F.from_json(record, "map<string,string>", _OPTIONS)
    with_top = records.withColumn(own, top).withColumn(mark, fingerprint(F.col(own), layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for x in layouts:
        paths = F.xxhash64(F.lit("\n".join(x.paths())))
        name = F.when(F.col(mark) == paths, x.name).otherwise(name)
        turns = F.when(F.col(mark) == paths, _turns(x, F.col(own))).otherwise(turns)
    return with_top.withColumn("layout", name).withColumn("turns", turns).drop(own, mark)


def escaped(text: Column) -> Column:
    """Reversibly free of the opening and closing strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(": "), F.lit(":\\ "))


def unescaped(text: Column) -> Column:
    """A backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start, end in code points) to conversations.

    The spans hold the escaped texts of ``loss_role``. No turns give an empty string; null turns give
    nulls. Columns of those names that were there are replaced.
    """
    turns = F.col(turns_col)
    heads = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit(MIDDLE)))
    bodies = F.transform(turns, lambda t: escaped(t["text"]))
    head, body = unused("heads", conversations.columns), unused("bodies", conversations.columns)
    out = conversations.withColumn(head, heads).withColumn(body, bodies)
    parts = F.zip_with(head, body, lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    sizes = F.zip_with(head, body, lambda h, b: F.struct(F.length(h).alias("head"), F.length(b).alias("body")))
    marked = F.zip_with(sizes, turns, lambda s, t: F.struct(s["head"].alias("head"), s["body"].alias("body"), (t["role"] == loss_role).alias("loss")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["head"]
        end = start + x["body"]
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + len(CLOSE)).cast("int").alias("at"), F.when(x["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(marked, none, step, lambda s: s["spans"])
    return out.withColumn("formatted", _joined(parts)).withColumn("loss_spans", spans).drop(head, body)


def read_back(conversations: DataFrame) -> DataFrame:
    """Add ``read_turns`` and ``loss_text``, taken from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    at = lambda p: F.locate(MIDDLE, p)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substr(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"),
            unescaped(F.substr(p, at(p) + len(MIDDLE))).alias("text"),
        ),
    )
    under = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return conversations.withColumn("read_turns", turns).withColumn("loss_text", _joined(under))


def records_of(rows: DataFrame) -> DataFrame:
    """JSON records ``(conv_id, record)`` of a table of turns, in the layouts that their shape allows.

    Rows are put in order by turn, then role, then text; null roles and texts are empty. A user and an
    assistant row make a prompt or an instruction record, plain roles a list of from and value, all
    else a list of messages.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles, texts = F.col("rows.role"), F.col("rows.text")
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    prompt = F.to_json(F.struct(texts[0].alias("prompt"), texts[1].alias("response")))
    instruction = F.to_json(F.struct(texts[0].alias("instruction"), F.lit("").alias("input"), texts[1].alias("output")))
    shared = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    messages = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    record = F.when(pair & pick, prompt).when(pair, instruction).when(plain & pick, shared).otherwise(messages)
    return grouped.select("conv_id", record.alias("record"))


def digests(rows: DataFrame) -> DataFrame:
    """Format all conversations and tell, from the output, what they hold."""
    out = read_back(formatted(canonical(records_of(rows))).select("conv_id", "formatted", "loss_spans"))
    said = _joined(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
