"""How the driver's tables bind to books, chapters and lexicons, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import line_chapters

#: A lexicon that the tables' texts hit in every category.
LATIN = {"en": ["the", "and", "th", "ing"], "de": ["und", "sch", "keit", "der"], "fr": ["les", "eau", "pour", "ai"], "es": ["que", "ción", "los", "ado"]}
FORMULAS = {"en": ("rise", "status", "class", "help", ["city", "myth"]), "de": ("growth", "purpose", "doubt", "trial", ["work"])}
FORMULA_DEFAULT = ("plain", "goal", "block", "act", ["any"])
RESPONSES = {"en": "calm", "de": "order", "fr": "joy"}
GROWTH = {"static": ["sch", "ado"], "growth": ["ing", "tion"], "exp": ["eau", "ción"]}
LIMITS = {"price": ["under", "nder"], "limit": ["eaux", "ingen"], "side": ["sch", "ando"], "need": ["tionth", "lles"]}
PAINS = ["zzz", "ción", "keit", "anth", "eau", "the"]
ARCS = {"a": (["the", "und"], ["ing", "sch"]), "b": (["les", "que"], ["eau", "ado"]), "c": (["th"], ["der"])}
TURNINGS = ["ingth", "schen", "eaux", "ciónm", "onth"]
INFO = {"world": ["thing", "schund", "eauou"], "person": ["ander", "keit", "ción"], "plot": ["tionth", "lles", "ai"]}
METHODS = {"told": ["that", "der"], "hinted": ["with", "les"]}
SENSES = {"see": ["ea", "ei"], "hear": ["ou", "au"], "touch": ["th", "sch"], "smell": ["ó"]}
SEGMENTS = {"young": ["the", "und"], "old": ["ing", "keit"], "new": ["eau", "ción"]}
AGES = {"young": (12, 18), "old": (35, 55), "new": (22, 30)}
MOTIVES = {"en": "追更解谜", "de": "获得爽感", "fr": "情感满足", "es": "自我代入"}
ARPU = {"young": 15.0, "old": 60.0, "new": 50.0}
KINDS = {"short": ["the", "und", "que"], "game": ["ing", "keit", "ción"], "film": ["and", "der", "los"], "comic": ["eau", "les"]}
COSTS = {"short": 0.8, "game": 0.25, "film": 0.2, "comic": 0.6}
ROLES = {"info": ["the", "und", "les"], "help": ["ing", "keit"], "foe": ["th", "eau", "que"]}
PERSONS = [r"(\w{2,4})(?:ing|keit|eau|ción)"]
SPEECH = r'"[^"]*?(?:tion|und|eau|los)[^"]*?"'
BEHAVIOURS = {"x": "th.{0,2}ing", "y": "sch.{0,2}en", "z": "ai.{0,2}eu"}
HABITS = ["and", "der", "ment", "ado", "ing"]

BOOKS = "books as (select doc_id as novel_id, text, lang as genre, source, n_chars from documents)"
_WHITE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"


CHAPTERS = (
    "lines as (select doc_id as novel_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), "
    f"chapters as (select novel_id, cast(row_number() over (partition by novel_id order by pos) as int) as chapter_number, content from (select novel_id, pos, {strip('line')} as content from lines) where content <> '')"
)
QUOTED = (
    "quoted as (select doc_id as novel_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 3 = 0 then '\"' || x || '\"' else x end), chr(10)) as text from documents)"
)


def s(x: str) -> str:
    """A SQL string."""
    return "'" + x.replace("'", "''") + "'"


def cnt(t: str, k: str) -> str:
    return f"((length({t}) - length(replace({t}, {s(k)}, ''))) // {len(k)})"


def total(t: str, keys: list[str]) -> str:
    return "(" + " + ".join(cnt(t, k) for k in keys) + ")"


def has(t: str, k: str) -> str:
    return f"contains({t}, {s(k)})"


def has_any(t: str, keys) -> str:
    return "(" + " or ".join(has(t, k) for k in keys) + ")"


def present(t: str, keys: list[str]) -> str:
    return "(" + " + ".join(f"cast({has(t, k)} as int)" for k in keys) + ")"


def first_present(t: str, keys: list[str]) -> str:
    return "case " + " ".join(f"when {has(t, k)} then {s(k)}" for k in keys) + " end"


def top(names, exprs: list[str]) -> str:
    """Name of the first highest expression."""
    most = f"greatest({', '.join(exprs)})"
    return "case " + " ".join(f"when {e} = {most} then {s(n)}" for n, e in zip(names, exprs, strict=True)) + " end"


def case(key: str, table: dict, default: str) -> str:
    out = lambda v: s(v) if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return "case " + " ".join(f"when {key} = {s(k)} then {out(v)}" for k, v in table.items()) + f" else {default} end"


def scored(lexicon: dict, how=total, t: str = "text") -> str:
    """Columns s0, s1, ... of a lexicon's categories."""
    return ", ".join(f"{how(t, keys)} as s{i}" for i, keys in enumerate(lexicon.values()))


def cols(lexicon: dict) -> list[str]:
    return [f"s{i}" for i in range(len(lexicon))]


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


class Tables:
    """The tables of a folder, and what they are bound to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def books(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("novel_id"), "text", F.col("lang").alias("genre"), "source", "n_chars")

    @cached_property
    def chapters(self) -> DataFrame:
        return line_chapters(self.books)

    @cached_property
    def quoted(self) -> DataFrame:
        """Books in which every third line stands in quotes."""
        mark = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
        return self.books.select("novel_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


_FOUND: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with its SQL where SQL can express it."""

    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep
