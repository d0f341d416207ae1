"""Secret spans: three fixed patterns, and character Markov models of random strings.

Two order-2 character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a string is a secret if its log-likelihood ratio favours the random model, by enough
for its length and by enough in all. No length is asked for: the ratio of a short string can't be large.
What lies beside a base span is scored without it. The labelled samples come from a bounded set of
documents (those with the smallest hash of their id): strings that the fixed patterns hold are random, the others are
ordinary. Labelled random strings and identifiers made from a fixed seed are added, so that any corpus gives a model.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

# The patterns of the three base kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "markov")

#: Strings in base spans that are labelled random.
LABELLED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Documents from which labelled samples are taken.
SAMPLE = 2000
#: Of them at most so many strings of each label are used, the first by hash.
STRINGS = 20_000
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: A string is a secret if its log-likelihood ratio is above ``LEAST`` a character and above ``NEEDED`` in all, which weighs
#: against there being few secrets among many strings; one character tells ``MOST`` at most.
LEAST, NEEDED, MOST = 0.5, 14.0, 4.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _codes(text: str) -> np.ndarray:
    """Characters as numbers below the size of the alphabet, behind two starts."""
    return np.array([len(ALPHABET)] * 2 + [ALPHABET.index(c) for c in text])


class Model:
    """Log-likelihood ratio of two order-2 character models; lower orders back the higher ones."""

    def __init__(self, secret: list[str], ordinary: list[str], backing: float = 4.0) -> None:
        size = len(ALPHABET) + 1
        logs = []
        for sample in (secret, ordinary):
            counts = np.zeros((size, size, size))
            for text in sample:
                c = _codes(text)
                np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
            none = counts.sum(axis=(0, 1)) + 1
            one = counts.sum(axis=0) + backing * none / none.sum()
            one /= one.sum(axis=1, keepdims=True)
            two = counts + backing * one[None]
            logs.append(np.log(two / two.sum(axis=2, keepdims=True)))
        self.ratio = logs[0] - logs[1]

    def score(self, text: str) -> float:
        """Mean ratio per character; above 0 the text is rather random."""
        c = _codes(text)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())

    def random_runs(self, text: str, apart: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places of the runs of candidate characters that are secrets; the places ``apart`` belong to none.

        All characters of a text are scored side by side, and the runs' sums are differences of a running sum.
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = _CODE_OF[np.minimum(points, 128)]
        for a, b in apart:
            codes[a:b] = len(ALPHABET)
        inside = codes < len(ALPHABET)
        if not inside.any():
            return []
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        one = np.concatenate([[len(ALPHABET)], codes[:-1]])
        two = np.where(one < len(ALPHABET), np.concatenate([[len(ALPHABET)], one[:-1]]), len(ALPHABET))
        size = len(ALPHABET) + 1
        told = np.minimum(self.ratio.ravel()[(two * size + one) * size + codes], MOST)
        sums = np.add.reduceat(np.where(inside, told, 0), begin)  # what is between two runs adds nothing
        good = sums > np.maximum(LEAST * (end - begin), NEEDED)
        return list(zip(begin[good].tolist(), end[good].tolist(), strict=True))


#: The code of each ASCII character, and of all others at 128; characters outside the alphabet have that of a start.
_CODE_OF = np.array([ALPHABET.find(chr(i)) if chr(i) in ALPHABET else len(ALPHABET) for i in range(128)] + [len(ALPHABET)], np.int64)


def random_strings(n: int = 3000, seed: int = 7) -> list[str]:
    draw = random.Random(seed)
    sets = (string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, ALPHABET[:64])
    return ["".join(draw.choices(draw.choice(sets), k=draw.randint(20, 48))) for _ in range(n)]


# Words of which labelled identifiers are made.
_WORDS = (
    "get set is has load save read write find list make user name file path data index page count total size token key value "
    "config option state error message request response server client account order item product version release build test "
    "default internal external public private module package library service handler manager factory context session cache "
    "usr local share lib src main docs images static assets html json http https www com org net example"
).split()


def identifiers(n: int = 3000, seed: int = 8) -> list[str]:
    """Names in the usual styles, some with small numbers, dates or versions."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = draw.choices(_WORDS, k=draw.randint(3, 6))
        style = draw.randrange(6)
        if style == 0:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            text = "_".join(words).upper()
        elif style == 2:
            text = f"20{draw.randint(10, 29)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}-" + "-".join(words)
        elif style == 3:
            text = "/" + "/".join(words) + draw.choice(["", f"/{draw.randint(1, 9999)}", f"/v{draw.randint(1, 9)}"])
        else:
            text = "_-"[style - 4].join(words) + draw.choice(["", str(draw.randint(1, 99)), f"_{draw.randint(1, 2030)}"])
        out.append(text)
    return out


def strings_of(text: str) -> tuple[list[str], list[str]]:
    """Labelled strings of a text: in fixed patterns, and all others."""
    spans = base_spans(text)
    secret = [m.group() for k, a, b in spans for m in LABELLED.finditer(text[a:b])]
    rest, last = [], 0
    for _, a, b in spans:
        rest.append(text[last : max(a, last)])
        last = max(last, b)
    return secret, re.findall(r"[A-Za-z0-9+/_=-]+", " ".join([*rest, text[last:]]))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(x, kind) for text in batch.column(0).to_pylist() for kind, part in enumerate(strings_of(text)) for x in dict.fromkeys(part)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["word", "label"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, strings: int = STRINGS) -> Model:
    """Models from the strings of up to ``sample`` document ids, ``strings`` of each label at most.

    Only hashes are sorted; the texts of the chosen ids are found by a filter on their hash.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last).cast("long")).select("text")
    words = written(chosen.mapInArrow(_labelled, "word string, label int").distinct(), "words")
    got = [[r.word for r in words.where(F.col("label") == k).orderBy(F.xxhash64("word"), "word").limit(strings).collect()] for k in (0, 1)]
    return Model(got[0] + random_strings(), got[1] + identifiers())


def all_spans(model: Model, text: str) -> list[tuple[str, int, int]]:
    """The base spans, and random-looking strings in what these leave."""
    found = base_spans(text)
    found += [("markov", a, b) for a, b in model.random_runs(text, [(a, b) for _, a, b in found])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_assign, n_access, n_hex, base_sha256, spans)``, one row for each input row.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind; the
    hash is of the same list of base spans alone. A null text counts as empty. Only the two named
    columns are read; repeated and null ids are kept.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(shared.value, x or "") for x in batch.column(1).to_pylist()]
            base = [[s for s in x if s[0] != "markov"] for x in found]
            cols = [batch.column(0)]
            cols += [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
            cols += [pa.array([hashlib.sha256(_told(x).encode()).hexdigest() for x in base], pa.string()), pa.array([_told(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(told, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret span replaced by ``mark``; overlapping spans are one.

    ``length_col``, where there is such a column, gets the new number of code points; other columns
    stay as they are, and no row goes. A null text stays null.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for _, a, b in all_spans(shared.value, text):
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join([*out, text[last:]]) if out else text

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(told, docs.schema)
    if length_col in docs.columns:
        changed = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(changed))
    return out
