"""Language identification that labels spans of mixed-language text.

Words get one score per language: the mean-free sum of letter-trigram log-likelihoods. The scripts of
a word's letters narrow the candidates to languages that were learned with that script. A Viterbi
pass over the words of a text, with a penalty for each switch, labels every word; equal neighbours
form spans. The language with most letters is the text's, its share of the letters is the score.

The trigram counts are learned from a bounded sample: all documents of a language that has up to ``SAMPLE``
of them, else those whose hash falls below the share that makes ``SAMPLE`` to be expected. No rows are moved to
draw it: the languages' counts are the only thing it needs. Whole texts are used, in training and in
prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, gathered, slices

#: Training documents of each language; languages that a model is held for (more would not fit into a worker).
SAMPLE, LANGUAGES = 2000, 2000
#: Buckets of hashed letter trigrams.
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log-likelihood that a switch of language costs.
SWITCH = 12.0
#: A script counts for a language if it has this share of its training letters.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
#: Texts that advance side by side, and the bytes of these; words times languages that are scored at once.
ROWS, BATCH_BYTES, CELLS = 2000, 16 << 20, 8 << 20

# First code point of each script range that is told apart; 0 stands for any other.
SCRIPTS = (
    (0x0000, "Latin"), (0x0250, "other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case code point (0 if it is no letter), and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(0x110000, np.uint8)
    for at, name in SCRIPTS:
        script[at:] = NAMES.index(name)
    return lower, script


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages, whether learned with it


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters of a text: places, trigram buckets, scripts. Words are runs of letters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lower, script = _tables()
    low = lower[points]
    at = np.flatnonzero(low)
    wide = np.zeros(len(low) + 2, np.uint32)
    wide[1:-1] = low
    h = wide[at] * np.uint32(0x9E3779B1) + wide[at + 1] * np.uint32(0x85EBCA77) + wide[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return at, (h * np.uint32(0x27D4EB2F)) >> np.uint32(16), script[points[at]]


def word_scores(model: Model, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a text: first letters, numbers of letters, scores (words x languages)."""
    at, bucket, script = letters_of(text)
    if not len(at) or not model.languages:
        return at[:0], at[:0], np.zeros((0, len(model.languages)), np.float32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    scores = np.add.reduceat(model.scores[bucket], first, axis=0)
    allowed = np.logical_and.reduceat(model.scripts[script], first, axis=0)
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return at[first], np.diff(np.append(first, len(at))), np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 2 * SWITCH)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several texts' words, laid end to end; the texts advance side by side."""
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    stay = np.empty((n, k), bool)
    best = np.zeros(n, np.int16)
    end = np.zeros(n, np.int16)
    steps = int(sizes[0]) if len(sizes) else 0
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, steps + 1), side="left")
    state = np.zeros((len(sizes), k), np.float32)
    for t in range(steps):
        m = live[t]
        at, now = starts[:m] + t, state[:m]
        if t:
            top = now.argmax(axis=1)
            jump = np.take_along_axis(now, top[:, None], 1) - np.float32(switch)
            stay[at] = now >= jump
            best[at] = top
            now = np.maximum(now, jump)
            now -= jump  # only differences matter; this keeps the numbers small
        state[:m] = now + scores[at]
        if t + 1 == steps or live[t + 1] < m:
            done = slice(live[t + 1] if t + 1 < steps else 0, m)
            end[starts[done] + t] = state[done].argmax(axis=1)
    labels = np.empty(n, np.int16)
    label = np.zeros(len(sizes), np.int16)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        fresh = sizes[:m] == t + 1
        label[:m] = np.where(fresh, end[at], label[:m])
        labels[at] = label[:m]
        if t:
            keep = stay[at, label[:m]]
            label[:m] = np.where(keep, label[:m], best[at])
    return labels


#: Languages that a worker counts side by side, and characters that it counts at once.
COUNTED, WINDOW = 64, 1 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, both in found.items():
            for kind, counts in enumerate(both):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    ["lang", "kind", "slot", "n"],
                )
        found.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in found and len(found) >= COUNTED:
                yield from told()
            grams, scripts = found.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
            for a, b in windows(text, WINDOW):
                _, bucket, script = letters_of(text[a:b])
                grams += np.bincount(bucket, minlength=BUCKETS)
                scripts += np.bincount(script, minlength=len(NAMES))
    yield from told()


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of each language, or all, that are not held out.

    The sample is bounded by ``sample`` times the number of languages. A language's counts are put together by a task of
    its own and come as one row of ``BUCKETS`` numbers, so that what is gathered is the model itself. Over
    ``LANGUAGES`` languages raise an error, as no worker could hold the model.
    """
    own = [F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")]
    fit = docs.select(*own).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = fit.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    shares = [(r.lang, (sample << 63) // r["count"]) for r in sizes if r["count"] > sample]
    drawn = F.shiftrightunsigned(F.xxhash64("id", "text"), 1)
    bound = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, bound long"))
    texts = fit.join(bound, "lang", "left").where(F.coalesce(drawn < F.col("bound"), F.lit(True))).select("text", "lang")
    rows = texts.mapInArrow(_counts, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))
    table = sorted(rows.groupBy("lang").applyInArrow(_packed, "lang string, grams binary, scripts binary").collect(), key=lambda r: r.lang)
    languages = tuple(r.lang for r in table)
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    logs = np.empty((BUCKETS, len(languages)), np.float32)
    scripts = np.empty((len(NAMES), len(languages)))
    for k, r in enumerate(table):
        grams = np.frombuffer(r.grams, np.int64).astype(np.float64)
        logs[:, k] = np.log((grams + SMOOTHING) / (grams.sum() + SMOOTHING * BUCKETS))
        scripts[:, k] = np.frombuffer(r.scripts, np.int64)
    logs -= logs.mean(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
    return Model(languages, logs, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def _packed(rows: pa.Table) -> pa.Table:
    """The counts of one language as two rows of numbers."""
    kind, slot, n = (rows.column(c).to_numpy() for c in ("kind", "slot", "n"))
    packed = []
    for k, size in ((0, BUCKETS), (1, len(NAMES))):
        counts = np.zeros(size, np.int64)
        counts[slot[kind == k]] = n[kind == k]
        packed.append(pa.array([counts.tobytes()], pa.binary()))
    return pa.table([rows.column("lang").slice(0, 1).combine_chunks(), *packed], ["lang", "grams", "scripts"])


def _advance(scores: np.ndarray, state: np.ndarray | None, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state behind a window of one text's words, and for each word whether its label may stay and what it came from."""
    n, k = scores.shape
    stay, best = np.ones((n, k), bool), np.zeros(n, np.int16)
    for t in range(n):
        if state is None:
            state = scores[t]
            continue
        best[t] = state.argmax()
        jump = state[best[t]] - np.float32(switch)
        stay[t] = state >= jump
        state = np.maximum(state, jump) - jump + scores[t]
    return state, stay, best


def windows(text: str, size: int) -> list[tuple[int, int]]:
    """Places that cut a text into windows of up to ``size`` characters, between words where a word is shorter than half of it."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        back = end
        while back < len(text) and back > at + size // 2 and text[back].isalpha() and text[back - 1].isalpha():
            back -= 1
        if back > at + size // 2:
            end = back
        out.append((at, end))
        at = end
    return out


Label = tuple[str, float, list[tuple[int, int, str]]]


def label_long(model: Model, text: str, size: int) -> Label:
    """The label of a text that is too long for one table: windows forward for the state at each, then back for the labels."""
    cut = windows(text, size)
    states: list[np.ndarray | None] = [None]
    for a, b in cut:
        states.append(_advance(word_scores(model, text[a:b])[2], states[-1])[0])
    if states[-1] is None:
        return UNKNOWN, 0.0, []
    label = int(states[-1].argmax())
    share = np.zeros(len(model.languages))
    spans: list[tuple[int, int, int]] = []
    for (a, b), state in zip(reversed(cut), reversed(states[:-1]), strict=True):
        places, letters, scores = word_scores(model, text[a:b])
        _, stay, best = _advance(scores, state)
        for t in range(len(scores) - 1, -1, -1):
            share[label] += letters[t]
            start = a + int(places[t])
            if spans and spans[-1][2] == label:
                spans[-1] = (start, spans[-1][1], label)
            else:
                spans.append((start, start + int(letters[t]), label))
            if not stay[t, label]:
                label = int(best[t])
    top = int(share.argmax())
    return model.languages[top], float(share[top] / share.sum()), [(a, b, model.languages[k]) for a, b, k in reversed(spans)]


def label_texts(model: Model, texts: list[str | None]) -> list[Label]:
    """For each text: language, score, spans (start, end, language) in code points.

    Texts are scored in groups of up to ``CELLS`` words times languages, by the words that their lengths allow; a longer text by itself, in windows.
    """
    most = max(CELLS // max(len(model.languages), 1), 1000)  # words; a word and a blank are two characters at least
    out: list[Label] = []
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        words = len(text) // 2 + 1
        if held and size + words > most:
            out += _label_group(model, held)
            held, size = [], 0
        if words > most and model.languages:
            out.append(label_long(model, text, 2 * most))
        else:
            held.append(text)
            size += words
    return out + _label_group(model, held)


def _label_group(model: Model, texts: list[str]) -> list[Label]:
    parts = [word_scores(model, x) for x in texts]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    labels = viterbi(np.concatenate([p[2] for p in parts]), sizes) if len(model.languages) and len(parts) else np.zeros(0, np.int16)
    out, at = [], 0
    for (places, letters, _), n in zip(parts, sizes.tolist(), strict=True):
        if not n or not model.languages:
            out.append((UNKNOWN, 0.0, []))
            continue
        own = labels[at : at + n]
        at += n
        share = np.bincount(own, weights=letters, minlength=len(model.languages))
        top = int(share.argmax())
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ends = np.append(cut[1:], n) - 1
        spans = [(int(places[a]), int(places[b] + letters[b]), model.languages[own[a]]) for a, b in zip(cut, ends, strict=True)]
        out.append((model.languages[top], float(share[top] / share.sum()), spans))
    return out


def _labelled(model, with_spans: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(slices(batches, 1, BATCH_BYTES), ROWS, 1, BATCH_BYTES):
            found = label_texts(model.value, batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if with_spans:
                cols.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], span))
            yield pa.RecordBatch.from_arrays(cols, ["id", "lang_pred", "score", "spans"][: len(cols)])

    return told


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """``(<id_col>, lang_pred, score[, spans])``, one row for each input row.

    A null text, one without letters, or any text under a model without languages is ``und`` with
    score 0 and no spans. Only the two named columns are read; repeated or null ids are kept. Ties
    go to the language that sorts first.
    """
    spark = docs.sparkSession
    arrow_rows(spark, ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = ", spans array<struct<start:int,end:int,lang:string>>" if with_spans else ""
    out = rows.mapInArrow(_labelled(spark.sparkContext.broadcast(model), with_spans), f"id {kind}, lang_pred string, score double{spans}")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more; columns as they are."""
    spark = docs.sparkSession
    arrow_rows(spark, ROWS)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(slices(batches, at, BATCH_BYTES), ROWS, at, BATCH_BYTES):
            found = label_texts(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(told, docs.schema)
