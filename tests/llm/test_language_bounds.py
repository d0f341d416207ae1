"""Language labels within bounded memory: long texts in windows, many languages."""

from __future__ import annotations

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.llm import language

from .test_operators import DOCS, SF, docs_of


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{SF}/documents.parquet"))


def mixed(spark, n=12):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [r.text for r in rows]
    return ["\n".join(texts[k : k + 5]) for k in range(n)] + ["", "  ", "12 34", "é", texts[0]]


def test_windows_give_the_same_labels(spark, model, monkeypatch):
    texts = mixed(spark)
    want = language.label_texts(model, texts)
    assert max(len(w[2]) for w in want) > 2
    for size in (40, 333, 5000):
        assert [language.label_long(model, t, size) for t in texts] == want
    monkeypatch.setattr(language, "CELLS", 4000)  # small groups; texts over 1,000 words go by windows
    assert language.label_texts(model, texts) == want


def test_windows_cut_between_words():
    text = "ab cde " * 50 + "x" * 500 + " end"
    cut = language.windows(text, 60)
    assert "".join(text[a:b] for a, b in cut) == text and all(b - a <= 60 for a, b in cut)
    assert sum(text[b - 1].isalpha() and text[b : b + 1].isalpha() for _, b in cut) <= 500 // 30
    assert language.windows("", 5) == []


def test_three_hundred_languages(spark):
    """Each language has words of its own letters; all are told apart."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)
        words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(40)]
        rows += [(10_000 + 10 * k + i, " ".join(rng.choice(words, 60)), f"l{k:03d}", "s", 1) for i in range(8)]
    docs = docs_of(spark, rows)
    model = language.train(docs)
    assert len(model.languages) == 300
    got = language.label_texts(model, [r[1] for r in rows])
    assert np.mean([g[0] == r[2] for g, r in zip(got, rows, strict=True)]) > 0.95
    with pytest.raises(ValueError):
        language.LANGUAGES, was = 299, language.LANGUAGES
        try:
            language.train(docs)
        finally:
            language.LANGUAGES = was


def test_memory_of_many_long_texts(spark, model):
    """2,000 texts of 20,000 words need little more memory than the texts."""
    text = (mixed(spark)[0] * 200)[:120_000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = language.label_texts(model, [text] * 300)
    assert len(rows) == 300 and len(set(map(str, rows))) == 1
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def test_a_long_row_among_others(spark, model):
    docs = spark.createDataFrame([(1, "the house and the tree " * 200_000, "en", "s", 1), (2, None, "en", "s", 1), (3, "der Baum", "de", "s", 1)], DOCS)
    got = {r.doc_id: r for r in language.identify(docs.withColumn("lang_pred", F.lit("x")), model, with_spans=False).collect()}
    assert set(got) == {1, 2, 3} and got[2].lang_pred == "und" and 0 < got[1].score <= 1
