"""Backtracking BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyspark.llm import backtrack, queries

from .test_operators import SF, clashing, docs_of, texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"aaaabbetionsrl  ''.,!?-0123ÀÉéßΣσςİIıñ\t\n\x1c\x85", " ", "　", "é", "東", "ि", "🙂", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "tion", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return backtrack.Encoder(PATH)


def test_random_strings(own, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 3000, "!" * 4000, "." * 1001, "-=-=" * 500, ""]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_pair_of_short_tokens_is_judged_as_merges_do(own, library):
    rng = random.Random(5)
    names = [t for t in library.get_vocab() if t.isascii() and t.isalpha() and t.islower() and len(t) < 6]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        word = a + b
        ids = [library.token_to_id(a), library.token_to_id(b + "</w>")]
        if ids[1] is not None:
            assert own.fits(*ids) == (library.encode(word, add_special_tokens=False).ids == ids)


def test_small_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(backtrack, "KEPT", 3)
    monkeypatch.setattr(backtrack, "PAIRS", 2)
    monkeypatch.setattr(backtrack, "LONGEST", 2)
    own = backtrack.Encoder(PATH)
    for text in ("one two three four", "two five <|endoftext|> one", "x " * 50):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_backtracks_where_the_longest_token_leads_nowhere(tmp_path):
    """b+c comes before a+b, so that abc is a, bc, though ab and even abc are tokens."""
    file = json.load(open(PATH))
    file["model"]["vocab"] = {"a": 0, "b": 1, "c": 2, "a</w>": 3, "b</w>": 4, "c</w>": 5, "bc": 6, "bc</w>": 7, "ab": 8, "abc": 9}
    file["model"]["merges"] = [["b", "c"], ["b", "c</w>"], ["a", "b"], ["ab", "c"]]
    file["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(file))
    library, own = Tokenizer.from_file(str(path)), backtrack.Encoder(str(path))
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids, word


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        backtrack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    texts = texts_of(spark)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe(spark, SF).collect()}
    assert got == {k: digest(library, t) for k, t in texts.items()}


def test_odd_rows(spark, library):
    docs = docs_of(spark)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in backtrack.encode_texts(clashing(docs), PATH).collect())
    assert got == sorted((r.doc_id or -1, *digest(library, r.text)) for r in docs.collect())
    assert backtrack.encode_texts(docs_of(spark, []), PATH).count() == 0


def test_ids_come_back_as_text(spark, library):
    rows = backtrack.decode_ids(backtrack.encode_texts(docs_of(spark), PATH), PATH)
    for r in rows.collect():
        assert r.text == library.decode(r.ids, skip_special_tokens=False)
    none = backtrack.decode_ids(rows.select(F.lit(None).cast("array<int>").alias("ids"), "text"), PATH)
    assert {r.text for r in none.collect()} == {None}
    assert np.asarray(rows.select("n_tokens").toPandas()).sum() > 0
