"""A shared folder whose name has signs that Spark escapes."""

from __future__ import annotations

from storyspark.llm import common, substrings

from .test_operators import docs_of


def test_substring_removal_in_an_odd_folder(spark, tmp_path, monkeypatch):
    words = " ".join(f"w{k}" for k in range(40))
    docs = docs_of(spark, [(1, f"a {words} b", "en", "s", 1), (2, f"{words} c", "en", "s", 1), (3, "short", "en", "s", 1)])
    told = lambda: sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect())
    want = told()
    assert [w[2] for w in want] == [40, 40, 0]
    for name in ("my dir", "50% +ü#1"):
        (tmp_path / name).mkdir()
        monkeypatch.setattr(common, "shared_dir", lambda spark, name=name: f"{tmp_path}/{name}")
        assert told() == want
