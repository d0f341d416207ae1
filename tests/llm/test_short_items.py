"""Decontamination of short items, of scripts without spaces and of scattered substitutions."""

from __future__ import annotations

from storyspark.llm import decontaminate

from .test_operators import docs_of

ITEMS = [
    (1, "What is the capital of France?"),
    (2, "中国古代四大发明是指南针造纸术火药和印刷术它们对世界文明产生了深远影响"),
    (3, "one two three four five six seven eight nine ten eleven twelve"),
    (4, "Quite unheard-of"),
]
DOCS = [
    (1, "He asked: what is the capital of France, then left."),
    (2, "He asked: what is the capital of Spain, then left."),
    (3, "他说过中国古代四大发明是指南针造纸木火药和印刷术它们对世界文明产生了深远影响等等"),
    (4, "这里谈的是另外一些完全不同的事情没有任何重复的段落可言"),
    (5, "x one other three four five other seven eight nine ten eleven twelve y"),
    (6, "x one other three four other six seven other nine ten eleven twelve y"),
    (7, "a quite unheard of thing"),
    (8, "what is"),
]


def test_short_items_and_scripts_without_spaces(spark):
    docs, bench = docs_of(spark, [(*r, "en", "s", 0) for r in DOCS]), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.matched) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: ([1], 6), 3: ([2], len(ITEMS[1][1]) - 1), 5: ([3], 10), 7: ([4], 3)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {2, 4, 6, 8}


def test_any_two_substitutions_in_twelve_are_found(spark):
    words = ITEMS[2][1].split()
    texts = [" ".join("other" if k in (a, b) else w for k, w in enumerate(words)) for a in range(12) for b in range(a, 12)]
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([ITEMS[2]], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == len(texts)
