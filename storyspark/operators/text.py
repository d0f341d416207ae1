"""Cleaning, segmentation and metadata of books.

Books are rows ``(novel_id, text)``, chapters rows ``(novel_id, chapter_number, title, content)``. A book is
cut inside its own row with array functions, so cutting never shuffles; joining groups by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import JUNK_PATTERNS, METADATA_LABELS, TITLE_PATTERNS
from ..functions.textfn import col, strip


def clean_text(text: str | Column, junk: list[str] = JUNK_PATTERNS) -> Column:
    """Without junk, with plain line ends, single spaces, at most one blank line, no control characters."""
    out = F.regexp_replace(col(text), f"(?diu){'|'.join(junk)}", "")
    for pattern, to in ((r"\r\n", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def lines(text: str | Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(col(text), "\n", -1), strip), lambda x: x != "")


paragraphs = lines


def sentences(text: str | Column, marks: str = "[。！？；]") -> Column:
    """Stripped pieces between sentence marks that are not empty."""
    return F.filter(F.transform(F.split(col(text), marks, -1), strip), lambda x: x != "")


def is_title(line: Column, patterns: list[str] = TITLE_PATTERNS) -> Column:
    return F.rlike(line, F.lit(f"(?iuU)^(?:{'|'.join(patterns)})"))


def word_count(text: str | Column) -> Column:
    """Characters, as the length of a text is counted here."""
    return F.length(col(text))


def content_hash(text: str | Column) -> Column:
    return F.md5(col(text))


def split_chapters(books: DataFrame, patterns: list[str] = TITLE_PATTERNS) -> DataFrame:
    """Chapters ``(novel_id, chapter_number, title, content, word_count)`` of books.

    A title opens a chapter and takes a number even if nothing follows it; such a chapter is dropped, as
    is text before the first title. A book without any chapter is one chapter, its whole text.
    """
    rows = books.select("novel_id", "text", lines("text").alias("__l"))
    rows = rows.withColumn("__t", F.filter(F.transform("__l", lambda x, i: F.when(is_title(x, patterns), i)), lambda i: i.isNotNull()))
    l, t = F.col("__l"), F.col("__t")
    body = lambda p, k: F.slice(l, p + 2, F.coalesce(F.get(t, k + 1), F.size(l)) - p - 1)
    found = F.transform(t, lambda p, k: F.struct((k + 1).alias("chapter_number"), F.get(l, p).alias("title"), body(p, k).alias("body")))
    found = F.transform(F.filter(found, lambda c: F.size(c["body"]) > 0), lambda c: F.struct(c["chapter_number"].alias("chapter_number"), c["title"].alias("title"), F.array_join(c["body"], "\n").alias("content")))
    whole = F.array(F.struct(F.lit(1).alias("chapter_number"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content")))
    rows = rows.select("novel_id", "text", found.alias("__c")).select("novel_id", F.inline(F.when(F.size("__c") > 0, F.col("__c")).otherwise(whole)))
    return rows.withColumn("word_count", word_count("content"))


def line_chapters(books: DataFrame) -> DataFrame:
    """Each line that is not blank as a chapter of its own, numbered in order."""
    return books.select("novel_id", F.posexplode(lines("text")).alias("pos", "content")).select("novel_id", (F.col("pos") + 1).alias("chapter_number"), "content")


def mark_core_chapters(chapters: DataFrame) -> DataFrame:
    """Add ``is_core``: all of up to 20 chapters, else the first 10, every 10th between, the last 5."""
    book = Window.partitionBy("novel_id")
    i, n = F.row_number().over(book.orderBy("chapter_number")) - 1, F.count("*").over(book)
    rows = chapters.withColumn("__i", i).withColumn("__n", n)
    i, n = F.col("__i"), F.col("__n")
    return rows.withColumn("is_core", (n <= 20) | (i < 10) | (i >= n - 5) | ((i - 10) % 10 == 0)).drop("__i", "__n")


def extract_metadata(books: DataFrame, labels: dict[str, str] = METADATA_LABELS, first: int = 50) -> DataFrame:
    """Add one column for each label: what follows its first occurrence in the first lines."""
    head = F.transform(F.slice(F.split("text", "\n", -1), 1, first), strip)

    def value(label: str) -> Column:
        found = F.transform(head, lambda x: F.regexp_extract(x, rf"(?dU)(?:{label})[:：\s]*(.+)", 1))
        return strip(F.get(F.filter(found, lambda x: x != ""), F.lit(0)))

    return books.withColumns({name: value(label) for name, label in labels.items()})


def joined_text(chapters: DataFrame, only: Column | None = None, name: str = "text") -> DataFrame:
    """The contents of each book's chapters, in order, with a blank line between."""
    row = F.struct("chapter_number", "content")
    rows = F.array_sort(F.collect_list(row if only is None else F.when(only, row)))
    return chapters.groupBy("novel_id").agg(F.array_join(rows["content"], "\n\n").alias(name))


def full_text(chapters: DataFrame) -> DataFrame:
    return joined_text(chapters)


def core_text(chapters: DataFrame) -> DataFrame:
    """The core chapters' contents; where they are empty those of the first ten."""
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy("chapter_number"))
    ranked = chapters.withColumn("__place", place)
    row = F.struct("chapter_number", "content")
    core, head = (F.array_join(F.array_sort(F.collect_list(F.when(c, row)))["content"], "\n\n") for c in (F.col("is_core"), F.col("__place") <= 10))
    return ranked.groupBy("novel_id").agg(F.coalesce(F.nullif(core, F.lit("")), head).alias("text"))


def select_chapters(chapters: DataFrame, strategy: str) -> DataFrame:
    """``full``, ``core_first`` (core chapters) or ``sampling`` (3 from each of five places).

    Sampling takes places from the start, a quarter, the middle, three quarters and the end; places
    beyond the book fall away, places before its start count from its end, and repeats stay.
    """
    if strategy == "full":
        return chapters
    if strategy == "core_first":
        return chapters.where("is_core")
    if strategy != "sampling":
        raise ValueError(f"unknown strategy: {strategy}")
    book = Window.partitionBy("novel_id")
    rows = chapters.withColumn("__i", F.row_number().over(book.orderBy("chapter_number")) - 1).withColumn("__n", F.count("*").over(book))
    n = F.col("__n")
    starts = [F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4), n - 3]
    places = F.array(*[(start + k).cast("long") for start in starts for k in range(3)])
    inside = F.transform(F.filter(places, lambda p: (p < n) & (p >= -n)), lambda p: F.when(p < 0, p + n).otherwise(p))
    hits = F.size(F.filter(inside, lambda p: p == F.col("__i")))
    return rows.withColumn("__hits", hits).where("__hits > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__hits")))).drop("__i", "__n", "__hits", "__k")


def context_window(text: str | Column, keyword: Column, before: int = 20, after: int = 30) -> Column:
    """What stands around the first occurrence of a keyword; null without one."""
    at = F.instr(col(text), keyword)
    start = F.greatest(at - 1 - before, F.lit(0))
    return F.when(at > 0, strip(F.substr(col(text), start + 1, at - 1 + after - start)))


def chunk_text(books: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """Overlapping pieces ``(novel_id, chunk, content)`` of ``size`` characters."""
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"), F.lit(size - overlap)))
    pieces = F.transform(starts, lambda i: F.substr(F.col("text"), i, F.lit(size)))
    return books.select("novel_id", F.posexplode(pieces).alias("chunk", "content"))


def parse_book(books: DataFrame, patterns: list[str] = TITLE_PATTERNS, labels: dict[str, str] = METADATA_LABELS, junk: list[str] = JUNK_PATTERNS) -> DataFrame:
    """Clean, read metadata, split and mark: chapters with their book's metadata and total length."""
    cleaned = books.select("novel_id", clean_text("text", junk).alias("text"))
    info = extract_metadata(cleaned, labels).drop("text")
    info = info.withColumnsRenamed({k: f"novel_{k}" for k in labels})
    chapters = mark_core_chapters(split_chapters(cleaned, patterns))
    total = F.sum("word_count").over(Window.partitionBy("novel_id"))
    return chapters.withColumn("total_word_count", total).withColumn("chapter_hash", content_hash("content")).join(info.hint("merge"), "novel_id")
