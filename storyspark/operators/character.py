"""Characters (C1-C9): the hero's arc, marks of speech and habit, supporting roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import lookup, scores, top
from ..functions.textfn import cnt, col, first_present, has_any, matches, once, one_of
from .text import context_window


def _places(chapters: DataFrame) -> DataFrame:
    book = Window.partitionBy("novel_id")
    return chapters.withColumn("__up", F.row_number().over(book.orderBy("chapter_number"))).withColumn("__n", F.count("*").over(book))


def arc_type(chapters: DataFrame, lexicon=L.ARCS, span: int = 10) -> DataFrame:
    """``(novel_id, arc_type)``: start words in the first chapters and end words in the last, which may be the same."""
    rows = _places(chapters)
    head, tail = F.col("__up") <= span, F.col("__up") > F.col("__n") - span
    sums = []
    for k, (_, (starts, ends)) in enumerate(lexicon.items()):
        n = F.when(head, reduce(lambda a, b: a + b, [cnt("content", w) for w in starts])).otherwise(0) + F.when(tail, reduce(lambda a, b: a + b, [cnt("content", w) for w in ends])).otherwise(0)
        sums.append(F.sum(n).alias(f"__s{k}"))
    found = rows.where(head | tail).groupBy("novel_id").agg(*sums)
    table = F.array(*[F.struct(F.lit(a).alias("category"), F.col(f"__s{k}").alias("score")) for k, a in enumerate(lexicon)])
    return found.select("novel_id", table.alias("found")).select("novel_id", top("found").alias("arc_type"))


def turning_points(chapters: DataFrame, keywords=L.TURNINGS, most: int = 5) -> DataFrame:
    """``(novel_id, place, chapter_number, context)``: around the first listed keyword of a chapter.

    Of more than ``most`` chapters every n-th is taken, so that they are spread over the book.
    """
    found = chapters.withColumn("__key", first_present("content", keywords)).where("__key is not null")
    book = Window.partitionBy("novel_id")
    rows = found.withColumn("__i", F.row_number().over(book.orderBy("chapter_number")) - 1).withColumn("__n", F.count("*").over(book))
    step = F.greatest(F.floor(F.col("__n") / most), F.lit(1))
    rows = rows.where((F.col("__n") <= most) | ((F.col("__i") % step == 0) & (F.col("__i") < step * most)))
    place = F.when(F.col("__n") <= most, F.col("__i")).otherwise(F.col("__i") / step).cast("int") + 1
    return rows.select("novel_id", place.alias("place"), "chapter_number", context_window("content", F.col("__key")).alias("context"))


def completion(n: Column, last_chapter: Column, n_chapters: Column, most: int = 5) -> Column:
    full = F.least(n / most, F.lit(1.0)) + F.when(n_chapters > 0, last_chapter / n_chapters).otherwise(0.0) * 0.2
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).otherwise(F.least(full, F.lit(1.0)))


def arc_completion(chapters: DataFrame, keywords=L.TURNINGS) -> DataFrame:
    """``(novel_id, n_turning_points, completion)``."""
    points = turning_points(chapters, keywords).groupBy("novel_id").agg(F.count("*").alias("n"), F.max("chapter_number").alias("last"))
    rows = chapters.groupBy("novel_id").agg(F.count("*").alias("n_chapters")).join(points.hint("merge"), "novel_id", "left")
    return rows.select("novel_id", F.coalesce("n", F.lit(0)).alias("n_turning_points"), completion(F.col("n"), F.col("last"), F.col("n_chapters")).alias("completion"))


def satisfaction(arc: Column, done: Column, popular=L.POPULAR_ARCS) -> Column:
    return F.least(F.when(arc.isin(*popular), 0.75).otherwise(0.7) + done * 0.25, F.lit(1.0))


def character_tags(books: DataFrame, speech: str = L.SPEECH_PATTERN, behaviours=L.BEHAVIOURS, habits=L.HABITS, least_behaviour: int = 3, least_habit: int = 5, most: int = 5) -> DataFrame:
    """``(novel_id, place, tag_type, tag_description, frequency, quotes)``, the most frequent first."""
    tags = books.select("novel_id", F.explode(tag_items("text", speech, behaviours, habits, least_behaviour, least_habit)).alias("t")).select("novel_id", "t.*")
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("frequency"), "ord"))
    return tags.withColumn("place", place).where(F.col("place") <= most).select("novel_id", "place", "tag_type", "tag_description", "frequency", "quotes")


def tag_items(text: str, speech: str = L.SPEECH_PATTERN, behaviours=L.BEHAVIOURS, habits=L.HABITS, least_behaviour: int = 3, least_habit: int = 5) -> Column:
    """Array of (ord, tag_type, tag_description, frequency, quotes) of a book."""
    tag = lambda k, kind, said, n, q: F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("tag_type"), F.lit(said).alias("tag_description"), n.alias("frequency"), q.alias("quotes"))
    # Each tag is counted once and then judged.
    rows = [once(matches(text, speech), lambda q: tag(0, "语言", "说话喜欢带语气词", F.size(q), F.array_join(F.slice(q, 1, 3), "\n")))]
    rows += [tag(k, "行为", f"经常{name}", F.regexp_count(col(text), F.lit(f"(?d){pattern}")), F.lit("")) for k, (name, pattern) in enumerate(behaviours.items(), 1)]
    rows += [tag(k, "习惯", f"有{name}的习惯", cnt(text, name), F.lit("")) for k, name in enumerate(habits, 1 + len(behaviours))]
    return F.filter(F.array(*rows), lambda t: t["frequency"] >= F.when(t["ord"] == 0, 1).when(t["ord"] <= len(behaviours), least_behaviour).otherwise(least_habit))


def person_mentions(books: DataFrame, patterns=L.PERSON_PATTERNS, most: int = 10) -> DataFrame:
    """``(novel_id, person, mentions)``: the names most often mentioned, then by name."""
    return books.select("novel_id", F.inline(top_persons("text", patterns, most)))


def top_persons(text: str, patterns=L.PERSON_PATTERNS, most: int = 10) -> Column:
    """Array of (person, mentions) of a book: its names in order are cut where the name changes."""
    found = F.array_sort(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(1)) for p in patterns])))

    def counted(names: Column) -> Column:
        new = lambda x, i: F.when((i == 0) | (F.get(names, i - 1) != x), i)
        starts = F.array_compact(F.transform(names, new))
        size = lambda s: lambda at, k: F.struct((at - F.coalesce(F.get(s, k + 1), F.size(names))).cast("long").alias("less"), F.get(names, at).alias("person"))
        return once(starts, lambda s: F.transform(s, size(s)))

    best = F.slice(F.array_sort(once(found, counted)), 1, most)
    return F.transform(best, lambda r: F.struct(r["person"].alias("person"), (-r["less"]).alias("mentions")))


def said_scores(content: str | Column, cast: str | Column, lexicon=L.ROLES, stop: str = "。") -> Column:
    """Array of (person, mentions, r0, r1, ...) of the persons of a list whom a chapter names: how often keywords of each role stand in their sentences.

    Keywords are counted once a sentence, however many persons it names.
    """
    roles = range(len(lexicon))
    counted = lambda s: F.struct(s.alias("s"), *[reduce(lambda a, b: a + b, [cnt(s, w) for w in keys]).alias(f"r{k}") for k, keys in enumerate(lexicon.values())])
    total = lambda own, k: F.aggregate(own, F.lit(0), lambda n, x: n + x[f"r{k}"])
    scored = lambda p, own: F.when(F.size(own) > 0, F.struct(p["person"].alias("person"), p["mentions"].alias("mentions"), *[total(own, k).alias(f"r{k}") for k in roles]))
    each = lambda found: F.transform(cast, lambda p: once(F.filter(found, lambda x: F.contains(x["s"], p["person"])), lambda own: scored(p, own)))
    return F.array_compact(once(F.transform(F.split(content, one_of(stop), -1), counted), each))


def supporting_roles(chapters: DataFrame, persons: DataFrame, lexicon=L.ROLES, stop: str = "。", reusable=L.REUSABLE_ROLES, most: int = 5, texts=L.ROLE_TEXTS, plots=L.PLOT_FUNCTIONS, relations=L.RELATIONSHIPS) -> DataFrame:
    """``(novel_id, place, role_name, function_type, role_description, relationship, plot_function, reusability)``.

    The few persons of a book are joined to its chapters as a list; a chapter yields a row for each person it
    names, with the scores of that person's sentences.
    """
    cast = persons.groupBy("novel_id").agg(F.collect_list(F.struct("person", "mentions")).alias("__p"))
    pairs = chapters.join(cast.hint("merge"), "novel_id").select("novel_id", F.inline(said_scores("content", "__p", lexicon, stop)))
    sums = [F.sum(f"r{k}").alias(f"__s{k}") for k in range(len(lexicon))]
    rows = pairs.groupBy("novel_id", "person", "mentions").agg(*sums)
    table = F.array(*[F.struct(F.lit(r).alias("category"), F.col(f"__s{k}").alias("score")) for k, r in enumerate(lexicon)])
    rows = rows.select("novel_id", "person", "mentions", table.alias("found")).withColumn("function_type", top("found"))
    return ranked_roles(rows, reusable, most, texts, plots, relations)


def ranked_roles(rows: DataFrame, reusable=L.REUSABLE_ROLES, most: int = 5, texts=L.ROLE_TEXTS, plots=L.PLOT_FUNCTIONS, relations=L.RELATIONSHIPS) -> DataFrame:
    """The roles of persons with a ``function_type``, the most reusable first."""
    rows = rows.withColumn("reusability", F.when(F.col("function_type").isin(*reusable), 0.95).otherwise(0.75))
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("reusability"), F.desc("mentions"), "person"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(
        "novel_id", "place", F.col("person").alias("role_name"), "function_type", role_description(F.col("function_type"), texts).alias("role_description"),
        infer_relationship("person", relations).alias("relationship"), lookup(F.col("function_type"), plots, "辅助剧情").alias("plot_function"), "reusability",
    )


def infer_relationship(name: str | Column, table=L.RELATIONSHIPS, default: str = "其他") -> Column:
    out = F.lit(default)
    for kind, keys in reversed(table.items()):
        out = F.when(has_any(name, keys), kind).otherwise(out)
    return out


def role_description(kind: Column, table=L.ROLE_TEXTS) -> Column:
    return lookup(kind, table, "功能性配角")


def memorability(done: Column, n_tags: Column, n_roles: Column) -> Column:
    return F.least(F.lit(0.6) + done * 0.15 + F.least(n_tags * 0.03, F.lit(0.15)) + F.least(n_roles * 0.02, F.lit(0.1)), F.lit(1.0))
