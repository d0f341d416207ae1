"""Keyword and pattern rules over texts (R1-R10), from a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.lexicons import RULES
from ..functions.textfn import col, declared
from .keywords import group_hits

CONFIDENCE = {"task.task_structure": 0.8, "background.world_type": 0.9, "background.power_system": 0.85, "writing.narrative_perspective": 0.7, "plot.conflict_types": 0.75}


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The default rules as a table."""
    rows = []
    for k, (rule_id, value, field, kind, what, weight) in enumerate(RULES):
        words, pattern = (what, None) if kind == "keyword" else (None, what)
        rows.append((rule_id, k, rule_id, field, kind, words, pattern, value, weight, True, None))
    return spark.createDataFrame(rows, schemas.RULES)


def keyword_presence_ratio(text: str | Column, keywords: Column) -> Column:
    """Share of the keywords that the text holds; 0 without keywords."""
    n = F.size(F.filter(keywords, lambda k: F.contains(col(text), k)))
    return F.when((F.size(keywords) > 0) & col(text).isNotNull(), n / F.size(keywords)).otherwise(0.0)


def regex_rule_score(text: str | Column, pattern: str | Column) -> Column:
    """Matches of a pattern, whatever the case, as tenths up to 1; a null text has none."""
    p = F.concat(F.lit("(?iuU)"), pattern) if isinstance(pattern, Column) else F.lit(f"(?iuU){pattern}")
    return F.least(F.coalesce(F.regexp_count(col(text), p), F.lit(0)) / 10, F.lit(1.0))


def first_matching_keyword(text: str | Column, keywords: Column) -> Column:
    """The first listed keyword that the text holds.

    The text is named outside the lambda too: a filter that names it in there alone may be pushed to the
    side of a join that lacks it.
    """
    return F.when(col(text).isNotNull(), F.get(F.filter(keywords, lambda k: F.contains(col(text), k)), F.lit(0)))


def rule_scores(books: DataFrame, rules: DataFrame) -> DataFrame:
    """``(novel_id, rule_id, rule_ord, target_field, value, score, weight)`` of each enabled rule that scores.

    The keywords of all rules are found in one pass over a text, by one automaton; a rule scores by the share of its
    listed keywords that occur, and its value is its own or the first of these. Patterns are a small
    declared table; each is tried on each text. Rules are told apart by their order and id.
    """
    own = rules.where(F.coalesce("enabled", F.lit(True))).select("rule_id", "rule_ord", "name", "target_field", "rule_type", "keywords", "pattern", F.col("value").alias("rule_value"), "weight")
    names = ["novel_id", "rule_id", "rule_ord", "target_field", "value", "score", "weight"]
    by_word = own.where("rule_type = 'keyword'").select("rule_id", "rule_ord", "target_field", "rule_value", "weight", "keywords").collect()  # as many as are declared
    entries = [(k, g, p) for g, r in enumerate(by_word) for p, k in enumerate(r.keywords or [])]
    spark = books.sparkSession
    hits = group_hits(books.select("novel_id", "text"), spark.createDataFrame(entries, "keyword string, group long, place long"))
    told = [(g, r.rule_id, r.rule_ord, r.target_field, r.rule_value, r.weight, r.keywords) for g, r in enumerate(by_word) if r.keywords]
    told = spark.createDataFrame(told, "group long, rule_id string, rule_ord int, target_field string, rule_value string, weight double, keywords array<string>")
    found = hits.join(F.broadcast(told), "group").withColumn("score", F.col("present") / F.size("keywords"))
    found = found.withColumn("value", F.coalesce("rule_value", F.get("keywords", F.col("first").cast("int"))))
    patterns = books.select("novel_id", "text").crossJoin(declared(own.where("rule_type = 'regex'")))
    tried = patterns.withColumn("score", regex_rule_score("text", F.col("pattern"))).withColumn("value", F.coalesce("rule_value", "name")).where("score > 0")
    return found.select(*names).unionByName(tried.select(*names))


def apply_rules(books: DataFrame, rules: DataFrame) -> DataFrame:
    """The best value ``(novel_id, target_field, value, score)`` of each field; the first of equals.

    Scores are equal if they agree to nine places, as a sum's last places depend on the order in which its rows come.
    """
    by = rule_scores(books, rules).where("value is not null").groupBy("novel_id", "target_field", "value").agg(F.sum(F.col("score") * F.col("weight")).alias("score"), F.min("rule_ord").alias("rule_ord"))
    place = F.row_number().over(Window.partitionBy("novel_id", "target_field").orderBy(F.desc(F.round("score", 9)), "rule_ord"))
    return by.withColumn("place", place).where("place = 1").select("novel_id", "target_field", "value", "score")


def rule_features(books: DataFrame, rules: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row a book, one column a target field (dots as underscores), and ``confidence_score``."""
    fields = fields or list(dict.fromkeys(r[2] for r in RULES))
    found = apply_rules(books, rules).groupBy("novel_id").pivot("target_field", fields).agg(F.first("value"))
    out = books.select("novel_id").join(found.hint("merge"), "novel_id", "left")
    return out.select("novel_id", *[F.col(f"`{f}`").alias(f.replace(".", "_")) for f in fields], rule_confidence({f: F.col(f"`{f}`") for f in fields}).alias("confidence_score"))


def rule_confidence(values: dict[str, Column]) -> Column:
    """Mean of the fixed trusts of the fields that have a value, else 0."""
    n, total = F.lit(0), F.lit(0.0)
    for field, trust in CONFIDENCE.items():
        if field in values:
            n, total = n + values[field].isNotNull().cast("int"), total + F.when(values[field].isNotNull(), trust).otherwise(0.0)
    return F.when(n > 0, total / n).otherwise(0.0)


def rule_stats(rules: DataFrame) -> DataFrame:
    """Numbers of rules, enabled rules and target fields."""
    return rules.agg(F.count("*").alias("total_rules"), F.count_if("enabled").alias("enabled_rules"), F.array_join(F.array_sort(F.collect_set("target_field")), ",").alias("target_fields"))


def rulesets_for_genre(sets: DataFrame, genre: str | None) -> DataFrame:
    """Enabled rule sets of a genre, and those for any."""
    return sets.where(F.col("enabled") & (F.col("genre").eqNullSafe(F.lit(genre)) | F.col("genre").isNull()))


def lexicon_scores(books: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Scores by a lexicon that is itself a table: ``(novel_id, category, cat_ord, n, present)``.

    Categories without a hit have their row too. All keywords are found in one pass over a text; a keyword that is listed
    twice counts twice. The categories (not the keywords) are a small declared table.
    """
    spark = books.sparkSession
    rows = books.select("novel_id", "text")
    named = [(g, r.category, r.cat_ord) for g, r in enumerate(declared(lexicon.select("category", "cat_ord").distinct()).collect())]
    groups = spark.createDataFrame(named, "group long, category string, cat_ord int")
    own = lexicon.join(F.broadcast(groups), lexicon["category"].eqNullSafe(groups["category"]) & lexicon["cat_ord"].eqNullSafe(groups["cat_ord"]))
    hits = group_hits(rows, own.select("keyword", "group", F.lit(0).cast("long").alias("place")), whole=False)
    zero = F.lit(0).cast("long")
    none = rows.select("novel_id").distinct().crossJoin(F.broadcast(groups.select("group"))).select("novel_id", "group", zero.alias("n"), zero.alias("present"))
    by = hits.select("novel_id", "group", "n", "present").unionByName(none).groupBy("novel_id", "group").agg(F.sum("n").alias("n"), F.sum("present").alias("present"))
    return by.join(F.broadcast(groups), "group").select("novel_id", "category", "cat_ord", "n", "present")
