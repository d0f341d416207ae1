"""Queries of cleaning, segmentation and rules (T, R), and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import schemas
from ..operators import rules as R
from ..operators import text as T
from ..operators.keywords import keyword_hits
from .bindings import BOOKS, CHAPTERS, LATIN, Tables, case, cols, first_present, present, query, s, scored, strip, top, total, with_

_JUNK = "'(?i)www\\..+\\.com|tion'"
_CLEAN = "text"
for _p, _to in ((_JUNK, "''"), ("'\\r\\n'", "chr(10)"), ("'[ \\t]+'", "' '"), ("'\\n{3,}'", "chr(10) || chr(10)"), ("'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'", "''")):
    _CLEAN = f"regexp_replace({_CLEAN}, {_p}, {_to}, 'g')"
_CLEAN = strip(_CLEAN)


@query(with_(BOOKS) + f"select category, cast(count(*) as bigint) as n from (select {top(LATIN, [total('text', k) for k in LATIN.values()])} as category from (select novel_id, {_CLEAN} as text from books)) group by category")
def flagship_top_categories(t: Tables) -> DataFrame:
    cleaned = t.books.select("novel_id", T.clean_text("text", [r"www\..+\.com", "tion"]).alias("text"))
    return cleaned.select(S.top(S.scores("text", LATIN)).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(with_(BOOKS) + f"select novel_id, md5(c) as text_md5, cast(length(c) as int) as n_chars from (select novel_id, {_CLEAN} as c from books)")
def t1_clean_text(t: Tables) -> DataFrame:
    c = T.clean_text("text", [r"www\..+\.com", "tion"])
    return t.books.select("novel_id", c.alias("c")).select("novel_id", F.md5("c").alias("text_md5"), F.length("c").alias("n_chars"))


_TITLED = "titled as (select doc_id as novel_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when doc_id % 5 > 0 and (i - 1) % 4 = 1 then 'Chapter ' || i || chr(10) || x else x end), chr(10)) as text from documents)"
_SPLIT = _TITLED + f""",
tl as (select novel_id, pos, {strip('line')} as line from (select novel_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from titled)),
tm as (select novel_id, pos, line, regexp_matches(line, '^(?i)(?:第[一二三四五六七八九十百千零0-9]+章[\\s:：]|Chapter\\s*[0-9]+|[0-9]+[\\s:：]|[\\(（]?[0-9]+[\\)）]?[\\s:：])') as title from tl where line <> ''),
tn as (select *, sum(cast(title as int)) over (partition by novel_id order by pos) as k from tm),
tc as (select novel_id, k, max(line) filter (title) as title, string_agg(line, chr(10) order by pos) filter (not title) as content from tn where k > 0 group by novel_id, k having count(*) filter (not title) > 0),
split as (select novel_id, cast(k as int) as chapter_number, title, content from tc
  union all select novel_id, 1, null, text from titled where novel_id not in (select novel_id from tc))"""


def titled(t: Tables) -> DataFrame:
    mark = lambda x, i: F.when((F.col("novel_id") % 5 > 0) & (i % 4 == 1), F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x)
    return t.books.select("novel_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


@query(with_(_SPLIT) + "select novel_id, chapter_number, title, md5(content) as content_md5, cast(length(content) as int) as word_count from split")
def t2_split_chapters(t: Tables) -> DataFrame:
    return T.split_chapters(titled(t)).select("novel_id", "chapter_number", "title", F.md5("content").alias("content_md5"), "word_count")


@query(with_(CHAPTERS) + "select novel_id, cast(sum(length(content)) as bigint) as total_word_count, cast(count(*) as bigint) as chapters from chapters group by novel_id")
def t3_word_count(t: Tables) -> DataFrame:
    return t.chapters.groupBy("novel_id").agg(F.sum(T.word_count("content")).alias("total_word_count"), F.count("*").alias("chapters"))


#: Books with many chapters: the chapters of ten consecutive documents.
_MERGED = CHAPTERS + ", merged as (select novel_id // 10 as novel_id, cast(row_number() over (partition by novel_id // 10 order by novel_id, chapter_number) as int) as chapter_number, content from chapters)"
_CORE = _MERGED + ", core as (select *, n <= 20 or i < 10 or i >= n - 5 or (i - 10) % 10 = 0 as is_core from (select *, row_number() over (partition by novel_id order by chapter_number) - 1 as i, count(*) over (partition by novel_id) as n from merged))"


def merged(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    book = F.floor(F.col("novel_id") / 10).cast("long")
    place = F.row_number().over(Window.partitionBy("book").orderBy("novel_id", "chapter_number"))
    return t.chapters.withColumn("book", book).withColumn("n", place).select(F.col("book").alias("novel_id"), F.col("n").alias("chapter_number"), "content")


@query(with_(_CORE) + "select novel_id, chapter_number, is_core from core")
def t4_mark_core_chapters(t: Tables) -> DataFrame:
    return T.mark_core_chapters(merged(t)).select("novel_id", "chapter_number", "is_core")


@query(
    with_(BOOKS)
    + "select novel_id, nullif(trim(list_filter(list_transform(string_split(text, chr(10))[:50], lambda x: regexp_extract(x, 'anth[:\\s]*(.+)', 1)), lambda y: y <> '')[1]), '') as title, "
    + "nullif(trim(list_filter(list_transform(string_split(text, chr(10))[:50], lambda x: regexp_extract(x, '(?:keit|eau)[:\\s]*(.+)', 1)), lambda y: y <> '')[1]), '') as author from books"
)
def t5_extract_metadata(t: Tables) -> DataFrame:
    return T.extract_metadata(t.books.select("novel_id", "text"), {"title": "anth", "author": "keit|eau"}).select("novel_id", F.nullif("title", F.lit("")).alias("title"), F.nullif("author", F.lit("")).alias("author"))


PARSED = _SPLIT.replace("titled as (", "raw as (", 1).replace(",\ntl as (", f",\ntitled as (select novel_id, {_CLEAN} as text from raw),\ntl as (", 1)
_LABELS = {"title": "anth", "author": "keit|eau"}
PARSE = {"labels": _LABELS, "junk": [r"www\..+\.com", "tion"]}
_LABELLED = "".join(f", {strip(f"list_filter(list_transform(string_split(text, chr(10))[:50], lambda x: regexp_extract(x, '(?:{p})[:\\s]*(.+)', 1)), lambda y: y <> '')[1]")} as novel_{k}" for k, p in _LABELS.items())


#: Texts of the core chapters of parsed books.
CORE_TEXTS = (
    "pn as (select *, row_number() over (partition by novel_id order by chapter_number) - 1 as i, count(*) over (partition by novel_id) as c from split), "
    "books as (select novel_id, string_agg(content, chr(10) || chr(10) order by chapter_number) filter (c <= 20 or i < 10 or i >= c - 5 or (i - 10) % 10 = 0) as text from pn group by 1)"
)


@query(
    with_(PARSED)
    + f", info as (select novel_id{_LABELLED} from titled), n as (select *, row_number() over (partition by novel_id order by chapter_number) - 1 as i, count(*) over (partition by novel_id) as c from split) "
    + "select novel_id, chapter_number, title, cast(length(content) as int) as word_count, c <= 20 or i < 10 or i >= c - 5 or (i - 10) % 10 = 0 as is_core, cast(sum(length(content)) over (partition by novel_id) as bigint) as total_word_count, "
    + "md5(content) as chapter_hash, novel_title, novel_author from n join info using (novel_id)"
)
def t6_parse_book(t: Tables) -> DataFrame:
    rows = T.parse_book(titled(t), **PARSE)
    return rows.select("novel_id", "chapter_number", "title", "word_count", "is_core", "total_word_count", "chapter_hash", "novel_title", "novel_author")


@query(with_(_CORE) + "select novel_id, md5(string_agg(content, chr(10) || chr(10) order by chapter_number) filter (is_core)) as text_md5 from core group by novel_id")
def t7_core_text(t: Tables) -> DataFrame:
    return T.core_text(T.mark_core_chapters(merged(t))).select("novel_id", F.md5("text").alias("text_md5"))


@query(with_(_MERGED) + "select novel_id, md5(string_agg(content, chr(10) || chr(10) order by chapter_number)) as text_md5 from merged group by novel_id")
def t8_full_text(t: Tables) -> DataFrame:
    return T.full_text(merged(t)).select("novel_id", F.md5("text").alias("text_md5"))


@query(
    with_(_MERGED)
    + """, r as (select *, row_number() over (partition by novel_id order by chapter_number) - 1 as i, count(*) over (partition by novel_id) as n from merged),
    p as (select distinct novel_id, n, unnest([0, 1, 2, n // 4, n // 4 + 1, n // 4 + 2, n // 2, n // 2 + 1, n // 2 + 2, n * 3 // 4, n * 3 // 4 + 1, n * 3 // 4 + 2, n - 3, n - 2, n - 1]) as i, generate_subscripts([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14], 1) as k from r)
    select r.novel_id, r.chapter_number, cast(count(*) as bigint) as picked from p join r on p.novel_id = r.novel_id and r.i = case when p.i < 0 then p.i + p.n else p.i end where p.i < p.n and p.i >= -p.n group by 1, 2"""
)
def t9_select_sampling(t: Tables) -> DataFrame:
    return T.select_chapters(merged(t), "sampling").groupBy("novel_id", "chapter_number").agg(F.count("*").alias("picked"))


@query(with_(BOOKS) + f"select novel_id, cast(len(l) as int) as n, md5(array_to_string(l, '|')) as text_md5 from (select novel_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda x: {strip('x')}), lambda y: y <> '') as l from books)")
def t10_sentences(t: Tables) -> DataFrame:
    return t.books.select("novel_id", T.sentences("text", "[.!?;]").alias("l")).select("novel_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("text_md5"))


@query(with_(CHAPTERS) + "select novel_id, cast(count(*) as int) as n, md5(string_agg(content, '|' order by chapter_number)) as text_md5 from chapters group by novel_id")
def t11_paragraphs(t: Tables) -> DataFrame:
    return t.books.select("novel_id", T.paragraphs("text").alias("l")).where(F.size("l") > 0).select("novel_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("text_md5"))


_KEYS = ["tionth", "schund", "eauou", "ciónm"]


@query(with_(BOOKS) + f"select novel_id, keyword, {strip('substring(text, greatest(strpos(text, keyword) - 21, 0) + 1, strpos(text, keyword) - 1 + 30 - greatest(strpos(text, keyword) - 21, 0))')} as context from (select novel_id, text, {first_present('text', _KEYS)} as keyword from books) where keyword is not null")
def t12_context_window(t: Tables) -> DataFrame:
    rows = t.books.select("novel_id", "text", T.F.coalesce(*[F.when(F.contains("text", F.lit(k)), F.lit(k)) for k in _KEYS]).alias("keyword")).where("keyword is not null")
    return rows.select("novel_id", "keyword", T.context_window("text", F.col("keyword")).alias("context"))


@query(with_(BOOKS) + "select novel_id, cast((k - 1) // 1800 as int) as chunk, md5(substring(text, k, 2000)) as content_md5 from (select novel_id, text, unnest(range(1, length(text) + 1, 1800)) as k from books where length(text) > 0)")
def t13_chunk_text(t: Tables) -> DataFrame:
    return T.chunk_text(t.books).select("novel_id", "chunk", F.md5("content").alias("content_md5"))


@query(with_(CHAPTERS) + "select novel_id, chapter_number, md5(content) as chapter_hash from chapters")
def t14_content_hash(t: Tables) -> DataFrame:
    return t.chapters.select("novel_id", "chapter_number", T.content_hash("content").alias("chapter_hash"))


# --- rules

RULE_ROWS = [
    ("k_en", 0, "n_en", "f.lang", "keyword", LATIN["en"], None, "english", 0.9, True, None),
    ("k_de", 1, "n_de", "f.lang", "keyword", LATIN["de"], None, "german", 0.8, True, "de"),
    ("k_fr", 2, "n_fr", "f.lang", "keyword", LATIN["fr"], None, None, 0.9, True, "fr"),
    ("k_es", 3, "n_es", "f.lang", "keyword", LATIN["es"], None, "english", 0.5, True, None),
    ("x_th", 4, "many_th", "f.style", "regex", None, "TH[aei]n", None, 0.7, True, None),
    ("x_ou", 5, "many_ou", "f.style", "regex", None, "ou[ ,.]", "ou-ish", 0.7, True, "fr"),
    ("off", 6, "off", "f.lang", "keyword", ["e"], None, "never", 9.0, False, None),
]


#: The same rules for fields that features have.
FIELD_ROWS = [(*r[:3], {"f.lang": "background.world_type", "f.style": "task.task_structure"}[r[3]], *r[4:]) for r in RULE_ROWS]


def rule_table(t: Tables, rows: list[tuple] = RULE_ROWS) -> DataFrame:
    return t.spark.createDataFrame(rows, schemas.RULES)


def _rule_sql(rows: list[tuple] = RULE_ROWS) -> str:
    parts = []
    for rid, k, name, field, kind, words, pattern, value, weight, on, _ in rows:
        if not on or kind not in ("keyword", "regex"):
            continue
        score = f"{present('text', words)} / {len(words)}" if kind == "keyword" else f"least(len(regexp_extract_all(text, {s('(?i)' + pattern)})) / 10, 1.0)"
        val = s(value) if value else first_present("text", words) if kind == "keyword" else s(name)
        parts.append(f"select novel_id, {s(rid)} as rule_id, {k} as rule_ord, {s(field)} as target_field, {val} as value, cast({score} as double) as score, cast({weight} as double) as weight from books")
    return "rs as (select * from (" + " union all ".join(parts) + ") where score > 0)"


_RULES = with_(BOOKS, _rule_sql())
_BEST = "ap as (select novel_id, target_field, value, sum(score * weight) as score, min(rule_ord) as o from rs where value is not null group by 1, 2, 3), best as (select *, row_number() over (partition by novel_id, target_field order by round(score, 9) desc, o) as p from ap)"
_APPLY = _RULES[:-1] + f", {_BEST}\n"
#: Features that the rules give the texts of ``books``.
FOUND = (
    f"{_rule_sql(FIELD_ROWS)}, {_BEST}, fr as (select b.novel_id, max(value) filter (target_field = 'background.world_type' and p = 1) as world_type, max(value) filter (target_field = 'task.task_structure' and p = 1) as task_structure from books b left join best using (novel_id) group by 1), "
    "found as (select *, case when world_type is null and task_structure is null then 0.0e0 else (case when world_type is null then 0.0e0 else 0.9e0 end + case when task_structure is null then 0.0e0 else 0.8e0 end) / (cast(world_type is not null as int) + cast(task_structure is not null as int)) end as confidence_score from fr)"
)


@query(_RULES + "select novel_id, rule_id, score from rs where rule_id like 'k%'")
def r1_keyword_presence_ratio(t: Tables) -> DataFrame:
    return R.rule_scores(t.books, rule_table(t)).where(F.startswith("rule_id", F.lit("k"))).select("novel_id", "rule_id", "score")


@query(_RULES + "select novel_id, rule_id, score from rs where rule_id like 'x%'")
def r2_regex_rule_score(t: Tables) -> DataFrame:
    return R.rule_scores(t.books, rule_table(t)).where(F.startswith("rule_id", F.lit("x"))).select("novel_id", "rule_id", "score")


@query(with_(BOOKS) + f"select novel_id, {first_present('text', _KEYS)} as keyword from books")
def r4_first_matching_keyword(t: Tables) -> DataFrame:
    return t.books.select("novel_id", R.first_matching_keyword("text", F.array(*[F.lit(k) for k in _KEYS])).alias("keyword"))


@query(_APPLY + "select novel_id, target_field, value, score from best where p = 1")
def r5_apply_rules(t: Tables) -> DataFrame:
    return R.apply_rules(t.books, rule_table(t))


@query(_APPLY + "select b.novel_id, max(value) filter (target_field = 'f.lang' and p = 1) as f_lang, max(value) filter (target_field = 'f.style' and p = 1) as f_style from books b left join best using (novel_id) group by 1")
def r6_rule_features(t: Tables) -> DataFrame:
    return R.rule_features(t.books, rule_table(t), ["f.lang", "f.style"]).select("novel_id", "f_lang", "f_style")


_USER_ROWS = [
    ("u_keit", 100, "mine", "f.lang", "keyword", ["keit", "ung"], None, "mine", 2.0, True, None),
    ("u_case", 101, "case", "f.case", "regex", None, "[A-Z][a-z]+ion", "cased", 1.0, True, None),
    ("u_ml", 102, "ml", "f.case", "ml", None, None, "never", 9.0, True, None),
]


@query(with_(BOOKS, _rule_sql(RULE_ROWS + _USER_ROWS), _BEST) + "select novel_id, target_field, value, score from best where p = 1")
def u2_user_rules(t: Tables) -> DataFrame:
    """Rules of the caller beside the others; a rule of a kind that has no score never applies."""
    return R.apply_rules(t.books, rule_table(t).unionByName(rule_table(t, _USER_ROWS)))


@query(with_(BOOKS) + "select novel_id, case when a + b > 0 then (a * 0.8e0 + b * 0.9e0) / (a + b) else 0.0e0 end as confidence from (select novel_id, cast(contains(text, 'keit') as int) as a, cast(contains(text, 'eau') as int) as b from books)")
def r7_rule_confidence(t: Tables) -> DataFrame:
    has_ = lambda k: F.when(F.contains("text", F.lit(k)), F.lit("x"))
    return t.books.select("novel_id", R.rule_confidence({"task.task_structure": has_("keit"), "background.world_type": has_("eau")}).alias("confidence"))


_SETS = "sets as (select item_id as set_id, item_id % 3 > 0 as enabled, case item_id % 4 when 0 then null when 1 then 'en' when 2 then 'de' else 'fr' end as genre from benchmark)"


def _sets(t: Tables) -> DataFrame:
    k = F.col("item_id") % 4
    return t.read("benchmark").select(F.col("item_id").alias("set_id"), (F.col("item_id") % 3 > 0).alias("enabled"), F.when(k == 1, "en").when(k == 2, "de").when(k == 3, "fr").alias("genre"))


@query(with_(_SETS) + "select cast(count(*) as bigint) as total_rules, cast(count(*) filter (enabled) as bigint) as enabled_rules, array_to_string(list_sort(list_distinct(list(genre))), ',') as target_fields from sets")
def r9_rule_stats(t: Tables) -> DataFrame:
    return R.rule_stats(_sets(t).withColumnRenamed("genre", "target_field"))


@query(with_(_SETS, BOOKS) + "select b.genre, r.set_id, cast(count(*) as bigint) as novels from books b join sets r on r.enabled and (b.genre = r.genre or r.genre is null) group by 1, 2")
def r10_rulesets_for_genre(t: Tables) -> DataFrame:
    sets = _sets(t).where("enabled").withColumnRenamed("genre", "set_genre")
    genres = t.books.groupBy("genre").agg(F.count("*").alias("novels"))
    return genres.join(F.broadcast(sets), (F.col("genre") == F.col("set_genre")) | F.col("set_genre").isNull()).select("genre", "set_id", "novels")


_LONG = " union all ".join(f"select novel_id, {s(c)} as category, cast({total('text', k)} as bigint) as n, cast({present('text', k)} as int) as present from books" for c, k in LATIN.items())


@query(with_(BOOKS) + f"select novel_id, category, present from ({_LONG})")
def r11_lexicon_presence_count(t: Tables) -> DataFrame:
    return t.books.select("novel_id", F.inline(S.scores("text", LATIN, "presence"))).select("novel_id", "category", F.col("score").alias("present"))


@query(with_(BOOKS) + f"select novel_id, category, n from ({_LONG})")
def r12_lexicon_occurrence_count(t: Tables) -> DataFrame:
    return t.books.select("novel_id", F.inline(S.scores("text", LATIN))).select("novel_id", "category", F.col("score").cast("long").alias("n"))


@query(with_(BOOKS) + f"select novel_id, {top(LATIN, cols(LATIN))} as category from (select novel_id, {scored(LATIN)} from books)")
def r13_top_category(t: Tables) -> DataFrame:
    return t.books.select("novel_id", S.scores("text", LATIN).alias("f")).select("novel_id", S.top("f").alias("category"))


@query(with_(BOOKS) + f"select novel_id, category, case when sum(n) over (partition by novel_id) > 0 then n / sum(n) over (partition by novel_id) else 0.25e0 end as share from ({_LONG})")
def r14_category_share(t: Tables) -> DataFrame:
    return t.books.select("novel_id", S.scores("text", LATIN).alias("f")).select("novel_id", F.explode(S.shares("f")).alias("category", "share"))


@query(with_(BOOKS) + f"select novel_id, {case('genre', {'en': 'isles', 'de': 'forest'}, s('other'))} as label from books")
def r15_template_lookup(t: Tables) -> DataFrame:
    return t.books.select("novel_id", S.lookup(F.col("genre"), {"en": "isles", "de": "forest"}, "other").alias("label"))


@query(with_(BOOKS) + f"select novel_id, category, n, present from ({_LONG})")
def u3_user_lexicon(t: Tables) -> DataFrame:
    """A lexicon that is itself a table."""
    rows = [(c, i, w) for i, (c, ws) in enumerate(LATIN.items()) for w in ws]
    lexicon = t.spark.createDataFrame(rows, "category string, cat_ord int, keyword string")
    return R.lexicon_scores(t.books, lexicon).select("novel_id", "category", "n", F.col("present").cast("int").alias("present"))




#: A lexicon that grows with its table: all words of the benchmark, by their length.
_WORDS = "words as (select distinct w as keyword, cast(length(w) % 5 as int) as cat_ord from (select unnest(regexp_split_to_array(text, '\\s+')) as w from benchmark) where w <> '')"


def _words(t: Tables) -> DataFrame:
    words = t.read("benchmark").select(F.explode(F.split("text", r"\s+")).alias("keyword")).where("keyword != ''").distinct()
    order = (F.length("keyword") % 5).cast("int")
    return words.select("keyword", order.alias("cat_ord"), F.concat(F.lit("c"), order.cast("string")).alias("category"))


_COUNT = "(length(text) - length(replace(text, keyword, ''))) // length(keyword)"


@query(with_(BOOKS, _WORDS) + f"select novel_id, 'c' || cat_ord as category, cast(sum({_COUNT}) as bigint) as n, cast(count(*) filter (contains(text, keyword)) as bigint) as present from books cross join words group by 1, 2")
def u3_large_lexicon(t: Tables) -> DataFrame:
    """Scores by all words of the benchmark, found in one pass over each text."""
    return R.lexicon_scores(t.books, _words(t)).select("novel_id", "category", "n", "present")


@query(with_(BOOKS, _WORDS) + f"select keyword, cast(count(*) as bigint) as texts, cast(sum({_COUNT}) as bigint) as n from books cross join words where contains(text, keyword) group by 1")
def r12_keyword_hits(t: Tables) -> DataFrame:
    """In how many texts each word of the benchmark occurs, and how often."""
    return keyword_hits(t.books.select("novel_id", "text"), _words(t)).groupBy("keyword").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
