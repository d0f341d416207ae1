"""Queries of sources, tables, search, vectors and telemetry (S, Q, K, W, U)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as Q
from ..operators import telemetry as W
from ..operators import textindex
from ..operators import vectors as K
from ..operators import text as T
from ..operators.text import line_chapters
from ..sources import corpus
from ..sources import files as S
from ..sources import tables as X
from ..streaming import streams
from ..sources.buckets import BucketTable
from . import q_fusion  # noqa: F401  its reports are read here
from .q_text import PARSE, PARSED, titled
from .bindings import _FOUND, BOOKS, CHAPTERS, LATIN, Tables, cols, query, s, scored, strip, with_
from .bindings import top as sql_top

# --- sources and tables


def _sql_tag(name: str) -> str:
    return f"'(?is)<{name}\\b[^>]*>(.*?)</{name}\\s*>'"


_BARE = f"regexp_replace(regexp_replace(html, {_sql_tag('script')}, '', 'g'), {_sql_tag('style')}, '', 'g')"
_TITLE = "coalesce(" + ", ".join(f"nullif(regexp_extract(b, {_sql_tag(x)}, 1), '')" for x in ("h1", "h2", "h3", "title")) + ")"
_BODY = "coalesce(" + ", ".join(f"nullif(regexp_extract(b, {_sql_tag(x)}, 1), '')" for x in ("main", "article", "body")) + ")"
_TEXT = "regexp_replace(c, '(?is)<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, {s(_a)}, {s(_b)})"
for _p, _to in (("'(?i)本书由.+整理|VIP章节请订阅|正版订阅在阅文|起点中文网|QQ阅读|手机用户请到.+阅读|请记住本书首发域名|笔趣阁|小说网|www\\..+\\.com'", "''"), ("'\\r\\n'", "chr(10)"), ("'[ \\t]+'", "' '"), ("'\\n{3,}'", "chr(10) || chr(10)"), ("'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'", "''")):
    _TEXT = f"regexp_replace({_TEXT}, {_p}, {_to}, 'g')"


@query(f"select page_id, {strip('regexp_replace(t, ' + s('<[^>]+>') + ', ' + s('') + ', ' + s('g') + ')')} as title, md5(x) as content_md5, cast(length(x) as int) as n_chars from (select page_id, t, {strip(_TEXT)} as x from (select page_id, {_TITLE} as t, {_BODY} as c from (select page_id, {_BARE} as b from pages))) where length(x) > 100")
def s5_html_chapters(t: Tables) -> DataFrame:
    return S.html_chapters(t.read("pages")).select("page_id", "title", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


#: Four shapes of the same pages, by their ids: in each the text stands in another element, with elements of the same kind, comments and quoted tags inside.
_SHAPES = (
    ("<div title='a>b' class=\"old chapter\">", '<div class="ad">Read on</div><!-- </div> -->', "<div>the end<p>of it</div></div>"),
    ("<section CLASS='content x'>", "<section>Read on<section></section></section>", "<br/><div>left open</section>"),
    ("<div id=content>", '<div class="main"><div>Read on</div></div>', "<!-- <div> --><img alt='</div>'></div>"),
    ("<main>", "<main>Read on</main><article/>", "</main>"),
)


def _shaped(k: int) -> str:
    """The page in shape k: its article, if it has one, within other elements."""
    a, b, c = _SHAPES[k]
    return f"replace(replace(html, '<article>', {s(a + b)}), '</article>', {s(c)})"


_SHAPED = "case page_id % 4 " + " ".join(f"when {k} then {s(b)} || a || {s(c.removesuffix('</div>').removesuffix('</section>').removesuffix('</main>'))}" for k, (_, b, c) in enumerate(_SHAPES)) + " end"
# the parts of the shapes in which a tag or comment holds an angle bracket
_SHAPED = f"replace(replace({_SHAPED}, '<!-- </div> -->', '<!>'), {s('<!-- <div> --><img alt=' + chr(39) + '</div>' + chr(39) + '>')}, '<!><img>')"


@query(f"select page_id, md5(x) as content_md5, cast(length(x) as int) as n_chars from (select page_id, {strip(_TEXT)} as x from (select page_id, {_SHAPED} as c from (select page_id, regexp_extract(b, {_sql_tag('article')}, 1) as a from (select page_id, {_BARE} as b from pages)) where a <> '')) where length(x) > 100")
def s5_nested_elements(t: Tables) -> DataFrame:
    """Chapters from pages whose text stands in elements of a class or an id, with others of their kind inside."""
    shaped = F.expr("case page_id % 4 " + " ".join(f"when {k} then {_shaped(k)}" for k in range(4)).replace("''", "\\'") + " end")
    pages = t.read("pages").where("html like '%<article>_%</article>%'").select("page_id", shaped.alias("html"))
    return S.html_chapters(pages).select("page_id", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


_FEAT = "feat as (select doc_id as novel_id, lang as world_type, n_chars, cast(n_chars % 10 as double) / 10 as confidence_score, n_chars % 7 as version from documents)"


def _feat(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.read("documents").select(F.col("doc_id").alias("novel_id"), F.col("lang").alias("world_type"), "n_chars", ((n % 10).cast("double") / 10).alias("confidence_score"), (n % 7).alias("version"))


_UPS = "ups as (select novel_id // 2 * 2 as novel_id, 'new' || n_chars as world_type, n_chars, confidence_score, version from feat where n_chars % 3 = 0)"


def _ups(t: Tables) -> DataFrame:
    return _feat(t).where("n_chars % 3 = 0").withColumn("novel_id", (F.floor(F.col("novel_id") / 2) * 2).cast("long")).withColumn("world_type", F.concat(F.lit("new"), F.col("n_chars").cast("string")))


@query(with_(_FEAT, _UPS) + ", u as (select novel_id, max(version) as version from ups group by 1) select novel_id, version from feat where novel_id not in (select novel_id from ups) and novel_id % 7 > 0 union all select novel_id, version from u where novel_id % 7 > 0")
def s6_bucket_upsert(t: Tables) -> DataFrame:
    """The upsert and a delete on a table in buckets; the updates come as a numbered batch that runs twice."""
    rows = _feat(t)
    table = BucketTable(t.spark, X.scratch(t.spark, "features"), rows.schema, ["novel_id"])
    table.upsert(rows, batch=0)
    for _ in range(2):
        table.upsert(_ups(t), "version", batch=1)
    table.delete(rows.select("novel_id").union(_ups(t).select("novel_id")).where("novel_id % 7 = 0"), batch=2)
    return table.read().select("novel_id", "version")


@query(with_(_FEAT, _UPS) + ", u as (select novel_id, max(version) as version from ups group by 1) select novel_id, version from feat where novel_id not in (select novel_id from ups) union all select novel_id, version from u")
def s6_upsert_features(t: Tables) -> DataFrame:
    return X.upsert(_feat(t), _ups(t), ["novel_id"], "version").select("novel_id", "version")


@query(with_(CHAPTERS) + "select novel_id, chapter_number, md5(content) as chapter_hash from chapters")
def s7_append_chapters(t: Tables) -> DataFrame:
    return X.append_chapters(t.chapters).select("novel_id", "chapter_number", "chapter_hash")


@query(with_(CHAPTERS) + ", n as (select novel_id, chapter_number, md5(case when chapter_number % 2 = 0 and novel_id % 2 = 0 then content || '!' else content end) as chapter_hash from chapters) select * from n")
def s8_update_chapter(t: Tables) -> DataFrame:
    new = t.chapters.where("chapter_number % 2 = 0 and novel_id % 2 = 0").withColumn("content", F.concat("content", F.lit("!")))
    return X.upsert(t.chapters, new, ["novel_id", "chapter_number"]).select("novel_id", "chapter_number", F.md5("content").alias("chapter_hash"))


@query(with_(_FEAT) + "select novel_id, case when n_chars % 3 = 0 then 1.0e0 else confidence_score end as confidence_score from feat")
def s9_upsert_deep_features(t: Tables) -> DataFrame:
    rows = _feat(t)
    return X.upsert(rows, rows.where("n_chars % 3 = 0").withColumn("confidence_score", F.lit(1.0)), ["novel_id"]).select("novel_id", "confidence_score")


_LABELS = "select doc_id from labels where quality = 1"


@query("select item_id as benchmark_id, coalesce(case when item_id % 2 = 0 then item_id * 10.0e0 end, -1.0e0) as reads, true as is_active from benchmark")
def s10_add_benchmark(t: Tables) -> DataFrame:
    rows = t.read("benchmark").select(F.col("item_id").alias("benchmark_id"), F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("read_count"), F.col("item_id") * 10.0)).alias("market_data"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("boolean").alias("is_active"))
    out = X.add_benchmark(rows.where("benchmark_id < 20").withColumn("is_active", F.lit(False)), rows)
    return out.select("benchmark_id", F.coalesce(F.element_at("market_data", F.lit("read_count")), F.lit(-1.0)).alias("reads"), "is_active")


@query(with_(_FEAT) + "select f.novel_id, coalesce(case when l.quality = 1 then 'good' end, f.world_type) as world_type, coalesce(l.quality = 1 and f.world_type <> 'good', false) as changed from feat f left join labels l on l.doc_id = f.novel_id")
def s11_update_custom_fields(t: Tables) -> DataFrame:
    ups = t.read("labels").select(F.col("doc_id").alias("novel_id"), F.when(F.col("quality") == 1, "good").alias("world_type"))
    return X.update_columns(_feat(t), ups, "novel_id", ["world_type"]).select("novel_id", "world_type", "changed")


@query(with_(_FEAT, CHAPTERS) + f"select 'features' as tab, count(*) as n from feat where novel_id not in ({_LABELS}) union all select 'chapters', count(*) from chapters where novel_id not in ({_LABELS})")
def s12_delete_by_key(t: Tables) -> DataFrame:
    gone = t.read("labels").where("quality = 1").select(F.col("doc_id").alias("novel_id"))
    left = X.delete_by_key({"features": _feat(t), "chapters": t.chapters}, gone, "novel_id")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("tab"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1])


_UNIT = "unit as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double))))) as v from embeddings)"


@query(with_(_UNIT) + "select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 9) as norm, round(v[1], 9) as first from unit")
def s13_insert_vectors(t: Tables) -> DataFrame:
    rows = X.insert_vectors(t.read("embeddings"), "embedding")
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm"), F.round(F.get("embedding", F.lit(0)), 9).alias("first"))


@query("select doc_id, sha256(doc_id || chr(31) || source) as id from documents")
def s14_create_catalog_row(t: Tables) -> DataFrame:
    return X.create_rows(t.read("documents"), ["doc_id", "source"]).select("doc_id", "id")


@query("select o_orderkey, o_custkey, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as int) as age from orders")
def s15_relational_scan(t: Tables) -> DataFrame:
    """The tables stand in for a database: a scan of two columns and one computed, over all rows."""
    return S.relational(t.read("orders"), ["o_orderkey", "o_custkey", "datediff(o_orderdate, date'1990-01-01') as age"])


def _as_files(t: Tables, *by: str) -> str:
    """The documents as text files, a line end after each."""
    path = X.scratch(t.spark, "texts")
    t.read("documents").select(F.coalesce("text", F.lit("")).alias("value"), *by).write.partitionBy(*by).text(path)
    return path


@query("select source, cast(sum(length(coalesce(text, '')) + 1) as bigint) as n_chars from documents group by 1")
def s1_read_text_corpus(t: Tables) -> DataFrame:
    files = S.read_text_corpus(t.spark, _as_files(t, "source"))
    return files.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), F.length("text").alias("n")).groupBy("source").agg(F.sum("n").alias("n_chars"))


@query("select 'txt' as extension, cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as size, true as titled from documents")
def s2_read_directory(t: Tables) -> DataFrame:
    files = S.read_directory(t.spark, _as_files(t))
    return files.groupBy("extension").agg(F.sum("size").alias("size"), F.bool_and(F.startswith("title", F.lit("part-"))).alias("titled"))


@query("select source, cast(count(*) > 0 as int) as titled, cast(sum(length(coalesce(text, '')) + 1) as bigint) as n_chars from documents group by 1")
def u4_data_source(t: Tables) -> DataFrame:
    """The documents as text files, read through the ``corpus`` data source."""
    corpus.register(t.spark)
    files = t.spark.read.format("corpus").option("path", _as_files(t, "source")).load()
    by = files.groupBy(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"))
    return by.agg(F.bool_and(F.startswith("title", F.lit("part-"))).cast("int").alias("titled"), F.sum(F.length("text")).alias("n_chars"))


@query("select doc_id as novel_id, coalesce(text, '') as content from documents")
def u4_user_source(t: Tables) -> DataFrame:
    S.register_source("table", lambda spark, path: spark.read.parquet(path).select(F.col("doc_id").alias("novel_id"), F.coalesce("text", F.lit("")).alias("content")))
    return S.source("Table")(t.spark, f"{t.folder}/documents.parquet")


@query("select doc_id, md5(text) as file_hash, cast(strlen(text) as int) as file_size, case when strlen(text) > 4000 then 'too large' when strlen(text) = 0 then 'empty' end as reject_reason from documents")
def s4_catalog_files(t: Tables) -> DataFrame:
    rows = t.read("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("txt").alias("extension"))
    return S.catalog_files(rows, 4000).select("doc_id", "file_hash", "file_size", "reject_reason")


def _as_gb18030(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of odd length as GB18030, the others as UTF-8."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        data = [None if x is None else x.encode("gb18030" if len(x) % 2 else "utf-8") for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "content"])


@query("select doc_id, md5(text) as text_md5, case when text is null then null when length(text) % 2 = 0 or regexp_full_match(text, '[\\x00-\\x7f]*') then 'utf-8' else 'gb18030' end as encoding, case when text is null then 'no known encoding fits' end as error from documents")
def s3_decode_charset(t: Tables) -> DataFrame:
    rows = t.read("documents").select("doc_id", "text").mapInArrow(_as_gb18030, "doc_id long, content binary")
    return S.decode_charset(rows).select("doc_id", F.md5("text").alias("text_md5"), "encoding", "error")


#: Signs in common use, one for each letter: from invented Latin words they make texts that need these character sets.
_LETTERS = "abcdefghijklmnopqrstuvwxyz,."
_SIGNS = (("gb18030", "的一是不了在人有我他这个们中来上大为和国地到以说时要，。"), ("big5", "的一是不了在人有我他這個們中來上大為和國地到以說時要，。"), ("shift_jis", "のはにをたがでてとしれさある人日本大国年中見行出間学、。"))
_ASCII = "regexp_replace(lower(text), '[^a-z,.]', '', 'g')"
_SHOWN = "case doc_id % 5 " + " ".join(f"when {k} then translate({_ASCII}, {s(_LETTERS)}, {s(signs)})" for k, (_, signs) in enumerate(_SIGNS)) + " when 3 then regexp_replace(text, '[^\\x01-\\xff]', '', 'g') else replace(text, chr(0), '') end"


def _in_charsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in five character sets, by their ids."""
    names = [n for n, _ in _SIGNS] + ["latin-1", "utf-16-le"]
    for batch in batches:
        data = [None if x is None else x.encode(names[k]) for k, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "content"])


@query(f"select doc_id, md5(x) as text_md5, case when regexp_full_match(x, '[\\x00-\\x7f]*') and (k < 4 or x = '') then 'utf-8' else case k when 0 then 'gb18030' when 1 then 'big5' when 2 then 'shift_jis' when 3 then 'latin-1' else 'utf-16-le' end end as encoding from (select doc_id, doc_id % 5 as k, {_SHOWN} as x from documents where text is not null)")
def s3_charsets(t: Tables) -> DataFrame:
    """Whole texts in five character sets, told apart by their bytes alone."""
    plain = F.regexp_replace(F.lower("text"), "[^a-z,.]", "")
    k = F.col("doc_id") % 5
    shown = F.when(k == 3, F.regexp_replace("text", r"[^\x01-\xff]", "")).otherwise(F.replace("text", F.lit("\0"), F.lit("")))
    for n, (_, signs) in enumerate(_SIGNS):
        shown = F.when(k == n, F.translate(plain, _LETTERS, signs)).otherwise(shown)
    rows = t.read("documents").where("text is not null").select("doc_id", k.cast("int").alias("k"), shown.alias("x"))
    return S.decode_charset(rows.mapInArrow(_in_charsets, "doc_id long, content binary")).select("doc_id", F.md5("text").alias("text_md5"), "encoding")


# --- search


@query(with_(_FEAT) + "select novel_id, confidence_score, (select count(*) from feat where world_type = 'en' and confidence_score >= 0.3e0) as total from feat where world_type = 'en' and confidence_score >= 0.3e0 order by n_chars desc, novel_id limit 20 offset 10")
def q1_search_features(t: Tables) -> DataFrame:
    page, n = Q.search_features(_feat(t), {"world_type": "en"}, 0.3, "n_chars", skip=10)
    return page.select("novel_id", "confidence_score").crossJoin(F.broadcast(n))


@query(with_(BOOKS) + "select novel_id, cast(contains(lower(text), 'thing') as int) + cast(contains(lower(text), 'eaux') as int) as matched from books where contains(lower(text), 'thing') or contains(lower(text), 'eaux')")
def q2_text_search(t: Tables) -> DataFrame:
    return Q.text_search(t.books, "Thing eaux").select("novel_id", "matched")


_WORDS = "w as (select novel_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from books), p as (select novel_id, len(ws) as size, unnest(ws) as term from w), tf as (select novel_id, term, size, count(*) as tf from p where term in ('the', 'que', 'and') group by all), df as (select term, count(*) as df from tf group by 1), tot as (select count(*) as n, avg(len(ws)) as mean from w)"


@query(
    with_(BOOKS, _WORDS)
    + "select tf.novel_id, count(*) as matched, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * size / mean))), 6) as score, count(*) = 3 as in_all, coalesce(bool_or(contains(' ' || array_to_string(ws, ' ') || ' ', ' and the ')), false) as in_phrase from tf join df using (term) join w using (novel_id), tot group by 1"
)
def q2_text_index(t: Tables) -> DataFrame:
    """Searches by an index that is written first: any, all, and a phrase of words."""
    path = X.scratch(t.spark, "index")
    textindex.build(t.books, path)
    any_ = textindex.search(t.spark, path, "The que AND")
    told = any_.join(textindex.search(t.spark, path, "the que and", "all").select("novel_id", F.lit(True).alias("in_all")).hint("merge"), "novel_id", "left")
    told = told.join(textindex.search(t.spark, path, "and the", "phrase").select("novel_id", F.lit(True).alias("in_phrase")).hint("merge"), "novel_id", "left")
    return told.select("novel_id", "matched", F.round("score", 6).alias("score"), F.coalesce("in_all", F.lit(False)).alias("in_all"), F.coalesce("in_phrase", F.lit(False)).alias("in_phrase"))


@query(with_(_FEAT) + "select novel_id, cast(place as int) as place, other_id from (select a.novel_id, b.novel_id as other_id, row_number() over (partition by a.novel_id order by b.confidence_score desc, b.novel_id) as place from feat a join feat b on (a.world_type is null or a.world_type = b.world_type) and (a.version is null or a.version = b.version) and a.novel_id <> b.novel_id and b.confidence_score >= 0.6e0) where place <= 5")
def q3_similar_by_features(t: Tables) -> DataFrame:
    return Q.similar_by_features(_feat(t), ["world_type", "version"], limit=5)  # a missing field is no filter


@query("select 'lang' as dimension, lang as value, count(*) as n from documents where lang is not null group by 2 union all select 'source', source, count(*) from documents where source is not null group by 2")
def q4_feature_stats(t: Tables) -> DataFrame:
    return Q.feature_stats(t.read("documents"), ["lang", "source"])


@query("select count(*) as total, count(*) filter (ts >= timestamp '2024-01-20') as today, round(avg(value), 6) as mean_confidence from events")
def q5_dashboard(t: Tables) -> DataFrame:
    return Q.dashboard(t.read("events"), F.lit("2024-01-20 13:00:00").cast("timestamp"), "ts", "value").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P' order by o_orderkey limit 50 offset 20")
def q6_list_all(t: Tables) -> DataFrame:
    return Q.list_all(t.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", 20, 50, o_orderstatus="P", o_orderpriority=None).select("o_orderkey", "o_orderstatus")


@query(with_(CHAPTERS) + f"select novel_id, chapter_number from chapters where novel_id in ({_LABELS})")
def q7_get_by_key(t: Tables) -> DataFrame:
    return Q.get_by_key(t.chapters, "novel_id", t.read("labels").where("quality = 1").select(F.col("doc_id").alias("novel_id"))).select("novel_id", "chapter_number")


@query("select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey = o_custkey")
def q8_novel_with_features(t: Tables) -> DataFrame:
    c, o = t.read("customer").select("c_custkey", "c_name"), t.read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return Q.with_features(c, o, "c_custkey")


_TASKS = "tasks as (select o_orderkey as task_id, case o_orderstatus when 'P' then 'pending' when 'F' then 'completed' else 'running' end as status, 6 - cast(o_orderpriority[1] as int) as priority, o_orderdate as created_at, cast(o_totalprice as double) as duration_seconds from orders)"


def _tasks(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    return t.read("orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), (6 - F.substr(F.col("o_orderpriority"), F.lit(1), F.lit(1)).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("double").alias("duration_seconds"))


@query(with_(_TASKS) + "select task_id, priority from tasks where status = 'pending' order by priority desc, created_at, task_id limit 10")
def q9_pending_tasks(t: Tables) -> DataFrame:
    return Q.pending_tasks(_tasks(t)).select("task_id", "priority")


@query(with_(_TASKS) + "select status, count(*) as kept from tasks where not (created_at < timestamp '1996-01-01' and status in ('completed', 'failed', 'cancelled')) group by 1")
def q10_expired_tasks(t: Tables) -> DataFrame:
    kept, _ = Q.split_expired(_tasks(t), F.lit("1996-01-01").cast("timestamp"))
    return kept.groupBy("status").agg(F.count("*").alias("kept"))


_LOG = "log as (select user_id as task_id, ts, event_id as seq, event_type as status, value as progress, event_type as stage from events)"


def _log(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.col("event_type").alias("stage"))


@query(with_(_LOG) + ", r as (select *, row_number() over (partition by task_id order by ts desc, seq desc) as p from log) select r.task_id, r.status, r.progress, q.n_updates, q.seconds from r join (select task_id, count(*) as n_updates, cast(floor(epoch(max(ts) filter (status = 'purchase'))) as bigint) as seconds from log group by 1) q on q.task_id = r.task_id where p = 1")
def q11_status_transitions(t: Tables) -> DataFrame:
    return Q.status_transitions(_log(t), "signup", "purchase").select("task_id", "status", "progress", "n_updates", F.unix_seconds("completed_at").alias("seconds"))


@query(with_(_LOG) + ", r as (select *, cast(floor(epoch(lead(ts) over (partition by task_id order by ts, seq))) - floor(epoch(ts)) as bigint) as secs, row_number() over (partition by task_id, stage order by ts desc, seq desc) as p from log) select task_id, stage, max(progress) filter (p = 1) as progress, cast(sum(coalesce(secs, 0)) as bigint) as seconds from r group by 1, 2")
def q12_task_progress_log(t: Tables) -> DataFrame:
    return Q.stage_progress(_log(t))


_REPORTS = {name: _FOUND[name] for name in ("f14_formulas", "f15_creative_report", "f16_comparison_report")}


@query("select novel_id, formula, summary, report, report_md5 from " + " join ".join(f"({sql}) {name}" + (" using (novel_id)" if k else "") for k, (name, (_, sql)) in enumerate(_REPORTS.items())) + f" where novel_id in ({_LABELS})")
def q13_deep_reports(t: Tables) -> DataFrame:
    """The reports of the novels that are asked for: those labelled good."""
    wanted = t.read("labels").where("quality = 1").select(F.col("doc_id").alias("novel_id"))
    first, *rest = (Q.get_by_key(f(t), "novel_id", wanted) for f, _ in _REPORTS.values())
    return reduce(lambda a, b: a.join(b, "novel_id"), rest, first)


@query(with_(_LOG) + ", r as (select *, row_number() over (partition by task_id order by ts desc, seq desc) as p from log) select task_id, status, stage as current_stage from r where p = 1")
def q14_task_status(t: Tables) -> DataFrame:
    return Q.status_transitions(_log(t)).select("task_id", "status", "current_stage")


# --- vectors


@query(with_(BOOKS) + "select novel_id, cast(part as int) as part, text from (select novel_id, 0 as part, genre || ': d o p' as text from books union all select novel_id, 1, source || ' g a b' from books union all select novel_id, 2, genre || ' i f' from books union all select novel_id, 3, '节奏0.5 短句0.3' from books)")
def k1_feature_texts(t: Tables) -> DataFrame:
    fixed = {"desire": "d", "obstacle": "o", "path": "p", "growth_type": "g", "initial_state": "i", "final_state": "f"}
    rows = t.books.select("novel_id", F.col("genre").alias("formula_name"), F.col("source").alias("gf_type"), F.col("genre").alias("arc_type"), F.array(F.lit("a"), F.lit("b")).alias("constraint_types"), F.lit(0.5).alias("rhythm_score"), F.lit(0.3).alias("short_ratio"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return K.feature_texts(rows)


@query(
    with_(BOOKS)
    + "select novel_id, cast(h % 64 as int) as slot, round(n / sqrt(sum(n * n) over (partition by novel_id)), 4) as value from (select novel_id, h % 64 as h, cast(sum(case when (h >> 16) & 1 = 1 then 1 else -1 end) as double) as n "
    + "from (select novel_id, cast('0x' || md5(w)[1:8] as bigint) as h from (select novel_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from books)) group by 1, 2) where n <> 0"
)
def k2_embed(t: Tables) -> DataFrame:
    rows = K.embed(t.books.select("novel_id", "text"))
    return rows.select("novel_id", F.posexplode("vector").alias("slot", "value")).where("value != 0").withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(with_(_UNIT) + "select vec_id, round(list_sum(v), 9) as total from unit")
def k3_l2_normalize(t: Tables) -> DataFrame:
    return t.read("embeddings").select("vec_id", F.round(F.aggregate(K.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("select label, cast(pos as int) as pos, round(avg(cast(x as double)), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2")
def k4_mean_vector(t: Tables) -> DataFrame:
    return K.mean_vector(t.read("embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


def _knn_sql(where: str = "true", k: int = 10) -> str:
    return with_(_UNIT) + f"select query_id, cast(place as int) as place, vec_id, round(score, 6) as score from (select q.vec_id as query_id, u.vec_id, list_inner_product(q.v, u.v) as score, row_number() over (partition by q.vec_id order by list_inner_product(q.v, u.v) desc, u.vec_id) as place from unit q join unit u on q.vec_id <> u.vec_id and {where} where q.vec_id % 50 = 0) where place <= {k}"


def _asked(t: Tables) -> DataFrame:
    return t.read("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_knn_sql())
def k5_knn_exact(t: Tables) -> DataFrame:
    return K.search(t.read("embeddings"), _asked(t)).withColumn("score", F.round("score", 6))


@query(_knn_sql("u.label = 3", 5))
def k6_knn_filtered(t: Tables) -> DataFrame:
    return K.search(t.read("embeddings"), _asked(t), k=5, where=F.col("label") == 3).withColumn("score", F.round("score", 6))


@query(_knn_sql("u.label < 5", 3))
def u5_user_vector_index(t: Tables) -> DataFrame:
    K.register_index("low_labels", lambda rows, queries, **options: K.knn_exact(rows.where("label < 5"), queries, **options))
    return K.search(t.read("embeddings"), _asked(t), "low_labels", k=3).withColumn("score", F.round("score", 6))


@query()
def k7_knn_approx(t: Tables) -> DataFrame:
    return K.search(t.read("embeddings"), _asked(t), "ivf").withColumn("score", F.round("score", 6))


@query()
def k7_knn_graph(t: Tables) -> DataFrame:
    return K.search(t.read("embeddings"), _asked(t), "graph").withColumn("score", F.round("score", 6))


@query()
def k7_knn_lsh(t: Tables) -> DataFrame:
    return K.search(t.read("embeddings"), _asked(t), "lsh").withColumn("score", F.round("score", 6))


@query(
    "with e as (select vec_id // 4 as novel_id, embedding from embeddings), m as (select novel_id, list(x order by pos) as v from (select novel_id, pos, avg(x) as x from (select novel_id, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as pos from e) group by 1, 2) group by 1), "
    "q as (select novel_id as query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from m where novel_id % 25 = 0), u as (select vec_id // 4 as novel_id, v from unit), "
    "b as (select query_id, novel_id, max(list_inner_product(q.v, u.v)) as score from q join u on query_id <> novel_id group by 1, 2) "
    "select query_id, cast(place as int) as place, novel_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, novel_id) as place from b) where place <= 5".replace("with e as", _UNIT.join(("with ", ", e as")))
)
def k8_similar_novels(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("novel_id"), F.col("embedding").alias("vector"))
    asked = rows.where("novel_id % 25 = 0").select(F.col("novel_id").alias("query_id")).distinct()
    return K.similar_novels(rows, asked).withColumn("score", F.round("score", 6))


@query("select vec_id, label from embeddings where label not in (2, 5)")
def k9_delete_vectors(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select("vec_id", "label")
    return K.delete_vectors(rows, rows.where("label in (2, 5)"))


# --- telemetry


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def w1_counter_totals(t: Tables) -> DataFrame:
    return W.counter_totals(t.read("events"), ["event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select window_start, event_type, cast(sum(n) over (partition by event_type order by window_start) as bigint) as so_far from (select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2)")
def w1_running_total(t: Tables) -> DataFrame:
    return W.running_total(t.read("events"), ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0]


@query("select event_type, le, n, total_n from (" + " union all ".join(f"select event_type, '{b}' as le, count(*) filter (value <= {b}) as n, count(*) as total_n from events group by 1" for b in _BOUNDS) + " union all select event_type, '+Inf', count(*), count(*) from events group by 1)")
def w2_histogram_buckets(t: Tables) -> DataFrame:
    return W.histogram_buckets(t.read("events"), _BOUNDS, ["event_type"]).select("event_type", "le", "n", "total_n")


@query("select event_id, cast(sum(case when event_type in ('click', 'view') then 1 else -1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as running from events")
def w3_in_progress_gauge(t: Tables) -> DataFrame:
    rows = t.read("events").withColumn("change", F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1))
    return W.in_progress_gauge(rows, "user_id").select("event_id", "running")


@query("select event_type, count(*) as n, cast(sum(d) as bigint) as seconds, max(d) as longest from (select event_type, cast(floor(epoch(lead(ts) over (partition by user_id order by ts, event_id))) - floor(epoch(ts)) as bigint) as d from events) where d is not null group by 1")
def w4_duration_by_stage(t: Tables) -> DataFrame:
    return W.duration_by_stage(t.read("events"), "user_id", "event_type")


_RATE = "select date_trunc('hour', ts) as window_start, count(*) as n, count(*) filter (event_type = '{}') as hits, count(*) filter (event_type = '{}') / count(*) as share from events where event_type in ('click', 'error', 'view') group by 1"


@query(_RATE.format("view", "view"))
def w5_hit_ratio(t: Tables) -> DataFrame:
    out = W.share_by_window(t.read("events"), F.col("event_type") == "view", F.col("event_type").isin("click", "error", "view"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "with recursive o as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as r from events), "
    "f as (select user_id, ts, r, ts as last, true as go from o where r = 1 union all select o.user_id, o.ts, o.r, case when o.ts - f.last >= interval 21600 second then o.ts else f.last end, o.ts - f.last >= interval 21600 second from f join o on o.user_id = f.user_id and o.r = f.r + 1) "
    "select user_id, ts from f where go"
)
def w6_alert_cooldown(t: Tables) -> DataFrame:
    return W.alert_cooldown(t.read("events"), "user_id", seconds=21_600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"select * from ({_RATE.format('error', 'error')}) where share > 0.2")
def w7_failure_rate_alert(t: Tables) -> DataFrame:
    out = W.failure_rate_alert(t.read("events"), F.col("event_type") == "error", F.col("event_type").isin("click", "error", "view"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _live(t: Tables) -> DataFrame:
    """The events as a stream."""
    kind = t.read("events").schema
    rows = t.spark.readStream.schema(kind).parquet(f"{t.folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def w1_stream_counter_totals(t: Tables) -> DataFrame:
    out = streams.drained(streams.counter_totals(_live(t), ["event_type"], late="400 days"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select date_trunc('hour', ts) as window_start, count(*) as n, count(*) filter (event_type = 'error') as hits from events where event_type in ('click', 'error', 'view') group by 1")
def w7_stream_failure_rates(t: Tables) -> DataFrame:
    out = streams.drained(streams.failure_rates(_live(t), F.col("event_type") == "error", F.col("event_type").isin("click", "error", "view"), late="400 days"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "hits")


@query("select user_id, session_start, count(*) as calls from (select user_id, min(ts) over (partition by user_id, k) as session_start from (select *, sum(new) over (partition by user_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 21600 second then 0 else 1 end as new from events))) group by 1, 2")
def w9_stream_sessions(t: Tables) -> DataFrame:
    out = streams.drained(streams.sessions(_live(t), "user_id", "21600 seconds", late="400 days"), "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "calls")


def _live_chapters(t: Tables) -> DataFrame:
    kind = t.read("documents").schema
    rows = t.spark.readStream.schema(kind).parquet(f"{t.folder}/documents.parquet*")
    return rows.select(F.col("doc_id").alias("novel_id"), "text")


@query(with_(CHAPTERS) + "select novel_id, cast(count(*) as bigint) as chapters from chapters group by 1")
def w11_stream_ingest(t: Tables) -> DataFrame:
    return streams.drained(line_chapters(_live_chapters(t))).groupBy("novel_id").agg(F.count("*").alias("chapters"))


@query(with_(PARSED) + "select novel_id, chapter_number, md5(content) as chapter_hash from split")
def w11_stream_books(t: Tables) -> DataFrame:
    """The books as a stream, parsed as they come; their chapters are kept in a table in buckets, each micro-batch once."""
    live = Tables(t.spark, t.folder)
    live.books = _live_chapters(t)
    schema = T.parse_book(titled(t), **PARSE).schema
    chapters = BucketTable(t.spark, X.scratch(t.spark, "chapters"), schema, ["novel_id"])
    streams.parsed_books(titled(live), chapters, X.scratch(t.spark, "state"), **PARSE).awaitTermination()
    return chapters.read().select("novel_id", "chapter_number", "chapter_hash")


@query(
    "with a as (select event_id, user_id, ts from events where event_type = 'view'), b as (select user_id, ts from events where event_type = 'purchase'), w as (select least((select max(ts) from a), (select max(ts) from b)) - interval 3600 second as mark), "
    "j as (select a.user_id, a.event_id, a.ts as started, b.ts as ended from a left join b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 86400 second) select j.* from j, w where ended is not null or started + interval 86400 second < mark"
)
def w4_stream_durations(t: Tables) -> DataFrame:
    """Views and the purchases that follow them within a day, as two streams; views without one once no purchase can come."""
    live = _live(t)
    keys = live.where("event_type = 'view'"), live.where("event_type = 'purchase'")
    out = streams.drained(streams.durations(*keys, ["user_id"], "86400 seconds", "3600 seconds", also=["event_id"]))
    return out.select("user_id", "event_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")])


@query(_FOUND["w6_alert_cooldown"][1])
def w6_stream_cooldown(t: Tables) -> DataFrame:
    out = streams.drained(streams.alert_cooldown(_live(t), "user_id", 21_600, late="400 days"))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(with_(_LOG) + ", r as (select *, row_number() over (partition by task_id order by ts desc, seq desc) as p, count(*) over (partition by task_id) as n_updates, (select max(ts) from log) as latest from log) select task_id, status, progress, n_updates, ts + interval 86400 second < latest - interval 3600 second as ended from r where p = 1")
def q11_stream_task_states(t: Tables) -> DataFrame:
    """The latest state of each task from its log as a stream; one of which nothing was heard for a day has ended."""
    key, conf = "spark.sql.streaming.stateStore.providerClass", t.spark.conf
    was = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = _live(t).select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
        out = streams.drained(streams.task_states(live, silence=86_400))
    finally:
        conf.set(key, was) if was else conf.unset(key)
    by = out.groupBy("task_id").agg(F.max("status").alias("status"), F.max("progress").alias("progress"), F.max("n_updates").alias("n_updates"), F.bool_or("ended").alias("ended"))
    return by.select("task_id", "status", "progress", "n_updates", "ended")


@query("select md5(text) as chapter_hash from documents group by 1")
def w12_stream_new_chapters(t: Tables) -> DataFrame:
    rows = _live_chapters(t).select(F.md5("text").alias("chapter_hash"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return streams.drained(streams.new_chapters(rows)).select("chapter_hash")


@query("select date_trunc('day', ts) as window_start, count(*) as n, count(*) filter (event_type <> 'error') as hits, count(*) filter (event_type <> 'error') / count(*) >= 0.8e0 as healthy from events group by 1")
def w8_model_health(t: Tables) -> DataFrame:
    rows = W.model_health(t.read("events"), F.col("event_type") != "error", width="1 day")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "hits", "healthy")


@query(with_(_TASKS) + "select count(*) filter (status = 'pending') as pending, cast(ceil(count(*) filter (status = 'pending') / 10) as bigint) as workers from tasks")
def w8_queue_backlog(t: Tables) -> DataFrame:
    return W.queue_backlog(_tasks(t))


@query("select event_id, cast(row_number() over (partition by user_id, k order by ts, event_id) as int) as calls, row_number() over (partition by user_id, k order by ts, event_id) > 3 as limited from (select *, sum(new) over (partition by user_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 21600 second then 0 else 1 end as new from events))")
def w9_rate_limit_count(t: Tables) -> DataFrame:
    return W.rate_limit_count(t.read("events"), "user_id", silence=21_600, limit=3).select("event_id", "calls", "limited")


@query("select event_type, cast(sum(event_id % 5) as bigint) as total from events group by 1")
def w10_named_counters(t: Tables) -> DataFrame:
    return W.named_counters(t.read("events"), "event_type", F.col("event_id") % 5)


@query("select event_type, cast(user_id % 3 as bigint) as status, count(*) as n, count(*) filter (value <= 10.0) as le_10_0, count(*) filter (value <= 50.0) as le_50_0 from events group by 1, 2")
def w13_http_request_stats(t: Tables) -> DataFrame:
    rows = t.read("events").withColumn("status", (F.col("user_id") % 3).cast("long"))
    return W.request_stats(rows, "event_type", "status", "value", [10.0, 50.0]).drop("total")


@query(with_(_TASKS) + "select (select count(*) from customer) as novels, count(*) as tasks, avg(cast(status = 'completed' as int)) as success_rate, round(avg(duration_seconds), 4) as mean_seconds from tasks")
def w14_system_stats(t: Tables) -> DataFrame:
    return W.system_stats(t.read("customer"), _tasks(t)).withColumn("mean_seconds", F.round("mean_seconds", 4))


@query(with_(BOOKS) + f"select category, count(*) as n from (select {sql_top(LATIN, cols(LATIN))} as category from (select {scored(LATIN)} from books)) group by 1")
def u1_user_function(t: Tables) -> DataFrame:
    """A caller's function over texts, by the same path as a model."""
    from ..operators.model import apply_model

    def guess(text: str) -> str:
        return max(LATIN, key=lambda c: sum(text.count(k) for k in LATIN[c]))

    return apply_model(t.books.select("novel_id", F.col("text").alias("prompt")), guess).groupBy(F.col("response").alias("category")).agg(F.count("*").alias("n"))


