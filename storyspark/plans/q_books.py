"""Queries of the five dimensions of a book (D, G, C, N, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import character as C
from ..operators import commercial as M
from ..operators import narrative as N
from ..operators import setting as G
from ..operators import story as D
from . import bindings as B
from .bindings import BOOKS, CHAPTERS, LATIN, QUOTED, Tables, case, cols, first_present, has, has_any, present, query, s, scored, strip, top, total, with_

#: Genres as SQL tells them, joined.
FORMULAS = {k: (*v[:4], ",".join(v[4])) for k, v in B.FORMULAS.items()}
_DEFAULT = (*B.FORMULA_DEFAULT[:4], ",".join(B.FORMULA_DEFAULT[4]))
_NAMES = ("formula_name", "desire", "obstacle", "path", "genres")

# --- story core

D1 = (
    f"d1 as (select novel_id, conflict_type, {', '.join(case('conflict_type', {k: v[i] for k, v in FORMULAS.items()}, s(_DEFAULT[i])) + ' as ' + n for i, n in enumerate(_NAMES))}, "
    f"case when {' + '.join(cols(LATIN))} > 0 then greatest({', '.join(cols(LATIN))}) / ({' + '.join(cols(LATIN))}) else 0.5e0 end as reusability "
    f"from (select *, {top(LATIN, cols(LATIN))} as conflict_type from (select novel_id, {scored(LATIN, present)} from books)))"
)
HC = "hc as (" + " union all ".join(f"select novel_id, chapter_number, {i} as ord, {s(c)} as hook_type, len(regexp_extract_all(content, {s('|'.join(k))})) as n from chapters" for i, (c, k) in enumerate(LATIN.items())) + ")"
PER = "per as (select novel_id, chapter_number, sum(n) as n, max(n) as most from hc group by 1, 2)"
D5 = (
    PER + ", gaps as (select novel_id, count(*) filter (n > 0) as k, (max(chapter_number) filter (n > 0) - min(chapter_number) filter (n > 0)) / nullif(count(*) filter (n > 0) - 1, 0) as gap, "
    "(max(chapter_number) filter (most >= 4) - min(chapter_number) filter (most >= 4)) / nullif(count(*) filter (most >= 4) - 1, 0) as major from per group by 1), "
    "d5 as (select novel_id, k as hook_chapters, case when k = 0 then '无明显节奏' when k < 2 then '钩子分布稀疏' else "
    "(case when gap <= 3 then '每1-3章1个小爽点' when gap <= 5 then '每3-5章1个小爽点' else '每5章以上1个小爽点' end) || '，' || "
    "(case when major is null then '无明显大爽点节奏' when major <= 10 then '每10章1个大爽点' when major <= 20 then '每10-20章1个大爽点' else '每20章以上1个大爽点' end) end as rhythm_pattern from gaps)"
)
D6 = f"d6 as (select novel_id, {top(LATIN, cols(LATIN))} as value_type, least(greatest({', '.join(cols(LATIN))}) / 100, 1.0e0) as relatability from (select novel_id, {scored(LATIN)} from books))"
HT = "ht as (select novel_id, ord, hook_type, sum(n) as n from hc group by 1, 2, 3), th as (select novel_id, arg_max(hook_type, n * 10 - ord) as top_hook, sum(n) as total_hooks, count(*) filter (n > 0) as types_used from ht group by 1)"


@query(with_(BOOKS, D1) + "select * from d1")
def d1_conflict_formula(t: Tables) -> DataFrame:
    return D.conflict_formula(t.books, LATIN, B.FORMULAS, B.FORMULA_DEFAULT).withColumn("genres", F.array_join("genres", ","))


_HM = " union all ".join(f"select novel_id, chapter_number, content, {s(c)} as hook_type, least(len(h), 5) as intensity, unnest(h) as keyword from (select *, regexp_extract_all(content, {s('|'.join(k))}) as h from chapters)" for c, k in LATIN.items())


@query(with_(CHAPTERS) + f"select novel_id, hook_type, position, cast(count(*) as bigint) as n, cast(sum(intensity) as bigint) as intensity from (select *, case when strpos(content, keyword) - 1 < length(content) * 0.2e0 then '开头' when strpos(content, keyword) - 1 > length(content) * 0.8e0 then '结尾' else '中间' end as position from ({_HM})) group by 1, 2, 3")
def d2_hook_matches(t: Tables) -> DataFrame:
    return D.hook_matches(t.chapters, LATIN).groupBy("novel_id", "hook_type", "position").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))


@query(with_(CHAPTERS, HC, HT) + "select novel_id, hook_type, cast(n as bigint) as n from ht")
def d3_hook_type_distribution(t: Tables) -> DataFrame:
    return D.hook_type_distribution(t.chapters, LATIN).select("novel_id", "hook_type", "n")


@query(with_(CHAPTERS, HC) + "select novel_id, chapter_number, cast(least(sum(n), 5) as int) as intensity, least(sum(n), 5) >= 4 as is_peak from hc group by 1, 2")
def d4_intensity_curve(t: Tables) -> DataFrame:
    return D.intensity_curve(t.chapters, LATIN)


@query(with_(CHAPTERS, HC, D5) + "select novel_id, cast(hook_chapters as bigint) as hook_chapters, rhythm_pattern from d5")
def d5_rhythm_pattern(t: Tables) -> DataFrame:
    return D.rhythm_pattern(t.chapters, LATIN)


@query(with_(BOOKS, D6) + "select novel_id, value_type, value_type || '的价值' as core_value, relatability from d6")
def d6_value_proposition(t: Tables) -> DataFrame:
    return D.value_proposition(t.books, LATIN)


_STORY = with_(BOOKS, CHAPTERS, HC, D1, D5, D6, HT)[:-1] + (
    ", sc as (select b.novel_id, formula_name, conflict_type, coalesce(rhythm_pattern, '无明显节奏') as rhythm, coalesce(top_hook, 'en') as hook, coalesce(types_used, 0) as used, value_type from books b join d1 using (novel_id) join d6 using (novel_id) left join d5 using (novel_id) left join th using (novel_id))\n"
)


def _story(t: Tables) -> DataFrame:
    return D.story_core(t.books, t.chapters, LATIN, LATIN, LATIN, B.FORMULAS)


@query(_STORY.replace(s(B.FORMULA_DEFAULT[0]), s("通用冲突公式")) + "select novel_id, '以『' || formula_name || '』为核心冲突，通过『' || hook || '』类情绪钩子驱动剧情，传递『' || value_type || '』的价值主张，形成' || rhythm || '的阅读节奏。' as core_attraction from sc")
def d7_core_attraction(t: Tables) -> DataFrame:
    return _story(t).select("novel_id", "core_attraction")


@query(_STORY + "select novel_id, least(case when conflict_type in ('en', 'fr') then 0.7e0 else 0.85e0 end + used / 4 * 0.2e0 + case when contains(rhythm, '大爽点') then 0.1e0 else 0.0e0 end, 1.0e0) as uniqueness from sc")
def d8_uniqueness(t: Tables) -> DataFrame:
    return _story(t).select("novel_id", D.uniqueness(F.col("conflict_type"), F.col("types_used"), F.col("rhythm_pattern"), 4, ("en", "fr")).alias("uniqueness"))


@query(with_(CHAPTERS, HC, HT) + f"select novel_id, hook_type, {case('hook_type', B.RESPONSES, s('情绪共鸣'))} as response from ht")
def d9_emotional_response(t: Tables) -> DataFrame:
    return D.hook_type_distribution(t.chapters, LATIN).select("novel_id", "hook_type", D.emotional_response(F.col("hook_type"), B.RESPONSES).alias("response"))


# --- setting

FINGERS = {"system": LATIN["en"], "space": LATIN["de"], "item": LATIN["fr"], "rebirth": LATIN["es"]}
G1 = f"g1 as (select novel_id, {top(FINGERS, cols(FINGERS))} as gf_type from (select novel_id, {scored(FINGERS)} from books))"
G2 = f"g2 as (select novel_id, case when s2 > 5 then 'dynamic_exp' when s1 > s0 then 'dynamic_linear' when s0 > s1 then 'static' else 'dynamic_step' end as growth_type from (select novel_id, {scored(B.GROWTH)} from books))"
_KW = [(c, k, kind, w) for c, (kind, ws) in enumerate(B.LIMITS.items()) for k, w in enumerate(ws)]
G3 = (
    "cm as (" + " union all ".join(f"select novel_id, {c * 10000 + k * 100} + generate_subscripts(m, 1) as ord, {s(kind)} as constraint_type, unnest(m) as raw from (select novel_id, regexp_extract_all(text, '[^.]*{w}[^.]*[.]')[:3] as m from books)" for c, k, kind, w in _KW)
    + f"), cd as (select *, row_number() over (partition by novel_id, {strip('raw')} order by ord) as f from cm), "
    f"g3 as (select * from (select novel_id, row_number() over (partition by novel_id order by ord) as place, constraint_type, {strip('raw')} as description, case when {has_any('raw', ['ea', 'sch'])} then 5 when {has_any('raw', ['on', 'los'])} then 4 else 3 end as severity from cd where f = 1) where place <= 5)"
)
_C = dict(lexicon=B.LIMITS, stop=".", gravest=["ea", "sch"], grave=["on", "los"])


@query(with_(BOOKS, G1) + "select * from g1")
def g1_gf_type(t: Tables) -> DataFrame:
    return G.gf_type(t.books, FINGERS)


@query(with_(BOOKS, G2) + "select * from g2")
def g2_growth_type(t: Tables) -> DataFrame:
    return G.growth_type(t.books, B.GROWTH)


@query(with_(BOOKS, G3) + "select novel_id, cast(place as int) as place, constraint_type, description, severity, '影响剧情发展' as plot_impact from g3")
def g3_constraints(t: Tables) -> DataFrame:
    return G.constraints(t.books, **_C)


EARLY = "early as (select novel_id, string_agg(content, ' ' order by chapter_number) as early_text from chapters where chapter_number <= 5 group by 1)"


@query(with_(BOOKS, CHAPTERS, EARLY, G1) + f"select novel_id, pain as pain_keyword, case when pain is null then '主角初期处于普通状态' else '主角初期面临' || pain || '的困境' end as pain_point, case when (gf_type = 'system' and {has('e', 'ing')}) or (gf_type = 'item' and {has('e', 'eau')}) then 0.8e0 else 0.5e0 end as fit_score from (select novel_id, gf_type, coalesce(early_text, '') as e, {first_present('coalesce(early_text, ' + chr(39) * 2 + ')', B.PAINS)} as pain from g1 left join early using (novel_id))")
def g4_fit(t: Tables) -> DataFrame:
    return G.fit(G.early_text(t.chapters), G.gf_type(t.books, FINGERS), B.PAINS, (("system", "ing"), ("item", "eau")))


_TYPES = "list_filter([" + ", ".join(f"case when {has_any('text', k[:3])} then {s(c)} end" for c, k in FINGERS.items()) + "], lambda x: x is not null)"


INNOVATIONS = f"list_filter([case when {has('text', 'eaux')} then '使用''情绪值''作为系统兑换资源，而非传统积分' end, case when priced and grave then '金手指使用需要付出沉重代价，增加剧情张力' end, case when len({_TYPES}) > 1 then '多金手指组合：' || array_to_string({_TYPES}, ', ') end], lambda x: x is not null)"


@query(
    with_(BOOKS, G3)
    + f", h as (select novel_id, bool_or(constraint_type = 'price') as priced, max(severity) >= 4 as grave from g3 group by 1) select novel_id, array_to_string({INNOVATIONS}, '|') as innovations from books left join h using (novel_id)"
)
def g5_innovations(t: Tables) -> DataFrame:
    return G.innovations(t.books, G.constraints(t.books, **_C), FINGERS, "eaux", "price").select("novel_id", F.array_join("innovations", "|").alias("innovations"))


_G6 = with_(BOOKS, G1, G2, G3)[:-1] + ", n as (select novel_id, count(*) as k from g3 group by 1), g6 as (select g1.novel_id, greatest(case when (gf_type, growth_type) in (('system', 'dynamic_linear'), ('rebirth', 'static'), ('supernatural', 'dynamic_linear')) then 0.7e0 else 0.5e0 end - coalesce(k, 0) * 0.1e0, 0.1e0) as similarity from g1 join g2 using (novel_id) left join n on g1.novel_id = n.novel_id)\n"


@query(_G6 + "select novel_id, similarity, 1 - similarity as novelty from g6")
def g6_similarity_novelty(t: Tables) -> DataFrame:
    n = G.constraints(t.books, **_C).groupBy("novel_id").agg(F.count("*").alias("k"))
    rows = G.gf_type(t.books, FINGERS).join(G.growth_type(t.books, B.GROWTH).hint("merge"), "novel_id").join(n.hint("merge"), "novel_id", "left")
    rows = rows.select("novel_id", G.similarity_to_common(F.col("gf_type"), F.col("growth_type"), F.coalesce("k", F.lit(0))).alias("similarity"))
    return rows.withColumn("novelty", G.novelty(F.col("similarity")))


@query(with_(BOOKS, G1) + r"select novel_id, nullif(case gf_type when 'system' then regexp_extract(text, '([\p{L}\p{N}_]+ing)', 1) when 'space' then regexp_extract(text, '([\p{L}\p{N}_]+keit)', 1) end, '') as gf_name from g1 join books using (novel_id)")
def g7_gf_name(t: Tables) -> DataFrame:
    rows = t.books.join(G.gf_type(t.books, FINGERS).hint("merge"), "novel_id")
    return rows.select("novel_id", G.gf_name("text", F.col("gf_type"), {"system": r"(?U)(\w+ing)", "space": r"(?U)(\w+keit)"}).alias("gf_name"))


_PEAKS = ["tionth", "schund", "eauou", "ciónm"]


@query(with_(BOOKS) + f"select novel_id, coalesce('可达到' || {first_present('text', _PEAKS)} || '境界', '潜力巨大，上限未知') as max_potential from books")
def g8_max_potential(t: Tables) -> DataFrame:
    return t.books.select("novel_id", G.max_potential("text", _PEAKS).alias("max_potential"))


SYSTEMS = {"wood": ["tionth", "ander"], "stone": ["schund", "keit"], "water": ["eauou", "ción"]}
G9 = "g9 as (" + " union all ".join(f"select novel_id, {i} as ord, {s(k + '体系')} as rule_name, '力量体系' as rule_category, 0.9e0 as consistency from books where {has_any('text', v)}" for i, (k, v) in enumerate(SYSTEMS.items())) + f" union all select novel_id, 3, '资源分配规则', '资源分配', 0.8e0 from books where {has_any('text', ['lles', 'thing'])})"


@query(with_(BOOKS, G9) + "select * from g9")
def g9_world_rules(t: Tables) -> DataFrame:
    return G.world_rules(t.books, SYSTEMS, ["lles", "thing"])


_EXPLOITS = ["tionth", "schund", "eauou", "ciónm", "ander"]
_EX = " union all ".join(f"select novel_id, chapter_number, {k} as kw_ord, {strip(f'list_filter(string_split(content, {s(chr(46))}), lambda x: {has(chr(120), w)})[1]')} as description from chapters where {has('content', w)} and len(list_filter(string_split(content, '.'), lambda x: {has('x', w)})) > 0" for k, w in enumerate(_EXPLOITS))


@query(with_(CHAPTERS) + f"select novel_id, cast(place as int) as place, chapter_number, description from (select *, row_number() over (partition by novel_id order by chapter_number, kw_ord) as place from (select *, row_number() over (partition by novel_id, description order by chapter_number, kw_ord) as f from ({_EX})) where f = 1) where place <= 3")
def g10_rule_exploits(t: Tables) -> DataFrame:
    return G.rule_exploits(t.chapters, _EXPLOITS, ".")


@query(with_(BOOKS, G3, G9) + "select novel_id, least(0.8e0 + coalesce(a, 0) * 0.05e0 + coalesce(b, 0) * 0.05e0, 1.0e0) as coherence from books left join (select novel_id, count(*) as a from g3 group by 1) using (novel_id) left join (select novel_id, count(*) as b from g9 group by 1) using (novel_id)")
def g11_coherence(t: Tables) -> DataFrame:
    a = G.constraints(t.books, **_C).groupBy("novel_id").agg(F.count("*").alias("a"))
    b = G.world_rules(t.books, SYSTEMS, ["lles", "thing"]).groupBy("novel_id").agg(F.count("*").alias("b"))
    rows = t.books.select("novel_id").join(a.hint("merge"), "novel_id", "left").join(b.hint("merge"), "novel_id", "left")
    return rows.select("novel_id", G.coherence(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("coherence"))


# --- characters

_ARCS = B.ARCS
_NC = "nc as (select *, count(*) over (partition by novel_id) as n from chapters)"
C1 = _NC + ", ac as (select novel_id, " + ", ".join(f"sum(case when chapter_number <= 10 then {total('content', a)} else 0 end + case when chapter_number > n - 10 then {total('content', b)} else 0 end) as s{i}" for i, (a, b) in enumerate(_ARCS.values())) + f" from nc group by 1), c1 as (select novel_id, {top(_ARCS, cols(_ARCS))} as arc_type from ac)"
C2 = (
    f"tk as (select novel_id, chapter_number, content, {first_present('content', B.TURNINGS)} as kw from chapters), ti as (select *, row_number() over (partition by novel_id order by chapter_number) - 1 as i, count(*) over (partition by novel_id) as n from tk where kw is not null), "
    f"c2 as (select novel_id, case when n <= 5 then i else i // (n // 5) end + 1 as place, chapter_number, {strip('substring(content, greatest(strpos(content, kw) - 21, 0) + 1, strpos(content, kw) - 1 + 30 - greatest(strpos(content, kw) - 21, 0))')} as context from ti where n <= 5 or (i % (n // 5) = 0 and i < (n // 5) * 5))"
)
C3 = "c3 as (select novel_id, coalesce(k, 0) as k, case when coalesce(k, 0) = 0 then 0.5e0 else least(least(k / 5, 1.0e0) + last / n * 0.2e0, 1.0e0) end as completion from (select novel_id, count(*) as n from chapters group by 1) left join (select novel_id, count(*) as k, max(chapter_number) as last from c2 group by 1) using (novel_id))"


@query(with_(CHAPTERS, C1) + "select * from c1")
def c1_arc_type(t: Tables) -> DataFrame:
    return C.arc_type(t.chapters, _ARCS)


@query(with_(CHAPTERS, C2) + "select novel_id, cast(place as int) as place, chapter_number, context from c2")
def c2_turning_points(t: Tables) -> DataFrame:
    return C.turning_points(t.chapters, B.TURNINGS)


@query(with_(CHAPTERS, C2, C3) + "select novel_id, cast(k as bigint) as n_turning_points, completion from c3")
def c3_completion(t: Tables) -> DataFrame:
    return C.arc_completion(t.chapters, B.TURNINGS)


@query(with_(CHAPTERS, C1, C2, C3) + "select novel_id, least(case when arc_type in ('a', 'c') then 0.75e0 else 0.7e0 end + completion * 0.25e0, 1.0e0) as satisfaction from c1 join c3 using (novel_id)")
def c4_satisfaction(t: Tables) -> DataFrame:
    rows = C.arc_type(t.chapters, _ARCS).join(C.arc_completion(t.chapters, B.TURNINGS).hint("merge"), "novel_id")
    return rows.select("novel_id", C.satisfaction(F.col("arc_type"), F.col("completion"), ["a", "c"]).alias("satisfaction"))


_QS = f"regexp_extract_all(text, {s(B.SPEECH)})"
C5 = (
    f"ct as (select novel_id, 0 as ord, '语言' as tag_type, '说话喜欢带语气词' as tag_description, len({_QS}) as frequency, array_to_string({_QS}[:3], chr(10)) as quotes from quoted where len({_QS}) > 0 union all "
    + " union all ".join(f"select novel_id, {i + 1}, '行为', {s('经常' + k)}, len(regexp_extract_all(text, {s(p)})), '' from quoted where len(regexp_extract_all(text, {s(p)})) >= 3" for i, (k, p) in enumerate(B.BEHAVIOURS.items()))
    + " union all "
    + " union all ".join(f"select novel_id, {i + 4}, '习惯', {s(f'有{k}的习惯')}, {total('text', [k])}, '' from quoted where {total('text', [k])} >= 5" for i, k in enumerate(B.HABITS))
    + "), c5 as (select * from (select *, row_number() over (partition by novel_id order by frequency desc, ord) as place from ct) where place <= 5)"
)


def _tags(t: Tables) -> DataFrame:
    return C.character_tags(t.quoted, B.SPEECH, B.BEHAVIOURS, B.HABITS)


@query(with_(QUOTED, C5) + "select novel_id, cast(place as int) as place, tag_type, tag_description, cast(frequency as int) as frequency, quotes from c5")
def c5_character_tags(t: Tables) -> DataFrame:
    return _tags(t)


C6 = r"c6 as (select novel_id, person, mentions from (select *, row_number() over (partition by novel_id order by mentions desc, person) as p from (select novel_id, person, count(*) as mentions from (select novel_id, unnest(regexp_extract_all(text, '([\p{L}\p{N}_]{2,4})(?:ing|keit|eau|ción)', 1)) as person from books) group by 1, 2)) where p <= 10)"
C7 = (
    "ss as (select novel_id, unnest(string_split(content, '.')) as sentence from chapters), sp as (select novel_id, person, mentions, " + ", ".join(f"sum({total('sentence', k)}) as s{i}" for i, k in enumerate(B.ROLES.values()))
    + " from ss join c6 using (novel_id) where contains(sentence, person) group by 1, 2, 3), "
    f"sr as (select novel_id, person, mentions, {top(B.ROLES, cols(B.ROLES))} as function_type from sp), "
    "c7 as (select * from (select novel_id, row_number() over (partition by novel_id order by case when function_type in ('info', 'foe') then 0.95e0 else 0.75e0 end desc, mentions desc, person) as place, person as role_name, function_type, case when function_type in ('info', 'foe') then 0.95e0 else 0.75e0 end as reusability from sr) where place <= 5)"
)


def _roles(t: Tables) -> DataFrame:
    return C.supporting_roles(t.chapters, C.person_mentions(t.books, B.PERSONS), B.ROLES, ".", ["info", "foe"])


@query(with_(BOOKS, C6) + "select novel_id, person, cast(mentions as bigint) as mentions from c6")
def c6_person_mentions(t: Tables) -> DataFrame:
    return C.person_mentions(t.books, B.PERSONS)


_RELATIONS = {"kin": ["th", "sch"], "guild": ["eau", "ci"]}
_ROLE_TEXTS = {"info": "tells", "help": "gives"}
_PLOTS = {"info": "clues", "foe": "conflict"}


@query(with_(BOOKS, CHAPTERS, C6, C7) + "select novel_id, cast(place as int) as place, role_name, function_type, case function_type when 'info' then 'tells' when 'help' then 'gives' else '功能性配角' end as role_description, " + f"case when {has_any('role_name', _RELATIONS['kin'])} then 'kin' when {has_any('role_name', _RELATIONS['guild'])} then 'guild' else '其他' end as relationship, " + "case function_type when 'info' then 'clues' when 'foe' then 'conflict' else '辅助剧情' end as plot_function, reusability from c7")
def c7_supporting_roles(t: Tables) -> DataFrame:
    return C.supporting_roles(t.chapters, C.person_mentions(t.books, B.PERSONS), B.ROLES, ".", ["info", "foe"], texts=_ROLE_TEXTS, plots=_PLOTS, relations=_RELATIONS)


@query(with_(BOOKS, C6) + f"select novel_id, person, case when {has_any('person', _RELATIONS['kin'])} then 'kin' when {has_any('person', _RELATIONS['guild'])} then 'guild' else 'none' end as relationship from c6")
def c8_infer_relationship(t: Tables) -> DataFrame:
    return C.person_mentions(t.books, B.PERSONS).select("novel_id", "person", C.infer_relationship("person", _RELATIONS, "none").alias("relationship"))


@query(with_(BOOKS, CHAPTERS, QUOTED, C2, C3, C5, C6, C7) + "select novel_id, least(0.6e0 + completion * 0.15e0 + least(coalesce(a, 0) * 0.03e0, 0.15e0) + least(coalesce(b, 0) * 0.02e0, 0.1e0), 1.0e0) as memorability from c3 left join (select novel_id, count(*) as a from c5 group by 1) using (novel_id) left join (select novel_id, count(*) as b from c7 group by 1) using (novel_id)")
def c9_memorability(t: Tables) -> DataFrame:
    a, b = (df.groupBy("novel_id").agg(F.count("*").alias(n)) for df, n in ((_tags(t), "a"), (_roles(t), "b")))
    rows = C.arc_completion(t.chapters, B.TURNINGS).join(a.hint("merge"), "novel_id", "left").join(b.hint("merge"), "novel_id", "left")
    return rows.select("novel_id", C.memorability(F.col("completion"), F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("memorability"))


# --- narrative

QCH = CHAPTERS.replace("from documents", "from quoted").replace("doc_id as novel_id", "novel_id")


def _quoted_chapters(t: Tables) -> DataFrame:
    from ..operators.text import line_chapters

    return line_chapters(t.quoted)


_DIA = "list_sum(list_transform(regexp_extract_all(content, '[''\"].*?[''\"]'), lambda x: length(x)))"
N1 = f"n1 as (select novel_id, 0.1e0 as hook_ratio, 0.8e0 as development_ratio, 0.1e0 as cliffhanger_ratio, cast(sum(length(content)) as double) / count(*) as paragraph_length, avg(coalesce({_DIA}, 0) / length(content)) as dialogue_ratio from chapters group by 1)"


@query(with_(QUOTED, QCH, N1) + "select novel_id, hook_ratio, development_ratio, cliffhanger_ratio, paragraph_length, round(dialogue_ratio, 9) as dialogue_ratio from n1")
def n1_chapter_structure(t: Tables) -> DataFrame:
    return N.chapter_structure(_quoted_chapters(t)).withColumn("dialogue_ratio", F.round("dialogue_ratio", 9))


N2 = (
    f"nm as (select *, case when {has_any('content', B.METHODS['told'])} then 'told' when {has_any('content', B.METHODS['hinted'])} then 'hinted' else 'found' end as method from chapters), "
    "nr as (" + " union all ".join(f"select novel_id, chapter_number, method, {i} as ord, {s(k)} as info_type from nm where {has_any('content', v)}" for i, (k, v) in enumerate(B.INFO.items()))
    + "), nb as (select novel_id, ord, info_type, method, count(*) as n, min(chapter_number) as f from nr group by 1, 2, 3, 4), nx as (select *, row_number() over (partition by novel_id, ord order by n desc, f) as p, sum(n) over (partition by novel_id, ord) as c from nb), "
    "n2 as (select nx.novel_id, ord, info_type, method as release_method, c as release_chapters, t as n_chapters, 1 - c / t as mystery_ratio from nx join (select novel_id, count(*) as t from chapters group by 1) q on q.novel_id = nx.novel_id where p = 1)"
)

#: Mean mystery ratio of a book's kinds, from whole sums with one division.
MYSTERY = "(count(*) * max(n_chapters) - sum(release_chapters)) / (count(*) * max(n_chapters))"


@query(with_(CHAPTERS, N2) + "select novel_id, ord, info_type, release_method, cast(release_chapters as bigint) as release_chapters, mystery_ratio from n2")
def n2_info_releases(t: Tables) -> DataFrame:
    return N.info_releases(t.chapters, B.INFO, B.METHODS, "found")


N3 = f"n3 as (select novel_id, len(l) as n, case when len(l) > 0 then len(list_filter(l, lambda x: x < 10)) / len(l) else 0.3e0 end as short_ratio, case when len(l) > 0 then len(list_filter(l, lambda x: x > 30)) / len(l) else 0.2e0 end as long_ratio, case when len(l) > 0 then list_sum(l) / len(l) else 15.0e0 end as average_length from (select novel_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda x: {strip('x')}), lambda y: y <> ''), lambda z: length(z)) as l from books))"


@query(with_(BOOKS, N3) + "select novel_id, cast(n as int) as sentences, short_ratio, long_ratio, average_length from n3")
def n3_sentence_stats(t: Tables) -> DataFrame:
    return N.sentence_stats(t.books, "[.!?;]")


VIEW = dict(first="th|und", third="an|ei|que", switch="th.*?an|an.*?th")
N4 = "n4 as (select novel_id, case when a > b * 2 or b > a * 2 then 0 else c end as switches, case when a > b * 2 then '第一人称' when b > a * 2 then '第三人称' when c > 5 then '多视角' else '第三人称' end as perspective from (select novel_id, len(regexp_extract_all(text, 'th|und')) as a, len(regexp_extract_all(text, 'an|ei|que')) as b, len(regexp_extract_all(substring(text, 1, 10000), 'th.*?an|an.*?th')) as c from books))"


@query(with_(BOOKS, N4) + "select novel_id, cast(switches as int) as switches, perspective from n4")
def n4_perspective(t: Tables) -> DataFrame:
    return N.perspective(t.books, **VIEW)


_SENSE = " union all ".join(f"select novel_id, {s(k)} as sense, {total('text', v)} as n from books" for k, v in B.SENSES.items())


@query(with_(BOOKS) + f"select novel_id, sense, case when sum(n) over (partition by novel_id) > 0 then n / sum(n) over (partition by novel_id) else 0.25e0 end as share from ({_SENSE})")
def n5_sensory_distribution(t: Tables) -> DataFrame:
    return N.sensory_distribution(t.books, B.SENSES).select("novel_id", F.explode("senses").alias("sense", "share"))


@query(with_(BOOKS, N3, N4) + "select novel_id, greatest(least(0.5e0 + (short_ratio - 0.3e0) * 0.5e0 - least(switches * 0.02e0, 0.1e0), 1.0e0), 0.0e0) as rhythm_score from n3 join n4 using (novel_id)")
def n6_rhythm_score(t: Tables) -> DataFrame:
    rows = N.sentence_stats(t.books, "[.!?;]").join(N.perspective(t.books, **VIEW).hint("merge"), "novel_id")
    return rows.select("novel_id", N.rhythm_score(F.col("short_ratio"), F.col("switches")).alias("rhythm_score"))


@query(with_(BOOKS, QUOTED, QCH, N1, N3) + "select novel_id, array_to_string(list_filter([case when hook_ratio > 0.15 then '快节奏爽文' else '慢热型作品' end, case when dialogue_ratio > 0.4 then '对话驱动型' else '叙述驱动型' end, case when short_ratio > 0.4 then '快节奏战斗场景' end, case when long_ratio > 0.3 then '氛围渲染场景' end], lambda x: x is not null), '|') as scenarios from n1 join n3 using (novel_id)")
def n7_scenarios(t: Tables) -> DataFrame:
    rows = N.chapter_structure(_quoted_chapters(t)).join(N.sentence_stats(t.books, "[.!?;]").hint("merge"), "novel_id")
    return rows.select("novel_id", F.array_join(N.scenarios(F.col("hook_ratio"), F.col("dialogue_ratio"), F.col("short_ratio"), F.col("long_ratio")), "|").alias("scenarios"))


@query(with_(CHAPTERS, N2) + f"select novel_id, least(3 + cast(coalesce(k, 0) > 2 as int) + cast(coalesce(m, 0) > 0.6e0 as int), 5) as difficulty from (select distinct novel_id from chapters) left join (select novel_id, count(*) as k, {MYSTERY} as m from n2 group by 1) using (novel_id)")
def n8_difficulty(t: Tables) -> DataFrame:
    r = N.info_releases(t.chapters, B.INFO, B.METHODS, "found").groupBy("novel_id").agg(F.count("*").alias("k"), F.sum("release_chapters").alias("releases"))
    rows = t.chapters.groupBy("novel_id").agg(F.count("*").alias("n")).join(r.hint("merge"), "novel_id", "left")
    return rows.select("novel_id", N.difficulty(F.lit(0.1), F.coalesce("k", F.lit(0)), N.mean_mystery(F.col("k"), F.col("releases"), F.col("n"))).alias("difficulty"))


@query(with_(QUOTED, QCH, N1) + "select novel_id, abs(hook_ratio + development_ratio + cliffhanger_ratio - 1) < 0.01 as ok from n1")
def n9_validate_ratios(t: Tables) -> DataFrame:
    return N.chapter_structure(_quoted_chapters(t)).select("novel_id", N.validate_ratios(F.col("hook_ratio"), F.col("development_ratio"), F.col("cliffhanger_ratio")).alias("ok"))


# --- commercial

M1 = f"m1 as (select *, {top(B.SEGMENTS, cols(B.SEGMENTS))} as segment from (select novel_id, {scored(B.SEGMENTS)} from books))"
_SECOND = "list_filter([" + ", ".join(f"case when s{i} > 0 then {s(k)} end" for i, k in enumerate(B.SEGMENTS)) + "], lambda x: x is not null and x <> segment)[:2]"
M3 = f"m3 as (select novel_id, {case(top(LATIN, cols(LATIN)), B.MOTIVES, s('综合需求'))} as motivation, array_to_string(list_filter([{', '.join(f'case when s{i} > 5 then {s(k)} end' for i, k in enumerate(LATIN))}], lambda x: x is not null), ',') as triggers from (select novel_id, {scored(LATIN)} from books))"
M4 = f"m4 as (select novel_id, segment, {case('segment', B.ARPU, '30.0e0')} * {case('motivation', {'追更解谜': 1.2, '获得爽感': 1.0, '情感满足': 1.3, '自我代入': 1.1}, '1.0e0')} as arpu from m1 join m3 using (novel_id))"


@query(with_(BOOKS, M1) + f"select novel_id, segment, array_to_string({_SECOND}, ',') as secondary, {case('segment', {k: v[0] for k, v in B.AGES.items()}, '18')} as age_low, {case('segment', {k: v[1] for k, v in B.AGES.items()}, '45')} as age_high from m1")
def m1_audience(t: Tables) -> DataFrame:
    return M.audience(t.books, B.SEGMENTS, B.AGES).withColumn("secondary", F.array_join("secondary", ","))


@query(with_(BOOKS) + f"select novel_id, case when a + b > 0 then a / (a + b) else 0.5e0 end as male, case when a + b > 0 then b / (a + b) else 0.5e0 end as female from (select novel_id, {total('text', LATIN['en'])} as a, {total('text', LATIN['fr'])} as b from books)")
def m2_gender_split(t: Tables) -> DataFrame:
    g = M.gender_split(t.books, {"male": LATIN["en"], "female": LATIN["fr"]})
    return g.select("novel_id", F.col("genders")["male"].alias("male"), F.col("genders")["female"].alias("female"))


@query(with_(BOOKS, M3) + "select * from m3")
def m3_payment_behavior(t: Tables) -> DataFrame:
    return M.payment_behavior(t.books, LATIN, B.MOTIVES).withColumn("triggers", F.array_join("triggers", ","))


def _arpu(t: Tables) -> DataFrame:
    rows = M.audience(t.books, B.SEGMENTS, B.AGES).join(M.payment_behavior(t.books, LATIN, B.MOTIVES).hint("merge"), "novel_id")
    return rows.select("novel_id", "segment", M.arpu(F.col("segment"), F.col("motivation"), B.ARPU).alias("arpu"))


@query(with_(BOOKS, M1, M3, M4) + "select novel_id, arpu from m4")
def m4_arpu(t: Tables) -> DataFrame:
    return _arpu(t).select("novel_id", "arpu")


_SPEAKER, SCENE = "[A-Z][a-z]{1,3}(?:th|ei)", "then|when|there"
_POINTS = lambda keys: "array_to_string(list_filter([" + ", ".join(f"case when {total('text', [k])} > 5 then {s(k)} end" for k in keys) + "], lambda x: x is not null)[:3], ',')"
M5 = (
    f"mk as (select *, len(list_distinct(regexp_extract_all(text, {s(SCENE)}))) as scenes, len(list_distinct(regexp_extract_all(text, {s(_SPEAKER)}))) as speakers from books), "
    "mu as (" + " union all ".join(f"select novel_id, {i} as ord, {s(k)} as adaptation_type, least({total('text', v)} / {10 * len(v)}, 1.0e0) as suitability, {_POINTS(v)} as key_points, greatest({B.COSTS[k]}e0 - (case when scenes > 20 then 0.1e0 else 0.0e0 end + case when speakers > 30 then 0.1e0 else 0.0e0 end), 0.1e0) as cost from mk" for i, (k, v) in enumerate(B.KINDS.items()))
    + "), mr as (select *, least((suitability * 0.7e0 + cost * 0.3e0) / greatest(1 - cost, 0.1e0), 5.0e0) as roi from mu where suitability > 0.3), "
    "m5 as (select * from (select *, row_number() over (partition by novel_id order by round(roi, 2) desc, ord) as place from mr) where place <= 3)"
)


def _adapt(t: Tables) -> DataFrame:
    return M.adaptations(t.books, B.KINDS, B.COSTS, _SPEAKER, SCENE)


@query(with_(BOOKS, M5) + "select novel_id, cast(place as int) as place, adaptation_type, suitability, key_points, cost, roi from m5")
def m5_adaptation_potential(t: Tables) -> DataFrame:
    return _adapt(t).withColumn("key_points", F.array_join("key_points", ","))


@query(with_(BOOKS, M5) + "select novel_id, adaptation_type, cost from mu")
def m6_adaptation_cost(t: Tables) -> DataFrame:
    rows = t.books.select("novel_id", M.distinct_matches("text", SCENE).alias("a"), M.distinct_matches("text", _SPEAKER).alias("b"), F.explode(F.array(*[F.lit(k) for k in B.KINDS])).alias("adaptation_type"))
    return rows.select("novel_id", "adaptation_type", M.adaptation_cost(F.col("adaptation_type"), F.col("a"), F.col("b"), B.COSTS).alias("cost"))


@query(with_(BOOKS, M5) + "select novel_id, max(roi) as best_roi, cast(count(*) as bigint) as n from m5 group by 1")
def m7_roi(t: Tables) -> DataFrame:
    return _adapt(t).groupBy("novel_id").agg(F.max(M.roi(F.col("suitability"), F.col("cost"))).alias("best_roi"), F.count("*").alias("n"))


DERIVED = dict(system="ing", world="ción", branch=("eau", "keit"), speaker=_SPEAKER, long=5000)
M8 = f"m8 as (select novel_id, list_filter([case when {has('text', 'ing')} then 0.7e0 end, case when len(list_distinct(regexp_extract_all(text, {s(_SPEAKER)}))) >= 5 then 0.6e0 end, case when {has('text', 'ción')} or length(text) > 5000 then 0.8e0 end, case when {has_any('text', ('eau', 'keit'))} then 0.65e0 end], lambda x: x is not null) as p from books)"


@query(with_(BOOKS, M8) + "select novel_id, cast(len(p) as int) as n, coalesce(list_sum(p), 0.0e0) as potential from m8")
def m8_derivatives(t: Tables) -> DataFrame:
    rows = t.books.select("novel_id", M.derivatives("text", **DERIVED).alias("d"))
    return rows.select("novel_id", F.size("d").alias("n"), F.aggregate("d.potential", F.lit(0.0), lambda a, x: a + x).alias("potential"))


@query(with_(BOOKS, M1, M3, M4, M5, M8) + "select novel_id, least(least(arpu / 100, 1.0e0) * 0.3e0 + case when r is null then 0.1e0 else r / 5 * 0.4e0 end + case when len(p) > 0 then list_sum(p) / len(p) * 0.3e0 else 0.1e0 end, 1.0e0) as score from m4 join m8 using (novel_id) left join (select novel_id, max(roi) as r from m5 group by 1) using (novel_id)")
def m9_commercial_score(t: Tables) -> DataFrame:
    most = _adapt(t).groupBy("novel_id").agg(F.max("roi").alias("r"))
    rows = _arpu(t).join(t.books.select("novel_id", M.derivatives("text", **DERIVED).alias("d")).hint("merge"), "novel_id").join(most.hint("merge"), "novel_id", "left")
    return rows.select("novel_id", M.commercial_score(F.col("arpu"), F.col("r"), F.col("d.potential")).alias("score"))


@query(with_(BOOKS, M1, M5) + "select novel_id, '付费阅读（核心受众：' || segment || '） → ' || coalesce(adaptation_type || '改编（ROI预测：' || format('{:.1f}', roi) || '倍） → ', '') || 'IP衍生开发（周边、游戏、系列文）' as path from m1 left join (select * from m5 where place = 1) using (novel_id)")
def m10_monetization_path(t: Tables) -> DataFrame:
    rows = M.audience(t.books, B.SEGMENTS, B.AGES).join(_adapt(t).where("place = 1").select("novel_id", "adaptation_type", "roi").hint("merge"), "novel_id", "left")
    return rows.select("novel_id", M.monetization_path(F.col("segment"), F.col("adaptation_type"), F.col("roi")).alias("path"))


