"""Composite pipelines (V1, V4-V6, P6): basic and deep features of books."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.scores import best, lookup, scores, top
from ..functions.textfn import alternation, cnt, first_present, has, has_any, matches, once
from ..sources import tables
from ..sources.scratch import stored
from . import benchmark, character, commercial, fusion, narrative, rules, setting, story, text

DIMENSIONS = {
    "story_core": "conflict_type formula_name desire obstacle path genres reusability value_type relatability rhythm_pattern top_hook total_hooks types_used uniqueness core_attraction",
    "core_setting": "gf_type growth_type n_constraints n_rules constraint_types pain_point fit_score innovations similarity novelty coherence gf_name initial_power max_potential",
    "character_analysis": "arc_type n_turning_points completion n_tags n_roles satisfaction memorability initial_state final_state",
    "narrative_technique": "sentences short_ratio long_ratio average_length switches perspective hook_ratio development_ratio cliffhanger_ratio paragraph_length dialogue_ratio n_releases mean_mystery rhythm_score difficulty scenarios",
    "commercial_value": "segment secondary motivation triggers best_adaptation best_roi arpu derivatives commercial_score monetization_path",
}


def deep_fuse(joined: DataFrame) -> DataFrame:
    """Add quality, tags, summary and consistency to a row that has all five dimensions."""
    c = F.col
    quality = fusion.overall_quality(c("reusability"), c("uniqueness"), c("coherence"), c("novelty"), c("satisfaction"), c("memorability"), c("rhythm_score"), c("difficulty"))
    tags = fusion.reusable_tags(c("formula_name"), c("gf_type"), c("growth_type"), c("rhythm_pattern"), c("arc_type"), c("innovations"))
    summary = fusion.reverse_summary(c("desire"), c("obstacle"), c("path"), c("gf_type"), c("growth_type"), c("initial_power"), c("initial_state"), c("final_state"), c("arc_type"), c("top_hook"), c("rhythm_pattern"))
    check = fusion.consistency_check(c("conflict_type"), c("growth_type"), c("formula_name"), c("arc_type"), c("scenarios"), c("rhythm_pattern"), c("n_constraints"), c("difficulty"))
    formula = fusion.formula_summary(c("formula_name"), c("gf_type"), c("growth_type"), c("arc_type"), c("rhythm_pattern"))
    return joined.withColumns({"overall_quality": quality, "reusable_tags": tags, "reverse_summary": summary, "consistency_score": check, "formula_summary": formula})


def _picked(options: dict, *names: str) -> dict:
    return {n: options[n] for n in names if n in options}


def _renamed(options: dict, **names: str) -> dict:
    """The options that are there, under the names that a function has for them."""
    return {new: options[old] for new, old in names.items() if old in options}


def book_features(books: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """What a book's own text tells, one row a book, as columns of one row: nothing shuffles.

    ``cast`` lists the persons most often mentioned.
    """
    st, se, ch, na, co = ((options or {}).get(k, {}) for k in ("story", "setting", "character", "narrative", "commercial"))
    derived = {k: v for k, v in co.items() if k in ("system", "world", "branch", "long", "speaker")}
    fingers = se.get("fingers", L.GOLDEN_FINGERS)
    counted = books.select(
        "novel_id", "text",
        scores("text", st.get("conflict", L.CONFLICT), "presence").alias("__conflict"), scores("text", st.get("values", L.VALUES)).alias("__values"),
        scores("text", fingers).alias("__fingers"), scores("text", se.get("growth", L.GROWTH)).alias("__growth"),
        setting.ended_sentences("text", se.get("stop", "。")).alias("__ended"), setting.several_types("text", fingers).alias("__types"),
        F.size(setting.world_rule_items("text", **_picked(se, "systems", "resources"))).alias("n_rules"),
        F.least(F.size(character.tag_items("text", **_picked(ch, "speech", "behaviours", "habits"))), F.lit(5)).alias("n_tags"),
        character.top_persons("text", **_renamed(ch, patterns="persons")).alias("cast"),
        narrative.sentence_lengths("text", na.get("marks", "[。！？；]")).alias("__lengths"),
        *[c.alias(n) for n, c in narrative.view_counts("text", **_picked(na, "first", "third", "switch")).items()],
        scores("text", co.get("audiences", L.AUDIENCES)).alias("__audience"), scores("text", co.get("triggers", L.PAYMENT_TRIGGERS)).alias("__payment"),
        *[c.alias(n) for n, c in commercial.adaptation_counts("text", **_renamed(co, lexicon="kinds", speaker="speaker", scene="scene")).items()],
        commercial.derivatives("text", **derived).alias("derivatives"),
    )
    kinds = counted.withColumns({
        "conflict_type": top("__conflict"), "value_type": top("__values"), "gf_type": top("__fingers"), "segment": top("__audience"), "growth_type": setting.growth_of("__growth"),
        "__items": setting.constraint_items("__ended", **_renamed(se, lexicon="limits", gravest="gravest", grave="grave")), "__best": commercial.adaptation_items(co.get("costs", L.BASE_COST)),
    })
    c = F.col
    items = F.coalesce("__items", F.array().cast(kinds.schema["__items"].dataType))
    dear = F.exists(items, lambda x: x["constraint_type"] == se.get("price", "代价")) & F.exists(items, lambda x: x["severity"] >= 4)
    told = kinds.select(
        "novel_id", "cast", "n_rules", "n_tags", "derivatives", "conflict_type", "value_type", "gf_type", "growth_type", "segment",
        *[x.alias(n) for n, x in story.conflict_columns("__conflict", c("conflict_type"), **_picked(st, "formulas", "default")).items()],
        F.concat("value_type", F.lit("的价值")).alias("core_value"), F.least(best("__values") / 100, F.lit(1.0)).alias("relatability"),
        F.size(items).alias("n_constraints"), items["constraint_type"].alias("constraint_types"),
        setting.innovation_tags("text", "__types", dear, se.get("mood", "情绪值")).alias("innovations"),
        setting.gf_name("text", c("gf_type"), se.get("names", L.GF_NAMES)).alias("gf_name"), setting.initial_power(c("gf_type")).alias("initial_power"), setting.max_potential("text", se.get("peaks", L.PEAKS)).alias("max_potential"),
        *[x.alias(n) for n, x in narrative.sentence_columns("__lengths").items()], *[x.alias(n) for n, x in narrative.view_columns().items()],
        *[x.alias(n) for n, x in commercial.audience_columns("__audience", c("segment"), co.get("ages", L.AGE_RANGES)).items()],
        *[x.alias(n) for n, x in commercial.payment_columns("__payment", co.get("motives", L.MOTIVATIONS)).items()],
        F.get("__best", F.lit(0))["adaptation_type"].alias("best_adaptation"), F.get("__best", F.lit(0))["roi"].alias("best_roi"), F.array_max(c("__best")["roi"]).alias("max_roi"),
    )
    told = told.withColumns({"similarity": setting.similarity_to_common(c("gf_type"), c("growth_type"), c("n_constraints")), "coherence": setting.coherence(c("n_constraints"), c("n_rules")), "arpu": commercial.arpu(c("segment"), c("motivation"), co.get("base", L.BASE_ARPU))})
    return told.withColumns({
        "novelty": setting.novelty(c("similarity")), "commercial_score": commercial.commercial_score(c("arpu"), c("max_roi"), c("derivatives.potential")),
        "monetization_path": commercial.monetization_path(c("segment"), c("best_adaptation"), c("best_roi")),
    })


def chapter_features(chapters: DataFrame, cast: DataFrame, options: dict[str, dict] | None = None, span: int = 10, early: int = 5, points: int = 5) -> DataFrame:
    """What a book's chapters tell, one row a book: one pass over the chapters, dealt by book once.

    A chapter becomes counts and flags before anything is added up. ``cast`` lists each book's persons, whose sentences are
    scored within the chapter; these sums and the chapters' own go through one aggregate by book and person.
    """
    st, se, ch, na = ((options or {}).get(k, {}) for k in ("story", "setting", "character", "narrative"))
    hooks, arcs, roles, kinds = st.get("hooks", L.HOOKS), ch.get("arcs", L.ARCS), ch.get("roles", L.ROLES), na.get("kinds", L.INFO_TYPES)
    words = list(dict.fromkeys([*se.get("pains", L.PAINS), *[w for _, w in se.get("solves", (("system", "弱"), ("item", "穷")))]]))
    added = lambda t, keys: reduce(lambda a, b: a + b, [cnt(t, w) for w in keys])
    c = F.col
    scored = character.said_scores("content", "cast", roles, ch.get("stop", "。"))
    zero = F.lit(0).cast("int")
    size = lambda a, x: a + F.length(x)
    rows = chapters.select("novel_id", "chapter_number", "content").join(cast.select("novel_id", "cast").hint("merge"), "novel_id", "left")
    rows = rows.select(
        "novel_id", "chapter_number", scored.alias("said"), text.paragraphs("content").alias("p"), F.aggregate(matches("content", narrative.QUOTED), zero, size).alias("quoted"), F.length("content").alias("size"),
        *[F.regexp_count("content", F.lit(alternation(w))).alias(f"h{k}") for k, w in enumerate(hooks.values())],
        *[added("content", starts).alias(f"s{k}") for k, (starts, _) in enumerate(arcs.values())], *[added("content", ends).alias(f"e{k}") for k, (_, ends) in enumerate(arcs.values())],
        *[has("content", w).alias(f"w{k}") for k, w in enumerate(words)], *[has_any("content", keys).alias(f"i{k}") for k, keys in enumerate(kinds.values())],
        first_present("content", ch.get("turnings", L.TURNINGS)).isNotNull().alias("turns"),
    )
    rows = rows.select("*", F.size("p").alias("n_p"), F.aggregate("p", zero, size).alias("size_p")).drop("p")
    book = Window.partitionBy("novel_id")
    rows = rows.withColumns({"up": F.row_number().over(book.orderBy("chapter_number")), "many": F.count("*").over(book)})
    head, tail = c("up") <= span, c("up") > c("many") - span
    hooked = [c(f"h{k}") for k in range(len(hooks))]
    n, most = reduce(lambda a, b: a + b, hooked), F.greatest(*hooked) if len(hooked) > 1 else hooked[0]
    own, major, at = F.when(n > 0, c("chapter_number")), F.when(most >= 4, c("chapter_number")), c("chapter_number")
    whole = c("r.person").isNull()  # the chapter's own row; the others are persons in it
    nobody = F.array(F.lit(None).cast(rows.schema["said"].dataType.elementType))
    rows = rows.withColumn("r", F.explode(F.concat(nobody, F.coalesce("said", F.array().cast(rows.schema["said"].dataType)))))
    only = lambda x: F.when(whole, x)
    sums = {f"h{k}": F.sum(only(h)) for k, h in enumerate(hooked)} | {f"i{k}": F.sum(only(c(f"i{k}").cast("int"))) for k in range(len(kinds))}
    sums |= {f"a{k}": F.sum(only(F.when(head, c(f"s{k}")).otherwise(0) + F.when(tail, c(f"e{k}")).otherwise(0))) for k in range(len(arcs))}
    sums |= {f"w{k}": F.max(only((c("up") <= early) & c(f"w{k}"))) for k in range(len(words))}
    sums |= {"n_chapters": F.sum(only(F.lit(1))), "k": F.count(only(own)), "own_a": F.min(only(own)), "own_b": F.max(only(own)), "major_k": F.count(only(major)), "major_a": F.min(only(major)), "major_b": F.max(only(major))}
    full = whole & (c("n_p") > 0)
    sums |= {"n_p": F.sum(F.when(full, c("n_p"))), "size_p": F.sum(F.when(full, c("size_p"))), "quoted": F.avg(F.when(full, c("quoted") / c("size")))}
    per = rows.groupBy("novel_id", "r.person").agg(F.max("r.mentions").alias("mentions"), F.collect_list(only(F.when(c("turns"), at))).alias("turned"), *[x.alias(k) for k, x in sums.items()], *[F.sum(f"r.r{k}").alias(f"r{k}") for k in range(len(roles))])
    table = F.array(*[F.struct(F.lit(r).alias("category"), c(f"r{k}").alias("score")) for k, r in enumerate(roles)])
    person = F.when(c("person").isNotNull(), F.struct("person", "mentions", top(table).alias("function_type")))
    out = per.groupBy("novel_id").agg(F.collect_list(person).alias("people"), F.flatten(F.collect_list("turned")).alias("turned"), *[F.max(k).alias(k) for k in sums])

    worth = lambda p: F.when(p["function_type"].isin(*ch.get("reusable", L.REUSABLE_ROLES)), 0.95).otherwise(0.75)
    ranked = F.array_sort(F.transform("people", lambda p: F.struct((-worth(p)).alias("a"), (-p["mentions"]).alias("b"), p["person"].alias("person"), p["function_type"].alias("kind"))))
    role = lambda p: F.struct(p["person"].alias("role_name"), p["kind"].alias("function_type"), character.role_description(p["kind"]).alias("role_description"), character.infer_relationship(p["person"]).alias("relationship"), lookup(p["kind"], L.PLOT_FUNCTIONS, "辅助剧情").alias("plot_function"), (-p["a"]).alias("reusability"))
    listed = lambda names, letter: F.array(*[F.struct(F.lit(x).alias("category"), c(f"{letter}{k}").alias("score")) for k, x in enumerate(names)])
    hits = F.array_sort("turned")
    step = F.greatest(F.floor(F.size(hits) / points), F.lit(1)).cast("int")
    last = F.when(F.size(hits) <= points, F.get(hits, F.size(hits) - 1)).otherwise(F.get(hits, step * (points - 1)))
    turned = F.least(F.size(hits), F.lit(points))
    found = [c(f"i{k}") for k in range(len(kinds))]
    n_kinds, releases = reduce(lambda a, b: a + b, [(i > 0).cast("long") for i in found]), reduce(lambda a, b: a + b, found)
    order = F.array(*[F.struct(c(f"h{k}").alias("n"), F.lit(-k).alias("o"), F.lit(h).alias("t")) for k, h in enumerate(hooks)])
    mean_gap = lambda a, b, k: (c(b) - c(a)) / F.nullif(c(k) - 1, F.lit(0))
    return out.select(
        "novel_id", story.rhythm_text(c("k"), mean_gap("own_a", "own_b", "k"), mean_gap("major_a", "major_b", "major_k")).alias("rhythm_pattern"), c("k").alias("hook_chapters"),
        F.array_max(order)["t"].alias("top_hook"), reduce(lambda a, b: a + b, hooked).alias("total_hooks"), reduce(lambda a, b: a + b, [(h > 0).cast("int") for h in hooked]).cast("long").alias("types_used"),
        *[c(f"w{k}").alias(f"__early_{k}") for k in range(len(words))], top(listed(arcs, "a")).alias("arc_type"),
        turned.cast("long").alias("n_turning_points"), character.completion(F.nullif(turned, F.lit(0)), last, c("n_chapters")).alias("completion"),
        F.transform(F.slice(ranked, 1, 5), role).alias("roles"), F.least(F.size("people"), F.lit(5)).cast("long").alias("n_roles"),
        *[F.when(c("n_p") > 0, x).alias(k) for k, x in {"hook_ratio": F.lit(narrative.HOOK), "development_ratio": F.lit(narrative.DEVELOPMENT), "cliffhanger_ratio": F.lit(narrative.CLIFFHANGER), "paragraph_length": c("size_p") / c("n_p"), "dialogue_ratio": c("quoted")}.items()],
        n_kinds.alias("n_releases"), narrative.mean_mystery(n_kinds, releases, c("n_chapters")).alias("mean_mystery"),
    )


def deep_features(books: DataFrame, chapters: DataFrame, options: dict[str, dict] | None = None, library: DataFrame | None = None, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All five dimensions of each book in one row: a projection of the books, an aggregate of the chapters, one join.

    The books are read twice, as a chapter needs its book's persons, and the chapters once. With a benchmark ``library`` there is a
    column ``benchmark_comparisons`` too, see ``compared``; ``comparisons`` gives these alone. A keyword of the first chapters must stand within one of them.
    """
    st, se, ch = ((options or {}).get(k, {}) for k in ("story", "setting", "character"))
    own = book_features(books, options)
    out = own.drop("cast").join(chapter_features(chapters, own, options).hint("merge"), "novel_id", "left")
    hooks, arcs = st.get("hooks", L.HOOKS), ch.get("arcs", L.ARCS)
    pains, solves = se.get("pains", L.PAINS), se.get("solves", (("system", "弱"), ("item", "穷")))
    words = list(dict.fromkeys([*pains, *[w for _, w in solves]]))
    c = F.col
    defaults = {"rhythm_pattern": "无明显节奏", "types_used": 0, "top_hook": next(iter(hooks)), "total_hooks": 0, "arc_type": next(iter(arcs)), "completion": 0.5, "n_roles": 0, "n_releases": 0}
    defaults |= {"hook_ratio": 0.1, "development_ratio": 0.7, "cliffhanger_ratio": 0.2, "paragraph_length": 200.0, "dialogue_ratio": 0.3}
    out = out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})
    early = lambda w: F.coalesce(f"__early_{words.index(w)}", F.lit(False))
    pain = F.coalesce(*[F.when(early(w), w) for w in pains], F.lit(None).cast("string"))
    out = out.withColumns({"pain_keyword": pain, "uniqueness": story.uniqueness(c("conflict_type"), c("types_used"), c("rhythm_pattern"), len(hooks), st.get("common", story.UNDERDOGS))})
    out = out.withColumns(setting.fit_columns(c("gf_type"), c("pain_keyword"), early, solves) | {
        "core_attraction": story.core_attraction(c("formula_name"), c("top_hook"), c("value_type"), c("rhythm_pattern")),
        "satisfaction": character.satisfaction(c("arc_type"), c("completion"), ch.get("popular", L.POPULAR_ARCS)), "memorability": character.memorability(c("completion"), c("n_tags"), c("n_roles")),
        "initial_state": lookup(c("arc_type"), L.ARC_STARTS, "普通状态"), "final_state": lookup(c("arc_type"), L.ARC_ENDS, "成长后的状态"),
        "rhythm_score": narrative.rhythm_score(c("short_ratio"), c("switches")), "difficulty": narrative.difficulty(c("hook_ratio"), c("n_releases"), c("mean_mystery")),
        "scenarios": narrative.scenarios(c("hook_ratio"), c("dialogue_ratio"), c("short_ratio"), c("long_ratio")), "ratios_valid": narrative.validate_ratios(c("hook_ratio"), c("development_ratio"), c("cliffhanger_ratio")),
    })
    out = deep_fuse(out.drop(*[f"__early_{k}" for k in range(len(words))]))
    return out if library is None else compared(out, library, describe)


#: What a comparison with benchmarks needs of a book.
COMPARED = ["novel_id", "genres", *benchmark.FIELDS, "top_hook", "innovations", "reusability", "roles", "total_hooks", "n_constraints", "completion", "commercial_score"]


def _lists(deep: DataFrame, library: DataFrame, describe: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return benchmark.comparison(deep.withColumn("genre", F.get("genres", F.lit(0))), library, describe=describe)


def comparisons(deep: DataFrame, library: DataFrame, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The four lists of ``benchmark.comparison`` within a book's first genre, ``describe`` as there.

    A comparison reads the features three times, so those it needs are worked out once and stored.
    """
    return _lists(stored(deep.select(*COMPARED), "deep"), library, describe)


def compared(deep: DataFrame, library: DataFrame, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``benchmark_comparisons``, the lists of ``comparisons``, to all features, which are stored once."""
    deep = stored(deep, "deep")
    told = _lists(deep, library, describe).select("novel_id", F.struct("differentiation", "reusable", "suggestions", "similar").alias("benchmark_comparisons"))
    return deep.join(told.hint("merge"), "novel_id", "left")


def dimension_structs(deep: DataFrame) -> DataFrame:
    """The five dimensions as nested columns, as they are stored."""
    return deep.select("novel_id", *[F.struct(*names.split()).alias(d) for d, names in DIMENSIONS.items()], "overall_quality", "reusable_tags", "reverse_summary", "consistency_score", "formula_summary")


class Basic(NamedTuple):
    """What basic parsing leaves: chapters and features to store, and the stages that each book passed."""

    chapters: DataFrame
    features: DataFrame
    progress: DataFrame


#: Stages of basic parsing, with the status that a task has in them.
STAGES = (("preprocessing", "preprocessing"), ("feature_extraction", "extracting"), ("result_fusion", "fusing"))


def text_features(texts: DataFrame, rule_table: DataFrame, model: DataFrame | None = None, cultivation: str = "仙侠") -> DataFrame:
    """Features of texts by rules, fused with a model's rows where there are any, and their ``issues``."""
    found = rules.rule_features(texts, rule_table)
    found = found.withColumnsRenamed({c: c.split("_", 1)[1] for c in found.columns if c not in ("novel_id", "confidence_score")})
    found = found.withColumn("conflict_types", F.when(F.col("conflict_types").isNotNull(), F.array("conflict_types")).otherwise(F.array().cast("array<string>")))
    out = fusion.engine_switch(found, model)
    c = F.col
    return out.withColumn("issues", fusion.validate_features(c("confidence_score"), c("world_type"), c("task_structure"), c("power_system"), cultivation=cultivation))


def basic_features(books: DataFrame, rule_table: DataFrame, model: DataFrame | None = None, known: DataFrame | None = None, **parse) -> Basic:
    """Parse raw books, take features of their core texts, check them, and put them in the ``known`` table.

    ``parse`` are options of ``text.parse_book``. Progress has a row for each book, stage and end of it.
    """
    chapters = text.parse_book(books, **parse)
    found = text_features(text.core_text(chapters), rule_table, model)
    stored = found if known is None else tables.upsert(known, found, ["novel_id"])
    ends = [F.struct(F.lit(2 * i + k).alias("ord"), F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(100.0 * k).alias("progress")) for i, (stage, status) in enumerate(STAGES) for k in (0, 1)]
    return Basic(chapters, stored, found.select("novel_id", F.inline(F.array(*ends))))


def incremental_features(chapters: DataFrame, features: DataFrame, incoming: DataFrame, rule_table: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """The features after new chapters came in.

    Only incoming chapters whose hash is unknown count; the features of a book's new text take the place
    of its known ones where they are surer. A book without new chapters keeps what it had.
    """
    new = text.joined_text(fusion.incremental_chapters(chapters, incoming))
    return fusion.merge_by_confidence(features, text_features(new, rule_table, model).select(*features.columns))


def parse_batch(books: DataFrame, wanted: DataFrame, rule_table: DataFrame, kind: str = "basic", options: dict[str, dict] | None = None, **parse) -> DataFrame:
    """Basic or deep features of the wanted books in one job; ``options`` are those of ``deep_features``."""
    own = books.join(wanted.select("novel_id").distinct().hint("merge"), "novel_id", "left_semi")
    if kind == "basic":
        return basic_features(own, rule_table, **parse).features
    if kind == "deep":
        chapters = text.parse_book(own, **parse).select("novel_id", "chapter_number", "content")
        return deep_features(text.full_text(chapters), chapters, options)
    raise ValueError(f"unknown kind: {kind}")
