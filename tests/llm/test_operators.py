"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyspark.llm import bytebpe, chat, decontaminate, language, neighbours, queries, secrets, simhash, substrings, tokenfiles, warc
from storyspark.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, ties, repeated rows, a missing id, a long text.
ODD = [
    (1, "a b c d e", "en", "s", 9),
    (1, "a b c d e", "en", "s", 9),
    (1, "another text under the same id", "en", "s", 9),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \t\n", "de", "s", 3),
    (None, "a b c d e", "en", "s", 9),
    (5, "A B C D E", None, "s", 9),
    (6, "wörter über ßtraße 東京   x " * 3000, "de", "s", 9),
]


def docs_of(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, DOCS)


def clashing(df):
    """The same table with columns whose names the operators use inside."""
    names = ["id", "fp", "node", "u", "v", "how", "key", "tag", "none", "pos", "word", "spans", "ids", "part", "n", "items", "__top"]
    return df.withColumns({n: F.lit("x") for n in names})


def texts_of(spark, sf=SF):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


# --- components and SimHash


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, None), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p if x is not None}
    for _ in range(200):
        for a, b in pairs:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != v}


def test_components_with_a_node_of_very_many_links(spark):
    hub, n = 5000, 1500
    pairs = [(hub, k) for k in range(6000, 6000 + n)] + [(20_000 + k, 6000 + k) for k in range(n)] + [(hub, 40), (40, 39)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: 39 for p in pairs for x in p if x != 39}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps):
    """fps: id -> fingerprint; the smallest id that links reach."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    return label


def slow_copies(texts):
    """texts: id -> text; the smallest id that links of five-word similarity 0.8 or more reach."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if label[b] < label[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return label


def test_simhash_against_brute_force(spark):
    texts = texts_of(spark)
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_groups(fps)


def test_simhash_heavy_buckets_are_divided(spark):
    """Buckets over the limit, first and second level, lose no link."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {int(rng.integers(1 << 62)) for _ in range(50)}
    fps |= {base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(1, 6), replace=False)) for _ in range(300)}
    nodes = [(f - (1 << 64) if f >> 63 else f, n) for n, f in enumerate(sorted(fps))]
    found = components(simhash.links(spark.createDataFrame(nodes, "fp long, node long"), limit=5))
    got = {r.node: r.component for r in found.collect()}
    want = slow_groups({n: f & (1 << 64) - 1 for f, n in nodes})
    assert got == {k: v for k, v in want.items() if k != v}


def test_simhash_odd_rows(spark):
    for df in (docs_of(spark), clashing(docs_of(spark))):
        rows = simhash.near_duplicates(df).collect()
        assert len(rows) == len(ODD)
        by = Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows)
        same = f"{slow_fingerprint('a b c d e'):016x}"
        assert by[(1, same, 1)] == 2 and by[(None, same, None)] == 1 and by[(5, same, 1)] == 1
        assert [by[(i, "0" * 16, 2)] for i in (2, 3, 4)] == [1, 1, 1]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    kept = simhash.keep_one(docs_of(spark))
    assert kept.columns == docs_of(spark).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 6]


# --- WARC


def test_warc_round_trip_and_revisits(spark):
    long = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "http://a/4\n", "short"), (5, "u", "short"), (6, "u", "ü" * 500), (7, "u", "ü" * 500), (7, "u", "ü" * 500), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (pages, pages.withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("first", F.lit(3))):
        got = warc.read_archives(warc.write_archives(df)).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
            [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "revisit", 7), (7, "response", None), (7, "response", None), (None, "revisit", 2)]
        )
        html = {i: (h or "").encode() for i, _, h in rows}
        for r in got:
            assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_archive_form(tmp_path):
    import zstandard

    records = [warc.record(i, f"http://h/{i}", b"<html>%d common text of all pages</html>" % i * 50, "0" * 40, None) for i in range(2500)]
    with open(tmp_path / "a", "wb") as f:
        archive = warc.Archive(f)
        for r in records:
            archive.add(r)
        archive.begin()
    data = (tmp_path / "a").read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8:12] == warc.DICTIONARY
    with open(tmp_path / "a", "rb") as f:
        assert list(warc.records_of(f)) == records
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)


# --- language ID


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op3_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars > 500").collect()}
    a, b = texts["en"][:400], texts["fr"][:400]
    lang, score, spans = language.label_texts(model, [f"{a}\n{b}"])[0]
    assert [s[2] for s in spans] == ["en", "fr"] and abs(spans[0][1] - 400) < 30 and 0.4 < score < 0.7
    assert language.label_texts(model, ["", None, "123 .,-"]) == [("und", 0.0, [])] * 3


def test_language_sample_is_drawn_by_share(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort satz "), F.col("id")).alias("text"), F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"))
    counted = language.train(docs, sample=1000)
    assert counted.languages == ("de", "en")
    whole = language.train(docs.where("lang = 'de'"), sample=1000)
    again = language.train(docs.repartition(7), sample=1000)
    assert (again.scores == counted.scores).all() and whole.languages == ("de",)
    with pytest.raises(ValueError):
        language.train(docs.withColumn("lang", F.col("doc_id").cast("string")))


def test_keep_least_of_repeated_ids_with_maps(spark):
    rows = [(1, {"a": "x"}, "y"), (1, {"a": "z"}, "y"), (2, None, "y"), (None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, extra map<string,string>, kept_id string").withColumn("text", F.lit("one two three four five six"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1]


def test_viterbi_against_plain_loop():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 17, 1, 9, 17])
    scores = rng.normal(0, 3, (sizes.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, sizes, 2.0)

    def total(part, path):
        return sum(part[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    at = 0
    for n in sizes:
        part = scores[at : at + n]
        best = [(0.0, [])] if n == 0 else [(float(part[0, k]), [k]) for k in range(3)]
        for t in range(1, n):
            best = [max(((s - 2.0 * (p[-1] != k) + float(part[t, k]), [*p, k]) for s, p in best), key=lambda x: x[0]) for k in range(3)]
        want = max(best, key=lambda x: x[0])[1]
        assert total(part, got[at : at + n].tolist()) == pytest.approx(total(part, want), abs=1e-3)
        at += n


def slow_label(model, text):
    """Language, score and spans of a text, letter by letter and word by word."""
    import unicodedata

    def script(c):
        return next(n for a, n in reversed(language.SCRIPTS) if ord(c) >= a)

    words, now = [], []
    for i, c in enumerate(text):
        if unicodedata.category(c)[0] == "L":
            now.append(i)
        elif now:
            words.append(now)
            now = []
    words += [now] if now else []
    if not words:
        return "und", 0.0, []
    low = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else "\0" for c in text]
    rows = []
    for w in words:
        total = np.zeros(len(model.languages))
        for i in w:
            a, b, c = (ord(low[k]) if 0 <= k < len(low) else 0 for k in (i - 1, i, i + 1))
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
            total += model.scores[((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 16]
        fine = np.array([all(model.scripts[language.NAMES.index(script(text[i])), k] for i in w) for k in range(len(model.languages))])
        rows.append(np.where(fine | ~fine.any(), total, total.min() - 2 * language.SWITCH))
    best, back = rows[0], []
    for row in rows[1:]:
        jump = best.max() - language.SWITCH
        back.append([k if best[k] >= jump else int(best.argmax()) for k in range(len(best))])
        best = np.maximum(best, jump) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    path.reverse()
    share = np.zeros(len(model.languages))
    spans = []
    for w, k in zip(words, path, strict=True):
        share[k] += len(w)
        if spans and spans[-1][2] == model.languages[k]:
            spans[-1] = (spans[-1][0], w[-1] + 1, spans[-1][2])
        else:
            spans.append((w[0], w[-1] + 1, model.languages[k]))
    return model.languages[int(share.argmax())], share.max() / share.sum(), spans


def test_language_against_slow_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = docs.where("n_chars < 3000").limit(40).collect()
    texts = [r.text for r in rows] + [a.text[:200] + " " + b.text[:200] for a, b in zip(rows, rows[7:], strict=False)] + ["東京 the ing", "Ünïcödé x\u0301y", "ΑΒΓ und der", ""]
    got = language.label_texts(model, texts)
    for text, (lang, score, spans) in zip(texts, got, strict=True):
        want = slow_label(model, text)
        assert (lang, spans) == (want[0], want[2]) and abs(score - want[1]) < 1e-9


def test_language_odd_rows(spark):
    model = language.train(docs_of(spark))
    rows = language.identify(clashing(docs_of(spark)), model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    empty = language.train(docs_of(spark, []))
    assert {r.lang_pred for r in language.identify(docs_of(spark), empty).collect()} == {"und"}
    assert language.identify(docs_of(spark, []), model).count() == 0
    assert language.keep_identified(docs_of(spark, []), model).columns == docs_of(spark).columns


# --- substrings


def slow_removal(texts, length=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_cover_is_a_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_substrings_against_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, SF).collect()}
    assert got == slow_removal(texts_of(spark))


def test_substrings_edges(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 50)
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    p34, p35, p60 = word(34), word(35), word(60)
    texts = {}
    for i in range(8):
        texts[i] = " ".join(word(int(rng.integers(0, 25))) + [p34, p35, p60][i % 3] + word(int(rng.integers(0, 25))))
    texts[8] = " ".join(["same"] * 120)  # overlaps itself
    texts[9] = "\t".join(p60[:50] + p60)
    texts[10], texts[11] = "", None
    for at in range(3):
        rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs_of(spark, rows).repartition(at + 1)).collect()}
        assert got == slow_removal(texts)
        texts[2] = "shift " + texts[2]
    rows = substrings.remove_repeats(clashing(docs_of(spark))).collect()
    assert len(rows) == len(ODD) and {r.kept for r in rows if r.doc_id == 2} == {""}
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_substrings_of_rows_without_ids(spark):
    """Texts whose 32-bit hashes are equal, and a thousand equal rows, all without an id."""
    rng = np.random.default_rng(12)
    said = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(3)]
    hashes = spark.range(300_000).select(F.concat(F.lit(said[0] + " "), F.col("id")).alias("a"), F.concat(F.lit(said[1] + " "), F.col("id")).alias("b"))
    one, two = (hashes.select(F.hash(c, F.lit(True)).alias("h"), F.col(c).alias(c)) for c in ("a", "b"))
    twin = one.join(two, "h").first()
    assert twin is not None  # the two differ, their hashes don't
    texts = [twin.a, twin.b, "before " + " ".join(said[0].split()[:45])] + [said[2]] * 1000
    want = sorted(slow_removal(dict(enumerate(texts))).values())
    rows = substrings.remove_repeats(docs_of(spark, [(None, t, "en", "s", 0) for t in texts])).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert {r.doc_id for r in rows} == {None} and next(r for r in rows if r.kept == twin.b).n_removed == 0


# --- decontamination


def test_masks_find_any_two_substitutions():
    for a in range(12):
        for b in range(a, 12):
            hit = False
            for mask in decontaminate.MASKS:
                for at in range(12 - len(mask) + 1):
                    hit |= all(kept == "0" or at + k not in (a, b) for k, kept in enumerate(mask))
            assert hit, (a, b)


def test_decontamination_finds_plants_and_leaves_others(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    texts = texts_of(spark)
    norm = lambda t: " ".join(decontaminate.tokens(t))
    want = {(i, b.item_id) for i, t in texts.items() for b in bench if norm(b.text) in norm(t)}
    got = {(r.doc_id, x) for r in queries.op5_decontaminate(spark, SF).collect() for x in r.item_ids}
    assert want and want <= got and len({d for d, _ in got}) <= len({d for d, _ in want}) + 2
    item = decontaminate.tokens(bench[0].text)
    worse = ["other" if k % 6 == 3 else w for k, w in enumerate(item)]
    half = item[: len(item) // 2]
    rows = [(1, "Before. " + ", ".join(worse).upper() + " after", "en", "s", 0), (2, "x " + " ".join(half) + " y", "en", "s", 0), (3, " ".join(sorted(item)), "en", "s", 0)]
    marks = decontaminate.contaminated(clashing(docs_of(spark, ODD[2:6] + [(r[0] + 10, *r[1:]) for r in rows])), spark.createDataFrame(bench))
    assert {r.doc_id: r.item_ids for r in marks.collect()} == {11: [bench[0].item_id], 12: [bench[0].item_id]}


def slow_overlap(ours, item):
    """Matches and covered places of an item in a text, over all shifts, by plain loops; none without a hit of a mask."""
    most, covered = 0, set()
    for shift in range(1 - len(item), len(ours)):
        at = [k for k in range(len(item)) if 0 <= k + shift < len(ours)]
        same = {k: ours[k + shift] == item[k] for k in at}
        masks = [m for m in decontaminate.MASKS] + [m for m in decontaminate.SHORT if len(m) == len(item)]
        if not any(all(x == "0" or same.get(k + i) for i, x in enumerate(m)) and k + len(m) <= at[-1] + 1 for m in masks for k in at):
            continue
        best, span = (0, 0, 0), None
        for a in at:
            score = n = 0
            for b in range(a, at[-1] + 1):
                score, n = (score + 1, n + 1) if same[b] else (score - decontaminate.PENALTY, n)
                if score > best[0]:
                    best, span = (score, n, 0), (a, b + 1)
        n = best[1]
        if n < decontaminate.LEAST <= len(at):
            size = min(decontaminate.SPAN, len(at))
            sums = [(sum(same[k] for k in range(a, a + size)), -a) for a in at if a + size <= at[-1] + 1]
            if max(sums)[0] >= decontaminate.LEAST:
                n, span = max(sums)[0], (-max(sums)[1], -max(sums)[1] + size)
        if n >= min(decontaminate.LEAST, len(item)):
            most = max(most, n)
            covered |= set(range(*span))
    return most, len(covered) / len(item) if item else 0


def slow_contaminated(texts, items):
    """texts, items: id -> text. id -> (item ids, matched, share)."""
    out = {}
    cut = {i: decontaminate.tokens(t) for i, t in items.items()}
    for i, t in texts.items():
        ours = decontaminate.tokens(t)
        found = {j: slow_overlap(ours, x) for j, x in cut.items() if set(x) & set(ours)}
        found = {j: x for j, x in found.items() if x[0]}
        if found:
            out[i] = (sorted(found), max(x[0] for x in found.values()), max(x[1] for x in found.values()))
    return out


def mixed_texts(seed=3):
    """Items and texts that hold them whole, in part, with substitutions, and of few different tokens."""
    rng = np.random.default_rng(seed)
    word = lambda n, m=400: [f"w{x}" for x in rng.integers(0, m, n)]
    items = {k: word(int(rng.integers(1, 40))) for k in range(12)} | {20: ["a"] * 30, 21: ["a", "b"] * 12, 22: ["a", "b", "c"] * 6, 23: word(15, 3)}
    texts = {0: ["a"] * 70, 1: ["a", "b"] * 40, 2: ["a", "b", "c"] * 20, 3: word(60, 3), 4: []}
    for i in range(10, 34):
        item = list(items[i % 12])
        for at in rng.integers(0, len(item), int(rng.integers(0, 1 + len(item) // 5))):
            item[at] = "other"
        cut = int(rng.integers(0, len(item)))
        texts[i] = word(10) + (item if i % 3 else item[cut:]) + word(10) + (item[:cut] if i % 2 else [])
    return {i: " ".join(w) for i, w in texts.items()}, {i: " ".join(w) for i, w in items.items()}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_decontamination_against_plain_loops(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", broadcast)
    texts, items = mixed_texts()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    got = {r.doc_id: (r.item_ids, r.matched, pytest.approx(r.share)) for r in decontaminate.contaminated(docs, bench).collect()}
    want = slow_contaminated(texts, items)
    assert want == got and 10 < len(want)
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == set(texts) - set(want)


def test_decontamination_of_repeated_tokens_stays_small(spark):
    bench = spark.createDataFrame([(1, "a " * 1000), (2, "a b " * 500)], "item_id long, text string")
    docs = docs_of(spark, [(1, "a " * 8000, "en", "s", 0), (2, "b a " * 4000, "en", "s", 0)])
    got = {r.doc_id: (r.item_ids, r.matched) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: ([1], 1000), 2: ([2], 1000)}
    group, key, start, gap, n = decontaminate.series(np.zeros(9, np.int64), np.array([7] * 8 + [9], np.uint64), np.array([0, 2, 4, 6, 7, 8, 9, 20, 5]))
    assert sorted(zip(key.tolist(), start.tolist(), gap.tolist(), n.tolist(), strict=True)) == [(7, 0, 2, 4), (7, 6, 1, 4), (7, 9, 11, 2), (9, 5, 1, 1)]


def test_decontamination_with_a_large_filter(spark, monkeypatch):
    texts, items = mixed_texts(5)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    told = lambda: sorted((r.doc_id, r.item_ids, r.matched) for r in decontaminate.contaminated(docs, bench).collect())
    want = told()
    for power in (6, 25):  # one that lets all through, and one with eight bits a byte
        monkeypatch.setattr(decontaminate, "FILTER_LEAST", power)
        monkeypatch.setattr(decontaminate, "FILTER_MOST", power)
        assert told() == want


def test_decontamination_of_tables_and_empty(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len(whole)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()


# --- neighbours


def slow_neighbours(rows, every=100, k=10):
    out = {}
    for q, v in rows:
        if q % every == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def test_neighbours_recall_and_scores(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = slow_neighbours(rows)
    got = {}
    for r in queries.op6_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    by = dict(rows)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert [i for i, _ in found] == [i for _, i in sorted((s, i) for i, s in found)]
        for i, s in found:
            assert s == pytest.approx(float(np.sqrt(((np.array(by[q]) - np.array(by[i])) ** 2).sum())), rel=1e-12)


def test_neighbours_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(0, 60)] + [(i, rng.normal(size=3).tolist()) for i in range(60, 330)]
    odd = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [1.0, float("nan"), 2.0]), (None, hot), (800, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *odd, rows[0], rows[100]], "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("vector", F.lit(2))
    got = {}
    for r in neighbours.search(df, chunk=16, share=6.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = slow_neighbours([*rows, (800, [1.0, 2.0, 0.0])])  # the shorter vector ends in zeros
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    few = spark.createDataFrame([(0, hot), (1, [1.0, 1.0, 1.0])], df.schema["vec_id"].name + " long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few).collect()] == [(0, 1, 1)]
    assert neighbours.search(df.limit(0)).count() == 0


# --- token files


def test_token_files_against_library(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = texts_of(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    files = tokenfiles.write_ids(docs, path, file_ids=40_000)
    assert files.count() > 3
    got = {r.doc_id: r for r in tokenfiles.read_ids(files).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*own.encode(texts[i], add_special_tokens=False).ids, 1]
        r = got.pop(i)
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_pieces_encode_like_whole_texts():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "  ", "It's we'LL \u00a0x\u3000y\u2003z", "a\u0301 \u0301b e\u0301", "x\x1cy\x1f z\x85w", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ Σ", "İstanbul ß", "東京123abc!!?", "a" * 3000, "\x00 \t\r\n\x0b\x0c", "🙂 👍🏽"]
    odd += ["End. end, END... e., é, É. x,\u0301 y.\u0301 A\u0301, q,", "<|EndOfText|>, a. <|endoftext|>. B,", "a,b. c.,d ,e .f İ, ß. Σ. ΣΣ, 1. 2, don't. I'LL,"]
    kept: dict = {}
    for _ in range(2):
        ids, lengths = tokenfiles.encode_batch(own, kept, pa.array([None, *odd, None]).slice(1, len(odd)))
        got = np.split(ids, np.cumsum(lengths)[:-1])
        assert [g.tolist() for g in got] == [[*own.encode(t, add_special_tokens=False).ids, 1] for t in odd]
    assert tokenfiles.encode_batch(own, kept, pa.array([], pa.string()))[0].tolist() == []
    assert tokenfiles.encode_batch(own, kept, pa.array([None, "a"]))[0].tolist()[0] == 1


def test_coder_round_trip_and_damage(tmp_path):
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.3, n).clip(max=49407).astype(np.uint32) for n in (1, 700, 3, 2000, 5)]
    blocks += [np.full(3000, 49407, np.uint32), np.tile(np.array([5, 9, 11], np.uint32), 900), np.array([65535, 0], np.uint32)]
    shares = tokenfiles.shares_of(np.concatenate(blocks))
    blobs = tokenfiles.encode_blocks(blocks, *shares)
    for a, b in zip(tokenfiles.decode_blocks(blobs, [len(b) for b in blocks], *shares), blocks, strict=True):
        assert (a == b).all()
    assert tokenfiles.decode_blocks(blobs[1:2], [700], *shares)[0].tolist() == blocks[1].tolist()  # blocks stand alone
    assert len(blobs[6]) < 1500 and len(blobs[5]) < 1500
    with open(tmp_path / "x", "wb") as f:
        tokenfiles.write_file(f, [3, None], np.array([2, 698]), blocks[1])
    data = bytearray((tmp_path / "x").read_bytes())
    import io

    docs, lengths, ids = tokenfiles.read_file(io.BytesIO(bytes(data)))
    assert docs == [3, None] and lengths.tolist() == [2, 698] and (ids == blocks[1]).all()
    data[-100] ^= 255
    with pytest.raises(ValueError):
        tokenfiles.read_file(io.BytesIO(bytes(data)))


def test_token_files_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokenfiles.read_ids(tokenfiles.write_ids(clashing(docs_of(spark)), path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 2, 3, 4, 5, 6] and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert [r.ids for r in rows if r.doc_id in (2, 3, 4)] == [[1]] * 3
    assert tokenfiles.read_ids(tokenfiles.write_ids(docs_of(spark, []), path)).count() == 0


# --- byte-level BPE


def test_byte_bpe_against_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bytebpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    codec = bytebpe.codec(path, public_tokenizers.PATTERN)
    odd = ["", " ", "▁ ▁x", "a", "it's  we'll\n\n\n x", "東京 ñandú ßtraße 12345", "<|endoftext|> <unk> <s>", "a" * 3000, "\x00\x01\t\r\n", "🙂👍🏽", "=" * 70 + "   "]
    for text in [*odd, *texts_of(spark).values()]:
        ids = own.encode_ordinary(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == text.encode()
        assert codec.digests(codec.pieces(text)) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = bytebpe.encode_texts(clashing(docs_of(spark)), path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) and [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert bytebpe.encode_texts(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


# --- chat


def slow_chat(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat(spark, SF).collect()}
    assert got == {k: slow_chat(v) for k, v in want.items()}


def test_chat_is_reversible(spark):
    texts = ["", "\\", "\\\\", "#", "##", "###", "####", "#####", "\\#", "#\\#", "</turn>", "<\\/turn>", "</turn>\n### assistant: x", ": ", "a: b", "é\U0001f642\r\n", "x" * 5000, "\\n $1 \\E"]
    rows = [(c, k, role, t) for c, t in enumerate(texts) for k, role in enumerate(["user", "assistant", "to: ol\\", "", None])]
    rows += [(100, None, None, None), (100, 1, "user", "b"), (100, 1, "user", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want: dict = {}
    for c, k, r, t in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df.withColumn("record", F.lit(1)).withColumn("rows", F.lit(2))).collect()}
    assert got == {k: slow_chat(v) for k, v in want.items()}
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"source":"x"}', "messages"),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations"),
        (3, '{"response":"b","prompt":"a"}', "prompt_response"),
        (4, '{"instruction":"a","input":"","output":"b"}', "instruction"),
        (5, '{"instruction":"a","output":"b"}', "instruction_only"),
        (6, '{"question":"a","answer":"b","id":7}', "question_answer"),
        (7, '{"prompt":"[{\\"role\\":1}]","completion":"b"}', "prompt_completion"),
        (8, '{"other":1}', None),
        (9, "not json", None),
        (10, None, None),
        (11, '{"messages":[]}', None),
    ]
    df = spark.createDataFrame([r[:2] for r in records], "id int, record string").withColumn("layout", F.lit("old"))
    got = {r.id: r for r in chat.formatted(chat.canonical(df)).collect()}
    assert {i: r.layout for i, r in got.items()} == {r[0]: r[2] for r in records}
    assert all([(t.role, t.text) for t in got[i].turns] == [("user", "a"), ("assistant", "b")] for i in (1, 2, 3, 4, 5, 6))
    assert got[1].formatted == "### user: a</turn>\n### assistant: b</turn>\n" and got[9].formatted is None
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["b"]


# --- secrets


def slow_base(text):
    found = []
    for k, (pattern, flags, least, group) in enumerate(
        [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 8, 2), (r"AKIA[A-Z0-9]+", 0, 16, 0), (r"[0-9a-f]+", 0, 32, 0)]
    ):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_against_brute_force(spark):
    texts = texts_of(spark)
    for r in queries.op10_secrets(spark, SF).collect():
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("markov")) == base


def slow_terms(secret, ordinary, text):
    """Log-likelihood ratio of each character of a string, by counts in dictionaries; the start is a character of its own."""
    size, terms = len(secrets.ALPHABET) + 1, np.zeros(len(text))
    padded = lambda t: ["", "", *t]
    for sign, sample in ((1, secret), (-1, ordinary)):
        none, one, two = Counter(), Counter(), Counter()
        for t in sample:
            p = padded(t)
            for a, b, c in zip(p, p[1:], p[2:], strict=False):
                none[c] += 1
                one[b, c] += 1
                two[a, b, c] += 1
        of_one, of_two = Counter(), Counter()
        for (b, _), n in one.items():
            of_one[b] += n
        for (a, b, _), n in two.items():
            of_two[a, b] += n
        total = sum(none.values()) + size
        first = lambda c: (none[c] + 1) / total
        second = lambda b, c: (one[b, c] + 4 * first(c)) / (of_one[b] + 4)
        p = padded(text)
        terms += sign * np.array([np.log((two[a, b, c] + 4 * second(b, c)) / (of_two[a, b] + 4)) for a, b, c in zip(p, p[1:], p[2:], strict=False)])
    return terms


def test_secret_spans_against_slow_ratios(spark):
    """Strings of all lengths, alone and joined to base spans: what a base span leaves is scored by itself."""
    good, plain = secrets.random_strings(300, 3), secrets.identifiers(300, 4)
    model = secrets.Model(good, plain)
    rng = np.random.default_rng(8)
    tried = secrets.random_strings(60, 5) + secrets.identifiers(60, 6) + ["".join(rng.choice(list("abcdeXYZ019+/_"), n)) for n in rng.integers(1, 40, 60)]
    for x in tried:
        assert abs(model.score(x) - slow_terms(good, plain, x).mean()) < 1e-9
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(10)]
    tried += [f"{x}_{h}" for x, h in zip(tried, hexes, strict=False)] + [f"{h}_{x}" for x, h in zip(tried[5:], hexes, strict=False)] + ["é" + tried[0] + "é", f"password={tried[1]}/{tried[2]}"]
    text = " ".join(tried)
    base = secrets.base_spans(text)
    free = "".join(" " if any(a <= i < b for _, a, b in base) else c for i, c in enumerate(text))
    want = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", free):
        if np.minimum(slow_terms(good, plain, m.group()), secrets.MOST).sum() > max(secrets.LEAST * len(m.group()), secrets.NEEDED):
            want.append(m.span())
    assert [(a, b) for k, a, b in secrets.all_spans(model, text) if k == "markov"] == want and len(want) > 30
    joined = tried[0] + "_" + hexes[0]
    assert [k for k, *_ in secrets.all_spans(model, joined)] == ["markov", "hex"]


def test_secret_spans_of_long_texts_take_linear_time():
    model = secrets.Model(secrets.random_strings(300, 3), secrets.identifiers(300, 4))
    text = " ".join(f"{x} password=abcdefghij" for x in secrets.random_strings(4000, 6))[:250_000]
    start = time.perf_counter()
    assert len(secrets.all_spans(model, text)) > 5000
    secrets.strings_of(text)
    assert time.perf_counter() - start < 0.6


def test_secrets_models(spark):
    model = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    random = secrets.random_strings(400, seed=99)
    plain = ["internationalization_of_the_library", "getApplicationConfigurationProperties", "Donaudampfschifffahrtsgesellschaft", "/usr/local/share/documentation/index", "2024-01-01-release-candidate-notes"]
    assert sum(model.score(x) > secrets.LEAST for x in random) >= 0.95 * len(random)
    assert not [x for x in plain if model.score(x) > secrets.LEAST]
    text = "key q9Zx7LmP2vRt8KwY4bNs1 and internationalization_of_the_library"
    assert secrets.all_spans(model, text) == [("markov", 4, 25)]
    odd = ["", "password: short", 'API_KEY = "abcdefgh12"', "tokeN=passwd=secret=abcdefghij", "paſſword=abcdefghijk", "AKIAAKIAAKIAAKIA1", "AKIA" + "Z" * 11, "f" * 31 + " " + "0" * 32, "password:token:\"abcdefghij\""]
    for t in odd:
        assert secrets._told(secrets.base_spans(t)) == slow_base(t)
    rows = secrets.scan(clashing(docs_of(spark)), model).collect()
    assert len(rows) == len(ODD)
    assert secrets.scan(docs_of(spark, []), secrets.train(docs_of(spark, []))).count() == 0
    out = secrets.redact(docs_of(spark, [(1, "a password=abcdefghij b", "en", "s", 23), (2, None, "en", "s", 5), (3, "clean", "en", "s", 5)]), model)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "a [SECRET] b", 12), (2, None, 5), (3, "clean", 5)]


# --- pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model, hidden = language.train(docs), None
    labels = {i: language.label_texts(model, [r.text])[0] for i, r in rows.items()}
    kept = {i for i, (lang, score, _) in labels.items() if lang != "und" and score >= 0.5}
    groups = slow_copies({i: rows[i].text for i in kept})  # the stage's rule: five words, similarity 0.8
    kept = {i for i in kept if groups[i] == i}
    kept -= {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}  # held to plain loops above
    hidden = secrets.train(docs.where(F.col("doc_id").isin(sorted(kept))))
    codec = bytebpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept and len(kept) > 0.7 * len(rows)
    for i in kept:
        text = rows[i].text
        for _, a, b in reversed(secrets.all_spans(hidden, text)):
            text = text[:a] + "[SECRET]" + text[b:]
        assert got[i].ids == codec.encode(text)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    for df in (docs_of(spark), clashing(docs_of(spark)), docs_of(spark, [])):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns, name
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= {r[0] for r in ODD}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_what_operators_wrote_is_discarded(spark):
    from pathlib import Path

    from storyspark.llm import common

    rows = common.written(spark.range(3), "some")
    path = rows.inputFiles()[0].removeprefix("file://")
    assert Path(path).exists()
    common.discard(spark)
    assert not Path(path).exists() and not common._MADE
