"""The pipeline's near-dedup against exact similarities of all pairs."""

from __future__ import annotations

import numpy as np

from storyspark.llm import nearcopies

from .test_operators import ODD, clashing, docs_of


def slow_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
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


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(5000, size=rng.integers(60, 400))]
        for c in range(5):
            copy = list(words)
            for at in rng.choice(len(words), c * len(words) // 90, replace=False):
                copy[at] = "other"
            texts[len(texts)] = " ".join(copy)
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {1000 + i: t for i, t in rows.items()}
    want = slow_groups(texts)
    got = {r.doc_id: r.component_id for r in nearcopies.groups(docs_of(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])).collect()}
    assert got == want
    assert want[1177] == 1001 and want[1145] == 1006  # 11 and 7 bits of op1's fingerprint apart
    assert len({want[i] for i in range(60)}) < 60


def test_near_copies_odd_rows(spark):
    for df in (docs_of(spark), clashing(docs_of(spark))):
        kept = nearcopies.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 6]
    assert len(nearcopies.groups(docs_of(spark)).collect()) == len(ODD)
    assert nearcopies.keep_one(docs_of(spark, [])).count() == 0


def test_near_copies_in_blocks(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(5000, size=120)]
    texts = {}
    for i in range(60):  # a hot bucket: copies of one text that are near to it, but often not to each other
        copy = list(words)
        for at in rng.choice(len(words), int(rng.integers(0, 4)), replace=False):
            copy[at] = f"x{i}"
        texts[i] = " ".join(copy)
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in nearcopies.groups(docs, block=1000).collect()}
    assert got == slow_groups(texts)


def test_spanning_joins_what_a_plain_search_joins():
    rng = np.random.default_rng(9)
    common = rng.integers(1 << 60, size=40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: rng.integers(30, 41)], rng.integers(1 << 60, size=rng.integers(0, 12), dtype=np.uint64)])) for _ in range(80)]
    label = list(range(80))
    for _ in range(80):
        for a in range(80):
            for b in range(80):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    label[b] = min(label[a], label[b])
    got = list(range(80))
    for u, v in sorted(nearcopies.spanning(sets, list(range(80)))):
        assert v < u
        got[u] = got[v]
    assert got == label
    assert 1 < len(set(label)) < 80


def test_simhash_alone_finds_pairs_of_the_least_similarity():
    rng = np.random.default_rng(5)
    for n, many in ((4, 400), (9, 400), (18, 400), (90, 300), (360, 100)):
        sides = [[], []]
        for _ in range(many):
            h = rng.integers(1 << 63, size=n + max(1, n // 9), dtype=np.uint64)
            sides[0].append(nearcopies.sums(h[:n]))
            sides[1].append(nearcopies.sums(h[n // 9 :]))  # n=4: one more of five; else a ninth of each is its own: similarity 0.8
        (ka, ca), (kb, cb) = (nearcopies.keys(nearcopies.prints(np.array(x))) for x in sides)
        share = np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(ka, kb)])
        near = nearcopies.alike(*(ca ^ cb).T)
        assert (share & near).mean() >= 0.995, n
        assert not nearcopies.alike(*(ca ^ np.roll(ca, 1, axis=0)).T).any(), n


def test_buckets_link_what_all_pairs_link():
    rng = np.random.default_rng(8)
    key = np.sort(np.concatenate([np.repeat(5, 600), rng.integers(10, 200, size=500)]).astype(np.int32))
    bits = rng.integers(-(1 << 63), 1 << 63, size=(30, 2), dtype=np.int64)[rng.integers(30, size=len(key))]
    for _ in range(40):  # flips that put some rows of one origin beyond the radius of each other
        bits[np.arange(len(key)), rng.integers(2, size=len(key))] ^= np.int64(1) << rng.integers(63, size=len(key))
    node = rng.permutation(len(key))
    got = {i: i for i in node.tolist()}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    def settle(pairs):
        for u, v in pairs:
            a, b = sorted((root(int(u)), root(int(v))))
            got[b] = a
        return {i: root(i) for i in got}

    found = settle(nearcopies.near(key, node, bits[:, 0], bits[:, 1]))
    got = {i: i for i in node.tolist()}
    apart = np.array([[bin((int(x[0]) ^ int(y[0])) & (1 << 64) - 1).count("1") + bin((int(x[1]) ^ int(y[1])) & (1 << 64) - 1).count("1") for y in bits] for x in bits])
    u, v = np.nonzero((apart <= nearcopies.RADIUS) & (key[:, None] == key))
    assert found == settle(zip(node[u], node[v], strict=True))
    assert 30 < len(set(found.values())) < len(key)


def test_buckets_yield_fewer_links_than_nodes(monkeypatch):
    many = (2, 200, 256, 300)  # up to 256 all pairs are compared, here all are near; the nodes of the second half are those of the first
    key = np.repeat(np.arange(2 * len(many), dtype=np.int32), 2 * many)
    node = np.tile(np.random.default_rng(3).permutation(sum(many)), 2)
    same = np.zeros(len(key), np.int64)
    for held in (nearcopies.HELD, 100):
        monkeypatch.setattr(nearcopies, "HELD", held)
        links = nearcopies.near(key, node, same, same)
        assert len(links) == sum(many) - len(many) and (links[:, 0] < links[:, 1]).all()
        assert np.unique(links, return_counts=True)[1].max() <= nearcopies.FAN + 1
        found = {n: n for n in node.tolist()}
        for u, v in links[np.argsort(links[:, 1])].tolist():
            found[v] = found[u]
        ends = np.cumsum(many)
        assert all(found[n] == node[a:b].min() for a, b in zip(ends - many, ends, strict=True) for n in node[a:b].tolist())
    assert nearcopies.near(key[:1], node[:1], same[:1], same[:1]).shape == (0, 2)
