"""Operators 3 and 9 and the near-duplicate join against plain versions."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import components as C, ngram_join as J, suffix_array as A, suffix_tree as S
from tickloom.llm.common import stored
from tickloom.llm.windows import runs

SCHEMA = "doc_id long, text string, key long, spans string, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def passages(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(200)]
    shared = [" ".join(r.choices(words, k=r.randint(30, 90))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            parts.append(r.choice(shared))
            parts.append(" ".join(r.choices(words, k=r.randint(0, 20))))
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab " * 400), (n + 3, "ab " * 300), (n + 4, rows[3][1]), (n + 5, "x" * 700), (n + 5, "x" * 700),
             (n + 6, rows[5][1]), (n + 6, "other text under the same id " * 9)]
    r.shuffle(rows)
    return rows


def plain_bytes(rows, w=100):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - w + 1):
            k = b[p:p + w]
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - w + 1):
            if first[b[p:p + w]] < (i, p):
                gone[p:p + w] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def plain_words(rows, w=50):
    first, out = {}, []
    for i, t in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for p in range(len(x) - w + 1):
            k = tuple(x[p:p + w])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(x)
        for p in range(len(x) - w + 1):
            if first[tuple(x[p:p + w])] < i:
                gone[p:p + w] = [True] * w
        out.append((i, len(x), sum(gone), " ".join(v for v, g in zip(x, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = passages(seed)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                 for r in A.remove_repeats(frame(spark, rows)).collect())
    assert got == plain_bytes(rows)
    assert sum(g[2] for g in got) > 1000


@pytest.mark.parametrize("seed,group", [(3, S.GROUP), (4, 5)])
def test_repeated_words(spark, seed, group):
    rows = passages(seed)  # a small group size makes the trees take longer prefixes, up to whole ones
    got = sorted(tuple(r) for r in S.remove_repeats(frame(spark, rows), group=group).collect())
    assert got == plain_words(rows)
    assert sum(g[2] for g in got) > 500


def test_no_rows(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert A.remove_repeats(none).count() == 0 and S.remove_repeats(none).count() == 0 and J.similar(none).count() == 0
    short = frame(spark, [(1, "a b c"), (2, "a b c"), (None, None)])
    assert {r["n_removed"] for r in A.remove_repeats(short).collect()} == {0}


def test_runs_hold_every_window_once():
    r = np.random.default_rng(5)
    units = np.concatenate([r.integers(1, 4, 900), np.ones(500), r.integers(1, 1 << 60, 300_000)]).astype(np.uint64)
    offsets = np.array([0, 30, 700, 700, 1500, 2000, len(units)])
    doc, lo, n, key, _ = runs(units, offsets, 20, 6)
    held = sorted((d, p) for d, a, c in zip(doc, lo, n) for p in range(a, a + c))
    assert held == [(d, p) for d in range(6) for p in range(offsets[d + 1] - offsets[d] - 19)]
    seen = {}
    for d, a, c, k in zip(doc[:2000], lo, n, key):
        for p in range(a, a + c):
            at = offsets[d] + p
            assert seen.setdefault(units[at:at + 20].tobytes(), k) == k  # equal windows have equal anchors


def plain_classes(rows, words=4, percent=85):
    sets = []
    for _, t in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(x[i:i + words]) for i in range(max(1, len(x) - words + 1))} if x else set())
    label = [r[0] for r in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted((r[0], len(s), c) for r, s, c in zip(rows, sets, label))


@pytest.mark.parametrize("seed", [6, 7])
def test_similar(spark, seed):
    r = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = r.choices(words, k=r.choice([3, 30, 60, 150]))
        for _ in range(r.randint(1, 12)):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\n"]).join(x).upper() if r.random() < .3 else " ".join(x)))
    rows += [(500, None), (501, " \n"), (502, "one"), (503, "One"), (504, "one two"), (7, rows[7][1])]
    got = sorted(tuple(x) for x in J.similar(frame(spark, rows)).collect())
    assert got == plain_classes(rows)
    kept = J.keep_one(frame(spark, rows)).collect()
    alone = [i for i, n, _ in got if n == 0]
    assert sorted(x["doc_id"] for x in kept) == sorted({c for _, n, c in got if n} | set(alone))
    assert kept[0].asDict().keys() == {"doc_id", "text", "key", "spans", "doc"}


@pytest.mark.parametrize("chunk", [4096, 10])
def test_similar_within_one_neighbourhood(spark, monkeypatch, chunk):
    """Copies of one text around the threshold: many components share most shingles, in one task or in pairs of chunks."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "BIN_ROWS", 30)
    monkeypatch.setattr(J, "BIN_BYTES", 2000)
    r = random.Random(chunk)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        x = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 9])):
            x[r.randrange(120)] = f"n{r.randrange(400)}"
        rows.append((i, " ".join(x)))
    got = sorted(tuple(x) for x in J.similar(frame(spark, rows)).collect())
    assert got == plain_classes(rows) and 3 < len({c for *_, c in got}) < 90


def test_neighbourhood_rows_grow_with_its_members(spark):
    """Unlinked near copies: each step of the search gives a row per member at most."""
    r = random.Random(3)
    rows = [(i, " ".join([f"c{k}" for k in range(60)] + [f"o{i}_{k}" for k in range(12)] + r.choices("xyz", k=3))) for i in range(400)]
    docs = J._texts(frame(spark, rows), "doc_id", "text")
    sets = stored(J.set_rows(docs, 4), "t-sets").withColumn("k", F.lit(1))
    groups = stored(sets.select(F.lit(1).cast("long").alias("token"), "set", "n"), "t-groups")
    none = spark.createDataFrame([], "set long, component long")
    members = stored(J.neighbourhoods(groups, none, 4096), "t-members")
    near = J.with_partners(members, sets, 85, 50_000)
    assert members.count() == 400 and near.count() <= 400


def test_points_of_sets_that_bytes_cannot_count_prune_nothing():
    small, large = np.arange(0, 256 * 200, 256, dtype=np.uint64), np.arange(0, 256 * 300, 256, dtype=np.uint64)
    points = np.stack([J.point(small), J.point(large), J.point(large[:290])])
    pairs = [set(map(int, p)) for x, y in J.RTree(points, np.array([200, 300, 290]), 85).pairs(np.arange(3), np.arange(3), lambda a, b: False) for p in zip(x, y)]
    assert {1, 2} in pairs
    assert J.linked(large, large[:290], 85) and not J.linked(small, large, 85)


def test_words_that_polynomial_hashes_confuse_differ(spark):
    """Thue-Morse words: any polynomial hash with an odd base modulo 2^64 takes a word and its complement for one."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"x {a} y z"), (4, f"x {b} y z"), (5, a)]
    got = sorted(tuple(x) for x in J.similar(frame(spark, rows)).collect())
    assert got == plain_classes(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_rtree_loses_no_pair():
    r = np.random.default_rng(8)
    points = r.poisson(3, (400, J.GROUPS))
    points[200:] = np.maximum(0, points[:200] + r.integers(-1, 2, (200, J.GROUPS)) * (r.random((200, J.GROUPS)) < .2))
    sizes, part = points.sum(axis=1), np.arange(400)
    got = {tuple(sorted(p)) for x, y in J.RTree(points.astype(np.uint8), sizes, 85, leaf=16).pairs(part, part, lambda a, b: False) for p in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400)
            if 185 * np.minimum(points[a], points[b]).sum() >= 85 * (sizes[a] + sizes[b])}
    assert got == want and len(want) > 100


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "u long, v long")
    got = {r["node"]: r["component"] for r in C.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def long_sets(seed, sizes, share):
    """Pairs of sets with this share of common shingles."""
    r = np.random.default_rng(seed)
    sets = []
    for n in sizes:
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        y = r.integers(0, 1 << 63, n + n // 40, dtype=np.uint64)
        y[:int(n * share)] = x[:int(n * share)]
        sets += [np.unique(x), np.unique(y)]
    return sets


def test_long_sets_without_common_shingles_are_not_searched_further():
    """Two points of 256 coordinates allow a link between any two sets of 10,000 shingles."""
    sets = long_sets(1, [9000, 10_000, 20_000], 0)
    every, sizes = np.arange(6), np.array([len(s) for s in sets])
    points, wide = np.stack([J.point(s) for s in sets]), [J.wide_point(s) for s in sets]

    def found(**more):
        return [p for x, y in J.RTree(points, sizes, 80, **more).pairs(every, every, lambda a, b: False) for p in zip(x, y)]
    assert len(found()) > 3 and not found(wide=wide)
    assert max(map(len, wide)) * 4 <= max(sizes)


def test_wide_points_lose_no_pair():
    sizes = [1500, 2040, 2050, 4090, 4100, 9000, 16_300, 16_500, 40_000]
    sets = long_sets(2, sizes, .95)
    assert len({len(J.wide_point(s)) for s in sets}) > 4
    wide, x = J.WidePoints([J.wide_point(s) for s in sets]), np.arange(len(sets))
    for i in x:
        common = [len(np.intersect1d(sets[i], s)) for s in sets]
        assert (wide.bound(np.full(len(sets), i), x) >= common).all()
    tree = J.RTree(np.stack([J.point(s) for s in sets]), np.array([len(s) for s in sets]), 80, leaf=4, wide=[J.wide_point(s) for s in sets])
    got = {(min(p), max(p)) for a, b in tree.pairs(x, x, lambda a, b: False) for p in zip(a.tolist(), b.tolist())}
    assert {(2 * i, 2 * i + 1) for i in range(len(sizes))} <= got
    hot = np.arange(0, 1 << 22, 1024, dtype=np.uint64)  # too many in a group for a byte
    assert len(J.wide_point(hot)) == 0 and J.WidePoints([J.wide_point(hot), wide.points[-1]]).bound(np.array([0]), np.array([1]))[0] > 1 << 30


def test_similar_long_texts(spark):
    r = random.Random(12)
    rows = []
    for n in (2300, 4500, 9000, 9100):
        base = [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[n // 50:])), (len(rows) + 2, " ".join(base[:n // 2] + [f"o{r.random()}" for _ in range(n // 2)]))]
    got = sorted(tuple(x) for x in J.similar(frame(spark, rows)).collect())
    assert got == plain_classes(rows) and len({c for *_, c in got}) == 8


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_texts_are_not_shuffled_to_keep_one_of_each_component(spark, monkeypatch, few):
    monkeypatch.setattr(J, "BROADCAST_IDS", few)
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, t[0]), (2, t[0] + " x"), (3, t[1]), (3, t[1]), (3, t[2]), (None, t[3]), (None, t[3]), (5, t[3]), (6, None), (6, None), (7, t[4]), (8, t[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(str, J.keep_one(docs).select("doc_id", F.substring("text", 1, 1)).collect()))
    want = [(1, "a"), (3, "b"), (3, "c"), (None, "d"), (6, None), (6, None), (7, "e")]
    assert kept == sorted(str(x) for x in spark.createDataFrame(want, "doc_id long, `substring(text, 1, 1)` string").collect())
    once = stored(spark.createDataFrame([x for x in rows if x[0] in (1, 2, 7, 8)], "doc_id long, text string"), "t-once")
    plan = J.keep_one(once)._jdf.queryExecution().executedPlan().toString()
    assert not few or "Exchange hashpartitioning" not in plan
