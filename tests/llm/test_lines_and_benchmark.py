"""Operators 2 and 5 against plain versions."""
import hashlib
import random
import re

import numpy as np
import pytest

from tickloom.llm import decontaminate as D, line_dedup as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs, last = {}, {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k] = docs.get(k, 0) + 1
            last[k] = max(last.get(k, i), i)
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        keep = [v for v in x if not (len(key(v)) >= min_chars and docs[key(v)] >= min_docs and last[key(v)] != i)]
        out.append((i, len(x), len(x) - len(keep), "\n".join(keep)))
    return sorted(out)


def line_rows(seed):
    r = random.Random(seed)
    common = [f"A Shared Line number {k} that is long enough É {'z' * k}" for k in range(6)] + ["short common line", "x" * 39, "é" * 40, "É" * 40]
    rows = []
    for i in range(40):
        x = [r.choice(common) for _ in range(r.randint(0, 5))] + [f"own line {i} {'y' * r.randint(0, 60)}"]
        x = [r.choice(["", "  ", "\t"]) + (v.upper() if v.isascii() and r.random() < .3 else v) + r.choice(["", " \r", "\x0b"]) for v in x]
        r.shuffle(x)
        rows.append((i, "\n".join(x)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, common[0] + "\n" + common[0]), (103, common[0]), (104, "long " * 40_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = line_rows(seed)
    df = spark.createDataFrame([(i, t, 5, "p") for i, t in rows], "doc_id long, text string, h1 int, shard string").repartition(3)
    out = L.drop_lines(df).collect()
    assert sorted((r["doc_id"], r["_llm_lines"], r["_llm_dropped"], r["_llm_kept"]) for r in out) == plain_lines(rows)
    assert {r["h1"] for r in out} == {5} and sum(r["_llm_dropped"] for r in out) > 20
    assert L.drop_lines(df.limit(0)).count() == 0


def test_small_shards_and_many_parts(spark):
    rows = line_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    probes = L.probes_of(df, "doc_id", "text", 40)
    index, shards = L.build_index(probes, shard_keys=7)
    few = {tuple(r) for r in L.probe_index(index, shards, probes, 5, shard_probes=3).collect()}
    assert shards > 3 and few == {tuple(r) for r in L.probe_index(*L.build_index(probes), probes, 5).collect()}


def test_perfect_hash():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 63, (50_000, 2), dtype=np.uint64)
    h[:100, 0] = h[100, 0]  # equal first halves
    levels, rest, slot = L.build(h[:, 0], h[:, 1])
    assert sorted(slot) == list(range(len(h)))
    sizes, left = [], len(h)
    for x in levels:
        sizes.append(max(64, left))
        left -= int(np.unpackbits(x).sum())
    assert (L.find(levels, sizes, rest, h[:, 0], h[:, 1]) == slot).all()
    assert sum(map(len, levels)) * 8 < 4 * len(h)  # bits per key


def plain_marks(rows, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            m = min(window, len(x))
            wins = {tuple(x[k:k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit.update(range(k, k + m))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, D.BLOCK_BYTES), (2, 200), (3, 40)])
def test_benchmark(spark, seed, block):
    r = random.Random(seed)
    words = ["a", "b", "É", "q9", "the", "_x", "don't", "日本"]
    items = [(k, r.choice([" ", "-", "\n"]).join(r.choices(words, k=r.choice([1, 2, 5, 9, 10, 14, 30])))) for k in range(12)]
    items += [(20, None), (21, "..."), (22, items[0][1]), (22, items[1][1])]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choices(words, k=r.randint(0, 40)))]
        if r.random() < .5:
            x = r.choice(items)[1] or ""
            parts.append(x.upper() if r.random() < .3 else x)
        parts.append(" ".join(f"z{r.randint(0, 99)}" for _ in range(r.randint(0, 30))))
        rows.append((i, ", ".join(parts)))
    rows += [(100, None), (101, ""), (102, "!!"), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.mark(docs, bench, block_bytes=block).collect()
    assert sorted((x["doc_id"], x["_llm_n_words"], x["_llm_n_hit"], x["_llm_n_items"], x["_llm_items_sha256"], x["_llm_contaminated"]) for x in out) \
        == plain_marks(rows, items)
    assert {x["n_words"] for x in out} == {1}
    assert not any(x["_llm_contaminated"] for x in D.mark(docs, bench.limit(0)).collect())
    assert D.mark(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 1])
def test_items_without_an_id_mark_words(spark, block):
    bench = spark.createDataFrame([(None, "x y z"), (None, None), (5, "y z q"), (None, "y z q")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a x y z b"), (2, "x y z q"), (3, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["_llm_n_hit"], r["_llm_n_items"], r["_llm_items_sha256"], r["_llm_contaminated"])
                 for r in D.mark(docs, bench, block_bytes=block).collect())
    named = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(1, 3, 0, named(""), True), (2, 4, 1, named("5"), True), (3, 0, 0, named(""), False)]
