import random
from hashlib import sha256
from itertools import combinations, permutations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import bk_tree as B, filter_audit as A, joins as J, merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _at long, shard string, g int, fp string"
ODD = [None, "", "  \n", "A", "THE BIG SIX", "one two", "a#b", "x" * 5000, "word " * 3000, "ÀÉ é ß\x1cx", "tab\tand\x0bmore\rlines"]


def documents(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "s", 2, "f") for r in rows], SCHEMA)


def random_rows(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["BIG", "$5"]
    out = []
    for i in range(n):
        text = r.choice(ODD) if r.random() < 0.3 else " ".join(r.choices(vocabulary, k=r.choice([3, 45, 55, 120])))
        out.append((i if r.random() < 0.97 else None, text, r.choice(["en", "fr", "", None]), r.choice(["a", "b", "", None]), r.choice([None, 0, 7, 10 ** 12])))
    return out + out[:15]


# filter audit

def plain_fails(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _, source, _ in rows:
        text = text or ""
        words = text.encode().split()
        out.append((i, source or "", "".join(letter for letter, failed in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and i > least[text])) if failed)))
    return out


def plain_audit(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (0, 0))
        marks[i] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    fails, out = plain_fails(rows), {}
    for part in {p for _, p, _ in fails}:
        own = [(f, *(marks.get(i, (0, 0)) if i is not None else (0, 0))) for i, p, f in fails if p == part]
        for order in ("".join(p) for p in permutations("ABCDE")):
            for k, letter in enumerate(order):
                earlier = set(order[:k])
                removed = [x for x in own if letter in x[0] and not earlier & set(x[0])]
                out[part, order, k + 1] = [sum(not (earlier | {letter}) & set(f) for f, *_ in own), len(removed),
                                           sum(letter in f and bool(earlier & set(f)) for f, *_ in own), sum(f == letter for f, *_ in own),
                                           sum(g for _, g, _ in removed), sum(t for *_, t in removed)]
        for letter in "ABCDE":
            total = sum(out[part, o, o.index(letter) + 1][1] for o in ("".join(p) for p in permutations("ABCDE")))
            for o in permutations("ABCDE"):
                out[part, "".join(o), o.index(letter) + 1].append(total)
    return out


def test_audit_equals_plain(spark):
    rows = random_rows(150, 1)
    r = random.Random(2)
    labels = [(r.choice([None, *range(150)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(120)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
           for x in A.audit(documents(spark, rows), marks).collect()}
    assert got == plain_audit(rows, labels)


def test_hot_keys_meet_by_broadcast_and_others_by_shuffle(spark):
    rows = spark.createDataFrame([("a", i) for i in range(900)] + [(f"k{i}", i) for i in range(60)] + [(None, 1)], "k string, v int")
    keyed = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.upper("k")).filter("k <> 'k7'")
    out = J.left_by_count(rows, keyed, "k", "n", 100_000)
    assert out.columns == ["k", "v", "n", "name"]
    got = sorted((str(x["k"]), x["v"], x["name"]) for x in out.collect())
    assert got == sorted((str(k), v, None if k in (None, "k7") else k.upper()) for k, v in rows.collect())


def test_audit_of_an_empty_table(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(documents(spark, []), marks).count() == 0


def test_matrix_rows_are_the_word_counts(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET_ROWS", 10)
    rows = random_rows(80, 3)
    cut = A.shards(documents(spark, rows).repartition(7))
    words = A.dictionary(cut)
    names = {x["id"]: bytes(x["word"]) for x in words.collect()}
    assert len(set(names.values())) == len(names) == words.count()
    got = []
    for x in A.matrix(cut).collect():
        starts, columns, counts = A.unpacked(x["starts"]), np.frombuffer(x["columns"], np.int64), A.unpacked(x["counts"])
        for d, a, b in zip(x["docs"], starts, starts[1:]):
            got.append((str(d["doc_id"]), sorted((names[c], n) for c, n in zip(columns[a:b].tolist(), counts[a:b].tolist()))))
    want = []
    for i, text, *_ in rows:
        words_of = (text or "").encode().split()
        want.append((str(i), sorted((w, words_of.count(w)) for w in set(words_of))))
    assert sorted(got) == sorted(want)


def test_long_texts_are_split_between_words():
    raw = b"ab \n" * 700_000 + b"c" * 3_000_000 + b" d"
    assert A.word_counts(raw) == {b"ab": 700_000, b"c" * 3_000_000: 1, b"d": 1}


# Merkle manifest

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests, fanout):
    """Root, and for every leaf its path [(place among the run, siblings)] from the leaf up."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i:i + fanout] for i in range(0, len(digests), fanout)]
        for path, k in zip(paths, at):
            run = runs[k // fanout]
            path.append((k % fanout, [d for j, d in enumerate(run) if j != k % fanout]))
        at = [k // fanout for k in at]
        digests = [h(*run) for run in runs]
    return (digests[0] if digests else None), paths


def plain_manifest(rows, fanout=2):
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, plain_leaf(i, text, lang, source, n), n, (i, text, lang, source)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, upper in zip(names, above):
        for (_, _, digest, n, (i, text, lang, source)), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            changed = i is not None and n is not None and crc32(str(i).encode()) % 7 == 0
            node = plain_leaf(i, text, lang, source, n + 1) if changed else digest
            for k, others in path + upper:
                node = h(*others[:k], node, *others[k:])
            out.append((str(i), digest, trees[g][0], root, h(*(d for _, others in path + upper for d in others)), node, node == root))
    return sorted(out)


COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (2, 1), (7, 2), (33, 1), (90, 4), (131, 40)])
def test_merkle_query_equals_plain(spark, tmp_path, monkeypatch, n, langs):
    monkeypatch.setattr(M, "LEVELS", 2)  # several tiers of segments
    monkeypatch.setattr(M, "manifest", lambda rows, g, k, real=M.manifest: real(rows, g, k, levels=2))
    r = random.Random(n)
    rows = [(i, r.choice(ODD), r.choice([None, "", *map(str, range(langs))]) if langs > 1 else "en", r.choice(["a", None]), r.choice([None, 3])) for i in range(n)]
    rows += rows[:3] + [(None, *x[1:]) for x in rows[:2]]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(x["doc_id"]), *(x[c] for c in COLUMNS)) for x in M.query(spark, str(tmp_path)).collect())
    assert got == plain_manifest(rows)


@pytest.mark.parametrize("fanout", [3, 5])
def test_merkle_of_more_children(spark, fanout):
    rows = [(i, f"t{i}", "xy"[i % 7 == 0], "s", i) for i in range(100)]
    leaves = documents(spark, rows).select("doc_id", "lang", M.leaf(*(F.col(c) for c in M.FIELDS)).alias("digest"))
    m = M.manifest(leaves, "lang", "doc_id", fanout=fanout, levels=2)
    found = M.proofs(m).select("doc_id", "digest", "subroot", M.folded(F.col("digest"), F.col("path")).alias("back"), M.proof_digest(F.col("path")).alias("proof")).collect()
    want = {x[0]: x[1:] for x in plain_manifest([(i, t, g, s, n) for i, t, g, s, n in rows], fanout)}
    assert m.root == next(iter(want.values()))[2]
    assert all((x["digest"], x["subroot"], m.root, x["proof"]) == want[str(x["doc_id"])][:4] and x["back"] == m.root for x in found) and len(found) == 100
    records = {x["digest"]: x["children"] for x in m.groups.records().unionByName(m.top.records()).collect()}
    assert all(h(*children) == digest for digest, children in records.items()) and m.root in records


def test_merkle_request_of_a_foreign_leaf_has_no_path(spark):
    rows = [(i, f"t{i}", "x", "s", i) for i in range(9)]
    m = M.manifest(documents(spark, rows).select("doc_id", "lang", M.leaf(F.col("doc_id")).alias("digest")), "lang", "doc_id")
    asked = spark.createDataFrame([("=x", 3, "0" * 64), ("=x", 500, "0" * 64), ("=none", 0, "0" * 64)], "g string, rank long, digest string")
    assert [x["path"] for x in M.proofs(m, asked).collect()] == [None] * 3


# SimHash

def plain_fingerprint(text, words=3):
    own = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not own:
        return 0
    shingles = [b" ".join(own[i:i + words]) for i in range(max(1, len(own) - words + 1))]
    values = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(values, radius):
    part = list(range(len(values)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= radius:
            part[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(values))]


def test_fingerprints_and_components_equal_plain(spark, monkeypatch):
    rows = random_rows(120, 5)
    r = random.Random(9)
    base = " ".join(r.choices([f"u{k}" for k in range(200)], k=400)).split()
    for i in range(60):  # near copies
        words = list(base)
        words[r.randrange(400)] = "Changed"
        rows.append((1000 + i, " ".join(words), "en", "a", 1))
    texts = {(str(i), text or ""): plain_fingerprint(text) for i, text, *_ in rows}
    docs = documents(spark, rows).repartition(5)
    found = B.near_duplicates(docs, chunk=8, bin_rows=40).join(docs.select("doc_id", "text").distinct(), "doc_id")  # chunks of shards
    assert B.near_duplicates(docs).count() == len(rows)
    values = [plain_fingerprint(text) for _, text, *_ in rows]
    tops, least = plain_components(values, 3), {}
    for top, (i, *_) in zip(tops, rows):
        if i is not None:
            least[top] = min(i, least.get(top, i))
    want = {(str(i), v): least.get(top) for (i, *_), v, top in zip(rows, values, tops)}
    got = {(str(x["doc_id"]), x["fp"] % (1 << 64)): x["component_id"] for x in B.near_duplicates(docs, chunk=8, bin_rows=40).collect()}
    assert got == want and len(set(want.values())) < len(want)
    assert found.count() >= len(texts) - 10


def test_empty_table_has_no_components(spark):
    assert B.near_duplicates(documents(spark, [])).count() == 0


def test_xxh64_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_long_text_fingerprint_equals_plain():
    text = "Ab cd\tef " * 150_000 + "z" * 2_000_000 + " end"
    assert B.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius, spread", [(3, 6), (3, 20), (1, 4), (6, 12)])
def test_forest_search_equals_brute_force(radius, spread):
    rng = np.random.default_rng(radius * 100 + spread)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, spread, rng.integers(0, 5))) for _ in range(600)], np.uint64)
    fp = np.unique(centres[rng.integers(0, 3, 600)] ^ flips)
    group = np.sort(rng.integers(0, 4, len(fp)))
    pairs = B.joining_links(fp, group, 4, np.ones(len(fp), bool), np.ones(len(fp), bool), radius)
    want = []
    for g in range(4):
        at = np.flatnonzero(group == g)
        want += [(g, int(at[t])) for t in plain_components([int(v) for v in fp[at]], radius)]
    part = list(range(len(fp)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in pairs:
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= radius and top(a) != top(b)
        part[max(top(a), top(b))] = min(top(a), top(b))
    assert [(int(group[x]), top(x)) for x in range(len(fp))] == want
