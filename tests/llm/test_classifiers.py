"""Operators 4 and 6: held-out results on the test tables and the defined cases."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language_id as G, toxicity as X

SF = "/root/testdata/sf0.01"


def test_language(spark):
    out = G.query(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert not any(r["rejected"] for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", "a"), (2, "der hund und die katze sind nicht da", "de", "b"), (3, None, "en", "c"),
            (4, "", None, None), (5, "12 34 !!", "de", "d"), (6, "the dog and the cat", None, "e"), (6, "the dog and the cat", None, "e"),
            (7, "die katze und der hund " * 20_000, "de", "f"), (None, "the", "en", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = G.fit(df)
    out = {r["doc_id"]: r for r in G.identify(df, model).collect()}
    assert [out[k]["_llm_lang_pred"] for k in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert [out[k]["_llm_rejected"] for k in (1, 3, 4, 5)] == [False, True, True, True] and out[1]["score"] == "a"
    assert G.identify(df.limit(0), model).count() == 0
    nothing = G.fit(df.limit(0))
    assert {r["_llm_lang_pred"] for r in G.identify(df, nothing).collect()} == {"und"}


def test_sample_bounds_the_fit_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = G.fit(docs, sample=5)
    assert len(model.languages) == 16 and G.identify(docs, model).count() == 1000


def test_toxicity(spark):
    out = X.query(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean([s >= 0.3 for s in toxic]) > 0.85 and np.mean([s >= 0.3 for s in clean]) < 0.02


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_finds_all_misspellings():
    r = np.random.default_rng(1)
    terms = {"".join(r.choice(list("abcd"), n)): float(n) for n in (3, 4, 5, 6, 7, 9, 12, 13) for _ in range(4)}
    lexicon = X.Lexicon(terms)
    for _ in range(4000):
        term = r.choice(list(terms))
        word = list(term)
        for _ in range(r.integers(0, 4)):
            k = int(r.integers(0, len(word) + 1))
            word[k:k + int(r.integers(0, 2))] = list("".join(r.choice(list("abcd"), int(r.integers(0, 2)))))
        word = "".join(word)
        near = [(edits(word, t), -w) for t, w in terms.items() if len(word) > 2 and edits(word, t) <= X.allowed(len(t))]
        want = (-min(near)[1], min(near)[0]) if near else None
        if word in terms:
            want = (terms[word], 0)
        assert lexicon.match(word) == want


def test_quotation_and_cases(spark):
    assert X.quoted('he said "you idiot" to me', 13, 18) and not X.quoted("you idiot there", 4, 9)
    lexicon = X.Lexicon({"idiot": 3.0, "stupid*": 2.0})
    assert X.features("you IDIOT, stupidly", lexicon)[0] > 0 and X.features(None, lexicon).sum() == 0
    rows = [(i, t, y, "s") for i, (t, y) in enumerate([(f"you idiot {k} {k + 1}", 1) for k in range(30)] + [(f"fine words {k}", 0) for k in range(60)] + [(None, 0), ("", 1)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = X.fit(df)
    assert "idiot" in model.weights
    out = X.rate(df.withColumn("n", F.lit(1)), model).collect()
    assert len(out) == 96 and all(0 <= r["_llm_score"] <= 1 for r in out) and {r["score"] for r in out} == {"s"}
    assert X.rate(df.limit(0), model).count() == 0
    none = X.rate(df, X.fit(df.filter("toxic = 0"))).collect()
    assert {r["_llm_predicted"] for r in none} == {0}


def test_words_are_those_of_the_pattern():
    texts = ["".join(map(chr, range(256))), "a_b-c d e\x85f\x1cg µm² ªx ÀÉ ß", "naïve “quoted” 漢字 x_y", "", "_", "don't stop", "x" * 5000]
    for text in texts:
        assert X.words_of(text) == X._word.findall(text)


@pytest.mark.parametrize("few", [0, 1000])
def test_places_of_matching_words(monkeypatch, few):
    monkeypatch.setattr(X, "FEW", few)
    text = "ab abab ab_ab xab abx -ab- éab ab\n漢ab ab² abab ab"
    found = {"ab": (1.0, 0), "abab": (1.0, 0), "x": (1.0, 0)}
    assert X.places(text, found) == [(m.start(), m[0]) for m in X._word.finditer(text) if m[0] in found]


def test_near_terms_of_each_length_are_walked():
    """Terms that no word of this length can be near are neither in the trie nor among the pieces."""
    terms = {"abcd": 1.0, "efghi": 2.0, "jklmnopqrstu": 3.0, "xyz": 4.0, "stems*": 5.0, "stemsof": 6.0}
    lexicon = X.Lexicon(terms)
    assert set().union(*(p for *_, p in lexicon.tables(4)[0])) == {"ab", "cd", "ef", "ghi"}
    assert not lexicon.tables(8)[0] and not lexicon.tables(8)[1][0]
    assert lexicon.match("xyzz") is None and lexicon.match("xyz") == (4.0, 0) and lexicon.match("stemsoff") == (5.0, 0)
    assert lexicon.match("jkmnopqrsstu") == (3.0, 2) and lexicon.match("bcd") == (1.0, 1)


def plain_lexicon(rows):
    """Terms that pass, from all words of all texts (each of weight 1)."""
    n1 = sum(y for _, y in rows)
    n0, total, counts = len(rows) - n1, len(rows), {}
    for text, y in rows:
        words = set(text.split())
        for w in words | {f"{w[:n]}*" for w in words for n in X.STEMS if len(w) > n}:
            counts.setdefault(w, [0, 0])[1 - y] += 1
    out = {}
    for w, (t, c) in counts.items():
        df = t + c
        cells = ((t, df * n1 / total), (c, df * n0 / total), (n1 - t, (total - df) * n1 / total), (n0 - c, (total - df) * n0 / total))
        p = (t + .5 * n1 / total) / (df + .5)
        if 2 * sum(a * np.log(a / b) for a, b in cells if a) >= X.SURE and p >= .5:
            out[w] = np.log(p / max(1e-3, 1 - p)) + np.log(n0 / n1)
    return out


@pytest.mark.parametrize("share,terms", [(.1, 500_000), (.1, 0), (.6, 500_000), (.9, 500_000)])
def test_the_lexicon_is_that_of_all_words_counted(spark, monkeypatch, share, terms):
    monkeypatch.setattr(X, "BROADCAST_TERMS", terms)
    r = np.random.default_rng(int(share * 10))
    rows = []
    for i in range(600):
        y = int(r.random() < share)
        words = [f"{'toxic' if r.random() < .25 * y + .02 else 'plain'}{'abcdefgh'[r.integers(8)]}{r.integers(12)}" for _ in range(25)] + [f"own{i}x{k}" for k in range(5)]
        rows.append((" ".join(words), y))
    model = X.fit(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int").repartition(3), sample=100)
    want = plain_lexicon(rows)
    assert model.weights.keys() == want.keys() and all(abs(model.weights[w] - x) < 1e-9 for w, x in want.items())
    assert len(want) > 5 or share > .8


def test_only_wanted_words_of_clean_texts_are_counted(spark):
    rows = spark.createDataFrame([("idiotic thing", 1.0), ("idiots idiot other", .5), (None, 1.0)], "text string, weight double")
    assert {tuple(x) for x in X.count_words(rows, {"other", "idiot", "idiot*", "missing"}).collect()} == {("other", .5), ("idiot", .5), ("idiot*", 1.5)}
    assert X.count_words(rows).count() == 7
