"""Null ids, columns named like the operators' own, texts that earlier bounds cut."""
import random

import pytest

from tickloom.llm import decontaminate as D, language_id as L, line_dedup as K, ngram_join as J, toxicity as X, viterbi as V

LINE = "this line is long enough to be counted among the others"


def test_rows_without_an_id_keep_their_lines_and_count(spark):
    rows = [(None, f"{LINE}\nown {i}") for i in range(3)] + [(2 ** 60 + i, f"{LINE}\nown") for i in range(2)] + [(1, None)]
    out = K.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = sorted((str(r["doc_id"]), r["_llm_dropped"]) for r in out)
    assert kept == sorted([("None", 0)] * 3 + [(str(2 ** 60), 1), (str(2 ** 60 + 1), 0), ("1", 0)])


CLASH = "doc_id long, text string, _llm_id long, _llm_set long, _llm_gone string, _llm_kept string, _llm_n_words long, _llm_state string, _llm_score double, _llm_ids string, _llm_rejected boolean"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{LINE}\n{' '.join(random.Random(i // 2).choices('abcdefghij', k=30))}", 7, 8, "g", "k", 9, "s", .5, "i", True) for i in range(8)]
    return spark.createDataFrame(rows, CLASH).repartition(2)


def test_columns_named_like_those_of_line_dedup(clashing):
    out = K.drop_lines(clashing).collect()
    assert len(out) == 8 and {(r["_llm_id"], r["_llm_gone"], r["_llm_dropped"] in (0, 1)) for r in out} == {(7, "g", True)}
    assert sum(r["_llm_dropped"] for r in out) == 7


def test_columns_named_like_those_of_the_similarity_join(clashing):
    out = J.keep_one(clashing)
    assert out.columns == clashing.columns
    assert sorted((r["doc_id"], r["_llm_id"], r["_llm_set"], r["_llm_kept"]) for r in out.collect()) == [(i, 7, 8, "k") for i in (0, 2, 4, 6)]


def test_columns_named_like_those_of_decontamination(spark, clashing):
    items = spark.createDataFrame([("x", LINE), ("y", "a b c")], "item_id string, text string")
    out = D.mark(clashing, items, block_bytes=1).collect()  # two blocks: the state goes along
    assert {(r["_llm_state"], r["_llm_n_words"], r["_llm_contaminated"]) for r in out} == {("s", 41, True)}


def test_columns_named_like_those_of_the_classifiers_and_the_encoder(clashing):
    model = L.Model(L.np.ones(L.DIMS, L.np.float32), [], L.np.zeros((0, L.DIMS), L.np.float32), L.np.zeros(0))
    assert {r["_llm_lang_pred"] for r in L.identify(clashing, model).collect()} == {"und"}
    assert {r["_llm_predicted"] for r in X.rate(clashing, X.Model({}, X.np.append(X.np.zeros(X.FEATURES), -9.0))).collect()} == {0}
    assert all(r["_llm_decoded"] == r["text"] and len(r["_llm_ids"]) > 5 for r in V.round_trip(clashing).collect())


@pytest.mark.parametrize("text, letter", [("²½①", False), ("12 _ ३", False), ("ª", True), ("5 é", True), ("漢", True)])
def test_letters(text, letter):
    assert (L.bins(text) is not None) == letter


@pytest.mark.parametrize("size", [3, 250, 5000])
def test_context_windows_hold_whole_words(size):
    word = "n" * size
    text = f'{word} {word} "{word} badterm {word}" {word} {word}'
    at = text.index("badterm")
    assert X.quoted(text, at, at + 7)
    assert not X.quoted(text.replace('"', ""), at - 1, at + 6)
    assert X.quoted(f"said {word} {word} {word} badterm", *(lambda s: (s, s + 7))(len(f"said {word} {word} {word} ")))
    assert not X.quoted(f"said {word} {word} {word} {word} badterm", *(lambda s: (s, s + 7))(len(f"said {word} {word} {word} {word} ")))


def test_the_lexicon_has_no_bound(spark):
    """6,000 terms, each in many toxic texts and no other, are all in the lexicon."""
    r = random.Random(1)
    terms = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(6000)]
    orders = [r.sample(terms, 6000) for _ in range(25)]  # each term in 25 texts
    rows = [(20 * k + i, " ".join(order[300 * i:300 * (i + 1)]), 1) for k, order in enumerate(orders) for i in range(20)]
    rows += [(1000 + i, " ".join(r.choices([f"w{k}" for k in range(2000)], k=60)), 0) for i in range(500)]
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4), sample=50)
    known = X.Lexicon(model.weights)
    assert len(model.weights) > 5000 and all(t in known.weights or known.stem_weight(t) is not None for t in terms)
