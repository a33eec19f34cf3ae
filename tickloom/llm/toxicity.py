"""Operator 6: toxicity from misspelled lexicon terms and their context.

1. Lexicon: the words of labelled training texts are counted by label (near copies of a text share one vote), those of clean texts
   only if the counts of toxic ones let them pass; words that mark toxic texts far more often than chance (log-likelihood
   ratio) form the lexicon, all of them.
   Beginnings of 5 to 7 letters compete with whole words; those that win are stems, which match all words they begin.
2. A trie of the lexicon is walked together with the Levenshtein automaton of a word: the automaton's state is the
   row of edit distances (as bits per distance), a branch ends when no entry is within the distance its terms allow (0 below 4
   letters, 1 below 12, else 2). Before the walk a pigeonhole test on pieces of the terms rules most words out without losing any
   match. Trie and pieces of a word are those of the terms whose length is near enough.
3. Each hit is looked at in a window of words around it: quotation marks on both sides or a word of reporting
   or of talking about words make it a quotation, other hits are plain. Hits count by distance and context.
4. A logistic regression over these counts gives the score. It is fitted on a bounded sample of training rows
   (``SAMPLE`` rows with the smallest hashed id); so the weight of misspellings and of quotations is learned.

Only texts and labels of training rows are learned from; a score sees the text alone.

Defined cases: null and empty texts are scored as texts without hits; null labels and labels of unknown documents
teach nothing, of several labels of one doc_id the largest counts; without both kinds of labelled training rows the
score is the share of toxic training rows (0 without any); repeated rows get equal results; an empty table gives no rows.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.llm.common import map_batches, mix, stored, table, with_columns
from tickloom.llm.language_id import held_out
from tickloom.llm.ngram_join import shingle_sets

SAMPLE, SURE, THRESHOLD = 20_000, 25.0, 0.3
WINDOW = 4
STEMS = (5, 6, 7)
FAR = 99
#: Labels that are broadcast at most, about 100 bytes each in a hash table.
BROADCAST_LABELS = 1_000_000
#: Terms of toxic texts that are looked for in clean ones; beyond, all terms of these are counted.
BROADCAST_TERMS = 500_000
#: One in so many clean texts is counted before the others: what it holds rules out most words of toxic texts.
FIRST = 8
CACHE = 200_000  # words whose matches a worker remembers at least until then; beyond, the memory is emptied
_word = re.compile(r"[^\W_]+")
#: Latin-1 bytes of what _word takes as they are, of all others as a space.
_letters = bytes(c if chr(c).isalnum() else 32 for c in range(256))
QUOTES = "\"'“”„‘’«»`"
#: Words that announce a quotation or talk about a word.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word words term terms insult insults "
                      "sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split())


def words_of(text: str) -> list[str]:
    """What ``_word`` finds; texts of Latin-1 characters alone are split without a regular expression."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _word.findall(text)
    return raw.translate(_letters).decode("latin-1").split()


def allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 12 else 2


class Lexicon:
    """Terms with weights, and for each length of a word the trie of the terms that may be near and the pieces one of which the word must hold."""

    def __init__(self, weights: dict[str, float]):
        self.stems = {t[:-1]: v for t, v in weights.items() if t[-1] == "*"}
        self.stem_sizes = sorted({len(t) for t in self.stems} & {*STEMS})
        self.weights = {t: v for t, v in weights.items() if t[-1] != "*"}
        self.by_length: dict[int, list[str]] = {}
        for term in self.weights:  # a stem stands for its words, misspelled endings included; short terms match as they are
            if allowed(len(term)) and self.stem_weight(term) is None:
                self.by_length.setdefault(len(term), []).append(term)
        self.near: dict[int, tuple[list, tuple]] = {}
        self.cache: dict[str, tuple[float, int]] = {}
        self.strange: set[str] = set()  # words without a match

    def stem_weight(self, word: str) -> float | None:
        return max((self.stems[word[:n]] for n in self.stem_sizes if len(word) > n and word[:n] in self.stems), default=None)

    def tables(self, size: int) -> tuple[list, tuple]:
        """For words of this length: (start, end, pieces) to look for, and the trie; a node is its children, its term and the
        most edits that a term below it allows."""
        if size in self.near:
            return self.near[size]
        pieces: dict[tuple[int, int], set[str]] = {}
        root: tuple = ({}, [], [0])
        for length in range(max(0, size - 2), size + 3):
            d = allowed(length)
            if abs(length - size) > d:
                continue
            cut = [length * i // (d + 1) for i in range(d + 2)]
            for term in self.by_length.get(length, ()):
                node = root
                node[2][0] = max(d, node[2][0])
                for c in term:
                    node = node[0].setdefault(c, ({}, [], [0]))
                    node[2][0] = max(d, node[2][0])
                node[1].append((self.weights[term], d))
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    # the first piece stays at the start, the last at the end, others are shifted by 2 at most
                    shifts = (0,) if i == 0 else (size - length,) if i == d else (-2, -1, 0, 1, 2)
                    for shift in shifts:
                        if a + shift >= 0:
                            pieces.setdefault((a + shift, b + shift), set()).add(term[a:b])
        self.near[size] = [(a, b, some) for (a, b), some in sorted(pieces.items())], root
        return self.near[size]

    def possible(self, word: str) -> bool:
        """False only if no term can be within its distance: one of d + 1 pieces must be intact, shifted by d at most."""
        for a, b, pieces in self.tables(len(word))[0]:
            if word[a:b] in pieces:
                return True
        return False

    def walk(self, word: str) -> tuple[float, int] | None:
        """(weight, distance) of the nearest term; the heavier of equally near ones.

        The row of edit distances is kept as bits: bit i of the k-th number says that the term so far is within k edits of the
        first i letters. Without a bit in the number of the most edits allowed below, a branch ends.
        """
        best, end = None, 1 << len(word)
        whole, at = 2 * end - 1, {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        stack = [(self.tables(len(word))[1], 1, 3, 7 & whole)]
        while stack:
            (children, terms, _), r0, r1, r2 = stack.pop()
            for weight, d in terms:
                k = 0 if r0 & end else 1 if r1 & end else 2 if r2 & end else FAR
                if k <= d and (best is None or (k, -weight) < (best[1], -best[0])):
                    best = weight, k
            q1, q2 = r0 | r0 << 1, r1 | r1 << 1
            for c, child in children.items():
                m = at.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = ((r1 & m) << 1 | q1 | s0 << 1) & whole
                if child[2][0] == 2:
                    if s2 := ((r2 & m) << 1 | q2 | s1 << 1) & whole:
                        stack.append((child, s0, s1, s2))
                elif s1:
                    stack.append((child, s0, s1, 0))
        return best

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, distance) of the term that the word is, begins with, or misspells."""
        if (weight := self.weights.get(word)) is not None:
            return weight, 0
        for n in self.stem_sizes:
            if word[:n] in self.stems and (weight := self.stem_weight(word)) is not None:
                return weight, 0
        return self.walk(word) if len(word) > 2 and self.possible(word) else None

    def matches(self, words: set[str]) -> dict[str, tuple[float, int]]:
        cache, strange, found = self.cache, self.strange, {}
        if len(cache) + len(strange) > CACHE:
            cache.clear()
            strange.clear()
        for word in words - strange:
            hit = cache.get(word) or self.match(word)
            if hit is None:
                strange.add(word)
            else:
                found[word] = cache[word] = hit
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window of words around [start, end) shows a quotation."""
    reach, before, after = 200, [], []
    while True:  # until the words around are complete, however long they are
        before, after = text[max(0, start - reach):start].rsplit(None, WINDOW), text[end:end + reach].split(None, WINDOW)
        if (len(before) > WINDOW or reach >= start) and (len(after) > WINDOW or end + reach >= len(text)):
            break
        reach *= 4
    left, right = " ".join(before[-WINDOW:]), " ".join(after[:WINDOW])
    if any(c in QUOTES for c in left) and any(c in QUOTES for c in right):
        return True
    return any(w in REPORTING for w in _word.findall(left))


#: Matching words up to which a text is searched for each of them instead of word by word.
FEW = 16


def places(text: str, found: dict[str, tuple[float, int]]):
    """Start and word of each place of a word of ``found``, in order."""
    if len(found) > FEW:
        return [(m.start(), m[0]) for m in _word.finditer(text) if m[0] in found]
    out = []
    for word in found:
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and text[at - 1].isalnum()) and not text[end:end + 1].isalnum():  # isalnum is what _word takes
                out.append((at, word))
            at = text.find(word, at + 1)
    return sorted(out)


#: log counts of plain hits at distance 0, 1, 2, of quoted hits, the largest plain weight, hits per log word, length
FEATURES = 7


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros(FEATURES)
    if not text:
        return out
    text = text.lower()
    words = words_of(text)
    found = lexicon.matches(set(words))
    if found:
        for at, word in places(text, found):
            hit = found[word]
            if quoted(text, at, at + len(word)):
                out[3] += hit[0]
            else:
                out[hit[1]] += hit[0]
                out[4] = max(out[4], hit[0] / (1 + hit[1]))
        out[:4] = np.log1p(out[:4])
        out[5] = out[:3].sum() / np.log(9 + len(words))
    out[6] = np.log1p(len(text)) / 10
    return out


@dataclass
class Model:
    weights: dict[str, float]
    coefficients: np.ndarray
    _lexicon: Lexicon | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "coefficients": self.coefficients, "_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.weights)
        return self._lexicon

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([np.append(features(t, self.lexicon), 1.0) for t in texts]).reshape(len(texts), FEATURES + 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of x is 1 and is not shrunk."""
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they are few (a label is 24 bytes); the texts meet more of them by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LABELS else rows


def weighted(train: DataFrame) -> DataFrame:
    """``train`` and a weight: near copies of one label share the vote of one text. Texts with the same two smallest hashes
    of word triples (under two hash functions) count as near copies."""
    def run(batch):
        sets = shingle_sets(batch.column(2), 3, distinct=False)
        keys = [np.array([mix(s ^ salt).min() if len(s) else 0 for s in sets], np.uint64).view(np.int64) for salt in (np.uint64(1), np.uint64(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(k) for k in keys)], names=["doc_id", "toxic", "k1", "k2"])
    rows = train.select("doc_id", "toxic", "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
    keyed = stored(map_batches(rows, run, schema), "toxicity-keys")
    sizes = keyed.groupBy("k1", "k2", "toxic").agg(F.count(F.lit(1)).alias("size"))
    weights = keyed.join(sizes, ["k1", "k2", "toxic"]).groupBy("doc_id").agg(F.avg(1 / F.col("size")).alias("weight"))
    return train.select("doc_id", "text", "toxic").join(small(stored(weights, "toxicity-weights")), "doc_id")


def count_words(train: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """term, weight: the weights of the texts that hold the word or stem, of all or of the wanted ones."""
    shared = None
    if wanted is not None:
        beginnings = {n: {t[:-1] for t in wanted if t[-1] == "*" and len(t) == n + 1} for n in STEMS}
        shared = train.sparkSession.sparkContext.broadcast(({t for t in wanted if t[-1] != "*"}, {n: x for n, x in beginnings.items() if x}))

    def run(batch):
        total: dict[str, float] = {}
        for text, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(words_of((text or "").lower()))
            if shared is None:
                words |= {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
            else:
                whole, beginnings = shared.value
                words = (words & whole).union(*[[f"{x}*" for x in {w[:n] for w in words if len(w) > n} & some] for n, some in beginnings.items()])
            for w in words:
                total[w] = total.get(w, 0.0) + weight
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.float64())], names=["term", "weight"])
    counted = map_batches(train.select("text", "weight"), run, "term string, weight double")
    return counted.groupBy("term").agg(F.sum("weight").alias("weight"))


def fit(train: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learn from columns doc_id, text, toxic (0 or 1). Every term that passes the test is in the lexicon: a lexicon is word types, not rows."""
    train = weighted(train)
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    n1, n0 = totals.get(1, 0.0), totals.get(0, 0.0)
    if not n1 or not n0:
        bias = 30.0 if n1 else -30.0
        return Model({}, np.append(np.zeros(FEATURES), bias))
    t, c, total = F.col("t"), F.col("c"), n1 + n0

    def part(observed, expected):
        return F.when(observed > 1e-6, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    def ratio(c):
        df = t + c
        return 2 * (part(t, df * n1 / total) + part(c, df * n0 / total)
                    + part(n1 - t, (total - df) * n1 / total) + part(n0 - c, (total - df) * n0 / total))

    # The ratio is convex in c and the precision needs c <= most: a term of which some clean texts hold c already passes only if
    # c <= most and the ratio is enough at c or at most. So only a share of the clean texts is asked for all words of toxic ones.
    def able(c):
        return (c <= most + 1e-6) & (F.greatest(ratio(c), ratio(most)) >= SURE - 1e-6)

    is_toxic, most = F.coalesce("toxic", F.lit(0)) != 0, F.greatest(F.lit(0.0), F.least(t + (n1 / total - 0.5), F.lit(n0)))
    counted = count_words(train.filter(is_toxic)).withColumn("c", F.lit(0.0)).withColumnRenamed("weight", "t")
    asked = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0
    for texts in (asked, ~asked):
        known = stored(counted.filter(able(c)), "toxicity-terms")
        wanted = {r["term"] for r in known.select("term").collect()} if known.count() <= BROADCAST_TERMS else None
        clean = count_words(train.filter(~is_toxic & texts), wanted)
        counted = known.join(clean, "term", "left").select("term", "t", (c + F.coalesce("weight", F.lit(0.0))).alias("c"))
    precision = (t + 0.5 * n1 / total) / (t + c + 0.5)
    marked = counted.withColumn("g", ratio(c)).withColumn("p", precision).filter((F.col("g") >= SURE) & (F.col("p") >= 0.5))
    best = marked.collect()
    weights = {r["term"]: float(np.log(r["p"] / max(1e-3, 1 - r["p"])) + np.log(n0 / n1)) for r in best}

    shared = train.sparkSession.sparkContext.broadcast(Model(weights, np.zeros(FEATURES + 1)))
    chosen = train.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").distinct()
    picked = train.join(small(stored(chosen, "toxicity-sample")), "doc_id", "left_semi")

    def run(batch):
        lexicon = shared.value.lexicon
        rows = [features(x, lexicon).tolist() for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = map_batches(picked.select("text", F.col("toxic").cast("int").alias("toxic")),
                       run, "x array<double>, toxic int").collect()
    x = np.array([[*r["x"], 1.0] for r in rows])
    return Model(weights, regress(x, np.array([float(r["toxic"]) for r in rows])))


def rate(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "_llm_") -> DataFrame:
    """All columns of ``docs`` and, named with the prefix, score and predicted; columns of these names are replaced."""
    docs = docs.drop(f"{prefix}score", f"{prefix}predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        score = shared.value.score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return with_columns(batch, **{f"{prefix}score": pa.array(score), f"{prefix}predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    return map_batches(docs, run, schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled documents outside the held-out fold (crc32 of the id mod 4 is 2)."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(folds=4, fold=2)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return docs.select("doc_id", "text").join(small(known), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return rate(docs.select("doc_id", "text", held_out(folds=4, fold=2).alias("held_out")), model, prefix="").drop("text")
