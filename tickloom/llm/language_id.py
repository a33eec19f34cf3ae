"""Operator 4: language identification by nearest centroid.

A text is lower-cased, ASCII characters that are no letters become spaces, and its byte bigrams and trigrams are
hashed to ``DIMS`` bins. Bins weigh (1 + log count) * idf and the vector has length 1. Document frequencies come
from all training rows, by one Spark aggregation of per-task sums. Each language gets ``clusters`` centroids by
spherical k-means over a bounded sample: the ``sample`` training rows of the language whose hashed id is smallest.
A text takes the language of its nearest centroid by cosine, ties go to the language first in the alphabet.

Rejection: a text without letters or of another kind than every centroid is rejected. Texts of ``LONG`` n-grams or
more are rejected below a quarter of the lowest per-cent cosine seen in the language's own sample, shorter ones (whose
cosines are low by nature) only if they share next to nothing with any centroid.

Only text and language of training rows are learned from; a prediction sees the text alone.

Defined cases: null, empty and letterless texts get ``und`` with score 0 and are rejected; rows with a null language
are no training rows; without any training row every text gets ``und``; repeated rows get equal results; an empty
table gives no rows; all other columns pass.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tickloom.llm.common import map_batches, table, with_columns

DIMS, BITS = 8192, 13
CLUSTERS, SAMPLE, LONG = 4, 400, 200
#: More languages than this would make the broadcast model larger than about 130 MB (32 KB a centroid).
MAX_LANGUAGES = 1000
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_letter = regex.compile(r"\p{L}")


def bins(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a text; None without a letter."""
    if not text or not _letter.search(text):
        return None
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    grams = np.concatenate([two, three | np.uint32(1 << 24)])
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of bin counts (one row a text) and the number of n-grams, 0 without letters."""
    out, n = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if (b := bins(text)) is not None:
            out[i] = np.bincount(b, minlength=DIMS)
            n[i] = len(b)
    return out, n


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors, and the number of n-grams of each text."""
    x, n = counts(texts)
    seen = x > 0
    np.log(x, out=x, where=seen)
    x[seen] += 1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x, n


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; starts at the first vector and then at the one farthest from all starts."""
    k, picked = min(k, len(x)), [0]
    near = x @ x[0]
    while len(picked) < k:
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (mine == j).any():
                c[j] = x[mine == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid, sorted
    centroids: np.ndarray
    floor: np.ndarray  # of each centroid: long texts below are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), 64):
            x, n = vectors(texts[at:at + 64], self.idf)
            cos = x @ self.centroids.T if self.languages else np.zeros((len(x), 0))
            for i in range(len(x)):
                if not n[i] or not self.languages:
                    langs.append("und")
                    continue
                j = int(cos[i].argmax())
                langs.append(self.languages[j])
                score[at + i] = min(1.0, max(0.0, float(cos[i, j])))
                rejected[at + i] = cos[i, j] < (self.floor[j] if n[i] >= LONG else 0.01)
        return langs, score, rejected


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
        clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learn from rows with a language. ``sample`` rows of each language at most make its centroids."""
    train = train.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches):
        total, docs = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (b := bins(text)) is not None:
                    total[np.unique(b)] += 1
                    docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["bin", "n"])

    df = {r["bin"]: r["n"] for r in train.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    docs, n = df.pop(-1, 0), np.zeros(DIMS)
    n[list(df)] = list(df.values())
    idf = (np.log((1 + docs) / (1 + n)) + 1).astype(np.float32)

    newest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    picked = train.filter(F.col("text").rlike(r"\p{L}")).withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= sample)

    def centroids(group: pa.Table) -> pa.Table:
        x, grams = vectors(group.column("text").to_pylist(), idf)
        x, grams = x[grams > 0], grams[grams > 0]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "c": pa.array([], pa.binary()), "floor": pa.array([], pa.float64())})
        c = kmeans(x, clusters)
        best = (x @ c.T).max(axis=1)
        long = best[grams >= LONG]
        floor = float(np.quantile(long, 0.01)) / 4 if len(long) else 0.01
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(c), "c": [r.tobytes() for r in c], "floor": [floor] * len(c)})

    rows = picked.groupBy("lang").applyInArrow(centroids, "lang string, c binary, floor double").limit(MAX_LANGUAGES * clusters + 1).collect()
    if len(rows) > MAX_LANGUAGES * clusters:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the centroids would not be a bounded broadcast")
    rows.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    return Model(idf, [r["lang"] for r in rows], np.array([np.frombuffer(r["c"], np.float32) for r in rows], np.float32).reshape(-1, DIMS),
                 np.array([r["floor"] for r in rows]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "_llm_") -> DataFrame:
    """All columns of ``docs`` and, named with the prefix, lang_pred, score, rejected; columns of these names are replaced."""
    docs = docs.drop(*(f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        langs, score, rejected = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return with_columns(batch, **{f"{prefix}lang_pred": pa.array(langs, pa.string()), f"{prefix}score": pa.array(score),
                                      f"{prefix}rejected": pa.array(rejected)})

    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}lang_pred", T.StringType()),
                           T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}rejected", T.BooleanType())])
    return map_batches(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, prefix="").drop("text")
