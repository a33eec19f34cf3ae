"""Operator 11: filter interaction audit on a sparse document-term matrix.

1. Some megabytes of documents become one shard: its words, and per document the local numbers of its distinct words with
   their counts (compressed sparse rows). Share of capitals, special characters and the digest of the text go along.
2. The words of all shards are numbered once (global dictionary). A shard brings each of its words once, so what
   is shuffled is one row per shard and word, not per document and word.
3. Shards with global columns are the matrix. Row sums (words) and numbers of nonzeros (distinct words) decide filters A and B.
4. The other flags are attached, documents are counted by part and set of failed filters (32 rows a part at most), and
   these counts give every order and step.

Texts are equal when their SHA-256 digests are. Texts with very many copies meet their rows by a broadcast of at most
``joins.HOT_KEYS`` digests, the rest by a shuffle.

Defined cases: null text is empty and fails A only (and E behind a smaller doc_id with an empty or null text); B and C are
false without words and code points; null and empty sources are one part; null doc_ids never fail E, make no other row fail
it and have no label; rows that repeat a doc_id are each counted, and equal texts under one doc_id do not fail E; of several
label rows of a doc_id any 1 counts; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm.common import map_batches, ready, stored, table, text_or_empty, word_pieces
from tickloom.llm.joins import left_by_count

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS, SPECIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Text of one shard (a longer document is a shard by itself), rows of one bucket of the dictionary.
SHARD_BYTES, BUCKET_ROWS = 8 << 20, 20_000


def word_counts(raw: bytes) -> Counter:
    """How often each word occurs."""
    counts = Counter()
    for words in word_pieces(raw):
        counts.update(words)
    return counts


def packed(numbers: array) -> bytes:
    """32-bit numbers, compressed: local numbers of frequent words are small and most counts are 1."""
    return zstandard.compress(numbers.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.int32)


def _shard(rows: list[pa.RecordBatch], vocabulary: dict[bytes, int], starts: array, columns: array, counts: array) -> pa.RecordBatch:
    docs = pa.Table.from_batches(rows).combine_chunks().to_struct_array().combine_chunks()
    return pa.RecordBatch.from_arrays([
        pa.array([list(vocabulary)], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
        *(pa.array([packed(x)], pa.binary()) for x in (starts, columns, counts))],
        names=["words", "docs", "starts", "columns", "counts"])


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """shard, words, docs (doc_id, part, digest, capitals, special), starts, columns (local numbers), counts: one row per shard."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        def empty():
            return [], {}, array("i", [0]), array("i"), array("i")
        rows, vocabulary, starts, columns, counts = empty()
        size = 0
        for batch in batches:
            digests, capitals, special = [], [], []
            for text in batch.column(2).to_pylist():
                raw = text.encode()
                found = word_counts(raw)
                columns.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                counts.extend(found.values())
                starts.append(len(columns))
                digests.append(hashlib.sha256(raw).digest())
                capitals.append(100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text))
                special.append(len(raw.translate(None, SPECIAL)) < len(raw))
                size += len(raw)
            rows.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(capitals, pa.bool_()),
                                                    pa.array(special, pa.bool_())], names=["doc_id", "part", "digest", "capitals", "special"]))
            if size >= SHARD_BYTES:
                yield _shard(rows, vocabulary, starts, columns, counts)
                (rows, vocabulary, starts, columns, counts), size = empty(), 0
        if len(starts) > 1:
            yield _shard(rows, vocabulary, starts, columns, counts)
    cut = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    out = cut.mapInArrow(run, "words array<binary>, docs array<struct<doc_id:" + kind + ",part:string,digest:binary,capitals:boolean,special:boolean>>,"
                         "starts binary, columns binary, counts binary")
    return stored(out.select(F.monotonically_increasing_id().alias("shard"), "*"), "matrix-shards")


def encoded(cut: DataFrame) -> DataFrame:
    """of (shard), at (local number), word, id: the words of each shard with their global numbers.

    A word's number is its bucket (by hash) and its rank among the words of the bucket, so one shuffle of the words numbers them and
    answers all shards. Numbers are unique, not consecutive.
    """
    total = cut.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ROWS))
    words = cut.select(F.col("shard").alias("of"), F.posexplode("words").alias("at", "word"))
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    return words.select("of", "at", "word", (F.shiftleft("bucket", 32) + rank).alias("id"))


def dictionary(cut: DataFrame) -> DataFrame:
    """word, id, shards (how many hold the word)."""
    return encoded(cut).groupBy("word", "id").agg(F.count(F.lit(1)).alias("shards"))


def matrix(cut: DataFrame) -> DataFrame:
    """shard, docs, starts, columns (global numbers, 64 bits each), counts (``packed``, as starts): the rows of the document-term matrix."""
    rows, ids = cut.drop("words"), encoded(cut).select("of", "at", "id")

    def run(shard: pa.Table, numbers: pa.Table) -> pa.Table:
        to_global = np.zeros(numbers.num_rows, np.int64)
        to_global[numbers.column("at").to_numpy()] = numbers.column("id").to_numpy()
        local = unpacked(shard.column("columns")[0].as_py())
        return shard.set_column(shard.schema.get_field_index("columns"), "columns", pa.array([to_global[local].tobytes()], pa.binary()))
    return rows.groupBy("shard").cogroup(ids.groupBy("of")).applyInArrow(run, rows.schema)


def flags(rows: DataFrame) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, fails (letters of A to D that the document fails), from the matrix."""
    kind = rows.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batch):
        out = []
        for docs, starts, counts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("docs", "starts", "counts"))):
            own = docs.values
            starts, counts = unpacked(starts.as_py()), unpacked(counts.as_py())
            sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            n, distinct = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts).astype(np.int64)
            fails = np.full(len(n), "", "U4")
            for letter, failed in zip("ABCD", (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, np.asarray(own.field("capitals")), np.asarray(own.field("special")))):
                fails = np.char.add(fails, np.where(failed, letter, ""))
            out.append(pa.RecordBatch.from_arrays([own.field("doc_id"), own.field("part"), own.field("digest"), pa.array(n), pa.array(distinct),
                                                   pa.array(fails.tolist(), pa.string())], names=["doc_id", "part", "digest", "n_words", "n_distinct", "fails"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    return map_batches(rows, run, f"doc_id {kind}, part string, digest binary, n_words long, n_distinct long, fails string")


def judged(docs: DataFrame, **names) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, fails (letters of all five filters) of every row."""
    cut = shards(docs, **names)
    rows = stored(flags(matrix(cut)), "matrix-flags")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(copies, "matrix-copies")
    known = left_by_count(rows, copies, "digest", "n", rows.count())
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return known.withColumn("fails", F.concat("fails", F.when(later, "E").otherwise(""))).select(rows.columns)


def audit(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """One row per part, order of the filters and step: see the module's contract query for the columns."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = judged(docs, **names)
    # rows without an id have no label and must not meet in one task
    named = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select("part", "fails", "good", "toxic")
    unnamed = rows.filter(F.col("doc_id").isNull()).select("part", "fails", F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic"))
    counts = named.unionByName(unnamed).groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    counts = stored(counts, "audit-counts")
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.selectExpr(
        "*", "substring(filter_order, step, 1) as letter", "translate(substring(filter_order, 1, step - 1), fails, '') = substring(filter_order, 1, step - 1) as reached",
        "translate(substring(filter_order, 1, step), fails, '') = substring(filter_order, 1, step) as passes")
    steps = steps.withColumn("failing", F.expr("instr(fails, letter) > 0"))

    def total(value: str, where: str):
        return F.sum(F.expr(f"if({where}, {value}, 0)")).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", "passes").alias("kept"), total("n", "failing and reached").alias("removed"), total("n", "failing and not reached").alias("redundant"),
        total("n", "fails = letter").alias("unique_fails"), total("good", "failing and reached").alias("good_lost"),
        total("toxic", "failing and reached").alias("toxic_lost"), total("n * (120 div length(fails))", "failing").alias("shapley"))


SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from t),
f as (select doc_id, part, concat(case when len(w) < 50 then 'A' else '' end, case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end,
        case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end,
        case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end, case when doc_id > least then 'E' else '' end) as fails from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
      where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select *, filter_order[step] as letter, filter_order[1:step - 1] as earlier, filter_order[1:step] as own from o, (select unnest(range(1, 6)) as step)),
m as (select *, contains(fails, letter) as failing, translate(earlier, fails, '') = earlier as reached, translate(own, fails, '') = own as passes from c, s)
select part, filter_order, step::int as step, sum(case when passes then n else 0 end)::bigint as kept,
  sum(case when failing and reached then n else 0 end)::bigint as removed, sum(case when failing and not reached then n else 0 end)::bigint as redundant,
  sum(case when fails = letter then n else 0 end)::bigint as unique_fails, sum(case when failing and reached then good else 0 end)::bigint as good_lost,
  sum(case when failing and reached then toxic else 0 end)::bigint as toxic_lost,
  sum(case when failing then n * (120 // greatest(length(fails), 1)) else 0 end)::bigint as shapley
from m group by all
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
