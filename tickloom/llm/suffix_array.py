"""Operator 9: repeated byte strings by distributed prefix doubling.

Positions are ranked by the bytes that follow, in rounds of growing length; a position whose rank is unique leaves, and
after the last round equal ranks mean equal strings of the full length.

1. Length ``GRAM``. A string can repeat only if the smallest hash of its ``GRAM``-byte pieces (its anchor) occurs again.
   Neighbouring positions share their anchor, so Spark sorts one row per run of positions by the rank pair (anchor, hash of
   all bytes the run touches). Runs equal to an earlier run are gone as a whole, runs with a unique anchor leave.
2. Length ``WINDOW - BLOCK + 1``: what remains is cut into pieces of at most ``BLOCK`` positions at fixed distances from the
   anchor; all strings of a piece share a core of that length. Pieces sorted by the pair (anchor, core), unique ones leave.
3. Length ``WINDOW``: Spark sorts the positions left by the pair of ranks of their two halves (at offset 0 and at half the
   length) and reranks them by place: every position of a class but the first is gone.

A rank is the 64-bit hash of the bytes, so it needs no global numbering; in the last round the pair has 128 bits. In all rounds
copies within one Arrow batch are settled before the shuffle, so a string that very many documents share is sorted as one
row for each batch, not for each document.

Defined cases: null is the empty text; texts shorter than the string length are kept whole; rows that repeat a
doc_id are judged apart, a string in two of them belongs to the one where it starts at the smaller byte, equal rows both keep
theirs; null ids rank before all others; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import BYTE_VALUE, ByteValues, bytes_of, map_batches, stored, table
from tickloom.llm.repeats import (PLACE, START_MASK, cover, final, judged, later, piece_rows, place_batch, positions, run_rows,
                                  spans_of, table_of, text_marks, with_spans)
from tickloom.llm.windows import prefix_sums, stretch_hash

WINDOW, GRAM, BLOCK = 100, 24, 19


def byte_units(texts: pa.Array) -> tuple[ByteValues, np.ndarray]:
    data, offsets = bytes_of(texts)
    return ByteValues(data), offsets


def _parse(text: pa.Array):
    data = bytes_of(text)[0]
    return ByteValues(data), lambda a, b: data[a:b].tobytes()


def position_rows(left: DataFrame, window: int) -> DataFrame:
    """One row per position of the pieces left, with the ranks of both halves of its string."""
    def run(batch):
        data, offsets = bytes_of(batch.column(3))
        sums = prefix_sums(BYTE_VALUE[data])
        n = np.diff(offsets) - window + 1
        row, step = positions(n)
        begin = offsets[:-1][row] + step
        one, two = stretch_hash(sums, begin, begin + window // 2), stretch_hash(sums, begin + window // 2, begin + window)
        doc, at = np.asarray(batch.column(1))[row], np.asarray(batch.column(2))[row] + step
        return place_batch(one, two, doc, at, np.ones(len(row), np.int64), later([one, two], doc, at & np.int64(START_MASK), True))
    return map_batches(left, run, PLACE)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc, at, n: all positions whose string starts earlier elsewhere, as stretches. ``docs``: see ``table_of``."""
    runs = stored(judged(run_rows(docs, byte_units, window, gram, True), True), "suffix-runs")
    tested = with_spans(docs, runs.filter("not gone")).filter(F.col("spans").isNotNull())
    left = piece_rows(tested, _parse, window, gram, block)
    return runs.filter("gone").drop("gone").unionByName(stored(final(position_rows(left, window), True), "suffix-positions"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""
    rows = table_of(docs, id_col, text_col)

    def run(batch):
        out: list[list] = [[], [], [], []]
        texts, marks = batch.column(2).cast(pa.large_binary()).to_pylist(), text_marks(batch.column(2))
        for text, mark, spans in zip(texts, marks, spans_of(batch, 3)):
            gone = cover(spans, mark, len(text), window)
            removed = 0 if gone is None else int(gone.sum())
            edges = 0 if not removed else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = text if not removed else np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (len(text), removed, edges, kept)):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(with_spans(rows, repeated_spans(rows, window, gram)), run,
                       f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from t)),
g as (select doc_id, i, row_number() over (partition by s order by doc_id, i) > 1 as gone from w),
b as (select doc_id, unnest(range(0, len(h) // 2)) as i, h from t),
m as (select b.doc_id, b.i, substr(b.h, 2 * b.i + 1, 2) as byte,
      coalesce(bool_or(gone) over (partition by b.doc_id order by b.i rows between 99 preceding and current row), false) as gone
      from b left join g on b.doc_id = g.doc_id and b.i = g.i),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as first from m),
r as (select doc_id, count(*) as n, count(*) filter (where gone) as removed, count(*) filter (where first) as spans,
      coalesce(string_agg(byte, '' order by i) filter (where not gone), '') as kept from e group by doc_id)
select doc_id, coalesce(n, 0) as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256
from t left join r using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
