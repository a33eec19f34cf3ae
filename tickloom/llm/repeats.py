"""Steps that the repeated-passage operators share: runs of windows, their first places, and taking spans out of texts.

A place is (doc, at): the document's id and one long that holds 24 bits of a hash of its text above the 40-bit start
of the window, so that rows which repeat a doc_id keep apart when their texts differ.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import map_batches
from tickloom.llm.windows import anchor_of, prefix_sums, runs, stretch_hash

START_BITS = 40
START_MASK = (1 << START_BITS) - 1
PLACE = "key long, sup long, doc long, at long, n long"
NO_ID = -(1 << 63)  # stands for a null doc_id, before all others


def doc_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def start(at: str = "at") -> Column:
    return F.col(at).bitwiseAND(F.lit(START_MASK))


def text_mark(raw: bytes) -> int:
    """24 bits of the text's hash, in place above the start."""
    return (xxhash.xxh3_64_intdigest(raw) >> 41) << START_BITS


def text_marks(texts: pa.Array) -> np.ndarray:
    return np.array([text_mark(b) for b in texts.cast(pa.large_binary()).to_pylist()], np.int64) if len(texts) else np.zeros(0, np.int64)


def later(keys: list[np.ndarray], doc: np.ndarray, lo: np.ndarray, own_document: bool) -> np.ndarray:
    """Which rows have an equal row (all keys) at an earlier place; ``own_document``: earlier in the same document counts."""
    order = np.lexsort((lo, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    d, s = doc[order], lo[order]
    behind = d > d[head]
    if own_document:
        behind |= (d == d[head]) & (s > s[head])
    out = np.empty(len(order), bool)
    out[order] = behind
    return out


def joined_spans(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring stretches of windows of one document in one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return doc[head], at[head], np.add.reduceat(n, head) if len(head) else n


def place_batch(key, sup, doc, at, n, gone) -> pa.RecordBatch:
    """Rows that stay in question, and spans of windows that are gone for certain (sup is null, the key spreads them)."""
    gdoc, gat, gn = joined_spans(doc[gone], at[gone], n[gone])
    stay = ~gone
    spread = (gdoc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ gat.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    sups = pa.array(np.concatenate([sup[stay].view(np.int64), np.zeros(len(gdoc), np.int64)]),
                    mask=np.concatenate([np.zeros(int(stay.sum()), bool), np.ones(len(gdoc), bool)]))
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([key[stay].view(np.int64), spread])), sups, pa.array(np.concatenate([doc[stay], gdoc])),
        pa.array(np.concatenate([at[stay], gat])), pa.array(np.concatenate([n[stay], gn]))], names=["key", "sup", "doc", "at", "n"])


def run_rows(docs: DataFrame, units: Callable[[pa.Array], tuple], window: int, gram: int, own_document: bool) -> DataFrame:
    """The runs of all documents (columns doc, text); copies within one batch are already settled, which keeps
    the rows of a passage that very many documents share to one for each batch."""
    def run(batch):
        values, offsets = units(batch.column(1))
        i, lo, n, key, sup = runs(values, offsets, window, gram)
        if not len(i):
            return None
        doc = np.asarray(batch.column(0))[i]
        return place_batch(key, sup, doc, text_marks(batch.column(1))[i] | lo, n, later([key, sup], doc, lo, own_document))
    return map_batches(docs.select("doc", "text"), run, PLACE)


def judged(rows: DataFrame, own_document: bool) -> DataFrame:
    """doc, at, n, gone: runs whose whole stretch starts earlier elsewhere are gone; runs whose anchor has other
    surroundings elsewhere are to be tested; the others cannot repeat and are left out."""
    place = ["doc", "lo"] if own_document else ["doc"]
    rows = rows.withColumn("lo", start()).repartition("key")
    rank = F.rank().over(Window.partitionBy("key", "sup").orderBy(*place))
    around = Window.partitionBy("key")
    rows = rows.withColumn("rank", rank).withColumn("other", F.min("sup").over(around) != F.max("sup").over(around))
    gone = F.col("sup").isNull() | (F.col("rank") > 1)
    return rows.filter(gone | F.col("other")).select("doc", "at", "n", gone.alias("gone"))


def final(rows: DataFrame, own_document: bool) -> DataFrame:
    """doc, at, n of the rows that have an equal row (key and sup) at an earlier place."""
    place = ["doc", "lo"] if own_document else ["doc"]
    rows = rows.withColumn("lo", start()).repartition("key")
    rank = F.rank().over(Window.partitionBy("key", "sup").orderBy(*place))
    return rows.withColumn("rank", rank).filter("sup is null or rank > 1").select("doc", "at", "n")


def pieces(units: np.ndarray, count: int, window: int, gram: int, block: int) -> list[tuple[int, int, int]]:
    """(first position, number of positions, rank of the core) of the pieces of a run of ``count`` positions.

    Position p has the distance anchor - p; the windows at the distances of one block share a core around the anchor.
    """
    sums = prefix_sums(units)
    anchor = anchor_of(sums, count, window, gram)
    blocks = np.arange((anchor - count + 1) // block, anchor // block + 1)
    near, far = blocks * block, np.minimum(blocks * block + block - 1, window - gram)
    first, last = np.maximum(0, anchor - far), np.minimum(count - 1, anchor - near)
    core = stretch_hash(sums, anchor - near, anchor - far + window) + blocks.astype(np.uint64)
    return list(zip(first.tolist(), (last - first + 1).tolist(), core.view(np.int64).tolist()))


PIECE = "core long, doc long, at long, raw binary"


def piece_rows(tested: DataFrame, parse: Callable, window: int, gram: int, block: int) -> DataFrame:
    """Columns doc, doc_id, text, spans (the runs to be tested) become one row per piece; pieces whose core nobody
    shares are left out. ``parse`` gives a text's units and a function for the bytes of a stretch of them."""
    def run(batch):
        rows: list[list] = [[], [], [], []]
        marks, docs, texts = text_marks(batch.column(2)), batch.column(0).to_pylist(), batch.column(2)
        for i, spans in enumerate(spans_of(batch, 3)):
            if spans is None:
                continue
            own = spans[0] & ~np.int64(START_MASK) == marks[i]
            if not own.any():
                continue
            units, raw = parse(texts.slice(i, 1))
            for lo, n in zip((spans[0][own] & np.int64(START_MASK)).tolist(), spans[1][own].tolist()):
                for first, count, core in pieces(units[lo:lo + n + window - 1], n, window, gram, block):
                    for column, value in zip(rows, (core, docs[i], int(marks[i]) | lo + first, raw(lo + first, lo + first + count + window - 1))):
                        column.append(value)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())],
                                          names=["core", "doc", "at", "raw"]) if rows[0] else None
    rows = map_batches(tested, run, PIECE).repartition("core")
    return rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("core"))).filter("c > 1").drop("c")


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with so many positions each: the row of every position, and its number within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def per_document(spans: DataFrame, name: str) -> DataFrame:
    """One row per document with its spans; they are never more than the document has windows."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias(name)).withColumnRenamed("doc", f"{name}_doc")


def spans_of(batch: pa.RecordBatch, column: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(at, n) of every row of a column of arrays of struct(at, n)."""
    lists = batch.column(column)
    flat, offsets = lists.values, np.asarray(lists.offsets)
    at, n = np.asarray(flat.field(0)), np.asarray(flat.field(1))
    valid = lists.is_valid().to_pylist()
    return [(at[a:b], n[a:b]) if ok and b > a else None for a, b, ok in zip(offsets, offsets[1:], valid)]


def cover(spans: tuple[np.ndarray, np.ndarray] | None, mark: int, size: int, window: int) -> np.ndarray | None:
    """Which units of a text of ``size`` units lie in one of the text's spans."""
    if spans is None:
        return None
    at, n = spans
    own = at & ~np.int64(START_MASK) == mark
    lo = (at & np.int64(START_MASK))[own]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n[own] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def table_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(doc_key(id_col).alias("doc"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_spans(docs: DataFrame, spans: DataFrame, name: str = "spans") -> DataFrame:
    return docs.join(per_document(spans, name), F.col("doc") == F.col(f"{name}_doc"), "left").select("doc", "doc_id", "text", name)


