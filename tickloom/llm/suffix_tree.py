"""Operator 3: repeated passages of words by prefix-partitioned suffix trees.

1. Filter without loss: a window of words can repeat only if its anchor (smallest hash of its ``GRAM``-word pieces) occurs with
   another start; runs of windows equal to a run of an earlier document are settled as a whole (see ``windows`` and ``repeats``).
   The suffixes that begin at the windows still in question go to the trees.
2. Suffixes are cut after the window's length, for only nodes of that depth matter, and stand as hashes of ``STEP`` words each.
   Prefixes of variable length split them: suffixes begin with prefixes of 2 * ``STEP`` words; a prefix with more suffixes
   than ``GROUP`` is lengthened, again and again, until its groups fit in memory. A group that is still too large when
   the prefix has the whole length is one deep node by itself; Spark aggregates find its smallest document.
3. Groups of about ``GROUP`` suffixes (small prefixes share one) become suffix trees: sorted suffixes and the lengths of the common
   prefixes of neighbours. The deep internal nodes, those of the window's length, are the repeats; suffixes below a node which
   belong to a larger document than the node's smallest are repeats to remove.

Defined cases: null and empty texts have no words; documents with fewer words than the window are kept whole; a
passage repeated inside one document alone is kept; rows that repeat a doc_id are no copies of each other; null ids rank
before all others; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import bytes_of, map_batches, mix, stored, table, word_hashes, word_spans, word_units
from tickloom.llm.repeats import START_MASK, cover, judged, later, piece_rows, positions, run_rows, spans_of, table_of, text_marks, with_spans

WINDOW, GRAM, BLOCK, STEP = 50, 12, 19, 5
#: Suffixes of one group at most: 112 bytes each in memory while its tree is built.
GROUP = 400_000


def _parse(text: pa.Array):
    data, offsets = bytes_of(text)
    start, end, _ = word_spans(data, offsets)
    return word_hashes(data, start, end), lambda a, b: b" ".join(data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b]))


def suffix_rows(left: DataFrame, window: int, step: int) -> DataFrame:
    """steps (the suffix as hashes of ``step`` words each), doc, at, gone. Of equal suffixes in a batch only those of the
    smallest document stay in question."""
    parts = window // step

    def run(batch):
        units, first = word_units(batch.column(3))
        n = np.diff(first) - window + 1
        row, shift = positions(n)
        begin = first[:-1][row] + shift
        out = np.empty((len(begin), parts), np.uint64)
        for k in range(parts):
            out[:, k] = _stretches(units, begin + k * step, step if k < parts - 1 else window - step * (parts - 1))
        doc, at = np.asarray(batch.column(1))[row], np.asarray(batch.column(2))[row] + shift
        whole = out[:, 0].copy()
        for k in range(1, parts):
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + out[:, k])
        gone = later([whole, out[:, 0]], doc, at & np.int64(START_MASK), False)
        steps = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, parts, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([steps, pa.array(doc), pa.array(at), pa.array(gone)], names=["steps", "doc", "at", "gone"])
    return map_batches(left, run, "steps array<long>, doc long, at long, gone boolean")


def _stretches(units: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` units from each begin, without a prefix sum over the whole batch."""
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + units[begin + k])
    return out


def prefix(length: int):
    return F.xxhash64(*(F.col("steps")[i] for i in range(length)))


def deep_nodes(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in the tree, and the number of the full-depth node of each (leaves of their own included)."""
    order = np.lexsort(tuple(steps[:, k] for k in range(steps.shape[1] - 1, -1, -1)))
    ranked = steps[order]
    common = np.cumprod(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)  # longest common prefix with the suffix before
    return order, np.cumsum(np.append(True, common < steps.shape[1])) - 1


def _tree(group: pa.Table) -> pa.Table:
    """doc, at of the suffixes below a deep node that has a smaller document."""
    parts = len(group.column("steps")[0])
    steps = group.column("steps").combine_chunks().flatten().to_numpy().reshape(-1, parts)
    doc, at = group.column("doc").to_numpy(), group.column("at").to_numpy()
    order, node = deep_nodes(steps)
    smallest = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, node, doc[order])
    gone = order[doc[order] > smallest[node]]
    return pa.table({"doc": doc[gone], "at": at[gone]})


def tree_repeats(suffixes: DataFrame, parts: int, group: int = GROUP) -> DataFrame:
    """doc, at of the suffixes whose first ``parts`` steps also begin a suffix of a smaller document."""
    rows, assigned = suffixes, []
    for length in range(2, parts + 1, 2):
        keyed = rows.withColumn("prefix", prefix(length))
        large = stored(keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group).select("prefix"), "large-prefixes")
        if large.isEmpty():
            assigned.append(keyed)
            rows = None
            break
        assigned.append(keyed.join(large, "prefix", "left_anti"))
        rows = keyed.join(large, "prefix", "left_semi").drop("prefix")
    fit = assigned[0]
    for more in assigned[1:]:
        fit = fit.unionByName(more)
    bins = max(1, -(-suffixes.count() // group))
    out = fit.withColumn("bin", F.pmod("prefix", F.lit(bins))).select("bin", "steps", "doc", "at") \
        .groupBy("bin").applyInArrow(_tree, "doc long, at long")
    if rows is not None:  # prefixes of full length that are still too large: each is a node
        nodes = rows.groupBy("steps").agg(F.min("doc").alias("smallest"))
        out = out.unionByName(rows.join(nodes, "steps").filter(F.col("doc") > F.col("smallest")).select("doc", "at"))
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, step: int = STEP, group: int = GROUP) -> DataFrame:
    """doc, at, n: the windows that also start in a smaller document, as stretches. ``docs``: see ``table_of``."""
    runs = stored(judged(run_rows(docs, word_units, window, gram, False), False), "tree-runs")
    tested = with_spans(docs, runs.filter("not gone")).filter(F.col("spans").isNotNull())
    suffixes = stored(suffix_rows(piece_rows(tested, _parse, window, gram, block), window, step), "tree-suffixes")
    trees = tree_repeats(suffixes.filter("not gone").drop("gone"), window // step, group)
    found = suffixes.filter("gone").select("doc", "at").unionByName(trees).withColumn("n", F.lit(1).cast("long"))
    return runs.filter("gone").drop("gone").unionByName(stored(found, "tree-windows"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM,
                   group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) of every row."""
    rows = table_of(docs, id_col, text_col)

    def run(batch):
        total, removed, kept = [], [], []
        data, offsets = bytes_of(batch.column(2))
        start, end, first = word_spans(data, offsets)
        marks, raw = text_marks(batch.column(2)), data.tobytes()
        for i, spans in enumerate(spans_of(batch, 3)):
            s, e = start[first[i]:first[i + 1]], end[first[i]:first[i + 1]]
            gone = cover(spans, marks[i], len(s), window) if spans else None
            total.append(len(s))
            removed.append(0 if gone is None else int(gone.sum()))
            if removed[-1]:
                s, e = s[~gone], e[~gone]
            kept.append(b" ".join(raw[a:b] for a, b in zip(s.tolist(), e.tolist())).decode())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                          names=["doc_id", "n_words", "n_removed", "kept"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(with_spans(rows, repeated_spans(rows, window, gram, group=group)), run,
                       f"doc_id {kind}, n_words long, n_removed long, kept string")


SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from t)),
g as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from s) where doc_id > first),
p as (select distinct doc_id, unnest(range(i, i + 50)) as p from g),
k as (select t.doc_id, x.p, t.w[x.p] as word from t, unnest(range(1, len(t.w) + 1)) as x(p)),
r as (select k.doc_id, count(*) as n, count(p.p) as removed, coalesce(string_agg(word, ' ' order by k.p) filter (where p.p is null), '') as kept
      from k left join p on k.doc_id = p.doc_id and k.p = p.p group by k.doc_id)
select doc_id, coalesce(n, 0) as n_words, coalesce(removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join r using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
