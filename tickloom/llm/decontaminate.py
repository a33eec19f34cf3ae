"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark's windows (``window`` consecutive words of an item, or all words of a shorter item) are the patterns.
They are searched per pattern length m. A SHIFT table over blocks of two words tells how far the search position
may jump: m - 1 for a block in no pattern, so most words of a document are never looked at. A block with shift 0
selects the bucket of patterns that end in it; each of them is compared with the document's words directly.

The benchmark is the stated query set. It is read in blocks of at most ``block_bytes`` of text (cut by the items'
running size), each block's tables go to the executors, and the documents pass through the blocks one after the other in
one stage, so no table is larger than a block however large the benchmark grows.

Words: A-Z lower-cased, then runs of ASCII letters, digits and all code points above 0x7F. In UTF-8 those are runs of
bytes, so the search works on bytes.

Defined cases: null or empty texts have no words and are not contaminated; items without words are never found; items
with the same words or the same item_id are found together (an item_id counts once); items without an item_id mark words
and contamination, but have no name and do not count in n_items; every document row is judged on its own, repeated rows
alike; an empty benchmark hits nothing, an empty table gives no rows. All other columns pass.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.llm.common import free, map_batches, table, text_or_empty, with_columns

BLOCK_BYTES = 2 << 20
#: Bytes that belong to words stand for themselves, A-Z for a-z, all others for a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Patterns:
    """Patterns of one length m: shift table over blocks, buckets by suffix block."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[bytes, dict[bytes, int]] = {}  # by the block's last word, then by the word before it
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block - 1, m):
                before = self.shift.setdefault(pattern[end], {})
                key = pattern[end - 1] if self.block == 2 else b""
                before[key] = min(before.get(key, self.jump), m - 1 - end)
            self.buckets.setdefault(pattern[m - self.block:], []).append((list(pattern), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        m, jump, shift, two, n = self.m, self.jump, self.shift, self.block == 2, len(words)
        at = m - 1
        while at < n:
            before = shift.get(words[at])
            if before is None:
                # the last word is in no pattern, or only as a first word: nothing ends here or just behind it
                at += jump
                continue
            step = before.get(words[at - 1] if two else b"", jump)
            if step:
                at += step
                continue
            for pattern, items in self.buckets.get(tuple(words[at + 1 - self.block:at + 1]), ()):
                if words[at + 1 - m:at + 1] == pattern:
                    yield at + 1 - m, items
            at += 1


def tables(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            names = by_length.setdefault(m, {}).setdefault(tuple(words[i:i + m]), [])
            if item is not None and item not in names:
                names.append(item)
    return [Patterns(m, p) for m, p in sorted(by_length.items())]


_built: dict[str, list[Patterns]] = {}  # the newest block's tables, kept by a Python worker from task to task


def built(token: str, items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    if token not in _built:
        _built.clear()
        _built[token] = tables(items, window)
    return _built[token]


def search(words: list[bytes], searched: list[Patterns], spans: list[list[int]], found: set[str]) -> None:
    """Add the hit stretches (start, end) and the items found."""
    for patterns in searched:
        for start, items in patterns.occurrences(words):
            spans.append([start, start + patterns.m])
            found.update(items)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        if block and size + len(row[1] or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    yield block


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, prefix: str = "_llm_") -> DataFrame:
    """All columns of ``docs`` and, named with the prefix, n_words, n_hit, n_items, items_sha256, contaminated.

    Columns that have these names already are replaced.
    """
    spark = docs.sparkSession
    names = [f.split()[0] for f in FOUND.split(", ")]
    docs = docs.drop(*(f"{prefix}{n}" for n in names if f"{prefix}{n}" != text_col))
    out, state = docs, free(docs, f"{prefix}state")
    fields = T.StructType([T.StructField(f"{prefix}{f.name}", f.dataType) for f in T._parse_datatype_string(FOUND)])
    parts = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text, block_bytes)]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1

        def run(batch, part=part, last=last, token=uuid.uuid4().hex):
            searched = built(token, part.value, window)
            at = batch.schema.get_field_index(state)
            before = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
            if at >= 0:
                batch = batch.remove_column(at)
            rows = []
            for text, known in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), before):
                words = words_of(text)
                spans, found = json.loads(known) if known else ([], [])
                found = set(found)
                search(words, searched, spans, found)
                rows.append((words, spans, found))
            if not last:
                return with_columns(batch, **{state: pa.array([json.dumps([s, sorted(f)]) if s else None for _, s, f in rows], pa.string())})
            result = {n: [] for n in names}
            for words, spans, found in rows:
                hit = 0
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for start, end in spans:
                        edge[start] += 1
                        edge[end] -= 1
                    hit = int((np.cumsum(edge) > 0).sum())
                for n, v in zip(names, (len(words), hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0)):
                    result[n].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return with_columns(batch, **{f"{prefix}{n}": pa.array(v, t) for (n, v), t in zip(result.items(), types)})

        schema = T.StructType([*docs.schema.fields, *(fields if last else [T.StructField(state, T.StringType())])])
        out = map_batches(out, run, schema)
    return out


SQL = r"""
with t as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as win from
  (select item, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select r, m, i, array_to_string(w[i:i + m - 1], ' ') as win from
  (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from t, (select distinct m from bw) where len(w) >= m)),
hits as (select r, dw.m, i, item from dw join bw on dw.win = bw.win and dw.m = bw.m),
words as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + m)) as p from hits) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join words using (r) left join items using (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return mark(docs, table(spark, sf_dir, "benchmark"), prefix="").drop("text")
