"""Operator 5: line de-duplication with sharded minimal perfect hashes.

1. Every document sends the 128-bit hashes of its distinct long line keys; a hash aggregate with a map-side step
   counts the documents of each and takes the largest doc_id.
2. The distinct hashes are cut into shards by their value. Each shard becomes a minimal perfect hash (levels of bit
   arrays: a hash that is alone on its bit keeps it, the others go to the next level; the rank of the bit is its
   slot) with compact arrays by slot: 32-bit fingerprint, saturated 32-bit count, largest doc_id.
3. Documents probe the arrays of the shards of their lines: probes and arrays meet by shard, no line text is
   joined. A shard with many probes (a very common line) is read by several tasks, as many as its counts ask for.
4. Each document drops the lines whose keys are to go.

The index holds all distinct hashes, so a probe of an indexed document always finds its own slot; the fingerprint
guards probes of documents outside the index. Two keys are taken for one only if their 128-bit hashes agree.

Defined cases: null and empty texts have one empty line; every row counts as a document of its own, rows that
repeat the largest doc_id all keep their lines, and so do rows without a doc_id, which count as documents too; a repeated line inside one document counts once for it; an empty
table gives no rows. Only the id and text columns are read; ``drop_lines`` passes all other columns on.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.llm.common import free, map_batches, mix, stored, string_array, table, with_columns

BLANK = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null doc_id
SHARD_KEYS, SHARD_PROBES = 200_000, 400_000
LEVELS = 24  # a level keeps about 60 % of its hashes; what is left after the last lies in a sorted list


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None where the key is shorter than ``min_chars`` code points."""
    out = []
    for line in text.split("\n"):
        key = line.strip(BLANK) if len(line) >= min_chars else ""
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars and key else None)
    return out


def _pairs(keys: set[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))


def probes_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, h1, h2: the distinct long line keys of each row."""
    def run(batch):
        ids, hashes, n = batch.column(0), [], []
        for text in batch.column(1).to_pylist():
            keys = {k for k in line_keys(text or "", min_chars) if k is not None}
            hashes.append(_pairs(keys))
            n.append(len(keys))
        both = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
            names=["doc_id", "h1", "h2"])
    return map_batches(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col)), run, "doc_id long, h1 long, h2 long")


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h1 ^ (h2 * np.uint64(2 * level + 0x9E3779B97F4A7C15))) % np.uint64(size)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct (h1, h2), the leftover pairs, and each pair's slot."""
    left, levels, slot, base = np.arange(len(h1)), [], np.zeros(len(h1), np.int64), 0
    while len(left) and len(levels) < LEVELS:
        size = max(64, len(left))
        at = _slots(h1[left], h2[left], len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
        base += int(alone.sum())
        levels.append(np.packbits(alone))
        left = left[~mine]
    rest = left[np.lexsort((h2[left], h1[left]))]
    slot[rest] = base + np.arange(len(rest))
    return levels, np.stack([h1[rest], h2[rest]], 1), slot


def find(levels: list[np.ndarray], sizes: list[int], rest: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each pair; -1 where no level holds it."""
    out, todo, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for k, (packed, size) in enumerate(zip(levels, sizes)):
        if not len(todo):
            break
        bits = np.unpackbits(packed, count=size).astype(bool)
        at = _slots(h1[todo], h2[todo], k, size)
        mine = bits[at]
        out[todo[mine]] = base + (np.cumsum(bits) - 1)[at[mine]]
        base += int(bits.sum())
        todo = todo[~mine]
    if len(rest) and len(todo):
        known = {(int(a), int(b)): base + i for i, (a, b) in enumerate(rest)}
        out[todo] = [known.get((int(a), int(b)), -1) for a, b in zip(h1[todo], h2[todo])]
    return out


INDEX = T.StructType([T.StructField("shard", T.LongType()), T.StructField("levels", T.ArrayType(T.BinaryType())),
                      T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("rest", T.BinaryType()),
                      T.StructField("prints", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                      T.StructField("keep", T.BinaryType()), T.StructField("probes", T.LongType())])


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1 + h2 * np.uint64(3)) >> np.uint64(32)).astype(np.uint32)


def _shard_arrays(group: pa.Table) -> pa.Table:
    """One shard's counted hashes as perfect hash and arrays."""
    h1, h2 = (group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    levels, rest, slot = build(h1, h2)
    prints, counts, keep = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
    n = group.column("n").to_numpy()
    prints[slot] = fingerprint(h1, h2)
    counts[slot] = np.minimum(n, (1 << 32) - 1)
    keep[slot] = group.column("last").to_numpy()
    sizes, remaining = [], len(h1)
    for packed in levels:
        sizes.append(max(64, remaining))
        remaining -= int(np.unpackbits(packed).sum())
    row = {"shard": group.column("shard")[0].as_py(), "levels": [x.tobytes() for x in levels], "sizes": sizes,
           "rest": rest.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "keep": keep.tobytes(),
           "probes": int(n.sum())}
    return pa.Table.from_pylist([row], schema=pa.schema([
        ("shard", pa.int64()), ("levels", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("rest", pa.binary()),
        ("prints", pa.binary()), ("counts", pa.binary()), ("keep", pa.binary()), ("probes", pa.int64())]))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("h1"), F.lit(shards)).alias("shard")


def build_index(probes: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The stored index, one row per shard, and the number of shards (from the number of distinct hashes)."""
    counted = stored(probes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))
    index = counted.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(_shard_arrays, INDEX)
    return stored(index, "line-index"), shards


def _probe(min_docs: int):
    def run(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        """The (doc_id, h1, h2) of a shard whose lines are to go."""
        if not (arrays.num_rows and asked.num_rows):
            return pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        row = arrays.slice(0, 1).to_pylist()[0]
        h1, h2 = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slot = find([np.frombuffer(x, np.uint8) for x in row["levels"]], row["sizes"],
                    np.frombuffer(row["rest"], np.uint64).reshape(-1, 2), h1, h2)
        known = slot >= 0
        known[known] = np.frombuffer(row["prints"], np.uint32)[slot[known]] == fingerprint(h1[known], h2[known])
        drop = known.copy()
        drop[known] = np.frombuffer(row["counts"], np.uint32)[slot[known]] >= min_docs
        ids = asked.column("doc_id").to_numpy()
        drop[drop] = (np.frombuffer(row["keep"], np.int64)[slot[drop]] != ids[drop]) & (ids[drop] != NO_ID)
        return pa.table({"doc_id": ids[drop], "h1": h1[drop].view(np.int64), "h2": h2[drop].view(np.int64)})
    return run


def probe_index(index: DataFrame, shards: int, probes: DataFrame, min_docs: int, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """doc_id, h1, h2 of the lines to drop. Shards with many probes are dealt to several tasks."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("probes") / F.lit(shard_probes))).cast("long")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    width = index.select(F.col("shard"), parts.alias("parts"))
    asked = probes.withColumn("shard", shard_of(shards)).join(width, "shard").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    return dealt.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(
        _probe(min_docs), "doc_id long, h1 long, h2 long")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` and ``_llm_lines``, ``_llm_dropped``, ``_llm_kept`` (the text that stays); columns of these names are replaced."""
    docs = docs.drop("_llm_lines", "_llm_dropped", "_llm_kept")
    lost, key = free(docs, "_llm_gone"), free(docs, "_llm_id")
    probes = probes_of(docs, id_col, text_col, min_chars)
    index, shards = build_index(probes)
    gone = probe_index(index, shards, probes, min_docs).groupBy("doc_id").agg(
        F.collect_list(F.struct("h1", "h2")).alias(lost)).select(F.col("doc_id").alias(key), lost)

    def run(batch):
        lines, dropped, kept = [], [], []
        gone = batch.column(batch.schema.get_field_index(lost)).to_pylist()
        for text, out in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), gone):
            rows = (text or "").split("\n")
            lines.append(len(rows))
            if out:
                out = {np.array([x["h1"], x["h2"]], np.int64).astype(">i8").tobytes() for x in out}
                rows = [r for r, k in zip(rows, line_keys(text, min_chars)) if k is None or k not in out]
            dropped.append(lines[-1] - len(rows))
            kept.append(text or "" if dropped[-1] == 0 else "\n".join(rows))
        return with_columns(batch, _llm_lines=pa.array(lines, pa.int64()), _llm_dropped=pa.array(dropped, pa.int64()),
                            _llm_kept=string_array(kept))

    joined = docs.join(gone, docs[id_col].cast("long") == gone[key], "left").drop(key)
    schema = T.StructType([*joined.schema.fields, T.StructField("_llm_lines", T.LongType()),
                           T.StructField("_llm_dropped", T.LongType()), T.StructField("_llm_kept", T.StringType())])
    return map_batches(joined, run, schema).drop(lost)


SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line,
             unnest(range(len(string_split(text, chr(10))))) as i from t),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, count(distinct r) as n, max(doc_id) as last from k where length(key) >= 40 group by key),
s as (select k.*, c.n >= 5 and k.doc_id <> c.last as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where coalesce(gone, false)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not coalesce(gone, false)), '')) as kept_sha256
from s group by r, doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_llm_lines").alias("n_lines"), F.col("_llm_dropped").alias("n_dropped"),
                      F.sha2(F.col("_llm_kept"), 256).alias("kept_sha256"))


