"""Operator 13: SimHash near duplicates with BK-trees.

1. Each text gets a 64-bit SimHash of its hashed word shingles. Equal fingerprints are one node, so copies form no pairs.
2. Shards: the 64 bits are cut into ``radius + 2`` blocks. Two fingerprints that differ in at most ``radius`` bits have two equal
   blocks or more, so they meet in the shard of such a pair of blocks. Every shard has a BK-tree: children of a node are keyed
   by their distance to it. A tree goes to every task that holds queries of its shard (one task mostly, several where a shard is
   larger than ``CHUNK``); one broadcast of all trees would hold every fingerprint and has no size bound.
3. A fingerprint searches the tree of its shard and follows only edges whose distance differs from its own distance to the node by at most
   ``radius``. Subtrees that are known to be of its own component are passed over. A task gives the links that join components,
   never all pairs of a group.
4. The links' components give every document the smallest doc_id that it reaches.

Trees of all shards in a bin are built and searched together on numpy arrays, level by level.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any other; texts with fewer words
than a shingle have one shingle; equal texts and repeated rows are one component; null doc_ids never are a component's
name unless all its ids are null; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import map_batches, ready, stored, table, text_or_empty, word_pieces
from tickloom.llm.components import components
from tickloom.llm.joins import left_by_count

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a shard that one task takes as a tree, and rows of a bin of shards.
CHUNK, BIN_ROWS = 20_000, 50_000
#: Pairs of query and node that a search expands at once; queries between two looks at the components.
FRONTIER, QUERIES = 1 << 16, 4096
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """SimHash of a text: bits that more than half of its shingles' XXH64 have."""
    counts, n, carried, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for piece in word_pieces(raw.translate(_lower)):
        own = carried + piece
        carried = own[max(0, len(own) - words + 1):]
        if len(own) < words:
            continue
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(own) - words + 1].tolist(), ends[words - 1:].tolist())]
        counts += bit_counts(hashes)
        n += len(hashes)
    if not n:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        found = np.array([fingerprint(t.encode(), words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def block_masks(radius: int) -> list[int]:
    """Bit masks of all pairs of the ``radius + 2`` blocks, as signed longs."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def shard_rows(nodes: DataFrame, radius: int, chunk: int) -> DataFrame:
    """shard (number of the block pair and its bits), low, high, own, fp: members of shards with two or more.

    A shard of k chunks is searched as pairs of chunks (low <= high): the tree of chunk ``low``, queries of chunk ``high``;
    ``own`` is the member's chunk.
    """
    fp = F.col("fp")
    keys = F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(block_masks(radius))))
    rows = nodes.select("fp", F.explode(keys).alias("shard"))
    sizes = stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bk-shards")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    members = left_by_count(rows, sizes, "shard", "n", total).filter("n > 1")
    chunks = F.expr(f"cast((n + {chunk - 1}) div {chunk} as int)")
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return members.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")


class Forest:
    """BK-trees over ``nodes`` (fingerprints, distinct in each group), one tree per group; groups are numbers from 0 on."""

    def __init__(self, fp: np.ndarray, nodes: np.ndarray, group: np.ndarray, groups: int):
        self.fp, self.root = fp, np.full(groups, -1, np.int64)
        present, first = np.unique(group, return_index=True)
        self.root[present] = nodes[first]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # by depth: children and their parents
        left, at = np.delete(nodes, first), self.root[np.delete(group, first)]
        keys = []
        while len(left):
            key, child, member = np.unique(at * 65 + np.bitwise_count(fp[left] ^ fp[at]), return_index=True, return_inverse=True)
            child_node = left[child]
            self.edges.append((child_node, key // 65))
            keys.append((key, child_node))
            stays = np.ones(len(left), bool)
            stays[child] = False
            left, at = left[stays], child_node[member[stays]]
        self.keys = np.concatenate([k for k, _ in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.children = (np.concatenate([c for _, c in keys]) if keys else self.keys)[order]

    def spans(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest part in the subtree of each node."""
        low, high = part.copy(), part.copy()
        for child, parent in reversed(self.edges):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return low, high

    def near(self, queries: np.ndarray, group: np.ndarray, radius: int, skip):
        """Pairs (query, node) within the radius, in pieces; ``skip`` tells which pairs of query and subtree need no search."""
        stack = [(queries, self.root[group])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack.append((q[FRONTIER:], node[FRONTIER:]))
                q, node = q[:FRONTIER], node[:FRONTIER]
            wanted = ~skip(q, node)
            q, node = q[wanted], node[wanted]
            if not len(q):
                continue
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            # only edges whose distance differs from d by at most the radius can lead to a hit
            a = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            b = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = b - a
            if n.any():
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.children[at]))


def joining_links(fp: np.ndarray, group: np.ndarray, groups: int, in_tree: np.ndarray, asks: np.ndarray, radius: int):
    """Index pairs within the radius that join all components of each group: a spanning forest of its links."""
    part = np.arange(len(fp))
    nodes, queries = np.flatnonzero(in_tree), np.flatnonzero(asks)
    tree = Forest(fp, nodes, group[nodes], groups)
    queries = queries[tree.root[group[queries]] >= 0]
    found: list[tuple[int, int]] = []
    for a in range(0, len(queries), QUERIES):
        low, high = tree.spans(part)
        own = queries[a:a + QUERIES]
        for q, node in tree.near(own, group[own], radius, lambda q, node: (low[node] == high[node]) & (low[node] == part[q])):
            apart = part[q] != part[node]
            if not apart.any():
                continue
            q, node = q[apart], node[apart]
            x, y = np.minimum(part[q], part[node]), np.maximum(part[q], part[node])
            _, first = np.unique(x * len(fp) + y, return_index=True)
            above: dict[int, int] = {}

            def top(p: int) -> int:
                while p in above:
                    p = above[p]
                return p
            for i in first.tolist():
                u, v = top(int(x[i])), top(int(y[i]))
                if u != v:
                    above[max(u, v)] = min(u, v)
                    found.append((int(q[i]), int(node[i])))
            renamed = np.arange(len(fp))
            for p in above:
                renamed[p] = top(p)
            part = renamed[part]
            low, high = tree.spans(part)
    return found


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, bin_rows: int = BIN_ROWS) -> DataFrame:
    """u, v: links between different fingerprints (column ``fp``) that join all that differ in at most ``radius`` bits."""
    rows = stored(shard_rows(nodes, radius, chunk), "bk-members")
    bins = max(1, -(-rows.count() // bin_rows))
    binned = rows.select(F.pmod(F.xxhash64("shard", "low", "high"), F.lit(bins)).alias("bin"), "shard.t", "shard.bits", "low", "high", "own", "fp")

    def run(members: pa.Table) -> pa.Table:
        t, bits, low, high, own, fp = (members.column(c).to_numpy() for c in ("t", "bits", "low", "high", "own", "fp"))
        order = np.lexsort((fp, high, low, bits, t))
        t, bits, low, high, own, fp = t[order], bits[order], low[order], high[order], own[order], fp[order].view(np.uint64)
        new = np.append(True, (np.diff(t) != 0) | (bits[1:] != bits[:-1]) | (np.diff(low) != 0) | (np.diff(high) != 0))
        group = np.cumsum(new) - 1
        pairs = joining_links(fp, group, int(group[-1]) + 1, own == low, own == high, radius)
        u, v = (fp[np.array(side, np.int64)].view(np.int64) for side in (zip(*pairs) if pairs else ((), ())))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})
    return stored(binned.groupBy("bin").applyInArrow(run, "u long, v long").distinct(), "bk-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, radius: int = RADIUS,
                    chunk: int = CHUNK, bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = stored(fingerprints(docs, id_col, text_col, words), "bk-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "bk-nodes")
    parts = components(links(nodes.select("fp"), radius, chunk, bin_rows)).withColumnRenamed("node", "fp")
    linked = stored(parts.join(nodes, "fp"), "bk-parts")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(names, "component").select("fp", "n", "component_id")
    alone = nodes.filter("n > 1").join(parts, "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    named = stored(linked.unionByName(alone), "bk-names")
    out = left_by_count(rows, named, "fp", "n", rows.count())
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(ready(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
