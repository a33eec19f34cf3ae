"""Operator 12: Merkle manifest of a table, with proofs by descent through content-addressed records.

``manifest`` makes a leaf of every row, numbers the leaves of each group by their key, and folds runs of ``FANOUT`` nodes level by level
to the group's subroot; the subroots are folded likewise to the root. Every inner node is a record digest -> children, and records
of ``LEVELS`` levels form a segment that one task folds. A tree of any size is a few tiers of segments.

``proofs`` answers requests of leaves from these records alone. Requests descend from the root: the digits of a rank (base ``FANOUT``)
choose the child, the children not chosen are collected. They descend segment by segment: the upper segments are walked once for
each segment below them, not once for each leaf. The path runs from the root down and is reversed at the end. A record that is
missing or a descent that ends at another digest gives a null path.

Defined cases: null values count as ``-``; rows that repeat a key stand in the order of their leaves, so equal rows have equal
leaves; null keys come first, null groups are a group of their own before the empty name; the proof of a lone leaf of a lone group
is the digest of nothing; an empty table gives no rows; columns that are not named are not read.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.llm.common import ready, stored, table
from tickloom.llm.joins import numbered

FANOUT = 2
#: Levels of a segment: 1,024 leaves of a binary tree.
LEVELS = 10
PATH = "array<struct<at:int,others:array<string>>>"


def leaf(*columns: Column) -> Column:
    """Digest of the values: ``-`` for null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def fold(digests: list[str], fanout: int, levels: int, top: bool) -> tuple[str, int, dict[str, list[str]]]:
    """Root of the nodes, number of levels, records. The top segment ends at one node, others after all their levels."""
    records, height = {}, 0
    while len(digests) > 1 if top else height < levels:
        runs = [digests[i:i + fanout] for i in range(0, len(digests), fanout)]
        digests = [sha256("".join(run).encode()).hexdigest() for run in runs]
        records.update(zip(digests, runs))
        height += 1
    return digests[0], height, records


@dataclass
class Tree:
    """Tiers of segments of the trees of all groups; columns of each: g, block, digest, height, top, n, digests, children."""
    fanout: int
    levels: int
    tiers: list[DataFrame] = field(default_factory=list)

    @property
    def width(self) -> int:
        return self.fanout ** self.levels

    def roots(self) -> DataFrame:
        """g, digest: the root of each group's tree."""
        tops = [t.filter("top").select("g", "digest") for t in self.tiers]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def records(self) -> DataFrame:
        """digest, children of all inner nodes."""
        out = None
        for t in self.tiers:
            rows = t.select(F.explode(F.arrays_zip("digests", "children")).alias("r")).select("r.digests", "r.children")
            out = rows if out is None else out.unionByName(rows)
        return out.withColumnRenamed("digests", "digest").distinct()


def build(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Tree:
    """Trees of ``leaves`` (g, rank, rank_of, digest), tier by tier."""
    tree, width = Tree(fanout, levels), fanout ** levels

    def run(segment: pa.Table) -> pa.Table:
        segment = segment.sort_by("rank")
        n = segment.column("rank_of")[0].as_py()
        top = n <= width
        root, height, records = fold(segment.column("digest").to_pylist(), fanout, levels, top)
        return pa.table({"g": segment.column("g").slice(0, 1), "block": segment.column("block").slice(0, 1), "digest": [root],
                         "height": pa.array([height], pa.int32()), "top": [top], "n": pa.array([-(-n // width)], pa.int64()),
                         "digests": pa.array([list(records)], pa.list_(pa.string())),
                         "children": pa.array([list(records.values())], pa.list_(pa.list_(pa.string())))})
    items = leaves.select("g", "rank", "rank_of", "digest")
    while True:
        cut = items.withColumn("block", F.expr(f"rank div {width}"))
        tier = stored(cut.groupBy("g", "block").applyInArrow(
            run, "g string, block long, digest string, height int, top boolean, n long, digests array<string>, children array<array<string>>"), "merkle-tier")
        tree.tiers.append(tier)
        if tier.filter("not top").isEmpty():
            return tree
        items = tier.filter("not top").select("g", F.col("block").alias("rank"), F.col("n").alias("rank_of"), "digest")


def _descend(requests: DataFrame, segments: DataFrame, fanout: int, width: int) -> DataFrame:
    """Requests (g, rank, digest, more) with subroot and path, from segments that have a subroot and a path."""
    schema = T.StructType([*requests.schema.fields, T.StructField("subroot", T.StringType()), *T._parse_datatype_string(f"path {PATH}").fields])

    def run(asked: pa.Table, segment: pa.Table) -> pa.Table:
        asked = asked.drop_columns(["block"])
        at, counts, others, path_stops = [], [], [], []
        known = segment.num_rows > 0
        if known:
            row = segment.to_pylist()[0]
            records = dict(zip(row["digests"], row["children"]))
            above = [(s["at"], s["others"]) for s in row["path"]] if row["path"] is not None else None
            powers = [fanout ** k for k in range(row["height"] - 1, -1, -1)]
        for rank, digest in zip(asked.column("rank").to_pylist(), asked.column("digest").to_pylist()):
            steps = list(above) if known and above is not None else None
            if steps is not None:
                node = row["digest"]
                for power in powers:
                    children, k = records.get(node, ()), rank // power % fanout
                    if k >= len(children):
                        steps = None
                        break
                    steps.append((k, children[:k] + children[k + 1:]))
                    node = children[k]
                if steps is not None and node != digest:
                    steps = None
            for k, rest in steps or ():
                at.append(k)
                counts.append(len(rest))
                others += rest
            path_stops.append(len(at) if steps is not None else None)
        stops, last = [], 0
        for s in path_stops:  # offsets of the lists; a null list has an offset of null
            stops.append(last if s is not None else None)
            last = s if s is not None else last
        stops.append(last)
        ends = [0]
        for c in counts:
            ends.append(ends[-1] + c)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others, pa.string()))
        steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), lists], names=["at", "others"])
        paths = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), steps)
        subroot = pa.array([row["subroot"] if known else None] * asked.num_rows, pa.string())
        return asked.append_column("subroot", subroot).append_column("path", paths)
    cut = requests.withColumn("block", F.expr(f"rank div {width}"))
    return cut.groupBy("g", "block").cogroup(segments.groupBy("g", "block")).applyInArrow(run, schema)


def descend(tree: Tree, requests: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Requests (g, rank, digest of leaves, more columns) with subroot and path, root first.

    ``above``: g, subroot, path of each root; without it paths begin at the roots of the trees.
    """
    below = None
    for t in range(len(tree.tiers) - 1, -1, -1):
        segments = tree.tiers[t]
        tops = segments.filter("top")
        if above is None:
            tops = tops.withColumns({"subroot": F.col("digest"), "path": F.expr(f"cast(array() as {PATH})")})
        else:
            tops = tops.join(above, "g").select(*segments.columns, "subroot", "path")
        if below is not None:
            inner = segments.filter("not top").join(below.select("g", F.col("rank").alias("block"), "subroot", "path"), ["g", "block"])
            tops = tops.unionByName(inner.select(*segments.columns, "subroot", "path"))
        if t == 0:
            return _descend(requests, tops, tree.fanout, tree.width)
        asked = tree.tiers[t - 1].filter("not top").select("g", F.col("block").alias("rank"), "digest")
        below = stored(_descend(asked, tops, tree.fanout, tree.width), "merkle-paths")


@dataclass
class Manifest:
    leaves: DataFrame  # g, rank, digest and the columns carried along
    groups: Tree
    top: Tree
    subroots: DataFrame  # g, rank, digest
    root: str | None


def manifest(rows: DataFrame, group: str, key: str, digest: str = "digest", *, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The trees of ``rows`` (one leaf each, column ``digest``): one per value of ``group``, leaves by ``key``; and the tree of the subroots."""
    named = rows.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")))
    if digest != "digest":
        named = named.withColumnRenamed(digest, "digest")
    leaves = stored(numbered(stored(named, "merkle-leaves"), "merkle-sorted", "rank", "g", [F.col(key), F.col("digest")]), "merkle-ranked")
    groups = build(leaves, fanout, levels)
    subroots = stored(numbered(groups.roots(), "merkle-subroots", "rank", None, [F.col("g")]), "merkle-subroots-ranked")
    top = build(subroots.withColumn("g", F.lit("")), fanout, levels)
    root = top.roots().first()
    return Manifest(leaves.drop("rank_of"), groups, top, subroots.drop("rank_of"), root["digest"] if root else None)


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The requested leaves (all without ``requests``; columns g, rank, digest and more) with subroot and path, the leaf's siblings first."""
    asked = m.subroots.select(F.lit("").alias("g"), "rank", "digest", F.col("g").alias("name"))
    above = stored(descend(m.top, asked).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "path"), "merkle-above")
    found = descend(m.groups, m.leaves if requests is None else requests, above)
    return found.withColumn("path", F.reverse("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest gives with the siblings of a path."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(
        F.array_join(F.slice(step["others"], F.lit(1), step["at"]), ""), node,
        F.array_join(F.slice(step["others"], step["at"] + 1, F.size(step["others"])), "")), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: step["others"])), ""), 256)


SQL = r"""
with recursive v as (select doc_id, lang, n_chars, 'x' as x,
  case when doc_id is null then '-' else concat(strlen(doc_id::varchar), ':', doc_id) end
    || case when source is null then '-' else concat(strlen(source), ':', source) end || case when lang is null then '-' else concat(strlen(lang), ':', lang) end as a,
  case when text is null then '-' else concat(strlen(text), ':', text) end as b,
  list_reduce(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda s: ascii(s)::bigint),
    lambda c, s: list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, s)), 4294967295::bigint) as crc from documents),
l as (select doc_id, lang, sha256(a || case when n_chars is null then '-' else concat(strlen(n_chars::varchar), ':', n_chars) end || b) as leaf,
  sha256(a || case when n_chars is null then '-' else concat(strlen((n_chars + 1)::varchar), ':', n_chars + 1) end || b) as changed,
  doc_id is not null and xor(crc, 4294967295) % 7 = 0 as tampered from v),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by lang) as n from l),
tree as (select lang, 0 as lvl, r, leaf as h, n from r
  union all select lang, lvl + 1, r // 2, sha256(string_agg(h, '' order by r)), any_value((n + 1) // 2) from tree where n > 1 group by lang, lvl, r // 2),
subs as (select lang, h as subroot, lvl as height, row_number() over (order by lang nulls first) - 1 as q, count(*) over () as n from tree where n = 1),
high as (select 0 as lvl, q, subroot as h, n from subs
  union all select lvl + 1, q // 2, sha256(string_agg(h, '' order by q)), any_value((n + 1) // 2) from high where n > 1 group by lvl, q // 2),
top as (select h as root, lvl as levels from high where n = 1),
steps as (select r.lang, r.r, i.lvl, (r.r >> i.lvl) & 1 as side, t.h from r join subs s on r.lang is not distinct from s.lang
    join (select unnest(range(0, 64)) as lvl) i on i.lvl < s.height
    left join tree t on t.lang is not distinct from r.lang and t.lvl = i.lvl and t.r = xor(r.r >> i.lvl, 1)
  union all select r.lang, r.r, 100 + i.lvl, (s.q >> i.lvl) & 1, t.h from r join subs s on r.lang is not distinct from s.lang
    join (select unnest(range(0, 64)) as lvl) i on i.lvl < (select levels from top)
    left join high t on t.lvl = i.lvl and t.q = xor(s.q >> i.lvl, 1)),
paths as (select lang, r, coalesce(string_agg(h, '' order by lvl), '') as siblings,
    list(case when h is null then '' when side = 1 then 'l' || h else 'r' || h end order by lvl) as path from steps group by lang, r),
out as (select r.*, s.subroot, p.siblings, list_reduce(coalesce(p.path, []::varchar[]), lambda node, x: sha256(case when x = '' then node when x[1] = 'l' then x[2:] || node else node || x[2:] end),
    case when tampered then changed else leaf end) as folded_root
  from r join subs s on r.lang is not distinct from s.lang left join paths p on p.lang is not distinct from r.lang and p.r = r.r)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = root as verified from out, top
"""

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = leaf(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    rows = docs.select("doc_id", "lang", leaf(*(F.col(c) for c in FIELDS)).alias("digest"), F.when(tampered, changed).alias("changed"))
    m = manifest(rows, "lang", "doc_id")
    found = proofs(m)
    back = folded(F.coalesce("changed", "digest"), F.col("path"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                        back.alias("folded_root")).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))
