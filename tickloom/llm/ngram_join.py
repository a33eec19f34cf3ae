"""Operator 8: similarity join on word n-grams with count-vector R-trees.

Documents are sets of hashed 4-word shingles; equal sets are one node (copies never form pairs). Two sets link when
100 * intersection >= 85 * union. These are the values of the query; ``words`` and ``percent`` give others (the pipeline's stage
takes 5 and 80), and 4 and 0.85 below stand for them.

1. Routing: a set's shingles are put in one order for all sets (frequent ones last, then by hash). Linked sets share one of
   the first n - ceil(0.85 n) + 1 shingles of each, so sets meet in the groups of these shingles.
2. First links: in each group every set is paired with the group's first. These pairs are bounded by count vectors, verified,
   and joined to components. A group of near copies is mostly one component now, and no group emits all its pairs.
3. Count-vector R-tree: shingles are hashed into ``GROUPS`` groups, the numbers per group are a set's point (the tree sums them
   to ``COARSE`` coordinates; pairs that it finds are bounded again by all). Groups of step 1 whose
   members lie in several components are searched. Groups with the same first set are one neighbourhood, so near copies, which share
   many shingles, meet once. Points sorted by size are packed into leaves with bounding
   boxes; sum(min(a, b)) over the coordinates bounds the intersection of two points, and with the boxes' upper corners that of
   two leaves. Beyond about 6,000 shingles any two points of ``GROUPS`` coordinates allow a link, so sets of more than
   ``WIDE * GROUPS`` also have a wide point, with coordinates in proportion to their shingles. A first search over the points alone tells which sets have a partner of another component that may link; only
   these bring their shingles to a second search, which verifies the pairs and gives the links that join components. Both give at most
   one row per member and task, never the pairs of a group. Neighbourhoods beyond ``CHUNK`` sets are searched as pairs of chunks.

Every link between sets of different components passes step 3, so the components are exact. The order in step 1 rests on
shingles found in many sets of one Arrow batch, counted over all batches; any order gives the same result. Shingles and sets are
named by 64-bit hashes; among n different sets two share a name with odds of about n * n / 2^65.

Defined cases: null, empty and blank texts have the empty set and are alone; texts of one to three words (fewer than ``words``)
have one shingle; repeated rows and equal texts are one component; rows that repeat a doc_id are judged by their own text; a null
doc_id names a component only if all its ids are null; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tickloom.llm.common import LOWER, bytes_of, drop_stored, free, map_batches, map_groups, mix, stored, table, with_columns, word_hashes, word_spans
from tickloom.llm.components import components
from tickloom.llm.joins import left_by_count

WORDS, PERCENT = 4, 85
GROUPS, COARSE, LEAF = 256, 64, 64
#: Shingles a coordinate of a wide point counts at most on average, and bytes of wide points that are compared at a time.
WIDE, COMPARED = 8, 4 << 20
#: Shingles in this many sets of an Arrow batch count as frequent; at most FREQUENT of them (8 bytes each) are broadcast.
OFTEN, FREQUENT = 8, 500_000
#: Document ids that are broadcast at most (8 bytes each); beyond, the texts meet them by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets of a neighbourhood that one task searches, rows and bytes of shingles of a bin of neighbourhoods.
CHUNK, BIN_ROWS, BIN_BYTES = 4096, 50_000, 16 << 20
#: Bytes of texts that are split into words at a time; the arrays of words take about 20 times as much.
SPLIT = 1 << 20
_factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(texts: pa.Array, words: int = WORDS, distinct: bool = True) -> list[np.ndarray]:
    """Shingle hashes of each text, sorted and distinct if asked for, taken over about ``SPLIT`` bytes of texts at a time."""
    _, offsets = bytes_of(texts)
    out, at = [], 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPLIT, "right")) - 1)
        out += _shingle_sets(texts.slice(at, upto - at), words, distinct)
        at = upto
    return out


def _shingle_sets(texts: pa.Array, words: int, distinct: bool) -> list[np.ndarray]:
    data, offsets = bytes_of(texts)
    data = LOWER[data]
    start, end, first = word_spans(data, offsets)
    units = word_hashes(data, start, end)
    out = []
    factors = [_factors[k % 4] * np.uint64(2 * (k // 4) + 1) for k in range(words)]
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        own = units[a:b]
        if n >= words:
            total = own[:n - words + 1] * factors[0]
            for k in range(1, words):
                total += own[k:n - words + 1 + k] * factors[k]
            out.append(np.unique(mix(total)) if distinct else mix(total))
        elif n:
            out.append(mix((own * np.array(factors[:n])).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a set: equal sets have equal names."""
    return int(mix(np.array([mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


#: A coordinate that is never the smaller one: the point of a set that bytes cannot count.
MANY = 255


def point(shingles: np.ndarray) -> np.ndarray:
    """Numbers of shingles per group. Sets with more in a group than a byte holds get the point that is never pruned."""
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.full(GROUPS, MANY, np.uint8) if counts.max() >= MANY else counts.astype(np.uint8)


def wide_point(shingles: np.ndarray) -> np.ndarray:
    """Numbers of shingles in so many groups (a power of two) that sets without common shingles are told apart.

    Empty for sets whose ``point`` does that, and for those that bytes cannot count.
    """
    if len(shingles) <= WIDE * GROUPS:
        return np.zeros(0, np.uint8)
    groups = 1 << (-(-len(shingles) // WIDE) - 1).bit_length()
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.zeros(0, np.uint8) if counts.max() > 255 else counts.astype(np.uint8)


class WidePoints:
    """Wide points of some sets, or an empty one. The wider of two is folded to the other's width, which sums its groups."""

    def __init__(self, points: list[np.ndarray]):
        self.points, self.width = points, np.array([len(p) for p in points], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All points of this width or more as rows of this width, and the row of each set."""
        if width not in self.folded:
            some = np.flatnonzero(self.width >= width)
            rows = np.empty((len(some), width), np.uint16 if self.width.max() <= 256 * width else np.uint32)
            for k, i in enumerate(some):
                rows[k] = self.points[i].reshape(-1, width).sum(axis=0, dtype=rows.dtype)
            place = np.zeros(len(self.points), np.int64)
            place[some] = np.arange(len(some))
            self.folded[width] = rows, place
        return self.folded[width]

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A bound of the intersection of each pair, without limit if one of them has no wide point."""
        out, width = np.full(len(x), 1 << 40, np.int64), np.minimum(self.width[x], self.width[y])
        for w in np.unique(width[width > 0]).tolist():
            rows, place = self._rows(w)
            which, some = np.flatnonzero(width == w), max(1, COMPARED // (w * rows.itemsize))
            for k in range(0, len(which), some):
                at = which[k:k + some]
                out[at] = np.minimum(rows[place[x[at]]], rows[place[y[at]]]).sum(axis=1, dtype=np.int64)
        return out


def points_of(raw: pa.Array) -> np.ndarray:
    """The points of a column without nulls, not copied."""
    return bytes_of(raw)[0].reshape(-1, GROUPS)


def wide_of(raw: pa.Array) -> list[np.ndarray]:
    """The wide points of a column without nulls, not copied."""
    data, offsets = bytes_of(raw)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc (as given), set (null without shingles), n, point, wide (point, mostly empty) of every row."""
    def run(batch):
        sets = shingle_sets(batch.column(1), words)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                                           pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary()),
                                           pa.array([wide_point(s).tobytes() for s in sets], pa.binary())],
                                          names=["doc_id", "set", "n", "point", "wide"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, set long, n long, point binary, wide binary")


def _distinct(sets: list[np.ndarray]) -> dict[int, np.ndarray]:
    return {set_id(s): s for s in sets if len(s)}


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that many sets share, the most frequent ``FREQUENT``."""
    def run(batch):
        sets = list(_distinct(shingle_sets(batch.column(0), words)).values())
        values, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])
    counted = map_batches(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def prefix_rows(docs: DataFrame, last: np.ndarray, words: int, percent: int) -> DataFrame:
    """token, set, n: the first shingles of each distinct set of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batch):
        late, out, names, sizes, counts = shared.value, [], [], [], []
        for name, s in _distinct(shingle_sets(batch.column(0), words)).items():
            k = prefix_length(len(s), percent)
            if len(late):
                at = np.searchsorted(late, s)
                at[at == len(late)] = 0
                is_late = late[at] == s
                s = np.concatenate([s[~is_late], s[is_late]])
            out.append(s[:k])
            names.append(name)
            sizes.append(len(s))
            counts.append(k)
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), counts)),
                                           pa.array(np.repeat(np.array(sizes, np.int64), counts))], names=["token", "set", "n"])
    return map_batches(docs.select("text"), run, "token long, set long, n long")


def near_in_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def first_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """a, b: each set of a group with the group's first by name, which is mostly the same set in all groups of near copies."""
    first = groups.groupBy("token").agg(F.min("set").alias("s"))
    size = groups.select(F.col("token"), F.col("set").alias("s"), F.col("n").alias("m"))
    rows = groups.join(first.join(size, ["token", "s"]), "token")
    pairs = rows.filter((F.col("s") != F.col("set")) & near_in_size("n", "m", percent))
    return pairs.select(F.col("s").alias("a"), F.col("set").alias("b")).distinct()


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points allow a link: sum of the coordinate minima bounds the intersection."""
    def side(x):
        return points.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"), F.col("wide").alias(f"w{x}"))

    def run(batch):
        na, nb = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("na", "nb"))
        pa_, pb = (points_of(batch.column(batch.schema.get_field_index(c))) for c in ("pa", "pb"))
        inter = np.minimum(pa_, pb).sum(axis=1, dtype=np.int64)
        keep = (100 * inter >= percent * (na + nb - inter)) | (pa_[:, 0] == MANY) | (pb[:, 0] == MANY)
        at = np.flatnonzero(keep)
        wide = WidePoints([p for c in ("wa", "wb") for p in wide_of(batch.column(batch.schema.get_field_index(c)).take(pa.array(at)))])
        inter = np.minimum(wide.bound(np.arange(len(at)), np.arange(len(at), 2 * len(at))), np.minimum(na[at], nb[at]))
        keep[at] = 100 * inter >= percent * (na[at] + nb[at] - inter)
        return batch.select(["a", "b"]).filter(pa.array(keep))
    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


def shingle_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set, shingles (sorted, 8 bytes each) of the wanted sets; ``wanted``: set, doc_id of one document that has it."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted.select(F.col("doc_id").alias("_w"), "set"), F.col("doc_id").eqNullSafe(F.col("_w"))).select("text", "set")

    def run(batch):
        names, raw = [], []
        for s, name in zip(shingle_sets(batch.column(0), words), batch.column(1).to_pylist()):
            if len(s) and set_id(s) == name:  # rows may repeat a doc_id with another text
                names.append(name)
                raw.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(raw, pa.binary())], names=["set", "shingles"])
    return map_batches(rows, run, "set long, shingles binary")


def whole_sets(docs: DataFrame, sets: DataFrame, needed: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """set, shingles of the needed sets, and the documents they are taken from; both stored."""
    wanted = stored(sets.join(needed, "set").select("set", "doc_id"), "needed-sets")
    return stored(shingle_rows(docs, wanted, words), "shingles"), wanted


def _shingles(column: pa.Array) -> list[np.ndarray]:
    """The shingles of each set of a column without nulls, not copied."""
    data, offsets = bytes_of(column)
    return [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of shingles link."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    inter = int((y[at] == x).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v of the pairs that link, by their whole sets."""
    pairs = stored(pairs, "bounded-pairs")
    needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    whole, wanted = whole_sets(docs, sets, needed, words)

    def run(batch):
        keep = [linked(x, y, percent) for x, y in zip(_shingles(batch.column(2)), _shingles(batch.column(3)))]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])
    both = pairs.join(whole.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(
        whole.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    out = stored(map_batches(both, run, "u long, v long"), "set-links")
    drop_stored(pairs, whole, wanted)
    return out


class RTree:
    """Points packed into leaves by size; leaves have the upper corners of their boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int, leaf: int = LEAF, wide: list[np.ndarray] | None = None):
        coarse = points.reshape(len(points), COARSE, -1).sum(axis=2, dtype=np.int32)
        many = points[:, 0] == MANY
        coarse[many] = 1 << 24
        self.order = np.lexsort((*coarse.T[:2], sizes))
        self.whole, self.points, self.sizes, self.percent = points[self.order].astype(np.int32), coarse[self.order], sizes[self.order], percent
        self.whole[many[self.order]] = 1 << 24
        self.wide = WidePoints(wide) if wide and any(map(len, wide)) else None
        self.starts = np.arange(0, len(sizes), leaf)
        self.stops = np.append(self.starts[1:], len(sizes))
        self.corner = np.maximum.reduceat(self.points, self.starts)
        self.least, self.most = self.sizes[self.starts], self.sizes[self.stops - 1]

    def _may_link(self, overlap, a, b):
        return (100 + self.percent) * np.minimum(overlap, np.minimum(a, b)) >= self.percent * (a + b)

    def pairs(self, part: np.ndarray, side: np.ndarray, done):
        """Index pairs whose points may link and whose parts and sides differ, leaf pair by leaf pair.

        ``done`` tells of two leaves' members whether no pair of theirs is of use any more; ``part`` may change between the pairs.
        """
        for i in range(len(self.starts)):
            # leaves from here on whose sizes are near and whose boxes allow enough overlap
            after = np.arange(i, np.searchsorted(self.least * self.percent, self.most[i] * 100, "right"))
            bound = np.minimum(self.corner[after], self.corner[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(bound, np.minimum(self.most[i], self.most[after]))  # a pair with most in common has at least that size
            after = after[(100 + self.percent) * most >= self.percent * (np.maximum(self.least[i], most) + np.maximum(self.least[after], most))]
            a = self.order[self.starts[i]:self.stops[i]]
            for j in after:
                b = self.order[self.starts[j]:self.stops[j]]
                if done(a, b):
                    continue
                s, t = slice(self.starts[i], self.stops[i]), slice(self.starts[j], self.stops[j])
                overlap = np.minimum(self.points[s][:, None, :], self.points[t][None, :, :]).sum(axis=2, dtype=np.int64)
                ok = self._may_link(overlap, self.sizes[s][:, None], self.sizes[t][None, :])
                ok &= (part[a][:, None] != part[b][None, :]) & (side[a][:, None] != side[b][None, :])
                x, y = np.nonzero(ok)
                if i == j:
                    x, y = x[x < y], y[x < y]
                x, y = x + self.starts[i], y + self.starts[j]
                overlap = np.minimum(self.whole[x], self.whole[y]).sum(axis=1, dtype=np.int64)
                keep = self._may_link(overlap, self.sizes[x], self.sizes[y])
                x, y = x[keep], y[keep]
                if self.wide and len(x):
                    keep = self._may_link(self.wide.bound(self.order[x], self.order[y]), self.sizes[x], self.sizes[y])
                    x, y = x[keep], y[keep]
                if len(x):
                    yield self.order[x], self.order[y]


def neighbourhoods(groups: DataFrame, known: DataFrame, chunk: int) -> DataFrame:
    """s, low, high, own, set, n, part: the sets of groups that hold several components, by the groups' first set.

    Of a neighbourhood of k chunks the members of two chunks (low <= high) are searched together; ``own`` is a member's chunk.
    """
    parted = groups.join(known, "set", "left").withColumn("part", F.coalesce("component", "set")).drop("component")
    mixed = parted.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("set").alias("s")).filter("low < high").select("token", "s")
    members = stored(parted.join(mixed, "token").select("s", "set", "n", "part").distinct(), "neighbourhoods")
    large = stored(members.groupBy("s").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > chunk), "large-neighbourhoods")
    counted = left_by_count(members, large, "s", "m", members.count())
    chunks = F.expr(f"cast((coalesce(m, 1) + {chunk - 1}) div {chunk} as int)")
    dealt = counted.withColumn("own", F.pmod(F.xxhash64("set"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select("s", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set", "n", "part")


def _searches(members: pa.Table):
    """Rows of each neighbourhood (or pair of chunks) in a bin, and a side for each row: rows of one side are not paired."""
    s, low, high, own, name = (members.column(c).to_numpy() for c in ("s", "low", "high", "own", "set"))
    order = np.lexsort((high, low, s))
    new = (np.diff(s[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    for rows in np.split(order, np.flatnonzero(new) + 1):
        yield rows, own[rows] if low[rows[0]] != high[rows[0]] else name[rows]


def _numbers(members: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and parts as small numbers."""
    return members.column("n").to_numpy()[rows], np.unique(members.column("part").to_numpy()[rows], return_inverse=True)[1]


def with_partners(members: DataFrame, sets: DataFrame, percent: int, bin_rows: int) -> DataFrame:
    """The members that have, by their points, a partner of another component that may link."""
    wide = F.when(F.col("n") > WIDE * GROUPS, F.expr(f"n div {WIDE // 2}")).otherwise(0)
    count, size = members.agg(F.count(F.lit(1)), F.sum(wide + GROUPS)).first()
    bins = max(1, -(-count // bin_rows), -(-(size or 0) // BIN_BYTES))
    rows = members.join(sets.select("set", "point", "wide"), "set").withColumn("bin", F.pmod(F.xxhash64("s", "low", "high"), F.lit(bins)))
    columns = members.columns

    def run(group: pa.Table) -> pa.Table:
        raw, found = np.concatenate([points_of(c) for c in group.column("point").chunks]), np.zeros(group.num_rows, bool)
        wide = [p for c in group.column("wide").chunks for p in wide_of(c)]
        for at, side in _searches(group):
            n, part = _numbers(group, at)
            has = np.zeros(len(at), bool)
            for x, y in RTree(raw[at], n, percent, wide=[wide[i] for i in at]).pairs(part, side, lambda a, b: has[a].all() and has[b].all()):
                has[x] = has[y] = True
            found[at] = has
        return group.select(columns).filter(pa.array(found))
    return map_groups(rows.groupBy("bin"), run, members.schema)


def joining_links(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """u, v: verified links that join all components of each neighbourhood that linked sets lie in."""
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-8 * total // BIN_BYTES))
    rows = members.join(whole, "set").withColumn("bin", F.pmod(F.xxhash64("s", "low", "high"), F.lit(bins)))

    def run(group: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        name, raw = group.column("set").to_numpy(), [s for c in group.column("shingles").chunks for s in _shingles(c)]
        for at, side in _searches(group):
            own = [raw[i] for i in at]
            n, part = _numbers(group, at)
            tree = RTree(np.stack([point(s) for s in own]), n, percent, wide=[wide_point(s) for s in own])
            for x, y in tree.pairs(part, side, lambda a, b: len(a) == 0 or (part[a] == part[a[0]]).all() and (part[b] == part[a[0]]).all()):
                for i, j in zip(x.tolist(), y.tolist()):
                    if part[i] != part[j] and linked(own[i], own[j], percent):
                        found.append((int(name[at[i]]), int(name[at[j]])))
                        part[part == part[j]] = part[i]
        return pa.table({"u": pa.array([p[0] for p in found], pa.int64()), "v": pa.array([p[1] for p in found], pa.int64())})
    return map_groups(rows.groupBy("bin"), run, "u long, v long").distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, set, n, part (smallest set of the component, null without shingles) of every row."""
    rows = stored(set_rows(docs, words), "sets")
    sets = rows.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"),
                                                                   F.first("wide").alias("wide"))

    around = Window.partitionBy("token")
    groups = prefix_rows(docs, frequent(docs, words), words, percent).repartition("token")
    groups = groups.withColumn("low", F.min("set").over(around)).withColumn("high", F.max("set").over(around))
    groups = stored(groups.filter("low < high").select("token", "set", "n").distinct(), "groups")

    links = verified(bounded(first_pairs(groups, percent), sets, percent), docs, sets, words, percent)
    known = components(links).select(F.col("node").alias("set"), "component")
    members = stored(neighbourhoods(groups, known, CHUNK), "searched-sets")
    drop_stored(groups)
    near = stored(with_partners(members, sets, percent, BIN_ROWS), "sets-with-partners")
    whole, wanted = whole_sets(docs, sets, near.select("set").distinct(), words)
    more = stored(joining_links(near, whole, percent), "joining-links")
    drop_stored(members, near, whole, wanted)

    parts = components(links.unionByName(more)).select(F.col("node").alias("set"), "component")
    drop_stored(links, more)
    return rows.join(parts, "set", "left").withColumn("part", F.coalesce("component", "set")).select("doc_id", "set", "n", "part")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named = _classes(_texts(docs, id_col, text_col), words, percent)
    smallest = named.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "part", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each component: its smallest id. Rows without shingles all stay.

    The ids and sets that go, and those that rows repeat, meet the texts; so the texts are not shuffled as long as these are few.
    """
    named = _classes(_texts(docs, id_col, text_col), words, percent).filter(F.col("part").isNotNull())
    own, key, name = free(docs, "_llm_set"), free(docs, "_llm_id"), free(docs, "_llm_name")
    ids = stored(named.groupBy("part", "doc_id", "set").agg(F.count(F.lit(1)).alias("rows")), "classes")
    kept = ids.groupBy("part").agg(F.min(F.struct("doc_id", "set")).alias("k"))
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("set") == F.col("k.set"))
    marked = ids.join(kept, "part").select(F.col("doc_id").alias(key), F.col("set").alias(name), stays.alias("stays"), "rows")
    special = stored(marked.filter(~F.col("stays") | (F.col("rows") > 1)), "not-once")
    drop_stored(ids)
    few = F.broadcast if special.count() <= BROADCAST_IDS else lambda rows: rows
    repeated = special.filter("stays")

    def run(batch):
        sets = shingle_sets(batch.column(batch.schema.get_field_index(text_col)), words)
        return with_columns(batch, **{own: pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())})
    rows = map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    same = (F.col(own) == F.col(name)) & F.col(id_col).eqNullSafe(F.col(key))
    out = rows.join(few(special.select(key, name)), same, "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(few(repeated.select(key, name)), same, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)


SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from
      (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from t union select r.a, e.b from r join e on r.b = e.a)
select t.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id
from t left join n using (doc_id) join r on r.a = t.doc_id group by t.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
