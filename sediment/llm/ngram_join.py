"""N-gram Jaccard join with a count-vector R-tree: groups of documents linked by shared word shingles.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.75.
Tokens (64-bit shingle hashes) are hashed into GROUPS groups; a document's group counts are a point,
and the summed coordinate minima of two points, or of a point and a node's upper corner, bound the
overlap from above. An R-tree over such points answers "who can still reach the overlap that the
sizes demand", and survivors are verified on their whole sets.

How it runs without all pairs:

1. Equal sets are one class; everything after works on classes.
2. Linked sets of sizes x and y share at least s of their first n - ceil(0.75 n) + s tokens, for any s, in any one global
   order. With s about WITNESS percent of the set, a class stays in play only if so many of those tokens are also held by a class of
   a size that it could link with; strangers that share a few phrases leave here, before any point or set moves. With s = 1 the
   same rule gives the prefix of which linked classes share a token. Rarer tokens come first in the order: those that repeat
   inside tasks are counted, and the most frequent go last, so a passage that thousands share is not what documents meet on.
   The order changes cost, never results.
3. Classes in play that share a prefix token form a group, cut where sizes leave a gap that no link crosses; tokens with the
   same members are one group, and groups with the same two least classes are united. Each member is bounded against the group's
   pivot and its neighbour in size, a number of pairs in proportion to the group, and each class's most promising pairs are verified.
4. Only groups whose members are still in different components go to the R-trees: groups are cut into blocks, block pairs
   inside one component are skipped, and each remaining block pair is one bounded job. Its tree gives the candidate pairs of
   different components, and the job tells a spanning forest of them, at most an edge a member. The clusters that
   all forests form hold every candidate pair; each is searched once more by a tree, with whole sets at hand, in blocks where
   it is large, joining components as it goes, so a link inside a component is never tried.

Nulls and edges: a null or empty text (or one of white space) has an empty set and links with
nothing, its own kind included; rows with a null doc_id have no component (null) but their count;
repeated rows and ids each give a row; an empty table gives an empty result; other columns are ignored.
Sets are compared by 64-bit hashes (48 bits within a verified pair).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm import wordhash
from sediment.llm.components import components
from sediment.llm.staging import drop, lean, partitions, release, small_batches, stage

GROUPS = 128  # coordinates of a point
FINE_GROUPS = 1024  # and of a set of at least FINE_FROM tokens, whose coarse point is its fold: large sets need them to tell strangers apart
FINE_FROM = 1024
LEAF = 16  # points of a leaf and children of a node
BLOCK = 512  # members of a token group's block
CLUSTER_BLOCK = 1024  # members of a candidate cluster's block
PARTNERS = 2  # most promising pairs of a class that are verified before the search
WITNESS = 8  # percent of a set that a linked set must hold of its extended prefix
HEAVY_LOCAL = 8  # occurrences inside a task that make a token worth counting
HEAVY_MAX = 1 << 17  # most frequent tokens that go last in the order: 2 MB, broadcast
BUFFER = 2_000_000  # prefix entries a task holds before it writes them out
SHINGLE = 5
THRESHOLD = 75  # percent


def _per_doc(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Bounds of each document's tokens in arrays ordered by document."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def _class_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(wordhash.mix(hashes ^ np.uint64(0x5DEECE66D)), dtype=np.uint64))
        return wordhash.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, cls, point) for documents; rows (token, hits) for tokens frequent inside a task. A class has its point once a task, on its first row with an id."""
    names = ["doc_id", "n", "cls", "point", "token", "hits"]

    def run(batches):
        seen, held, size = set(), [], 0

        def heavy():
            token, hits = np.unique(np.concatenate(held), return_counts=True)
            token, hits = token[hits >= HEAVY_LOCAL], hits[hits >= HEAVY_LOCAL]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(hits.astype(np.int64))], names)

        for batch in batches:
            doc, token = wordhash.shingles(batch.column(1), SHINGLE)
            bounds = _per_doc(doc, batch.num_rows)
            n, cls = np.diff(bounds), _class_keys(token, bounds)
            none = pa.nulls(batch.num_rows, pa.int64())
            fresh = np.zeros(batch.num_rows, bool)
            named = batch.column(0).is_valid().to_pylist()
            for k, c in enumerate(cls.tolist()):
                if named[k] and c not in seen:
                    seen.add(c)
                    fresh[k] = n[k] > 0
            points = pa.array([point_of(token[bounds[k] : bounds[k + 1]]) if fresh[k] else None for k in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cls.view(np.int64), mask=n == 0), points, none, none], names)
            held.append(token[fresh[doc]])
            size += len(held[-1])
            if size >= 2 * BUFFER:
                yield heavy()
                held, size = [], 0
        if held:
            yield heavy()

    return docs.mapInArrow(lean(run), "doc_id long, n long, cls long, point binary, token long, hits long")


def _counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(((hashes >> np.uint64(16)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def point_of(hashes: np.ndarray) -> bytes:
    """Group counts, in one, two or four bytes each as the largest needs."""
    counts = _counts(hashes, FINE_GROUPS if len(hashes) >= FINE_FROM else GROUPS)
    most = counts.max()
    return counts.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


class Points:
    """Coarse points of all rows, fine ones of those that have them, and exact sizes."""

    def __init__(self, rows: list[np.ndarray]):
        """rows: count vectors of GROUPS or FINE_GROUPS coordinates."""
        self.where = np.full(len(rows), -1)
        large = [k for k, r in enumerate(rows) if len(r) == FINE_GROUPS]
        self.where[large] = np.arange(len(large))
        self.fine = np.stack([rows[k] for k in large]).astype(np.int32) if large else np.zeros((0, FINE_GROUPS), np.int32)
        self.coarse = np.zeros((len(rows), GROUPS), np.int32)
        small = np.flatnonzero(self.where < 0)
        if len(small):
            self.coarse[small] = np.stack([rows[k] for k in small])
        if large:
            self.coarse[large] = self.fine.reshape(len(large), -1, GROUPS).sum(1)
        self.sizes = self.coarse.sum(1)

    @classmethod
    def decode(cls, column: list[bytes]) -> Points:
        kinds = {n * k: f"<u{k}" for n, widths in ((GROUPS, (1, 2, 4)), (FINE_GROUPS, (1, 2, 4))) for k in widths}
        return cls([np.frombuffer(x, kinds[len(x)]) for x in column])

    @classmethod
    def of_sets(cls, sets: list[np.ndarray]) -> Points:
        """From unpacked sets, which have lost the 16 low bits that groups don't use."""
        return cls([_counts(s << np.uint64(16), FINE_GROUPS if len(s) >= FINE_FROM else GROUPS) for s in sets])

    def overlaps(self, x: np.ndarray, other: Points, y: np.ndarray) -> np.ndarray:
        """Summed coordinate minima of rows x here and rows y there, by fine points where both have them."""
        out = np.minimum(self.coarse[x], other.coarse[y]).sum(1)
        both = np.flatnonzero((self.where[x] >= 0) & (other.where[y] >= 0))
        if len(both):
            out[both] = np.minimum(self.fine[self.where[x[both]]], other.fine[other.where[y[both]]]).sum(1)
        return out


def bounded(sizes_x, sizes_y, overlaps):
    """Whether an overlap of at most `overlaps` allows a link."""
    return (100 + THRESHOLD) * overlaps >= THRESHOLD * (sizes_x + sizes_y)


class TokenOrder:
    """The global order of tokens: unlisted ones by hash, then listed ones by rising frequency."""

    def __init__(self, tokens: np.ndarray):
        """tokens: uint64, by falling frequency."""
        order = np.argsort(tokens)
        self.tokens, self.ranks = tokens[order], (len(tokens) - order).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.tokens >> np.uint64(44)] = True

    def rank(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        if len(self.tokens):
            at = np.flatnonzero(self.maybe[token >> np.uint64(44)])
            k = np.minimum(np.searchsorted(self.tokens, token[at]), len(self.tokens) - 1)
            hit = self.tokens[k] == token[at]
            out[at[hit]] = self.ranks[k[hit]]
        return out

    def places(self, doc: np.ndarray, token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each token's place (tokens come ordered by document and hash) in its document's order."""
        rank = self.rank(token)
        listed = np.zeros(len(bounds) - 1, bool)
        listed[doc[rank > 0]] = True
        place = np.arange(len(token)) - bounds[doc]
        mixed = np.flatnonzero(listed[doc])
        order = mixed[np.argsort((doc[mixed] << 20) | rank[mixed], kind="stable")]
        place[order] = place[mixed]
        return place


def witnesses(n):
    """How many tokens of the extended prefixes two linked sets share at least, by the size of the smaller one."""
    return 1 + n * WITNESS // 100


def prefix_entries(docs: DataFrame, order, n_ranges: int) -> DataFrame:
    """Extended prefix tokens of each class as packed (token, class, 2 * size + 1 if in the plain prefix) arrays, by range of token."""
    names = ["range", "token", "cls", "size"]

    def run(batches):
        seen, held, size = set(), [], 0

        def flush():
            token, cls, n = (np.concatenate(x) for x in zip(*held))
            part = ((token >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
            by = np.argsort(part, kind="stable")
            token, cls, n, part = token[by], cls[by], n[by], part[by]
            at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
            cuts = [[x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] for x in (token, cls, n)]
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), *[pa.array(c, pa.binary()) for c in cuts]], names)

        for batch in batches:
            doc, token = wordhash.shingles(batch.column(0), SHINGLE)
            bounds = _per_doc(doc, batch.num_rows)
            n, cls = np.diff(bounds), _class_keys(token, bounds)
            fresh = np.zeros(batch.num_rows, bool)
            for k, c in enumerate(cls.tolist()):
                if n[k] and c not in seen:
                    seen.add(c)
                    fresh[k] = True
            place, spare = order.value.places(doc, token, bounds), (n + (-THRESHOLD * n) // 100)[doc]
            take = (place < spare + witnesses(n)[doc]) & fresh[doc]
            held.append((token[take], cls[doc[take]], (2 * n[doc[take]] + (place <= spare)[take]).astype(np.uint32)))
            size += int(take.sum())
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(lean(run), "range int, token binary, cls binary, size binary")


def _runs(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a row of (key, size), ordered so, begins a run of one key in which each size could link with the one before."""
    return np.append(True, (key[1:] != key[:-1]) | (100 * n[:-1] < THRESHOLD * n[1:]))[: len(key)]


def _grouped(key: np.ndarray, cls: np.ndarray, n: np.ndarray):
    """Rows ordered by (key, size, class) and distinct, to runs of two or more with a key that names the member set; of equal sets one stays: (key, cls, n, first row of each run)."""
    begin = _runs(key, n)
    first = np.flatnonzero(begin)
    if not len(first):
        return cls[:0], cls[:0], n[:0], first
    count = np.diff(np.append(first, len(key)))
    with np.errstate(over="ignore"):
        name = wordhash.mix(np.add.reduceat(wordhash.mix(cls.view(np.uint64)), first) + count.astype(np.uint64)).view(np.int64)
    good = np.zeros(len(first), bool)
    good[np.unique(name, return_index=True)[1]] = True
    good &= count > 1
    row, count = np.repeat(good, count), count[good]
    return np.repeat(name[good], count), cls[row], n[row], np.cumsum(count) - count


def token_groups(entries: DataFrame, n_partitions: int) -> DataFrame:
    """Rows (grp, cls, n) of plain-prefix tokens that two or more classes share, and rows (cls, n, hits): shared tokens of an extended prefix."""
    names = ["grp", "cls", "n", "hits"]

    def one_range(parts):
        token, cls, size = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in enumerate((np.uint64, np.int64, np.uint32)))
        order = np.argsort(token)
        token = token[order]
        again = np.append(token[1:] == token[:-1], False)
        keep = again | np.append(False, again[:-1])
        order, token = order[keep], token[keep]
        cls, plain, n = cls[order], size[order] & 1, (size[order] >> 1).astype(np.int64)
        order = np.lexsort((cls, n, token))
        token, cls, plain, n = token[order], cls[order], plain[order], n[order]
        keep = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))[: len(token)]
        token, cls, plain, n = token[keep], cls[keep], plain[keep] == 1, n[keep]
        begin = _runs(token, n)
        hit = ~(begin & np.append(begin[1:], True)) if len(begin) else begin
        which, at, hits = np.unique(cls[hit], return_index=True, return_counts=True)
        sizes = n[hit][at]
        grp, cls, n, _ = _grouped(token[plain & hit], cls[plain & hit], n[plain & hit])
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none(len(which)), pa.array(which), pa.array(sizes), pa.array(hits)], names)
        for k in range(0, len(grp), 20_000):
            yield pa.RecordBatch.from_arrays([*[pa.array(x[k : k + 20_000]) for x in (grp, cls, n)], none(len(grp[k : k + 20_000]))], names)

    def run(batches):
        by_range: dict[int, list] = {}
        for batch in batches:
            for r, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                by_range.setdefault(r, []).append(arrays)
        for r in sorted(by_range):
            yield from one_range(by_range.pop(r))

    return entries.repartition(n_partitions, "range").mapInArrow(lean(run), "grp long, cls long, n long, hits long")


def _families(grp: np.ndarray, cls: np.ndarray, n: np.ndarray):
    """Groups (ordered by key) renamed by their two least classes and those of one name united: (name, cls, n), ordered by (name, size, class) and distinct.

    Near copies share tens of prefix tokens with slightly different holders each time; what belongs together is searched once.
    """
    first = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grp))))
    least = np.minimum.reduceat(cls, first)
    second = np.minimum.reduceat(np.where(cls == least[group], np.iinfo(np.int64).max, cls), first)
    with np.errstate(over="ignore"):
        name = wordhash.mix(wordhash.mix(least.view(np.uint64)) + second.view(np.uint64)).view(np.int64)[group]
    order = np.lexsort((cls, n, name))
    name, cls, n = name[order], cls[order], n[order]
    keep = np.append(True, (name[1:] != name[:-1]) | (cls[1:] != cls[:-1]))
    return name[keep], cls[keep], n[keep]


def groups_in_play(found: DataFrame, able: DataFrame, n_partitions: int) -> DataFrame:
    """(grp, cls, n, pivot, pivot_n, prev, prev_n): the groups of `found` without the classes that are not in `able`, by families (a partition's part of each)."""
    names = ["grp", "cls", "n", "pivot", "pivot_n", "prev", "prev_n"]

    def run(batches):
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        grp, cls, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((cls, n, grp))
        grp, cls, n = grp[order], cls[order], n[order]
        keep = np.append(True, (grp[1:] != grp[:-1]) | (cls[1:] != cls[:-1]))
        grp, cls, n, first = _grouped(grp[keep], cls[keep], n[keep])
        if not len(grp):
            return
        # _grouped keeps runs apart by place, and equal names are one run
        grp, cls, n = _families(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grp)))), cls, n)
        first = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grp))))
        at = np.flatnonzero(cls == np.minimum.reduceat(cls, first)[group])[group]
        before = np.arange(len(cls)) - 1
        before[first] = at[first]
        out = [grp, cls, n, cls[at], n[at], cls[before], n[before]]
        for k in range(0, len(grp), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 20_000]) for x in out], names)

    rows = found.filter("grp is not null").select("grp", "cls", "n").join(able.select("cls"), "cls").select("grp", "cls", "n")
    return rows.repartition(n_partitions, "grp").mapInArrow(lean(run), "grp long, cls long, n long, pivot long, pivot_n long, prev long, prev_n long")


def pack_set(hashes: np.ndarray) -> bytes:
    """Sorted 48-bit hashes, six bytes each."""
    return (hashes >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = overlap(x, y)
    return 100 * shared >= THRESHOLD * (len(x) + len(y) - shared)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the wanted classes (cls, rep), from the text of each class's representative."""

    def run(batches):
        for batch in batches:
            doc, token = wordhash.shingles(batch.column(1), SHINGLE)
            bounds = _per_doc(doc, batch.num_rows)
            ours = np.flatnonzero(_class_keys(token, bounds).view(np.int64) == batch.column(0).to_numpy())
            for k in range(0, len(ours), 2000):
                some = ours[k : k + 2000]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array([pack_set(token[bounds[i] : bounds[i + 1]]) for i in some], pa.binary())], ["cls", "set"])

    rows = docs.join(wanted, docs.doc_id == wanted.rep).select("cls", "text")
    return rows.mapInArrow(lean(run), "cls long, set binary")


def verify_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        known, held = None, None
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = []
            for k in range(len(a)):
                if a[k] != known:
                    known, held = a[k], unpack_set(x[k])
                good.append(linked(held, unpack_set(y[k])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.withColumnRenamed("cls", "b").withColumnRenamed("set", "y"), "b")
    two = one.join(sets.withColumnRenamed("cls", "a").withColumnRenamed("set", "x"), "a")
    return two.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def bound_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow a link, with the similarity that they allow."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (Points.decode(batch.column(k).to_pylist()) for k in (2, 3))
                each = np.arange(batch.num_rows)
                both, most = x.sizes + y.sizes, x.overlaps(each, y, each)
                good = bounded(x.sizes, y.sizes, most)
                allowed = pa.array(most / np.maximum(1, both - most))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), allowed], ["a", "b", "allowed"]).filter(pa.array(good))

    point = lambda c, name: classes.select(F.col("cls").alias(c), F.col("point").alias(name))
    return pairs.join(point("b", "y"), "b").join(point("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long, allowed double")


def best_partners(pairs: DataFrame, each: int = PARTNERS) -> DataFrame:
    """The pairs (a, b) that are among the `each` most promising of a or of b: verifying them moves each set about so many times."""
    ends = pairs.select("a", "b", "allowed").union(pairs.select("b", "a", "allowed"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("allowed"), "b"))
    best = ends.withColumn("place", place).filter(F.col("place") <= each)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def by_job(batches):
    """Tables of whole jobs from batches ordered by job (the first column)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        job = table.column(0).to_numpy()
        if not len(job):
            continue
        last = int(np.flatnonzero(job != job[-1])[-1]) + 1 if job[0] != job[-1] else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


class CountTree:
    """R-tree over group-count points, packed bottom-up. Nodes keep their upper corner and least set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        by_size = np.argsort(sizes, kind="stable")
        slab = np.empty(len(sizes), np.int64)
        slab[by_size] = np.arange(len(sizes)) // (LEAF * LEAF)
        self.rows = np.lexsort((points[:, 1], points[:, 0], slab))
        self.levels = [(points[self.rows].astype(np.int32), sizes[self.rows])]
        while len(self.levels[-1][1]) > LEAF:
            corner, least = self.levels[-1]
            first = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(corner, first), np.minimum.reduceat(least, first)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound allows a link, best bound first."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[at], point).sum(1)
            able = bounded(size, least[at], bound)
            at, bound = at[able], bound[able]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.rows[at[np.argsort(-bound, kind="stable")]]


def _candidates(points: Points, rows: np.ndarray, roots: np.ndarray, side: np.ndarray):
    """(asking row, candidate rows of other roots) of a job whose points are `rows`: between its two sides, or within its only one."""
    two = side.min() != side.max()
    base = np.flatnonzero(side == side.min())
    sizes = points.sizes[rows]
    coarse = points.coarse[rows]
    tree = CountTree(coarse[base], sizes[base])
    for q in np.flatnonzero(side == side.max()):
        found = base[tree.search(coarse[q], int(sizes[q]))]
        found = found[roots[found] != roots[q]]
        found = found if two else found[found < q]
        if len(found) and points.where[rows[q]] >= 0:
            fine = points.overlaps(np.full(len(found), rows[q]), points, rows[found])
            found = found[bounded(sizes[q], sizes[found], fine)]
        yield int(q), found


class _Roots:
    """Union-find over component roots."""

    def __init__(self, roots):
        self.parent = {int(r): int(r) for r in roots}

    def top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def meet(self, x: int, y: int) -> None:
        self.parent[max(x, y)] = min(x, y)


def join_block(keys: np.ndarray, roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect different roots among members; not every link, but every connection."""
    if not len(keys):
        return []
    union, out = _Roots(roots), []
    for q, found in _candidates(Points.of_sets(sets), np.arange(len(keys)), roots, side):
        for k in found:
            x, y = union.top(int(roots[q])), union.top(int(roots[k]))
            if x != y and linked(sets[q], sets[k]):
                union.meet(x, y)
                out.append((int(keys[q]), int(keys[k])))
    return out


def spanning_forest(cls: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (lower class, higher class) that connect what the pairs of rows connect; those of the lowest classes go first, so jobs with the same members tell the same edges."""
    union, out = _Roots(cls), []
    for a, b in sorted((min(x, y), max(x, y)) for x, y in ((int(cls[i]), int(cls[j])) for i, j in pairs)):
        x, y = union.top(a), union.top(b)
        if x != y:
            union.meet(x, y)
            out.append((a, b))
    return out


def tree_candidates(rows: DataFrame, n_partitions: int) -> DataFrame:
    """Spanning forests (a, b) of the candidate pairs of all jobs (job, side, cls, root, point). Groups repeat edges; a task tells each about once."""

    def run(batches):
        told: set[tuple[int, int]] = set()
        for table in by_job(batches):
            job, side, cls, root = (table.column(k).to_numpy() for k in range(4))
            points = Points.decode(table.column(4).to_pylist())
            at = np.append(np.flatnonzero(np.append(True, job[1:] != job[:-1])), len(job))
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                pairs = [(q, k) for q, found in _candidates(points, np.arange(a, b), root[a:b], side[a:b]) for k in found.tolist()]
                for edge in spanning_forest(cls[a:b], pairs):
                    if edge not in told:
                        told.add(edge)
                        out.append(edge)
            if len(told) > 500_000:
                told.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    ordered = rows.select("job", "side", "cls", "root", "point").repartition(n_partitions, "job").sortWithinPartitions("job")
    return ordered.mapInArrow(lean(run), "a long, b long")


def cluster_links(edges: DataFrame, roots: DataFrame, sets: DataFrame, n_partitions: int) -> DataFrame:
    """Links that connect different roots within the clusters that the edges (a, b) form.

    A set moves once to its cluster, or once a block pair in a cluster of more than CLUSTER_BLOCK members.
    """
    clusters = components(edges)
    sizes = stage(clusters.groupBy("root").agg(F.count("*").alias("members")), "jaccard-cluster-sizes")
    n_blocks = F.ceil(F.col("members") / CLUSTER_BLOCK).cast("int")
    placed = clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), n_blocks.alias("blocks"), F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("block"))
    placed = placed.join(roots, "node", "left").select("node", "cluster", "blocks", "block", F.coalesce("root", "node").alias("root"))
    each = placed.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    job = F.xxhash64("cluster", F.least("block", "peer"), F.greatest("block", "peer")).alias("job")
    needs = stage(each.select(job, F.col("node").alias("cls"), "root", F.when(F.col("block") <= F.col("peer"), 0).otherwise(1).alias("side")), "jaccard-needs")
    rows = needs.join(sets, "cls").select("job", "side", "cls", "root", "set")

    def run(batches):
        for table in by_job(batches):
            job, side, cls, root = (table.column(k).to_numpy() for k in range(4))
            at = np.append(np.flatnonzero(np.append(True, job[1:] != job[:-1])), len(job))
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                out += join_block(cls[a:b], root[a:b], side[a:b], [unpack_set(x) for x in table.column(4).slice(a, b - a).to_pylist()])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    ordered = rows.repartition(n_partitions, "job").sortWithinPartitions("job", "side", "cls")
    return ordered.mapInArrow(lean(run), "a long, b long")


def open_jobs(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (job, side, cls, root) of the groups whose members lie in different components, cut into block pairs."""
    placed = groups.select("grp", "cls").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    placed = stage(placed.select("grp", "cls", F.coalesce("root", "cls").alias("root")), "jaccard-placed")
    open_ = placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select("grp", "members")
    open_ = stage(open_, "jaccard-open")
    half = BLOCK // 2
    rest = placed.join(open_, "grp")
    small = rest.filter(F.col("members") <= BLOCK).select(F.xxhash64("grp").alias("job"), F.lit(0).alias("side"), "cls", "root")
    wide = stage(rest.filter(F.col("members") > BLOCK), "jaccard-rest")  # groups that need blocks
    sizes = stage(wide.groupBy("grp", "root").agg(F.count("*").alias("held")), "jaccard-sizes")
    large = F.col("held") > half
    pool = F.pmod(F.xxhash64("root"), F.ceil(F.col("members") / half))
    block = F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / half)))).otherwise(pool)
    cut = stage(wide.join(sizes, ["grp", "root"]).select("grp", "cls", "root", block.alias("block"), F.when(large, F.col("root")).alias("only")), "jaccard-blocks")
    blocks = stage(cut.select("grp", "block", "only").distinct(), "jaccard-block-list")
    other = blocks.select("grp", F.col("block").alias("block2"), F.col("only").alias("only2"))
    jobs = blocks.join(other, "grp").filter("block <= block2 and not (only is not null and only2 is not null and only = only2)")
    job = F.xxhash64("grp", "block", "block2").alias("job")
    sided = jobs.select("grp", "block", job, F.lit(0).alias("side")).union(jobs.filter("block <> block2").select("grp", F.col("block2").alias("block"), job, F.lit(1).alias("side")))
    rows = stage(small.union(cut.join(stage(sided, "jaccard-jobs"), ["grp", "block"]).select("job", "side", "cls", "root")), "jaccard-job-rows")
    drop(placed, open_, wide, sizes, blocks, cut)
    return rows


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs` (doc_id long, text string)."""
    with small_batches(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    width = partitions(spark)
    signed = stage(signatures(docs), "jaccard-signatures")
    heavy = signed.filter("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "token").limit(HEAVY_MAX)
    tokens = np.array([r[0] for r in heavy.select("token").toLocalIterator()], np.int64).view(np.uint64)
    order = spark.sparkContext.broadcast(TokenOrder(tokens))
    found = stage(token_groups(prefix_entries(docs, order, 8 * width), width), "jaccard-tokens")
    release(spark)
    hits = found.filter("hits is not null").groupBy("cls").agg(F.sum("hits").alias("hits"), F.max("n").alias("n"))
    least_partner = F.ceil(F.col("n") * THRESHOLD / 100)
    able = hits.filter(F.col("hits") >= 1 + F.floor(least_partner * WITNESS / 100)).select("cls")
    mine = signed.filter("cls is not null and doc_id is not null")
    classes = mine.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("point", ignorenulls=True).alias("point"))
    classes = stage(classes.join(able, "cls"), "jaccard-classes")
    groups = stage(groups_in_play(found, classes, width), "jaccard-groups")
    drop(found)
    fits = lambda m: (F.col("cls") != F.col(m)) & (100 * F.least("n", f"{m}_n") >= THRESHOLD * F.greatest("n", f"{m}_n"))
    pair = lambda m: groups.filter(fits(m)).select(F.least("cls", m).alias("a"), F.greatest("cls", m).alias("b"))
    pairs = stage(pair("pivot").union(pair("prev")).distinct(), "jaccard-star")
    near = stage(best_partners(stage(bound_pairs(pairs, classes), "jaccard-near")), "jaccard-pairs")
    sets = stage(sets_of(docs, classes.select("cls", "rep").join(groups.select("cls").distinct(), "cls")), "jaccard-sets")
    links = stage(verify_pairs(near, sets), "jaccard-links")
    drop(pairs, near)
    first = components(links)
    jobs = open_jobs(groups, first)
    drop(groups, links)
    edges = stage(tree_candidates(jobs.join(classes.select("cls", "point"), "cls"), width), "jaccard-candidates")
    drop(jobs)
    more = stage(cluster_links(edges, first, sets, width), "jaccard-more-links")
    drop(sets, edges)
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    drop(first, more)
    rooted = stage(classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls").select("cls", "rep", "root"), "jaccard-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("rep").alias("least")), "jaccard-least")
    linked_ = rooted.join(least, "root").select("cls", "least")
    alone = mine.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    named = stage(alone.join(linked_, "cls", "left").select("cls", F.coalesce("least", "rep").alias("component_id")), "jaccard-named")
    drop(rooted, least, roots, classes)
    rows = signed.filter("token is null").select("doc_id", "n", "cls").join(named, "cls", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op6_count_vector_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
