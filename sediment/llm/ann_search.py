"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Largest inner product becomes smallest distance by one extra coordinate (vectors are scaled into
the unit ball and lifted onto its sphere). Each of TABLES tables hashes a vector by a few Gaussian
projections cut into slots. A query visits its own and perturbed buckets in the order of estimated
success, the chance that a neighbour at the expected distance falls there, until the visited
buckets hold SUCCESS of it. A first pass takes one distance for all queries, from a sample. The k-th
score it finds bounds each query's own distance from above, and a second pass visits the buckets
that are still missing at that distance, so a dense group of rows does not narrow the search of the
others. Candidates of all tables are scored exactly, in double precision on the original vectors,
and merged.

Rows are dealt to parts by (bucket, salt); a bucket larger than a part's fair share gets more salts,
so a hot bucket is split and its queries follow all its parts. Equal vectors are one index entry
that carries its k + 1 smallest ids, enough for exact ties. A query that finds fewer than it should
is searched again over all buckets.

Nulls and edges: rows whose id or vector is null, or whose vector is zero or holds null or
non-finite components, take no part, nor do vectors of a length other than the most common one's;
repeated rows count as separate candidates only under different ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.staging import drop, partitions, stage

TABLES = 2
SUCCESS = 0.78  # of each table
SAMPLE = 4096  # rows on which slot width and expected distance are fitted
BUCKET_ROWS = 128
PART_ROWS = 200_000  # index entries of a part
SEED = 7


def _gauss_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


class PStableHash:
    """Slots of Gaussian projections for every table."""

    def __init__(self, sample: np.ndarray, n: int, k: int, tables: int = TABLES, seed: int = SEED):
        """sample: original vectors; n: rows to index; k: neighbours wanted."""
        self.scale = 1.0  # set by the caller to the largest norm
        self.hashes = max(1, round(math.log(max(n, BUCKET_ROWS) / BUCKET_ROWS) / math.log(4.5)))
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.axes = rng.standard_normal((tables, width, self.hashes))
        self.shift = rng.random((tables, self.hashes))
        self.codes = rng.integers(1, 1 << 62, (tables, self.hashes + 1), dtype=np.int64).view(np.uint64) | np.uint64(1)
        self.n, self.k = n, k
        self.slot, self.reach = 1.5, 1.0

    def fit(self, sample: np.ndarray, scale: float) -> PStableHash:
        self.scale = scale
        lifted = self.lift(sample)
        self.slot = 1.5 * max(1e-9, float(np.std(lifted @ self.axes[0], axis=0).mean()))
        asks = self.lift_query(sample[:64])
        near = np.sort(2 - 2 * asks @ lifted.T, axis=None)
        rank = min(len(near) - 1, len(asks) + int(len(near) * self.k / max(self.n, 1)))  # each sampled query meets itself
        self.reach = math.sqrt(max(near[rank], 1e-12))
        return self

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]], 1)

    @staticmethod
    def lift_query(x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.concatenate([x, np.zeros((len(x), 1))], 1)

    def code(self, table: int, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = (slots.astype(np.int64).view(np.uint64).reshape(slots.shape) * self.codes[table, : self.hashes]).sum(-1, dtype=np.uint64) + self.codes[table, -1]
            out ^= out >> np.uint64(29)
            return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def buckets(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return self.code(table, np.floor(lifted @ self.axes[table] / self.slot + self.shift[table]))

    def distance(self, query: np.ndarray, score: float) -> float:
        """Lifted distance of an original query to a row with this inner product."""
        return math.sqrt(max(2 - 2 * score / (float(np.linalg.norm(query)) * self.scale), 1e-12))

    def probes(self, table: int, lifted: np.ndarray, success: float, near: float | None = None) -> np.ndarray:
        """Bucket codes of one query, likeliest first, until they hold `success` of the estimate for a neighbour at distance `near`."""
        z = lifted @ self.axes[table] / self.slot + self.shift[table]
        spread = (self.reach if near is None else near) / self.slot
        reach = int(math.ceil(4 * spread)) + 1
        ladders = []  # per projection: (probability, slot), falling
        for x in z:
            home = math.floor(x)
            slots = range(home - reach, home + reach + 1)
            ladders.append(sorted(((_gauss_cdf((s + 1 - x) / spread) - _gauss_cdf((s - x) / spread), s) for s in slots), reverse=True))
        first = (0,) * len(ladders)
        heap = [(-math.prod(lad[0][0] for lad in ladders), first, 0)]
        out, held = [], 0.0
        while heap and held < success:
            p, at, low = heapq.heappop(heap)
            held -= p
            out.append([lad[k][1] for lad, k in zip(ladders, at)])
            for j in range(low, len(at)):  # each combination is reached once: raise coordinates left to right
                if at[j] + 1 < len(ladders[j]) and (q := ladders[j][at[j] + 1][0]) > 0:
                    heapq.heappush(heap, (p / ladders[j][at[j]][0] * q, at[:j] + (at[j] + 1,) + at[j + 1 :], j))
        return self.code(table, np.array(out, float))


def _part(codes: np.ndarray, salt: np.ndarray | int, n_parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes.view(np.uint64) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int32)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v: array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", success: float = SUCCESS, tables: int = TABLES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k found rows of largest inner product, its own id excluded."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asks = stage(usable(queries, key, vector).distinct(), "ann-queries")
    each = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(each)).filter(F.col("r") <= k + 1)
    merged = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stage(merged.withColumn("entry", F.monotonically_increasing_id()), "ann-entries")  # a number of its own, fixed by the writing
    n, scale = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.v for r in entries.orderBy(F.xxhash64("ids")).limit(SAMPLE).select("v").collect()])
    hasher = PStableHash(sample, n, k, tables).fit(sample, scale)
    n_parts = max(partitions(spark), -(-n * tables // PART_ROWS))  # a worker holds a part

    def index(batches):
        for batch in batches:
            lifted = hasher.lift(_matrix(batch.column(0)))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(hasher.buckets(t, lifted)), *batch.columns], ["bucket", "v", "ids", "entry"])

    hashed = stage(entries.mapInArrow(index, "bucket long, v array<double>, ids array<long>, entry long"), "ann-index")
    fair = max(1, n * tables // n_parts)
    hot = {r.bucket: -(-r["count"] // fair) for r in hashed.groupBy("bucket").count().filter(F.col("count") > fair).collect()}  # fewer than n_parts buckets can be this large

    def deal(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy()
            salts = np.array([hot.get(c, 1) for c in codes.tolist()], np.int64)
            first = np.array([ids[0].as_py() for ids in batch.column(2)], np.int64) if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_part(codes, (first * 7919) % salts, n_parts)), *batch.columns], ["part", "bucket", "v", "ids", "entry"])

    def route(everywhere: bool, again: bool):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                worst = batch.column(2).to_pylist() if again else []
                out = []
                for q, lifted in enumerate(hasher.lift_query(x) if len(x) else x):
                    if everywhere:
                        out += [(p, q, b"") for p in range(n_parts)]
                        continue
                    codes = np.concatenate([hasher.probes(t, lifted, success) for t in range(tables)])
                    if again:
                        near = hasher.distance(x[q], worst[q])
                        codes = np.setdiff1d(np.concatenate([hasher.probes(t, lifted, success, near) for t in range(tables)]), codes)
                    parts = [_part(codes, 0, n_parts)]
                    split = np.array([c in hot for c in codes.tolist()], bool)
                    for c in codes[split]:
                        parts.append(_part(np.full(hot[int(c)] - 1, c), np.arange(1, hot[int(c)]), n_parts))
                    where = np.concatenate(parts)
                    whose = np.concatenate([codes, *[np.full(hot[int(c)] - 1, c) for c in codes[split]]])
                    out += [(int(p), q, np.unique(whose[where == p]).tobytes()) for p in np.unique(where)]
                if out:
                    p, q, b = zip(*out)
                    take = pa.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(b, pa.binary()), pa.array([worst[k] if again else None for k in q], pa.float64())], ["part", "id", "v", "probes", "worst"])

        return run

    keep = k + 2  # different entries a part
    room = tables * keep  # rows that surely hold them: an entry is met at most once a table

    def search(index_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        names = ["query_id", "ids", "score"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not index_rows.num_rows or not query_rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        order = np.argsort(index_rows.column("bucket").to_numpy(), kind="stable")
        codes, x, y = index_rows.column("bucket").to_numpy()[order], _matrix(index_rows.column("v"))[order], _matrix(query_rows.column("v"))
        bounds = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
        present = codes[bounds[:-1]]
        visits: list[list[int]] = [[] for _ in present]
        for q, blob in enumerate(query_rows.column("probes").to_pylist()):
            if blob:
                asked = np.frombuffer(blob, np.int64)
                at = np.minimum(np.searchsorted(present, asked), len(present) - 1)
                at = at[present[at] == asked]
            else:
                at = range(len(present))
            for b in at:
                visits[b].append(q)
        best = np.full((len(y), room), -np.inf)
        who = np.full((len(y), room), -1, np.int64)
        for b, qs in enumerate(visits):
            for low in range(0, len(qs), 512):
                some = np.array(qs[low : low + 512])
                score = y[some] @ x[bounds[b] : bounds[b + 1]].T
                both = np.concatenate([best[some], score], 1)
                ids = np.concatenate([who[some], np.broadcast_to(np.arange(bounds[b], bounds[b + 1]), score.shape)], 1)
                top = np.argpartition(-both, room - 1, axis=1)[:, :room] if both.shape[1] > room else np.broadcast_to(np.arange(both.shape[1]), both.shape)
                best[some], who[some] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        q, j = np.nonzero(who >= 0)
        entry = index_rows.column("entry").to_numpy()[order[who[q, j]]]
        by = np.lexsort((entry, q))
        fresh = np.append(True, (q[by][1:] != q[by][:-1]) | (entry[by][1:] != entry[by][:-1]))[: len(by)]
        q, j = q[by[fresh]], j[by[fresh]]
        by = np.lexsort((-best[q, j], q))
        q, j = q[by], j[by]
        near = np.arange(len(q)) - np.searchsorted(q, q) < keep
        q, j = q[near], j[near]
        ids = index_rows.column("ids").combine_chunks().take(pa.array(order[who[q, j]]))
        exact = np.einsum("ij,ij->i", y[q], x[who[q, j]])
        out = pa.table([query_rows.column("id").combine_chunks().take(pa.array(q)), ids, pa.array(exact)], names)
        worst = query_rows.column("worst").to_numpy()[q]  # the k-th score so far: rows below it can't rank
        return out.filter(pa.array(~(exact < worst - 1e-9 * np.abs(worst))))

    dealt = stage(hashed.mapInArrow(deal, "part int, bucket long, v array<double>, ids array<long>, entry long"), "ann-dealt")

    def found(some: DataFrame, everywhere: bool = False, before: DataFrame | None = None) -> DataFrame:
        """The best k of the rows met; with `before`, the rows of `some` have their k-th score there, and only further buckets are visited."""
        routed = some.repartition(n_parts, "id").mapInArrow(route(everywhere, before is not None), "part int, id long, v array<double>, probes binary, worst double")
        hits = dealt.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(search, "query_id long, ids array<long>, score double")
        rows = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
        if before is not None:
            rows = rows.union(before.select("query_id", "vec_id", "score"))
        rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stage(found(asks), "ann-first")
    drop(hashed)
    worst = first.filter(F.col("rank") == k).groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("worst"))
    out = stage(found(asks.join(worst, "id"), before=first), "ann-found")
    drop(first)
    total = rows.select("id").distinct().limit(k + 1).count()
    got = out.groupBy(F.col("query_id").alias("id")).count()
    short = asks.join(got, "id", "left").filter(F.coalesce("count", F.lit(0)) < min(k, max(0, total - 1))).select("id", "v")
    short = stage(short, "ann-short")
    if short.limit(1).count():
        out = out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(found(short, True))
    return out


def op5_multiprobe_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
