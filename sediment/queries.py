"""The registered queries over the driver's tables, and the DuckDB SQL that gives the same rows.

Views recast the tables as change logs: `ev` (events by user_id; an error deletes), `ord` (orders by
customer; status F deletes), `cust` (unique keys), and `runs`/`files`, which lay `ev` out in levels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import codec, columns
from sediment.operators import batch, checksum, cursor, log
from sediment.plans import compact, manifest, planner
from sediment.plans.planner import Limits
from sediment.plans.scratch import scratch
from sediment.plans.store import Store
from sediment.sources import formats
from sediment.streaming.apply import apply_log_stream, apply_stream, latest_stream

AS_OF = 5000
SNAPSHOT = 4000
TINY = Limits(base_bytes=40_000, grandparent_bytes=60_000, expand_bytes=200_000)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark, sf):
    kind = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return log.change_log(_table(spark, sf, "events"), F.col("user_id"), F.col("event_id") + 1, kind, F.col("value"))


def orders(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return log.change_log(_table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey") + 1, kind, F.col("o_totalprice"))


def cust(spark, sf):
    return log.change_log(_table(spark, sf, "customer"), F.col("c_custkey"), F.lit(1), F.lit(1), F.col("c_name"))


def runs(spark, sf):
    level = F.when(F.col("seq") % 10 == 0, 0).otherwise(1 + F.col("seq") % 3).cast("int")
    number = F.when(level == 0, F.floor(F.col("seq") / 500)).otherwise(level * 1000 + F.floor(F.col("key") / 7)).cast("long")
    return ev(spark, sf).withColumn("level", level).withColumn("file_number", number)


def files(spark, sf):
    size = (F.count("*") * 100).cast("long").alias("file_size")
    return runs(spark, sf).groupBy("level", "file_number").agg(size, F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


def edits(spark, sf):
    k = F.col("o_orderkey")
    entry = F.struct((k % 7).cast("int").alias("level"), k.alias("file_number"), (k * 10).alias("file_size"))
    gone = F.struct(((k - 37) % 7).cast("int").alias("level"), (k - 37).alias("file_number"))
    t = _table(spark, sf, "orders")
    return t.select(
        k.alias("edit_id"),
        F.when(k % 11 == 0, k).alias("log_number"),
        F.when(k % 13 == 0, F.greatest(k - 1, F.lit(0))).alias("prev_log_number"),
        F.when(k % 3 == 0, k + 1).alias("next_file_number"),
        F.when(k % 5 == 0, F.col("o_custkey")).alias("last_sequence"),
        F.array(entry).alias("added"),
        F.when((F.col("o_orderstatus") == "F") & (k > 37), F.array(gone)).otherwise(F.array().cast("array<struct<level:int,file_number:bigint>>")).alias("deleted"),
    )


def asked(spark, sf):
    """Keys that are asked for: all part keys, of which some are users."""
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("key"))


def ops(spark, sf):
    """Conversations as batches of operations."""
    kind = F.when(F.col("role") == "user", 1).otherwise(F.when(F.col("turn") % 5 == 4, 0).otherwise(1)).cast("tinyint")
    return _table(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("ordinal"), kind.alias("kind"), (F.col("conv_id") % 50).alias("key"), F.length("text").cast("double").alias("value"))


EV = "ev AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value FROM events)"
ORD = "ord AS (SELECT o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, o_totalprice AS value FROM orders)"
RUNS = f"{EV}, r0 AS (SELECT *, CASE WHEN seq % 10 = 0 THEN 0 ELSE (1 + seq % 3)::INT END AS level FROM ev), runs AS (SELECT *, CASE WHEN level = 0 THEN seq // 500 ELSE level * 1000 + key // 7 END::BIGINT AS file_number FROM r0)"
FILES = f"{RUNS}, files AS (SELECT level, file_number, (count(*) * 100)::BIGINT AS file_size, min(key) AS smallest_key, max(key) AS largest_key FROM runs GROUP BY ALL)"
ASKED = "asked AS (SELECT DISTINCT p_partkey AS key FROM part)"
OPS = "ops AS (SELECT conv_id AS batch, turn AS ordinal, CASE WHEN role = 'user' THEN 1 WHEN turn % 5 = 4 THEN 0 ELSE 1 END AS kind, conv_id % 50 AS key, length(text)::DOUBLE AS value FROM conversations)"
EDITS = """ed AS (SELECT o_orderkey AS edit_id, o_orderkey % 7 AS level, o_orderkey AS file_number, o_orderkey * 10 AS file_size, o_orderstatus = 'F' AND o_orderkey > 37 AS del, o_custkey FROM orders),
 acts AS (SELECT edit_id, 1 AS is_add, level, file_number, file_size FROM ed UNION ALL SELECT edit_id, 0, (file_number - 37) % 7, file_number - 37, NULL FROM ed WHERE del),
 live_f AS (SELECT level, file_number, file_size FROM (SELECT *, row_number() OVER (PARTITION BY level, file_number ORDER BY edit_id DESC, is_add DESC) AS rn FROM acts) WHERE rn = 1 AND is_add = 1)"""


def _live(source: str, as_of: int | None = None, name: str = "live") -> str:
    where = f"WHERE seq <= {as_of}" if as_of else ""
    return f"{name} AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM {source} {where}) WHERE rn = 1 AND kind = 1)"


LIVE = f"WITH {EV}, {_live('ev')}"
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _live_df(s, d):
    return log.resolve(ev(s, d))


# scans and lookups
query("kv_scan_latest", f"{LIVE} SELECT * FROM live")(_live_df)
query("kv_scan_asof", f"WITH {EV}, {_live('ev', AS_OF)} SELECT * FROM live")(lambda s, d: log.resolve(ev(s, d), AS_OF))
query("kv_scan_orders", f"WITH {ORD}, {_live('ord')} SELECT * FROM live")(lambda s, d: log.resolve(orders(s, d)))
_CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END)) AS steps)"


def _crc_of(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(range(1, length({text}) + 1), lambda i: ord(({text})[i])::BIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


_BYTES = "lpad(key::VARCHAR, 8, '0') AS key, CASE WHEN kind = 1 THEN round(value * 100)::BIGINT::VARCHAR END AS value"
query("kv_scan_checksum", f"{LIVE}, {_CRC_SQL}, b AS (SELECT seq, {_BYTES} FROM (SELECT *, 1 AS kind FROM live)), s AS (SELECT count(*) AS n_rows, coalesce(string_agg(key || value, '' ORDER BY key), '') AS s FROM b) SELECT n_rows, {_crc_of('s')} AS crc32c FROM s, crc")(
    lambda s, d: checksum.ordered_checksum(log.resolve(_binary_log(s, d)))
)
query("kv_history", f"WITH {EV} SELECT *, row_number() OVER (ORDER BY seq DESC, kind DESC)::INT AS age FROM (SELECT key, seq, kind::TINYINT AS kind, value FROM ev WHERE key = 7)")(lambda s, d: log.history(ev(s, d), 7))
query("kv_tombstones", f"WITH {EV} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM ev) WHERE rn = 1 AND kind = 0")(lambda s, d: log.tombstones(ev(s, d)))
query("kv_get", f"{LIVE} SELECT * FROM live WHERE key = 11")(lambda s, d: log.get(ev(s, d), 11))
query("kv_get_asof", f"WITH {EV}, {_live('ev', AS_OF)} SELECT * FROM live WHERE key = 11")(lambda s, d: log.get(ev(s, d), 11, AS_OF))
query("kv_multi_get", f"{LIVE}, {ASKED} SELECT live.* FROM live JOIN asked USING (key)")(lambda s, d: log.multi_get(ev(s, d), asked(s, d)))
query("kv_missing_keys", f"{LIVE}, {ASKED} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM live)")(lambda s, d: log.missing_keys(ev(s, d), asked(s, d)))
query("kv_exists", f"{LIVE}, {ASKED} SELECT key FROM asked WHERE key IN (SELECT key FROM live)")(lambda s, d: log.existing_keys(ev(s, d), asked(s, d)))
query("kv_coarse_keys", f"WITH {EV} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key // 10 ORDER BY seq DESC, kind DESC) AS rn FROM ev) WHERE rn = 1 AND kind = 1")(
    lambda s, d: log.resolve(ev(s, d), norm=F.floor(F.col("key") / 10)).select("key", "seq", "value")
)

# cursors
query("kv_first", f"{LIVE} SELECT * FROM live ORDER BY key LIMIT 1")(lambda s, d: cursor.first(_live_df(s, d)))
query("kv_last", f"{LIVE} SELECT * FROM live ORDER BY key DESC LIMIT 1")(lambda s, d: cursor.last(_live_df(s, d)))
query("kv_topk", f"{LIVE} SELECT * FROM live ORDER BY key LIMIT 10")(lambda s, d: cursor.first(_live_df(s, d), 10))
query("kv_seek", f"{LIVE} SELECT * FROM live WHERE key >= 42 ORDER BY key LIMIT 1")(lambda s, d: cursor.seek(_live_df(s, d), 42))
query("kv_seek_before", f"{LIVE} SELECT * FROM live WHERE key < 42 ORDER BY key DESC LIMIT 1")(lambda s, d: cursor.seek_before(_live_df(s, d), 42))
query("kv_next", f"{LIVE} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live UNION ALL SELECT NULL, min(key) FROM live")(lambda s, d: cursor.next_keys(_live_df(s, d)))
query("kv_prev", f"{LIVE} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key FROM live UNION ALL SELECT NULL, max(key) FROM live")(lambda s, d: cursor.previous_keys(_live_df(s, d)))
query("kv_range", f"{LIVE} SELECT *, row_number() OVER (ORDER BY key) AS position FROM live WHERE key >= 20 AND key < 90")(lambda s, d: cursor.between(_live_df(s, d), 20, 90))
query("kv_range_reverse", f"{LIVE} SELECT *, row_number() OVER (ORDER BY key DESC) AS position FROM live WHERE key >= 20 AND key < 90")(lambda s, d: cursor.between(_live_df(s, d), 20, 90, reverse=True))
query("kv_rank_all", f"WITH {ORD}, {_live('ord')} SELECT *, row_number() OVER (ORDER BY key) AS position FROM live")(lambda s, d: cursor.between(log.resolve(orders(s, d))))
query("kv_bulk_seek", f"{LIVE}, {ASKED} SELECT key AS bound, (SELECT min(l.key) FROM live l WHERE l.key >= asked.key) AS found_key FROM asked")(lambda s, d: cursor.bulk_seek(_live_df(s, d), asked(s, d).withColumnRenamed("key", "bound")))
query("kv_bulk_seek_before", f"{LIVE}, {ASKED} SELECT key AS bound, (SELECT max(l.key) FROM live l WHERE l.key < asked.key) AS found_key FROM asked")(
    lambda s, d: cursor.bulk_seek_before(_live_df(s, d), asked(s, d).withColumnRenamed("key", "bound"))
)

# batches
query("wb_assign_seq", f"WITH {OPS} SELECT batch, ordinal, kind::TINYINT AS kind, key, value, 100 + row_number() OVER (ORDER BY batch, ordinal) AS seq FROM ops")(lambda s, d: batch.assign_sequences(ops(s, d), 100))
query("wb_chain", f"WITH {OPS} SELECT 0::BIGINT AS batch, ordinal, kind::TINYINT AS kind, key, value FROM ops WHERE kind = 1 UNION ALL SELECT 1, ordinal, kind::TINYINT, key, value FROM ops WHERE kind = 0")(
    lambda s, d: batch.chain(*[ops(s, d).filter(F.col("kind") == n).select("ordinal", "kind", "key", "value") for n in (1, 0)]).select("batch", "ordinal", "kind", "key", "value")
)
query("wb_apply", f"WITH {EV}, {OPS}, al AS (SELECT key, seq, kind, value FROM ev UNION ALL SELECT key, 1000000000 + row_number() OVER (ORDER BY batch, ordinal), kind, value FROM ops), {_live('al')} SELECT * FROM live")(
    lambda s, d: log.resolve(batch.apply_batches(ev(s, d), ops(s, d), 1_000_000_000))
)
query("wb_validate", f"WITH {OPS} SELECT batch, declared, count(*) AS n_ops, CASE WHEN bool_or(k NOT IN (0, 1)) THEN 'unknown type' WHEN count(*) < declared THEN 'too few entries' WHEN count(*) > declared THEN 'too many entries' END AS problem FROM (SELECT batch, 4 + batch % 3 AS declared, CASE WHEN batch % 10 = 0 AND ordinal = 0 THEN 7 ELSE kind END AS k FROM ops) GROUP BY batch, declared")(
    lambda s, d: batch.validate(ops(s, d).select("batch", (4 + F.col("batch") % 3).alias("declared"), F.when((F.col("batch") % 10 == 0) & (F.col("ordinal") == 0), 7).otherwise(F.col("kind")).alias("kind")))
)

# runs and levels
query("merge_runs", f"{LIVE} SELECT * FROM live")(lambda s, d: log.resolve(compact.merge_runs(*[runs(s, d).filter(F.col("level") == n).select("key", "seq", "kind", "value") for n in range(4)])))
query("level_summary", f"WITH {FILES} SELECT level, count(*) AS n_files, sum(file_size)::BIGINT AS bytes, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key FROM files GROUP BY level")(lambda s, d: planner.level_summary(files(s, d)))
query("lvl_score", f"WITH {FILES} SELECT level, count(*) AS n_files, sum(file_size)::BIGINT AS bytes, CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(file_size) / (pow(10.0, level - 1) * 40000) END::DOUBLE AS score FROM files WHERE level < 6 GROUP BY level")(
    lambda s, d: planner.level_scores(files(s, d), TINY)
)
query("lvl_choose", f"WITH {FILES} SELECT * FROM (SELECT level, count(*) AS n_files, sum(file_size)::BIGINT AS bytes, CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(file_size) / (pow(10.0, level - 1) * 40000) END::DOUBLE AS score FROM files WHERE level < 6 GROUP BY level) WHERE score >= 1 ORDER BY score DESC, level LIMIT 1")(
    lambda s, d: planner.choose_level(files(s, d), TINY)
)
query("seek_budget", f"WITH {FILES} SELECT level, file_number, least(greatest(file_size // 16384, 100), 2147483647)::BIGINT AS seeks FROM files")(lambda s, d: planner.seek_budget(files(s, d)))
query("files_overlapping", f"WITH {FILES} SELECT * FROM files WHERE level = 1 AND largest_key >= 30 AND smallest_key <= 60")(lambda s, d: planner.overlapping(files(s, d), 1, 30, 60))
query("find_file", f"WITH {FILES} (SELECT * FROM files WHERE level = 1 AND largest_key >= 42 ORDER BY largest_key LIMIT 1) UNION ALL (SELECT * FROM files WHERE level = 2 AND largest_key > 41 ORDER BY largest_key LIMIT 1)")(
    lambda s, d: planner.find_file(files(s, d), 1, 42).union(planner.find_file(files(s, d), 2, 41, False))
)
query("next_file", f"WITH {FILES} (SELECT * FROM files WHERE level = 2 ORDER BY largest_key <= 50, smallest_key LIMIT 1) UNION ALL (SELECT * FROM files WHERE level = 3 ORDER BY smallest_key LIMIT 1)")(
    lambda s, d: planner.next_file(files(s, d), 2, 50).union(planner.next_file(files(s, d), 3, 1 << 40))
)
query("files_covering", f"WITH {FILES}, {ASKED} SELECT key, count(*) AS n_files, CASE WHEN count(*) > 1 THEN arg_min(file_number, level::BIGINT * 1000000000 - file_number) END AS charged_file FROM asked JOIN files ON key BETWEEN smallest_key AND largest_key GROUP BY key")(
    lambda s, d: planner.covering(files(s, d), asked(s, d))
)
_ISLANDS = "sum(new) OVER (PARTITION BY level ORDER BY smallest_key, largest_key, file_number)::BIGINT"
query("l0_transitive_overlap", f"WITH {FILES}, m AS (SELECT *, CASE WHEN smallest_key <= max(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, largest_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM files WHERE level = 0) SELECT * EXCLUDE (new), {_ISLANDS} AS overlap_group FROM m")(
    lambda s, d: planner.overlap_groups(files(s, d), 0)
)
query("boundary_inputs", f"WITH {FILES}, m AS (SELECT *, CASE WHEN smallest_key = lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, largest_key, file_number) THEN 0 ELSE 1 END AS new FROM (SELECT level, file_number, file_size, smallest_key // 3 AS smallest_key, largest_key // 3 AS largest_key FROM files) WHERE level = 1) SELECT * EXCLUDE (new), {_ISLANDS} AS boundary_group FROM m")(
    lambda s, d: planner.boundary_groups(files(s, d).withColumn("smallest_key", F.floor(F.col("smallest_key") / 3)).withColumn("largest_key", F.floor(F.col("largest_key") / 3)), 1)
)
#: Stretches of level 2 put into level 3, so that level 1 has files with nothing below; no file is left out.
_SPARSE = "sparse AS (SELECT * REPLACE (CASE WHEN level = 2 AND (smallest_key // 70) % 2 = 0 THEN 3 ELSE level END AS level) FROM files)"
query("trivial_moves", f"WITH {FILES}, {_SPARSE}, p AS (SELECT a.level, a.file_number, count(b.file_number) AS n FROM sparse a LEFT JOIN sparse b ON b.level = 2 AND a.largest_key >= b.smallest_key AND a.smallest_key <= b.largest_key WHERE a.level = 1 GROUP BY ALL), g AS (SELECT a.file_number, coalesce(sum(b.file_size), 0)::BIGINT AS grandparent_bytes FROM sparse a LEFT JOIN sparse b ON b.level = 3 AND a.largest_key >= b.smallest_key AND a.smallest_key <= b.largest_key WHERE a.level = 1 GROUP BY ALL) SELECT level, file_number, grandparent_bytes FROM p JOIN g USING (file_number) WHERE n = 0 AND grandparent_bytes <= 60000")(
    lambda s, d: planner.trivial_moves(files(s, d).withColumn("level", F.when((F.col("level") == 2) & (F.floor(F.col("smallest_key") / 70) % 2 == 0), 3).otherwise(F.col("level"))), 1, TINY)
)
query("memtable_level", f"WITH {FILES} SELECT CASE WHEN EXISTS (SELECT 1 FROM files WHERE level = 0 AND largest_key >= 200000 AND smallest_key <= 300000) THEN 0 ELSE 2 END::BIGINT AS level")(
    lambda s, d: s.createDataFrame([(planner.flush_level(files(s, d), 200_000, 300_000, TINY),)], "level long")
)
query("compaction_inputs", f"""WITH {FILES}, base AS (SELECT * FROM files WHERE level = 1 AND largest_key >= 30 AND smallest_key <= 60),
 bs AS (SELECT min(smallest_key) AS lo, max(largest_key) AS hi, count(*) AS n FROM base),
 par AS (SELECT files.* FROM files, bs WHERE level = 2 AND largest_key >= lo AND smallest_key <= hi),
 ps AS (SELECT min(smallest_key) AS lo, max(largest_key) AS hi, count(*) AS n, coalesce(sum(file_size), 0) AS bytes FROM par),
 wide AS (SELECT files.* FROM files, bs, ps WHERE level = 1 AND largest_key >= least(bs.lo, ps.lo) AND smallest_key <= greatest(bs.hi, ps.hi)),
 ws AS (SELECT min(smallest_key) AS lo, max(largest_key) AS hi, count(*) AS n, coalesce(sum(file_size), 0) AS bytes FROM wide),
 wp AS (SELECT count(*) AS n FROM files, ws WHERE level = 2 AND largest_key >= lo AND smallest_key <= hi),
 grow AS (SELECT ws.n > bs.n AND ws.bytes + ps.bytes < 200000 AND wp.n = ps.n AND ps.n > 0 AS yes FROM ws, bs, ps, wp)
 SELECT level, file_number FROM base, grow WHERE NOT yes UNION ALL SELECT level, file_number FROM wide, grow WHERE yes UNION ALL SELECT level, file_number FROM par""")(lambda s, d: planner.expand_inputs(files(s, d), 1, 30, 60, TINY))
query("output_cuts", f"""WITH RECURSIVE {FILES}, {ASKED}, k AS (SELECT key, (SELECT coalesce(sum(file_size), 0) FROM files WHERE level = 3 AND largest_key < asked.key)::BIGINT AS passed FROM asked),
 v AS (SELECT passed, row_number() OVER (ORDER BY passed) AS i FROM (SELECT DISTINCT passed FROM k)),
 f(i, passed, start, output) AS (SELECT i, passed, passed, 0::BIGINT FROM v WHERE i = 1 UNION ALL
  SELECT v.i, v.passed, CASE WHEN v.passed - f.start > 20000 THEN v.passed ELSE f.start END, f.output + CASE WHEN v.passed - f.start > 20000 THEN 1 ELSE 0 END FROM f JOIN v ON v.i = f.i + 1)
 SELECT key, output FROM k JOIN f USING (passed)""")(
    lambda s, d: planner.output_cuts(asked(s, d), files(s, d), 1, 20_000)
)
query("approx_offset", f"WITH {FILES}, {ASKED} SELECT key, coalesce(sum(CASE WHEN largest_key < key THEN file_size WHEN smallest_key < key THEN file_size // 2 ELSE 0 END), 0)::BIGINT AS \"offset\" FROM asked LEFT JOIN files ON smallest_key < key GROUP BY key")(
    lambda s, d: planner.approximate_offset(files(s, d), asked(s, d))
)


@query("approx_size", f"WITH {FILES} SELECT (SELECT sum(CASE WHEN largest_key < 90 THEN file_size WHEN smallest_key < 90 THEN file_size // 2 ELSE 0 END) FROM files)::BIGINT - (SELECT sum(CASE WHEN largest_key < 20 THEN file_size WHEN smallest_key < 20 THEN file_size // 2 ELSE 0 END) FROM files)::BIGINT AS size")
def approx_size(s, d):
    ends = planner.approximate_offset(files(s, d), s.createDataFrame([(20,), (90,)], "key long"))
    return ends.agg((F.max("offset") - F.min("offset")).alias("size"))


# manifest
query("mf_fold", "SELECT arg_max(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END) AS log_number, max(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END) AS prev_log_number, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END) AS next_file_number, arg_max(o_custkey, o_orderkey) FILTER (WHERE o_orderkey % 5 = 0) AS last_sequence FROM orders")(
    lambda s, d: manifest.fold_counters(edits(s, d))
)
query("mf_live_files", f"WITH {EDITS} SELECT level::INT AS level, file_number, file_size FROM live_f")(lambda s, d: manifest.live_files(edits(s, d)))
query("mf_pinned_files", f"WITH {EDITS.replace('FROM acts)', 'FROM acts WHERE edit_id <= 500)')} SELECT level::INT AS level, file_number FROM live_f")(lambda s, d: manifest.pinned_files(edits(s, d), [500]))
query("mf_gc", f"WITH {EDITS} SELECT o_orderkey AS file_number FROM orders WHERE o_orderkey NOT IN (SELECT file_number FROM live_f)")(lambda s, d: manifest.garbage(_table(s, d, "orders").select(F.col("o_orderkey").alias("file_number")), manifest.live_files(edits(s, d))))
query("mf_missing", f"WITH {EDITS} SELECT file_number, level::INT AS level, file_size FROM live_f WHERE file_number NOT IN (SELECT p_partkey FROM part)")(lambda s, d: manifest.missing(manifest.live_files(edits(s, d)), _table(s, d, "part").select(F.col("p_partkey").alias("file_number"))))
query("mf_check_overlap", f"WITH {FILES}, w AS (SELECT level, file_number, file_size, smallest_key - CASE WHEN file_number % 4 = 0 THEN 3 ELSE 0 END AS smallest_key, largest_key FROM files) SELECT level, file_number, 'number not allocated' AS problem FROM w WHERE file_number >= 3005 UNION ALL SELECT min(level), file_number, 'number used twice' FROM w GROUP BY file_number HAVING count(*) > 1 UNION ALL SELECT level, file_number, 'overlaps an earlier file' FROM (SELECT *, max(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM w WHERE level >= 1) WHERE smallest_key <= upto")(
    lambda s, d: manifest.check(files(s, d).withColumn("smallest_key", F.col("smallest_key") - F.when(F.col("file_number") % 4 == 0, 3).otherwise(0)), 3005)
)
query("snap_oldest", "SELECT min(event_id + 1) AS oldest, max(event_id + 1) AS newest FROM events WHERE event_type = 'purchase'")(
    lambda s, d: manifest.oldest_snapshot(_table(s, d, "events").filter("event_type = 'purchase'").select((F.col("event_id") + 1).alias("seq")), 0).select(*[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("oldest", "newest")])
)

# compaction
_KEPT = f"kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, seq <= {SNAPSHOT} ORDER BY seq DESC, kind DESC) AS age FROM ev) WHERE seq > {SNAPSHOT} OR age = 1)"
query("compact_keep_snapshot", f"WITH {EV}, {_KEPT} SELECT key, seq, kind::TINYINT AS kind, value FROM kept WHERE NOT (kind = 0 AND seq <= {SNAPSHOT})")(lambda s, d: compact.compact(ev(s, d), SNAPSHOT))
query("compact_drop_tombstones", f"WITH {EV}, {_KEPT} SELECT key, seq, kind::TINYINT AS kind, value FROM kept WHERE NOT (kind = 0 AND seq <= {SNAPSHOT}) OR key BETWEEN 10 AND 60")(
    lambda s, d: compact.compact(ev(s, d), SNAPSHOT, s.createDataFrame([(10, 40), (35, 60)], "smallest_key long, largest_key long"))
)
query("compact_latest", f"{LIVE} SELECT * FROM live")(lambda s, d: log.resolve(compact.compact(ev(s, d), SNAPSHOT)))
query("compact_asof_snapshot", f"WITH {EV}, {_live('ev', SNAPSHOT)} SELECT * FROM live")(lambda s, d: log.resolve(compact.compact(ev(s, d), SNAPSHOT), SNAPSHOT))


# codecs, interchange files, store and stream: byte formats and stateful jobs have no SQL form but the last ones' results do


def _bytes(c):
    return F.encode(c.cast("string"), "UTF-8")


def _pairs(s, d):
    a, b = _bytes(F.col("c_name")), _bytes(F.concat(F.substring("c_name", 1, 14), F.col("c_mktsegment")))
    return _table(s, d, "customer").select("c_custkey", a.alias("a"), b.alias("b"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


_PAIRS = "pairs AS (SELECT c_custkey, c_name AS a, left(c_name, 14) || c_mktsegment AS b, least(a, b) AS low, greatest(a, b) AS high, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: a[k] <> b[k])) - 1, least(length(a), length(b))) AS n FROM customer)"
_VARINT = "CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 WHEN {n} < 268435456 THEN 4 ELSE 5 END"
query("fn_common_prefix", f"WITH {_PAIRS} SELECT c_custkey, n::BIGINT AS n FROM pairs")(lambda s, d: _pairs(s, d).select("c_custkey", columns.common_prefix(F.col("a"), F.col("b")).alias("n")))
query("fn_separator", f"WITH {_PAIRS} SELECT c_custkey, hex(CASE WHEN n = length(low) THEN low WHEN ord(low[n + 1]) + 1 < ord(high[n + 1]) OR n + 1 < length(high) THEN left(low, n) || chr(ord(low[n + 1]) + 1) WHEN length(low) > n + 1 THEN left(low, n + 1) || chr(ord(low[n + 2]) + 1) ELSE low END) AS separator FROM pairs")(
    lambda s, d: _pairs(s, d).select("c_custkey", F.hex(columns.separator(F.col("low"), F.col("high"))).alias("separator"))
)
query("fn_successor", "SELECT c_custkey, hex(CASE WHEN c_name = '' THEN '' ELSE chr(ord(c_name) + 1) END) AS successor FROM customer")(lambda s, d: _pairs(s, d).select("c_custkey", F.hex(columns.successor(F.col("a"))).alias("successor")))
query("fn_varint", f"WITH o AS (SELECT o_orderkey, o_orderkey * 37 AS n, {_VARINT.format(n='o_orderkey * 37')} AS g FROM orders) SELECT o_orderkey, array_to_string(list_transform(range(0, g), lambda i: printf('%02X', ((n >> (7 * i)) & 127) + CASE WHEN i < g - 1 THEN 128 ELSE 0 END)), '') AS varint, n AS back FROM o")(
    lambda s, d: _table(s, d, "orders").select("o_orderkey", columns.put_varint(F.col("o_orderkey") * 37).alias("v")).select("o_orderkey", F.hex("v").alias("varint"), columns.get_varint(F.col("v")).alias("back"))
)
query("fn_prefixed", "SELECT c_custkey, printf('%02X', length(c_name)) || hex(c_name) AS prefixed FROM customer")(lambda s, d: _pairs(s, d).select("c_custkey", F.hex(columns.prefixed(F.col("a"))).alias("prefixed")))
query("fn_crc32c", f"WITH {_CRC_SQL}, c AS (SELECT c_custkey, {_crc_of('c_name')} AS c FROM customer, crc) SELECT c_custkey, (((c >> 15) | ((c << 17) & 4294967295)) + 2726488792) % 4294967296 AS masked FROM c")(
    lambda s, d: _pairs(s, d).select("c_custkey", columns.mask_crc(columns.crc32c("a")).alias("masked"))
)
query("fn_tag", "SELECT event_id, ((event_id + 1) * 256 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::HUGEINT::DECIMAL(20, 0) AS tag FROM events")(
    lambda s, d: _table(s, d, "events").select("event_id", columns.pack_tag(F.col("event_id") + 1, F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("tag"))
)


@query("bloom_probe", "SELECT count(*) AS n_listed, 0::BIGINT AS n_missed, true AS few_false FROM customer WHERE c_acctbal > 0")
def bloom_probe(s, d):
    """Filters per hundred keys built by one grouped pass, probed with all keys: how many listed keys were missed, and whether at most a thirtieth of the others passed. Nothing follows the probe."""
    import pyarrow as pa

    keys = _table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("listed"), F.floor(F.col("c_custkey") / 100).alias("chunk"))

    def build(table):
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "filter": [codec.bloom_build([b"%d" % k for k in table.column("c_custkey").to_pylist()])]})

    @F.pandas_udf("boolean")
    def passes(filters: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([codec.bloom_match(bytes(f), b"%d" % k) for f, k in zip(filters, keys)])

    filters = keys.filter("listed").select("c_custkey", "chunk").groupBy("chunk").applyInArrow(build, "chunk long, filter binary")
    probed = keys.join(filters, "chunk").withColumn("passes", passes("filter", "c_custkey"))
    listed, other = F.col("listed"), ~F.col("listed")
    return probed.agg(F.count_if(listed).alias("n_listed"), F.count_if(listed & ~F.col("passes")).alias("n_missed"), (30 * F.count_if(other & F.col("passes")) <= F.count_if(other) + 60).alias("few_false"))


def _binary_log(s, d):
    return ev(s, d).select(_bytes(F.lpad(F.col("key").cast("string"), 8, "0")).alias("key"), "seq", "kind", F.when(F.col("kind") == 1, _bytes(F.round(F.col("value") * 100).cast("long"))).alias("value"))


def _text(rows):
    return rows.withColumns({"key": F.decode("key", "UTF-8"), "value": F.decode("value", "UTF-8")})


@query("read_sst", f"{LIVE} SELECT seq, {_BYTES} FROM (SELECT *, 1 AS kind FROM live)")
def read_sst(s, d):
    """The events log written as foreign table files, read back through the data source and resolved."""
    folder = scratch(s, "sst")
    formats.write_sst(_binary_log(s, d), folder)
    back = formats.load(s, "sst", folder, mode="FAILFAST").select("key", "seq", F.col("kind").cast("tinyint").alias("kind"), "value")
    return _text(log.resolve(back))


@query("read_wal", f"WITH {EV} SELECT seq, kind::TINYINT AS kind, {_BYTES} FROM ev")
def read_wal(s, d):
    """The whole events log written as foreign log files and read back."""
    folder = scratch(s, "wal")
    formats.write_wal(_binary_log(s, d), folder)
    return _text(formats.load(s, "wal", folder, mode="FAILFAST").select("key", "seq", F.col("kind").cast("tinyint").alias("kind"), "value"))


@query("read_damaged_wal")
def read_damaged_wal(s, d):
    """A small log file of two batches with damage between them; the reader resynchronises and reports."""
    folder = formats.located(s, scratch(s, "wal"))
    first = codec.batch_encode(1, [(1, b"a", b"1"), (0, b"b", None)])
    last = codec.batch_encode(3, [(1, b"b", b"x" * 70_000)])
    formats.put_file(s, f"{folder}/000007.log", codec.log_write([first, b"?" * 20, last]))
    return formats.load(s, "wal", folder)


@query("read_manifest", f"WITH {EDITS} SELECT row_number() OVER (ORDER BY edit_id) - 1 AS edit_id, CASE WHEN edit_id % 11 = 0 THEN edit_id END AS log_number, CASE WHEN edit_id % 13 = 0 THEN greatest(edit_id - 1, 0) END AS prev_log_number, CASE WHEN edit_id % 3 = 0 THEN edit_id + 1 END AS next_file_number, CASE WHEN edit_id % 5 = 0 THEN o_custkey END AS last_sequence, level::INT AS level, file_number, file_size, CASE WHEN del THEN file_number - 37 END AS gone FROM ed")
def read_manifest(s, d):
    """The whole edits view written as one manifest log and read back."""
    folder = scratch(s, "manifest")
    key = F.encode(F.lit("k"), "UTF-8")
    entry = lambda x: F.struct(x.level.alias("level"), x.file_number.alias("file_number"), x.file_size.alias("file_size"), key.alias("smallest_key"), key.alias("largest_key"))
    formats.write_manifest(edits(s, d).withColumn("added", F.transform("added", entry)), folder)
    back = formats.load(s, "manifest", folder, mode="FAILFAST")
    first = F.get("added", F.lit(0))
    return back.select("edit_id", "log_number", "prev_log_number", "next_file_number", "last_sequence", first.level.alias("level"), first.file_number.alias("file_number"), first.file_size.alias("file_size"), F.get("deleted", F.lit(0)).file_number.alias("gone"))


@query("open_database", f"{LIVE} SELECT seq, {_BYTES} FROM (SELECT *, 1 AS kind FROM live)")
def open_database(s, d):
    """The events log as a foreign database folder, nine tenths of it in tables and the rest still in logs, opened as one log and resolved."""
    folder = scratch(s, "database")
    changes = _binary_log(s, d)
    last = changes.agg(F.max("seq")).first()[0] or 0
    formats.write_database(changes.filter(F.col("seq") <= last * 9 // 10), changes.filter(F.col("seq") > last * 9 // 10), folder)
    return _text(log.resolve(formats.read_database(s, folder)))


def _ops_of(rows):
    return rows.select(F.lit(0).cast("long").alias("batch"), F.col("seq").alias("ordinal"), "kind", "key", "value")


SMALL = Limits(l0_files=2, base_bytes=20_000, file_bytes=10_000, grandparent_bytes=20_000, expand_bytes=60_000)


@query("store_round_trip", f"{LIVE} SELECT key, value FROM live")
def store_round_trip(s, d):
    """The events log written to a store in three batches, compacted until no level is due, and scanned."""
    changes = ev(s, d)
    store = Store.open(s, scratch(s, "store"), "key long, value double", create_if_missing=True, limits=SMALL)
    for n in range(3):
        store.write(_ops_of(changes.filter((F.col("seq") > 3000 * n) & ((F.col("seq") <= 3000 * (n + 1)) | F.lit(n == 2)))))
    while store.compact():
        pass
    return store.scan().select("key", "value")


@query("store_checksum", _SQL["kv_scan_checksum"])
def store_checksum(s, d):
    """Count and crc32c of a store whose runs have been merged into one settled level: read in place, with no shuffle."""
    store = Store.open(s, scratch(s, "store"), create_if_missing=True)
    store.write_log(_binary_log(s, d), sealed=1 << 40)
    store.compact_range()
    return store.checksum()


@query("store_delete_range", f"{LIVE} SELECT key, value FROM live WHERE key NOT BETWEEN 20 AND 90")
def store_delete_range(s, d):
    """A range of keys deleted by compaction."""
    store = Store.open(s, scratch(s, "store"), "key long, value double", create_if_missing=True, limits=SMALL)
    store.write_log(ev(s, d), sealed=1 << 40)
    store.compact_range(20, 90, F.col("key").between(20, 90))
    return store.scan().select("key", "value")


def _late_files(s, d):
    """The events log as a folder of four files in which most rows come after newer ones of their key."""
    source = scratch(s, "stream-source")
    ev(s, d).repartition(4, F.xxhash64("seq")).write.parquet(source)
    return s.readStream.schema(s.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)


@query("stream_apply", f"{LIVE} SELECT key, value FROM live")
def stream_apply(s, d):
    """Events streamed into a store in four micro-batches, late rows among them, compacted in between, and scanned."""
    store = Store.open(s, scratch(s, "stream-store"), "key long, value double", create_if_missing=True, limits=SMALL)
    apply_log_stream(_late_files(s, d), store, scratch(s, "stream-state")).awaitTermination()
    return store.scan().select("key", "value")


@query("stream_ops", f"{LIVE} SELECT key, value FROM live")
def stream_ops(s, d):
    """Events as operations without numbers: one ordered micro-batch numbered by the store."""
    source = scratch(s, "stream-source")
    _ops_of(ev(s, d)).coalesce(1).write.parquet(source)
    store = Store.open(s, scratch(s, "stream-store"), "key long, value double", create_if_missing=True)
    apply_stream(s.readStream.schema(s.read.parquet(source).schema).parquet(source), store, scratch(s, "stream-state"), compact=False).awaitTermination()
    return store.scan().select("key", "value")


@query("stream_latest", f"WITH {EV} SELECT key, seq, kind::TINYINT AS kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM ev) WHERE rn = 1")
def stream_latest(s, d):
    """The running newest change of each key over four micro-batches with late rows."""
    out = scratch(s, "stream-latest")
    each = lambda rows, _: rows.write.mode("overwrite").parquet(out)
    latest_stream(_late_files(s, d)).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", scratch(s, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
