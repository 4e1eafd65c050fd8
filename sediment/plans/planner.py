"""Compaction planning as functions of the `files` table (level, file_number, file_size, smallest_key, largest_key).

The files table has one row a file, a fraction of the data; all choices are aggregates, window
functions, running sums and range predicates over it, and no function compares files with keys or files pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.ordered import neighbour, rank_rows, sum_before


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes. Ratios follow the classic leveled layout; tests use tiny values."""

    l0_files: int = 4
    base_bytes: int = 10 << 20
    ratio: int = 10
    levels: int = 7
    grandparent_bytes: int = 10 << 20
    expand_bytes: int = 25 << 20
    flush_level: int = 2
    seek_bytes: int = 16 << 10
    least_seeks: int = 100
    file_bytes: int = 2 << 20
    slow_l0: int = 8
    halt_l0: int = 12


def level_scores(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Score of each level that can be compacted; at 1 or more it is due."""
    full = F.pow(F.lit(float(limits.ratio)), F.col("level") - 1) * limits.base_bytes
    score = F.when(F.col("level") == 0, F.col("n_files") / limits.l0_files).otherwise(F.col("bytes") / full)
    sums = files.filter(F.col("level") < limits.levels - 1).groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))
    return sums.select("level", "n_files", "bytes", score.cast("double").alias("score"))


def choose_level(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The level with the strictly largest score of at least 1 (the lowest of equals), or no row."""
    return level_scores(files, limits).filter("score >= 1").orderBy(F.desc("score"), "level").limit(1)


def seek_budget(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Extra reads that each file allows before it is worth compacting."""
    allowed = F.least(F.greatest(F.floor(F.col("file_size") / limits.seek_bytes), F.lit(limits.least_seeks)), F.lit((1 << 32) // 2 - 1))
    return files.select("level", "file_number", allowed.cast("long").alias("seeks"))


def overlapping(files: DataFrame, level: int, low, high) -> DataFrame:
    """Files of a level whose range meets [low, high]."""
    return files.filter((F.col("level") == level) & (F.col("largest_key") >= F.lit(low)) & (F.col("smallest_key") <= F.lit(high)))


def find_file(files: DataFrame, level: int, key, inclusive: bool = True) -> DataFrame:
    """The first file of a disjoint level whose range does not end before `key` (with `inclusive` false: whose range ends after it), or no row."""
    ends = F.col("largest_key") >= F.lit(key) if inclusive else F.col("largest_key") > F.lit(key)
    return files.filter((F.col("level") == level) & ends).orderBy("largest_key", "file_number").limit(1)


def _point(value: Column, tie: int) -> Column:
    """A place in key order: before (0), at (1) or after (2) a value."""
    return F.struct(value.alias("value"), F.lit(tie).alias("tie")).alias("at")


def overlap_sums(files: DataFrame, ranges: DataFrame, amount: Column) -> DataFrame:
    """`ranges` (low, high: distinct pairs) with total: `amount` summed over the files that meet [low, high].

    A file meets a range unless it starts after its end or ends before its start, so the total is one running sum over starts
    less one over ends, and no range is compared with a file.
    """
    starts = files.select(_point(F.col("smallest_key"), 1), amount.alias("amount"))
    ends = files.select(_point(F.col("largest_key"), 1), amount.alias("amount"))
    upto = sum_before(starts, ranges.select(_point(F.col("high"), 2)).distinct()).select(F.col("at.value").alias("high"), F.col("total").alias("_upto"))
    past = sum_before(ends, ranges.select(_point(F.col("low"), 0)).distinct()).select(F.col("at.value").alias("low"), F.col("total").alias("_past"))
    return ranges.join(upto, "high").join(past, "low").select(*ranges.columns, (F.col("_upto") - F.col("_past")).alias("total"))


FAN_BITS, TIERS = 4, 6  # blocks of 16 segments, blocks of 16 of those, ...: TIERS sizes in all


def _pieces(first: Column, last: Column) -> Column:
    """The fewest aligned blocks (tier, block) that make up the segments from `first` to `last`: at most 30 a tier, whatever the length (the top tier has all that is left)."""

    def run(tier: int, low: Column, high: Column) -> Column:
        blocks = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda b: F.struct(F.lit(tier).alias("tier"), b.alias("block")))

    # the whole blocks of each tier inside the span
    ends = [(F.shiftright(first + ((1 << FAN_BITS * t) - 1), FAN_BITS * t), F.shiftright(last + 1, FAN_BITS * t) - 1) for t in range(TIERS)]
    out = []
    for tier in range(TIERS - 1):
        (low, high), (wide_low, wide_high) = ends[tier], ends[tier + 1]
        wide = wide_low <= wide_high
        out.append(run(tier, low, F.when(wide, F.shiftleft(wide_low, FAN_BITS) - 1).otherwise(high)))
        out.append(run(tier, F.when(wide, F.shiftleft(wide_high + 1, FAN_BITS)).otherwise(high + 1), high))
    return F.concat(*out, run(TIERS - 1, *ends[-1]))


def covering(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key: how many files could hold it, and the first to be charged when more than one does (lowest level, newest file).

    The ends of all files cut the key order into elementary segments. A file names the aligned blocks of segments that make up its span, at most a few
    dozen a tier however many segments it spans; a segment gathers what its block in each tier has, and each end takes what holds at it and after it to
    the keys that follow it in order. So the work follows files and keys, files that span everything and crowded segments included.
    """
    ends = rank_rows(files.select(F.col("smallest_key").alias("end")).union(files.select("largest_key")).distinct(), "end", name="place", start=0)
    place = lambda c, name: ends.select(F.col("end").alias(c), (F.col("place") * 2).alias(name))  # noqa: E731  even: the end itself; odd: up to the next end
    order = F.struct(F.col("level").alias("level"), (-F.col("file_number")).alias("n"))
    spans = files.join(place("smallest_key", "_first"), "smallest_key").join(place("largest_key", "_last"), "largest_key").select("_first", "_last", order.alias("o"))
    alike = spans.groupBy("_first", "_last").agg(F.count("*").alias("n_files"), F.min("o").alias("o"))
    named = alike.select(F.explode(_pieces(F.col("_first"), F.col("_last"))).alias("p"), "n_files", "o")
    blocks = named.groupBy("p.tier", "p.block").agg(F.sum("n_files").alias("n_files"), F.min("o").alias("o"))
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.shiftright("segment", FAN_BITS * t).alias("block")) for t in range(TIERS)])
    places = ends.select("place", F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1)).alias("segment"))
    asks = places.select("place", "segment", F.explode(tiers).alias("p")).select("place", "segment", "p.tier", "p.block")
    found = asks.join(blocks, ["tier", "block"])
    total = lambda odd: [f(F.when(F.col("segment") % 2 == odd, F.col(c))).alias(f"{c}{odd}") for f, c in ((F.sum, "n_files"), (F.min, "o"))]
    held = ends.join(found.groupBy("place").agg(*total(0), *total(1)), "place", "left")
    kind = files.schema["smallest_key"].dataType
    asked = keys.select(F.col("key").cast(kind).alias("key")).filter("key is not null").distinct()
    what = F.struct(F.col("end"), "n_files0", "o0", "n_files1", "o1")
    marks = held.select(_point(F.col("end"), 0), what.alias("what"))
    merged = marks.union(asked.select(_point(F.col("key"), 1), F.lit(None).cast(marks.schema["what"].dataType)))
    below = neighbour(merged, "at", F.col("what"), False, "below").filter("what is null and below is not null")
    here = F.col("below.end") == F.col("at.value")
    pick = lambda c: F.when(here, F.col(f"below.{c}0")).otherwise(F.col(f"below.{c}1")).alias(c)
    placed = below.select(F.col("at.value").alias("key"), pick("n_files"), pick("o")).filter("n_files > 0")
    return placed.select("key", "n_files", F.when(F.col("n_files") > 1, -F.col("o.n")).alias("charged_file"))


def overlap_groups(files: DataFrame, level: int = 0) -> DataFrame:
    """Files of a level with group: the transitive closure of overlap, found by a running maximum instead of a fixpoint."""
    in_order = Window.partitionBy("level").orderBy("smallest_key", "largest_key", "file_number")
    upto = F.max("largest_key").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(upto.isNull() | (F.col("smallest_key") > upto), 1).otherwise(0)
    marked = files.filter(F.col("level") == level).withColumn("_new", fresh)
    return marked.withColumn("overlap_group", F.sum("_new").over(in_order).cast("long")).drop("_new")


def boundary_groups(files: DataFrame, level: int) -> DataFrame:
    """Files of a level with group: neighbours that share a user key must be compacted together."""
    in_order = Window.partitionBy("level").orderBy("smallest_key", "largest_key", "file_number")
    before = F.lag("largest_key").over(in_order)
    fresh = F.when(before.isNull() | (before != F.col("smallest_key")), 1).otherwise(0)
    return files.filter(F.col("level") == level).withColumn("_new", fresh).withColumn("boundary_group", F.sum("_new").over(in_order).cast("long")).drop("_new")


def trivial_moves(files: DataFrame, level: int, limits: Limits = Limits()) -> DataFrame:
    """Files of a level that can move down by a metadata edit: nothing below, and little two levels below."""
    ranges = files.filter(F.col("level") == level).select("level", "file_number", F.col("smallest_key").alias("low"), F.col("largest_key").alias("high"))
    parents = overlap_sums(files.filter(F.col("level") == level + 1), ranges, F.lit(1)).filter("total = 0").drop("total")
    grand = overlap_sums(files.filter(F.col("level") == level + 2), parents, F.col("file_size"))
    return grand.filter(F.col("total") <= limits.grandparent_bytes).select("level", "file_number", F.col("total").alias("grandparent_bytes"))


def next_file(files: DataFrame, level: int, pointer=None) -> DataFrame:
    """The file that a size compaction of a level begins with: the first that ends after the level's rotation pointer, or the first of all."""
    mine = files.filter(F.col("level") == level)
    ahead = [] if pointer is None else [F.when(F.col("largest_key") > F.lit(pointer), 0).otherwise(1)]
    return mine.orderBy(*ahead, "smallest_key", "file_number").limit(1)


def expand_inputs(files: DataFrame, level: int, low, high, limits: Limits = Limits()) -> DataFrame:
    """(level, file_number) of a compaction of [low, high] from `level`: base files, parents, and more base files if they add no parent and stay within the cap."""

    def span(f: DataFrame):
        return f.agg(F.min("smallest_key"), F.max("largest_key"), F.count("*"), F.coalesce(F.sum("file_size"), F.lit(0))).first()

    base = overlapping(files, level, low, high)
    lo, hi, n, _ = span(base)
    if not n:
        return base.select("level", "file_number")
    parents = overlapping(files, level + 1, lo, hi)
    plo, phi, pn, pbytes = span(parents)
    if pn:
        wider = overlapping(files, level, min(lo, plo), max(hi, phi))
        wlo, whi, wn, wbytes = span(wider)
        if wn > n and wbytes + pbytes < limits.expand_bytes and span(overlapping(files, level + 1, wlo, whi))[2] == pn:
            base = wider
    return base.union(parents).select("level", "file_number")


def flush_level(files: DataFrame, low, high, limits: Limits = Limits()) -> int:
    """Where a flushed run of keys [low, high] goes: level 0 if it overlaps it, else as deep as nothing overlaps and two levels below stay small."""
    top = limits.flush_level
    meets = (F.col("largest_key") >= F.lit(low)) & (F.col("smallest_key") <= F.lit(high))
    rows = files.filter(meets & (F.col("level") <= top + 1)).groupBy("level").agg(F.sum("file_size")).collect()  # one row a level
    weight = {r[0]: r[1] for r in rows}
    level = 0
    if 0 not in weight:
        while level < top and level + 1 not in weight and weight.get(level + 2, 0) <= limits.grandparent_bytes:
            level += 1
    return level


def output_cuts(entries: DataFrame, files: DataFrame, level: int, cap: int) -> DataFrame:
    """`entries` (key) with output, from 0: a new output file starts at the first key by which more than `cap` bytes of grandparent files have been passed since the last start.

    A key has passed the files that end before it; files that end before the first key of all don't count. Between
    keys only the passed bytes matter, and they take at most one value a grandparent file: those values are folded in order, on a
    table as long as the files of one level, and keys meet their output by that value.
    """
    ends = files.filter(F.col("level") == level + 2).select(F.col("largest_key").alias("at"), F.col("file_size").alias("amount"))
    kind = files.schema["largest_key"].dataType
    passed = sum_before(ends, entries.select(F.col("key").cast(kind).alias("at")).distinct())
    values = passed.select("total").distinct()
    steps = values.agg(F.sort_array(F.collect_list("total")).alias("totals"))
    begin = F.struct(F.lit(None).cast("long").alias("start"), F.array().cast("array<bigint>").alias("cuts"))

    def step(state, total):
        cut = state.start.isNull() | (total - state.start > F.lit(cap))
        return F.when(cut, F.struct(total.alias("start"), F.concat(state.cuts, F.array(total)).alias("cuts"))).otherwise(state)

    cuts = steps.select(F.explode(F.aggregate("totals", begin, step, lambda state: state.cuts)).alias("total"), F.lit(1).alias("new"))
    number = F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("total")) - 1  # over at most one row a grandparent file
    made = values.join(cuts, "total", "left").select("total", number.cast("long").alias("output"))
    return passed.join(made, "total").select(F.col("at").alias("key"), "output")


def approximate_offset(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key: bytes of files wholly before it plus half of those it falls into."""
    half = F.floor(F.col("file_size") / 2)
    begins = files.select(F.col("smallest_key").alias("at"), half.alias("amount"))
    ends = files.select(F.col("largest_key").alias("at"), (F.col("file_size") - half).alias("amount"))
    out = sum_before(begins.union(ends), keys.select(F.col("key").alias("at")).distinct())
    return out.select(F.col("at").alias("key"), F.col("total").alias("offset"))


def level_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").cast("long").alias("bytes"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))
