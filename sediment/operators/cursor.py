"""Cursor operations over live rows, as plans.

Live keys have positions 1..n in order; position 0 is the phantom where a fresh cursor stands. Next
and previous go around through it: after the last key comes the phantom, after the phantom the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.ordered import neighbour, rank_rows


def first(live: DataFrame, n: int = 1) -> DataFrame:
    return live.orderBy("key").limit(n)


def last(live: DataFrame, n: int = 1) -> DataFrame:
    return live.orderBy(F.desc("key")).limit(n)


def seek(live: DataFrame, lower) -> DataFrame:
    """The first live row at or after `lower`."""
    return first(live.filter(F.col("key") >= F.lit(lower)))


def seek_before(live: DataFrame, upper) -> DataFrame:
    """The last live row strictly before `upper`."""
    return last(live.filter(F.col("key") < F.lit(upper)))


def between(live: DataFrame, lower=None, upper=None, reverse: bool = False) -> DataFrame:
    """Rows of [lower, upper) with their position in the range, from 1, in the direction asked."""
    out = live
    if lower is not None:
        out = out.filter(F.col("key") >= F.lit(lower))
    if upper is not None:
        out = out.filter(F.col("key") < F.lit(upper))
    if not reverse:
        return rank_rows(out, "key")
    ranked = rank_rows(out, "key", name="_up")
    total = out.agg(F.count("*").alias("_n"))  # one row
    return ranked.join(F.broadcast(total)).withColumn("position", F.col("_n") - F.col("_up") + 1).drop("_n", "_up")


def next_keys(live: DataFrame) -> DataFrame:
    """Each live key and the phantom (null) with the key that `next` goes to; null is the phantom."""
    step = neighbour(live.select("key"), "key", F.col("key"), True, "next_key")
    return step.union(live.agg(F.lit(None).cast(live.schema["key"].dataType).alias("key"), F.min("key").alias("next_key")))


def previous_keys(live: DataFrame) -> DataFrame:
    """Each live key and the phantom (null) with the key that `prev` goes to."""
    step = neighbour(live.select("key"), "key", F.col("key"), False, "prev_key")
    return step.union(live.agg(F.lit(None).cast(live.schema["key"].dataType).alias("key"), F.max("key").alias("prev_key")))


def _merged(live: DataFrame, bounds: DataFrame, ties: tuple[int, int]) -> DataFrame:
    """Keys and distinct bounds in one table (at: value and tie, key: null for a bound); ties put equal bounds before or after a key."""
    kind = live.schema["key"].dataType
    asked = bounds.select(F.struct(F.col("bound").cast(kind).alias("value"), F.lit(ties[0]).alias("tie")).alias("at")).distinct()
    return live.select(F.struct(F.col("key").alias("value"), F.lit(ties[1]).alias("tie")).alias("at"), "key").union(asked.withColumn("key", F.lit(None).cast(kind)))


def bulk_seek(live: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each `bound`, found_key: the first live key at or after it, or null. Bounds and keys are merged in order, with no theta join."""
    found = neighbour(_merged(live, bounds, (0, 1)), "at", F.col("key"), True, "found_key")
    return found.filter(F.col("key").isNull()).select(F.col("at.value").alias("bound"), "found_key")


def bulk_seek_before(live: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each `bound`, found_key: the last live key strictly before it, or null."""
    found = neighbour(_merged(live, bounds, (0, 1)), "at", F.col("key"), False, "found_key")
    return found.filter(F.col("key").isNull()).select(F.col("at.value").alias("bound"), "found_key")


class Cursor:
    """A position over a table of live rows; each move is one small query on the key order."""

    def __init__(self, live: DataFrame):
        self.live, self.row = live, None

    @property
    def valid(self) -> bool:
        return self.row is not None

    @property
    def current(self):
        return self.row

    def reset(self) -> None:
        self.row = None

    def _go(self, found: DataFrame):
        self.row = next(iter(found.take(1)), None)
        return self.row

    def seek(self, lower):
        return self._go(seek(self.live, lower))

    def seek_before(self, upper):
        return self._go(seek_before(self.live, upper))

    def seek_to_first(self):
        return self._go(first(self.live))

    def seek_to_last(self):
        return self._go(last(self.live))

    def next(self):
        return self._go(first(self.live if self.row is None else self.live.filter(F.col("key") > F.lit(self.row.key))))

    def prev(self):
        return self._go(last(self.live if self.row is None else self.live.filter(F.col("key") < F.lit(self.row.key))))
