"""Global ranks, neighbours and running sums over a million rows of several columns, written out whole."""

import time

import pytest
from pyspark.sql import functions as F

from sediment.operators.ordered import neighbour, rank_rows, sum_before

N = 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    """Keys 0, 3, 6, ... in hashed order with wide other columns."""
    out = spark.range(N).select((F.col("id") * 3).alias("key"), F.md5(F.col("id").cast("string")).alias("text"), F.xxhash64("id").alias("mix"))
    return out.repartition(7, "mix")


def test_ranks_are_a_permutation(spark, rows, tmp_path):
    rank_rows(rows, "key").write.parquet(str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    wrong = got.filter((F.col("position") != F.col("key") / 3 + 1) | (F.col("text") != F.md5((F.col("key") / 3).cast("long").cast("string"))))
    assert got.count() == N and wrong.count() == 0


@pytest.mark.parametrize("after", [True, False])
def test_neighbours(spark, rows, after, tmp_path):
    some = F.when(F.col("key") % 2 == 0, F.col("key"))  # every other key can be found
    neighbour(rows, "key", some, after, "to").write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n"))
    step = F.when(F.col("key") % 2 == 0, 6).otherwise(3)
    want = F.when(F.col("key") + step < 3 * N, F.col("key") + step) if after else F.when(F.col("key") >= step, F.col("key") - step)
    assert got.count() == N and got.filter(~F.col("to").eqNullSafe(want)).count() == 0


def test_running_sums(spark, rows, tmp_path):
    points = rows.select(F.col("key").alias("at"), F.lit(2).alias("amount"), "text")
    asked = spark.range(0, N, 10).select((F.col("id") * 3 + 1).alias("at"))
    sum_before(points, asked).write.parquet(str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == N // 10 and got.filter(F.col("total") != ((F.col("at") - 1) / 3 + 1) * 2).count() == 0


def test_forward_neighbours_cost_their_length(spark):
    took = []
    for n in (20_000, 20_000, 160_000):  # the first compiles
        table = spark.range(n).select(F.col("id").alias("key"))
        began = time.perf_counter()
        neighbour(table, "key", F.when(F.col("key") == n - 1, F.col("key")), True, "to").write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[2] < 16 * took[1] + 2


def test_empty_and_tied_rows(spark):
    none = spark.createDataFrame([], "key long, amount long")
    assert rank_rows(none, "key").count() == 0 and neighbour(none, "key", F.col("key"), True, "to").count() == 0
    tied = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "key long, v string")
    assert sorted(r.position for r in rank_rows(tied, "key").collect()) == [1, 2, 3, 4]
