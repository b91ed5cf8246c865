"""Block-wise ordered scans and group lookups equal the plain forms, also with a hot key."""

import random

import pytest
from pyspark.sql import Window, functions as F

from balanza.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        key = 0 if rng.random() < 0.4 else rng.randint(1, 20)
        data.append((key, i, rng.choice([None, rng.randint(-50, 50)])))
    return spark.createDataFrame(data, "k int, at int, v int").repartition(7)


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_running_sum(rows):
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "at", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    got = O.running_sum(rows, ["k"], ["at"], {"s": F.col("v"), "n": F.lit(1)}, F.floor(F.col("at") / 100)).select("k", "at", "s", "n")
    same(got, want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_last_known(rows, inclusive):
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("k", "at", F.last("v", ignorenulls=True).over(w).alias("last"))
    got = O.last_known(rows, ["k"], ["at"], {"last": F.col("v")}, F.floor(F.col("at") / 100), inclusive).select("k", "at", "last")
    same(got, want)


def test_attach_group(rows):
    sums = rows.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("_n"))
    want = rows.join(sums.drop("_n"), "k", "left").select("k", "at", "v", "total")
    for share in (1, 3, 1000):
        same(O.attach_group(rows, sums, ["k"], hot_share=share), want)


def test_top_k_cuts_before_the_shuffle(spark, rows):
    plan = O.top_k(rows, ["k"], [F.col("at")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
