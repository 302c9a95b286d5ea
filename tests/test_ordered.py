"""Running sums over ranges against a plain window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackweave.operators.ordered import number_falls, number_rows, running_sums


def rows(spark, n=700):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(9), "x") for i in range(n)], "k long, at long, v long, place string").repartition(7)


def test_sums(spark):
    df = rows(spark)
    for by in ([], ["k"]):
        w = Window.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("s", F.sum("v").over(w)).select("at", "s")
        got = running_sums(df, [F.desc("at")], {"s": F.col("v")}, by).select("at", "s")
        assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(r.n for r in number_rows(df, ["at"], "n").collect()) == list(range(700))
    assert running_sums(df.limit(0), ["at"], {"s": F.col("v")}).count() == 0


def test_falls(spark):
    df = rows(spark).where("k is not null")
    w = Window.partitionBy("k").orderBy("at")
    fall = F.when(F.lag("v").over(w).isNull() | (F.col("v") > F.lag("v").over(w)), 0).otherwise(1)
    want = df.withColumn("f", fall).select("k", "at", F.sum("f").over(w).alias("s"))
    assert sorted(number_falls(df, ["k"], "at", "v", "s").select("k", "at", "s").collect()) == sorted(want.collect())
