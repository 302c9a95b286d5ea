"""The join that spreads hot keys."""

from pyspark.sql import functions as F

from stackweave.joins import join_unique
from stackweave.session import materialize


def test_same_rows_as_a_plain_join(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700).cast("long").alias("k"))
    right = materialize(left.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1").withColumn("v", F.col("k") * 10), "right")
    for how in ("inner", "left"):
        got = join_unique(left, right, ["k"], "n", ["id"], how, parts=20)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, left.join(right.drop("n"), "k", how).select("id", "k", "v").collect()), key=repr)


def test_empty_sides(spark):
    left = spark.createDataFrame([], "id long, k long")
    right = spark.createDataFrame([], "k long, n long, v long")
    assert join_unique(left, right, ["k"], "n", ["id"], "left").count() == 0
    some = spark.createDataFrame([(1, 2), (2, None)], "id long, k long")
    assert join_unique(some, right, ["k"], "n", ["id"], "left").where("v is null").count() == 2


def test_hot_keys_are_met_in_pieces(spark):
    """Every row once, hot keys, null keys and keys without a partner, wide values too; the rows of a hot key lie in many parts."""
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id long, k string")
    weights = {}
    for _, k in rows:
        if k is not None:
            weights[k] = weights.get(k, 0) + 1
    right = spark.createDataFrame([(k, n, "x" * 500 + k) for k, n in weights.items() if k != "k7"], "k string, n long, v string")
    for how in ("inner", "left"):
        got = {r.id: r.v for r in join_unique(left, right, ["k"], "n", ["id"], how).collect()}
        want = {i: "x" * 500 + k if k is not None and k != "k7" else None for i, k in rows}
        assert got == (want if how == "left" else {i: v for i, v in want.items() if v is not None})
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put the small parts together again
    try:
        joined = join_unique(left, right, ["k"], "n", ["id"], merge=True)
        assert joined.where("k = 'hot'").selectExpr("spark_partition_id() as p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert join_unique(left.limit(0), right.limit(0), ["k"], "n", ["id"]).count() == 0
