"""Work tables and their scopes, dealing out of rows."""

import glob

from stackweave import session


def test_scope_drops_its_tables(spark):
    root = session.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/stackweave/*"))
    kept = session.materialize(spark.range(3), "outer")
    with session.work_scope(spark):
        inner = session.materialize(spark.range(5), "inner")
        with session.work_scope(spark):
            assert session.materialize(spark.range(7), "innermost").count() == 7
        assert inner.count() == 5
        assert len(set(glob.glob(f"{root}/stackweave/*")) - before) == 2
    assert kept.count() == 3
    assert len(set(glob.glob(f"{root}/stackweave/*")) - before) == 1


def test_spread(spark):
    few = session.spread(spark.range(10).coalesce(1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and few.count() == 10
    assert session.spread(spark.range(10).repartition(9)).rdd.getNumPartitions() == 9
