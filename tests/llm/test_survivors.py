"""Survivors of duplicate groups."""

import pytest
from pyspark.sql import functions as F

from stackweave.llm import survivors as s

ROWS = "root_id long, item long, trust int, at long, title string, value string"
BASE = [
    (1, 10, 2, 5, "old title", "v"), (1, 11, 1, 1, "N/A", "v"), (1, 12, 2, 9, "new title", None), (1, 13, 2, 9, "newest", "?"), (1, 13, 2, 9, "newest", "?"),
    (2, 20, 1, 1, "single", "v"), (3, 30, None, None, "no trust", " "), (3, 31, 6, None, "trusted", "UNKNOWN "), (None, 40, 1, 1, "x", "y"), (None, 41, 1, 1, "x", "y"),
]


def long(spark, rows=BASE):
    return s.unpivot(spark.createDataFrame(rows, ROWS).withColumnRenamed("value", "note"), ["root_id", "item", "trust", "at"], ["title", "note"])


def test_prefer(spark):
    got = s.prefer(long(spark), "root_id", "item", [-F.col("trust"), F.col("at")])
    assert {tuple(r) for r in got.collect()} == {(1, "title", 13, "newest"), (1, "note", 11, "v"), (3, "title", 31, "trusted")}
    assert s.prefer(long(spark, BASE[:0]), "root_id", "item", [F.col("at")]).count() == 0


@pytest.mark.parametrize("value,missing", [(None, True), ("", True), ("  ", True), ("---", True), ("?", True), ("UNKNOWN ", True), ("n/A", True), ("(No Title)", True), ("not  set", True), ("nonempty", False), ("7", False), ("é", False)])
def test_missing(spark, value, missing):
    assert spark.createDataFrame([(value,)], "x string").select(s.is_missing(F.col("x"))).first()[0] is missing


def test_votes(spark):
    day = 86_400_000_000
    rows = [(1, 1, 1, 0, "Once trusted", None), (1, 2, 2, 365 * day, "twice said", None), (1, 3, 2, 365 * day, "Twice  said ", None), (1, 3, 2, 365 * day, "Twice  said ", None)]
    won = s.elect(long(spark, rows), "root_id", "item", "trust", "at")
    row = won.first()
    # 1/2 + 1/2 against half of 1, at the older item's worth.
    assert (row.field_name, row.value) == ("title", "twice said")
    record = s.pivot_back(won, "root_id", ["title", "note"]).first()
    assert (record.root_id, record.title, record.note) == (1, "twice said", None)
    tie = s.elect(long(spark, [(1, 1, 1, 0, "b", None), (1, 2, 1, 0, "a", None)]), "root_id", "item", "trust", "at")
    assert tie.first().value == "a"
    assert s.elect(long(spark, BASE[:0]), "root_id", "item", "trust", "at").count() == 0
