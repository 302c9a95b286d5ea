"""Places of the right bucket from bounds against those of whole lists."""

import pytest
from pyspark.sql import functions as F

from stackweave.operators import candidates as cand
from stackweave.operators import metrics, ranking
from stackweave.plans import scoring, sweep
from test_intervals import stacks_of, timeline


@pytest.fixture(scope="module")
def crashes(spark):
    reports_, ids = timeline(spark, 11, n=90, buckets=14)
    queries = spark.createDataFrame([(0, k, i) for k, i in enumerate(ids[::2])], "chunk_id int, query_ord int, bug_id long")
    return reports_.cache(), stacks_of(spark, ids, 12, "aaabbbccddefghijklmn").cache(), queries


@pytest.mark.parametrize(
    "given,large,block",
    [
        ({"method": "prefix"}, -9, 10**6), ({"method": "edit", "trim_percent": 30.0, "recursion": "repeats"}, 100, 10**6), ({"method": "alignment", "trim_percent": 45.0}, -9, 90),
        ({"method": "positional", "trim_percent": 40.0}, 100, 10**6), ({"method": "linear", "trim_percent": 40.0}, -9, 10**6), ({"method": "weighted", "trim_percent": 45.0}, 100, 10**6),
        ({"method": "bag", "n_gram": 2}, -9, 10**6), ({"method": "weighted", "trim_percent": 30.0, "frequency_of_unknown": 99.999}, -9, 90), ({"method": "linear", "frequency_by_stack": True}, 100, 10**6),
    ],
)
def test_positions_are_those_of_whole_lists(spark, crashes, given, large, block, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", block)
    monkeypatch.setattr(sweep, "LARGE", large)
    monkeypatch.setattr(sweep, "PENDING", 20)
    monkeypatch.setattr(sweep, "chunks_of", lambda rows: 3)
    s = scoring.Settings(window_days=90, **given)
    run = scoring.evaluate(*crashes, s)
    want = {tuple(r) for r in run.positions.collect()}
    got = [tuple(r) for r in scoring.positions(*crashes, s).collect()]
    assert len(got) == len(want) and set(got) == want and len({p for _, p in want}) > 5
    if s.method == "prefix":
        ranks = {tuple(r) for r in metrics.hit_positions(ranking.rank(run.scored), cand.masters(crashes[0]), by_bucket=False).collect()}
        assert {tuple(r) for r in scoring.positions(*crashes, s, by_bucket=False).collect()} == ranks


@pytest.mark.parametrize("name", ["eval_edit", "eval_linear", "metric_positions", "eval_prefix", "eval_alignment", "eval_positional", "eval_weighted", "metric_positions_plain", "eval_bag"])
def test_positions_make_no_lists(spark, name, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(cand, "candidates", lambda *_: pytest.fail("all pairs of queries and candidates are made"))
    assert e.queries()[name](spark, "/root/testdata/sf0.001").where(F.lit(True)).count() >= 1


def test_rest_of_lists_is_that_of_repaired_ones(spark, crashes, monkeypatch):
    from stackweave.operators import intervals, pairs

    monkeypatch.setattr(sweep, "chunks_of", lambda rows: 4)
    monkeypatch.setattr(sweep, "LISTED", 8)
    reports_, flat, queries = crashes
    asked, found = intervals.intervals(reports_, queries, 90)
    first = ranking.top(sweep.first_by_prefix(asked, found, scoring.encoded(flat, scoring.Settings()), 3), 3).where("query_id % 5 > 0").localCheckpoint()
    want = ranking.repair(first, cand.candidates(reports_, queries, 90)).where(F.col("score") == pairs.NOT_RANKED)
    got = sweep.rest_of_lists(asked, found, first)
    columns = ["query_id", "cand_id", "rec_rank"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect())) and got.count() > 100
