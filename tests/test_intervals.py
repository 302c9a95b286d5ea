"""Candidates as intervals against the pairs themselves."""

import random

import pytest
from stackweave.functions.instants import DAY_US
from stackweave.operators import candidates as cand
from stackweave.operators import intervals

REPORT = "bug_id long, dup_id long, bucket long, ts long, label boolean"


def timeline(spark, seed, n=60, buckets=9, days=400):
    """Reports of few buckets over many days, some at one instant, ids in another order than time."""
    rng = random.Random(seed)
    ids = rng.sample(range(1, 4 * n), n)
    rows = [(i, None, ids[rng.randrange(buckets)], rng.randrange(days) * DAY_US + rng.choice([0, 0, 5]), rng.choice([None, None, True, False])) for i in ids]
    return spark.createDataFrame([(r[0], r[2] if r[2] != r[0] else None, *r[2:]) for r in rows], REPORT), ids


@pytest.mark.parametrize("window,block", [(None, 4096), (30, 4096), (30, 4), (None, 4), (1, 7), (10_000, 7)])
def test_pairs_of_intervals_are_the_candidates(spark, window, block, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", block)
    reports_, ids = timeline(spark, 7)
    queries = spark.createDataFrame([(i,) for i in [*ids[::3], ids[0], 10**6]], "bug_id long")
    want = sorted(map(tuple, cand.candidates(reports_, queries, window).collect()))
    asked, found = intervals.intervals(reports_, queries, window)
    assert sorted(map(tuple, intervals.pairs_of(asked, found).collect())) == want and len(want) > 20
    none = intervals.intervals(reports_, queries.limit(0), window)
    assert intervals.pairs_of(*none).count() == 0


@pytest.mark.parametrize("name", ["cands_all", "cands_window"])
def test_pairs_are_not_shuffled(spark, name):
    """What is shuffled after the pairs are made, or joined without a key, grows as the pairs do."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, made, below = plan.partition("Generate")
    assert made and "Exchange" not in above and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # The one exchange below gathers the queries' ids, the other side is read as it was written.
    assert "BroadcastHashJoin" in below and below.count("Exchange hashpartitioning") == 1


def stacks_of(spark, ids, seed, letters="aaabbcdefg"):
    """One to three stacks of most reports, many with a common beginning, some tokens unknown."""
    rng = random.Random(seed)
    rows = [(b, s, d, rng.choice([*letters, None])) for b in ids if rng.random() < 0.8 for s in range(rng.randint(1, 3)) for d in range(rng.randint(1, 6))]
    return spark.createDataFrame(rows, "bug_id long, stack_no int, depth int, function string")


@pytest.mark.parametrize("n,chunks", [(1, 1), (5, 3), (40, 5)])
def test_first_of_lists_are_those_of_all_pairs(spark, n, chunks, monkeypatch):
    from stackweave.functions import kernels
    from stackweave.operators import pairs, ranking
    from stackweave.plans import scoring, sweep

    monkeypatch.setattr(sweep, "chunks_of", lambda rows: chunks)
    reports_, ids = timeline(spark, 3)
    stacks = scoring.encoded(stacks_of(spark, ids, 4), scoring.Settings())
    queries = spark.createDataFrame([(i,) for i in ids[::2]], "bug_id long")
    every = pairs.best_of_pairs(cand.candidates(reports_, queries, 90), stacks, kernels.common_prefix)
    want = sorted(map(tuple, ranking.top(every, n).select("query_id", "cand_id", "score", "rec_rank").collect()))
    got = ranking.top(sweep.first_by_prefix(*intervals.intervals(reports_, queries, 90), stacks, n), n)
    assert sorted(map(tuple, got.select("query_id", "cand_id", "score", "rec_rank").collect())) == want and len(want) > 20


def test_listed_pairs_among_the_candidates(spark):
    reports_, ids = timeline(spark, 5)
    queries = spark.createDataFrame([(i,) for i in ids[::2]], "bug_id long")
    listed = spark.createDataFrame([(q, c) for q in [*ids[:20], 10**6] for c in [*ids[:20], 10**6, None]] + [(None, 1)], "query_id long, cand_id long")
    every = {tuple(r) for r in cand.candidates(reports_, queries, 90).collect()}
    got = [tuple(r) for r in intervals.known(reports_, queries, 90, listed).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in listed.collect()} & every and got


@pytest.mark.parametrize("name", ["rank_top5", "rank_reuse", "rank_violations"])
def test_lists_make_no_pairs(spark, name, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(cand, "candidates", lambda *_: pytest.fail("all pairs of queries and candidates are made"))
    e.queries()[name](spark, "/root/testdata/sf0.001").count()
