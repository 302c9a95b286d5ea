"""The online scorer over two micro-batches."""

from stackweave.functions.instants import DAY_US
from stackweave.plans.scoring import Settings
from stackweave.streaming.online import OnlineScorer, arrivals

SCHEMA = "bug_id long, dup_id long, bucket long, ts long, label boolean, frames array<struct<stack_no:int,depth:int,function:string>>"


def report(bug_id, dup_id, day, functions):
    return (bug_id, dup_id, dup_id or bug_id, day * DAY_US, None, [(0, d, f) for d, f in enumerate(functions)])


def test_batches_score_against_earlier_reports(spark, tmp_path):
    scorer = OnlineScorer(spark, str(tmp_path / "state"), str(tmp_path / "out"), Settings("prefix", window_days=None, top=2))
    for k, batch in enumerate([[report(1, None, 0, "abc"), report(2, None, 1, "xyz")], [report(3, 1, 2, "abd")]]):
        spark.createDataFrame(batch, SCHEMA).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in/0"))
    scorer.start(stream, str(tmp_path / "cp")).awaitTermination()
    scorer.process(spark.createDataFrame([report(3, 1, 2, "abd")], SCHEMA), 1)
    scorer.process(spark.createDataFrame([report(3, 1, 2, "abd")], SCHEMA), 1)  # run again after a failure
    out = spark.read.parquet(str(tmp_path / "out")).where("batch = 1").orderBy("rec_rank").collect()
    assert [(r.query_id, r.cand_id) for r in out] == [(3, 1), (3, 2)]
    assert round(out[0].score, 6) == 0.666667
    first = spark.read.parquet(str(tmp_path / "out")).where("batch = 0").collect()
    assert [(r.query_id, r.cand_id) for r in first] == [(2, 1)]


def test_state_gives_what_all_frames_would(spark, tmp_path, monkeypatch):
    """Weighted and trimmed scores over many small batches, one of them run twice, counts summed up in between."""
    import random

    import pytest

    from stackweave.operators import candidates as cand
    from stackweave.operators import ranking
    from stackweave.plans import scoring
    from stackweave.streaming import online

    monkeypatch.setattr(online, "SUM_EVERY", 2)
    s = Settings("weighted", window_days=None, top=3, trim_percent=60.0, recursion="repeats")
    scorer = OnlineScorer(spark, str(tmp_path / "state"), str(tmp_path / "out"), s)
    rng = random.Random(1)
    rows = [report(b, None, b, [rng.choice("ffghij") for _ in range(rng.randint(1, 4))]) for b in range(1, 11)]
    for k in (0, 1, 1, 2, 3, 4):
        scorer.process(spark.createDataFrame(rows[2 * k : 2 * k + 2], SCHEMA), k)
    for k in (1, 4):
        seen = spark.createDataFrame(rows[: 2 * k + 2], SCHEMA)
        stacks, _ = scoring.prepare(seen.selectExpr("bug_id", "inline(frames)"), s)
        asked = cand.candidates(seen.drop("frames"), spark.createDataFrame(rows[2 * k : 2 * k + 2], SCHEMA).select("bug_id"), None)
        want = {(r.query_id, r.rec_rank): (r.cand_id, pytest.approx(r.score)) for r in ranking.top(scoring.score_pairs(asked, stacks, s), 3).collect()}
        got = {(r.query_id, r.rec_rank): (r.cand_id, r.score) for r in spark.read.parquet(str(tmp_path / f"out/batch={k}")).collect()}
        assert got == want


def test_arrivals(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 10:00:00' as at, 1L as bug_id union all select timestamp'2020-01-01 11:00:00', 2L").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, bug_id long").parquet(str(tmp_path / "in"))
    q = arrivals(stream, 1).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.reports for r in spark.table("arrived").collect()] == [2]
