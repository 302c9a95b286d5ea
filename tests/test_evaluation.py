"""Candidates, ranking, metrics, canonical buckets, splits: the mini-case and corner cases."""

import random

import pytest
from pyspark.sql import functions as F

from stackweave.functions.instants import DAY_US
from stackweave.operators import candidates as cand
from stackweave.operators import canonical, metrics, ordered, pairs, ranking, reports, splits
from stackweave.functions import kernels
from stackweave.plans import scoring, search

REPORT = "bug_id long, dup_id long, bucket long, ts long, label boolean"


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(1, None, 1, 0), (2, 1, 1, 1), (3, None, 3, 2), (4, 3, 3, 500), (5, 1, 1, 600)]
    return spark.createDataFrame([(*r[:3], r[3] * DAY_US, None) for r in rows], REPORT)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "bug_id long")


@pytest.mark.parametrize("window,want", [(None, {4: {1, 2, 3}, 5: {1, 2, 3, 4}}), (365, {5: {3, 4}}), (100_000, {4: {1, 2, 3}, 5: {1, 2, 3, 4}})])
def test_candidates(spark, mini, window, want):
    got = {}
    for r in cand.candidates(mini, ids(spark, 4, 5, 5, 77), window).collect():
        got.setdefault(r.query_id, set()).add(r.cand_id)
    assert got == want


def test_universe_and_labels(spark, mini):
    assert {r.bug_id for r in cand.universe(mini, ids(spark, 3)).collect()} == {1, 2, 3}
    labelled = spark.createDataFrame([(1, None, 1, 0, False), (2, None, 2, 0, True), (3, None, 3, 0, None)], REPORT)
    assert {r.bug_id for r in cand.evaluated(ids(spark, 1, 2, 3), labelled).collect()} == {2, 3}


SCORED = "query_id long, cand_id long, score double"


def test_ranking(spark, mini):
    scored = spark.createDataFrame([(5, 1, 0.5), (5, 2, 0.9), (5, 3, 0.9), (5, 4, 0.1), (5, 5, 9.0)], SCORED)
    ranked = ranking.rank(scored)
    order = [r.cand_id for r in ranked.orderBy("rec_rank").collect()]
    assert order == [3, 2, 1, 4]
    masters = cand.masters(mini)
    assert [tuple(r) for r in metrics.hit_positions(ranked, masters).collect()] == [(5, 2)]
    assert [tuple(r) for r in metrics.hit_positions(ranked, masters, by_bucket=False).collect()] == [(5, 2)]
    row = metrics.recall_and_mrr(metrics.hit_positions(ranked, masters), 3).first()
    assert (row.queries, row.mrr, row.recall) == (1, 0.5, [0.0, 1.0, 1.0])
    assert [r.cand_id for r in ranking.top_or_first_hit(ranked, masters, 1).orderBy("rec_rank").collect()] == [3, 2]
    fixed = ranking.repair(ranking.top(scored, 2), cand.candidates(mini, ids(spark, 5), None))
    assert [(r.cand_id, r.rec_rank) for r in fixed.orderBy("rec_rank").collect()] == [(3, 1), (2, 2), (4, 3), (1, 4)]
    problems = ranking.violations(ranked, cand.candidates(mini, ids(spark, 5), 365), ids(spark, 5, 4))
    assert {(r.query_id, r.problem) for r in problems.collect()} == {(5, "foreign candidate"), (4, "no list")}


def test_no_hit_and_no_query(spark, mini):
    ranked = ranking.rank(spark.createDataFrame([(5, 3, 1.0), (5, 4, 0.5)], SCORED))
    assert [tuple(r) for r in metrics.hit_positions(ranked, cand.masters(mini)).collect()] == [(5, None)]
    assert ranking.top_or_first_hit(ranked, cand.masters(mini), 1).count() == 2
    empty = metrics.recall_and_mrr(metrics.hit_positions(ranked.limit(0), cand.masters(mini)), 2).first()
    assert (empty.queries, empty.mrr, empty.recall) == (0, None, [None, None])


def test_auc_and_roc(spark):
    best = spark.createDataFrame([(0.9, True), (0.4, True), (0.4, False), (0.1, False), (None, True), (0.2, None)], "score double, positive boolean")
    assert metrics.auc(best).first().auc == 0.875
    assert [tuple(r) for r in metrics.roc(best).orderBy("threshold").collect()] == [(0.1, 1.0, 1.0), (0.4, 1.0, 0.5), (0.9, 0.5, 0.0)]
    assert metrics.auc(best.where("positive")).first().auc is None
    assert metrics.loss(None, 0.5) == 1.5


CELL = "query_id long, cand_id long, q_stack int, c_stack int, score double"


@pytest.mark.parametrize("how,want", [("max", 0.9), ("avg_query", 0.7), ("avg_cand", (0.9 + 0.5 + 0.2) / 3), ("avg_short", 0.7), ("avg_long", (0.9 + 0.5 + 0.2) / 3), ("avg_query_cand", (0.7 + 1.6 / 3) / 2)])
def test_aggregates(spark, how, want):
    cells = spark.createDataFrame([(1, 2, 0, 0, 0.9), (1, 2, 0, 1, 0.1), (1, 2, 0, 2, 0.2), (1, 2, 1, 0, 0.3), (1, 2, 1, 1, 0.5), (1, 2, 1, 2, 0.0)], CELL)
    assert pairs.aggregate_cells(cells, how).first().score == pytest.approx(want)


def test_stack_filters(spark):
    rows = [(1, 0, ["a"], [90.0]), (1, 1, ["b", "a"], [10.0, 90.0]), (1, 2, ["b"], [10.0]), (1, 3, ["b"], [10.0])]
    stacks = spark.createDataFrame(rows, "bug_id long, stack_no int, tokens array<string>, df array<double>")
    assert pairs.select_one(stacks).first().stack_no == 2
    frequency = spark.createDataFrame([("a", 9, 90.0), ("b", 1, 10.0)], "token string, df long, percent double")
    assert {r.stack_no for r in pairs.top_tokens(stacks, frequency, 0.5).collect()} == {1, 2, 3}
    assert pairs.top_tokens(stacks, frequency, 1.0).count() == 4
    with pytest.raises(ValueError):
        pairs.top_tokens(stacks, frequency, 0.0)


def test_canonical_buckets(spark):
    raw = spark.createDataFrame([(1, None, 5), (2, 99, 3), (3, 99, 1), (4, 3, 9), (5, 99, 1)], "bug_id long, dup_id long, ts long")
    assert {(r.bug_id, r.dup_id) for r in canonical.adopt_orphans(raw).collect()} == {(1, None), (2, 3), (3, None), (4, 3), (5, 3)}
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 4), (5, None), (6, 5), (7, 6)], "id long, parent long")
    cut = canonical.break_cycles(links)
    assert {(r.id, r.parent) for r in cut.collect()} == {(1, None), (2, 1), (3, 2), (4, None), (5, None), (6, 5), (7, 6)}
    assert {(r.id, r.parent) for r in canonical.flatten(cut).collect()} == {(1, None), (2, 1), (3, 1), (4, None), (5, None), (6, 5), (7, 5)}
    assert {r.id for r in canonical.nested_masters(cut).collect()} == {3, 7}
    assert {(r.id, r.parent) for r in canonical.break_two_cycles(links.where("id < 4")).collect()} == {(1, None), (2, 1), (3, 2)}
    rows = spark.createDataFrame([(10, 7, 5), (7, 7, 9), (8, 7, 6), (20, 20, 1)], "bug_id long, bucket long, ts long")
    got = {(r.bug_id, r.original_bug_id, r.dup_id) for r in canonical.remaster_oldest(rows).collect()}
    assert got == {(7, 10, None), (10, 7, 7), (8, None, 7), (20, None, None)}
    known = ids(spark, 8)
    assert {(r.bug_id, r.dup_id) for r in canonical.masters_of_labels(rows, known).collect()} == {(8, None), (20, None)}
    assert {(r.bug_id, r.dup_id) for r in canonical.masters_of_labels(rows).collect()} == {(10, None), (7, 10), (8, 10), (20, None)}


def test_dates_and_cleaning(spark):
    rows = spark.createDataFrame([(1, "Fri Mar  5 10:00:00 2010"), (2, "Sat Apr 10 10:00:00 2010"), (3, "bad")], "bug_id long, date string")
    dates = spark.sql("select 1L as bug_id, timestamp_ntz'2011-01-01 00:00:00' as created")
    got = {r.bug_id: str(r.created) for r in canonical.enrich_dates(rows, dates, "date").collect()}
    assert got == {1: "2011-01-01 00:00:00", 2: "2010-04-10 10:00:00", 3: "None"}
    wide = spark.createDataFrame([(1, None, "x", "y")], "bug_id long, description string, `a.txt` string, _id string")
    assert canonical.clean_output(wide, ["description"]).first().asDict() == {"bug_id": 1, "description": ""}
    copies = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 0, "c")], "bug_id long, ts long, v string")
    assert [tuple(r) for r in canonical.first_of_each(copies, "bug_id", ["ts"]).collect()] == [(1, 1, "a")]


@pytest.fixture(scope="module")
def timeline(spark):
    return spark.createDataFrame([(i, i * DAY_US, i % 2 == 1, i - 1 if i % 2 else None) for i in range(20)], "bug_id long, ts long, seen_before boolean, dup_id long")


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.part, set()).add(r.bug_id)
    return out


def test_splits(spark, timeline):
    assert parts(splits.split_fraction(timeline, 0.3)) == {"training": set(range(16)), "test": set(range(16, 20))}
    assert parts(splits.split_after(timeline, 5 * DAY_US, 2)) == {"training": set(range(8)), "test": set(range(8, 20))}
    dated = splits.split_date(timeline, 10 * DAY_US)
    assert parts(dated) == {"training": set(range(10)), "test": set(range(10, 20))}
    assert parts(splits.split_validation(dated, share=0.4))["validation"] == {8, 9}
    assert parts(splits.split_validation(dated, date_us=7 * DAY_US))["validation"] == {7, 8, 9}
    assert parts(splits.chunk(timeline, 12, 4, 2)) == {"test": {12, 13, 14, 15}, "validation": {9, 10, 11}, "training": set(range(9))}
    assert parts(splits.split_fraction(timeline.where("not seen_before"), 0.3)) == {"training": set(range(0, 20, 2))}
    assert [r.place for r in ordered.number_rows(timeline.repartition(5), ["ts"]).orderBy("ts").collect()] == list(range(20))
    assert ordered.number_rows(timeline.limit(0), ["ts"]).count() == 0
    assert {r.bug_id for r in splits.not_after(timeline, 2 * DAY_US, 2).collect()} == {0, 1, 2}
    flagged = reports.flag_duplicates(spark.createDataFrame([(1, 1, 5), (2, 1, 4), (3, 3, 1)], "bug_id long, bucket long, ts long"))
    assert {(r.bug_id, r.seen_before) for r in flagged.collect()} == {(1, True), (2, False), (3, False)}


FLAT = "bug_id long, stack_no int, depth int, function string"


def test_evaluation_and_search(spark, mini):
    flat = spark.createDataFrame([(b, 0, d, f) for b, fs in {1: "abc", 2: "abc", 3: "xyz", 4: "xya", 5: "abd"}.items() for d, f in enumerate(fs)], FLAT)
    queries = ids(spark, 4, 5)
    for method in ("prefix", "weighted", "linear", "alignment", "edit", "positional", "merge", "bag"):
        run = scoring.evaluate(mini, flat, queries, scoring.Settings(method, window_days=None))
        row = run.recall.first()
        assert (row.queries, row.mrr, row.recall[0]) == (2, 1.0, 1.0), method
    measure = search.measure_with(mini, flat, queries)
    drawn = list(search.run_search(search.random_settings("positional", scoring.Settings(window_days=None), 5), 2, measure))
    assert len(drawn) == 2 and drawn[0][0] <= drawn[1][0]
    assert next(search.random_settings("positional", scoring.Settings(), 5)) == next(search.random_settings("positional", scoring.Settings(), 5))
    assert len(list(search.grid_settings("bag", scoring.Settings()))) == 7
    with pytest.raises(ValueError):
        next(search.grid_settings("positional", scoring.Settings()))
    stored = search.stored_settings('{"0": {"c": 1.5, "aggregate": "avg_query"}}', scoring.Settings("positional"))
    assert stored["0"].params == {"c": 1.5} and stored["0"].aggregate == "avg_query"
    texts = spark.createDataFrame([(5, 1, 0.5), (5, 2, 0.4), (5, 3, 0.3)], SCORED)
    blended = {r.cand_id: r.score for r in scoring.blend_stages(mini, flat, texts, scoring.Settings(params={"c": 0.0, "o": 0.0}, alpha=0.5, n_top=2)).collect()}
    assert blended[1] == pytest.approx(0.5 * (2 / 3) / (0.5 * 0.5 + 0.5 * 2 / 3)) and blended[3] == pairs.NOT_RANKED


def test_filters_leave_nothing(spark, mini):
    flat = spark.createDataFrame([(b, 0, 0, "f") for b in range(1, 6)], FLAT)
    run = scoring.evaluate(mini, flat, ids(spark, 5), scoring.Settings(window_days=None, trim_percent=50.0))
    assert {r.score for r in run.ranked.collect()} == {pairs.NO_STACK}
    with pytest.raises(ValueError):
        scoring.prepare(flat, scoring.Settings(trim_percent=0.0))


def test_evaluations_have_the_window_of_the_reference():
    from stackweave.queries import reference

    assert {n: s.window_days for n, s in reference.EVALUATIONS.items()} == dict.fromkeys(reference.EVALUATIONS, 730) and reference.WINDOW == 730


def at_queries_brute(reports_, order, stacks, pairs_, s):
    """Scores of pairs by the frequencies that the reports before, the query and the queries before it give."""
    import pyarrow as pa

    base = [b for b in reports_ if b not in order]
    docs = lambda b: [set(t) for t in stacks.get(b, [])] if s.frequency_by_stack else [set().union(*stacks.get(b, []))]
    out = {}
    for k, q in enumerate(order):
        held = [d for b in [*base, *order[: k + 1]] for d in docs(b)]
        unknown = lambda t: s.frequency_of_unknown is not None and t.startswith("??")
        df = lambda t: s.frequency_of_unknown if unknown(t) else sum(t in d for d in held) / len(held) * 100

        def side(b):
            kept = []
            for t in stacks.get(b, []):
                at = [i for i, x in enumerate(t) if s.trim_percent is None or df(x) <= s.trim_percent or unknown(x)]
                if at:
                    kept.append(t[at[0] : at[-1] + 1])
            return kept

        build, weighted = scoring.METHODS[s.method]
        for c in [c for x, c in pairs_ if x == q]:
            cells = [[None] * len(side(c)) for _ in side(q)]
            for i, a in enumerate(side(q)):
                for j, b in enumerate(side(c)):
                    more = [pa.array([[df(t) for t in x]]) for x in (a, b)] if weighted else []
                    cells[i][j] = kernels.score_lists(build(**s.params), pa.array([a]), pa.array([b]), *more)[0].as_py()
            rows, columns = [max(r) for r in cells if r], [max(x) for x in zip(*cells)]
            mean = lambda v: sum(v) / len(v)
            if not rows:
                out[q, c] = pairs.NO_STACK
            else:
                out[q, c] = {"max": max(rows), "avg_query": mean(rows), "avg_short": mean(rows) if len(rows) <= len(columns) else mean(columns)}[s.aggregate]
    return out


@pytest.mark.parametrize(
    "given",
    [
        {"method": "weighted"}, {"method": "weighted", "trim_percent": 40.0, "aggregate": "avg_short"}, {"method": "linear", "frequency_by_stack": True},
        {"method": "weighted", "trim_percent": 30.0, "frequency_of_unknown": 99.999}, {"method": "edit", "trim_percent": 30.0}, {"method": "prefix", "trim_percent": 35.0, "aggregate": "avg_query"},
        {"method": "merge", "trim_percent": 40.0, "frequency_of_unknown": 99.999, "keep_unknown": True},
    ],
)
@pytest.mark.parametrize("block", [10**6, 7])
def test_frequencies_at_queries_against_brute_force(spark, given, block, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", block)
    s = scoring.Settings(window_days=None, **given)
    rng = random.Random(3)
    rows = [(b, s_, d, rng.choice(["f", "f", "g", "h", "i", "j", "k", None])) for b in range(1, 15) if b != 6 for s_ in range(rng.randint(1, 3)) for d in range(rng.randint(1, 5))]
    flat = spark.createDataFrame(rows, FLAT)
    canonical_ = spark.createDataFrame([(b, None, b, b * DAY_US, None) for b in range(1, 15)], "bug_id long, dup_id long, bucket long, ts long, label boolean")
    # Asked in another order than that of time, one twice, one by a report without stacks.
    queries = spark.createDataFrame([(0, 0, 12), (0, 1, 9), (1, 0, 12), (1, 1, 14), (1, 2, 6)], "chunk_id int, query_ord int, bug_id long")
    asked = spark.createDataFrame([(q, c) for q in (12, 9, 14, 6) for c in range(1, q)], "query_id long, cand_id long")
    stacks = scoring.encoded(flat, s)
    held = {}
    for r in stacks.orderBy("bug_id", "stack_no").collect():
        held.setdefault(r.bug_id, []).append(list(r.tokens))
    got = scoring.score_at_queries(asked, stacks, canonical_, queries, s).collect()
    want = at_queries_brute(range(1, 15), [12, 9, 14, 6], held, [tuple(r) for r in asked.collect()], s)
    assert len(got) == len(want) and {(r.query_id, r.cand_id): r.score for r in got} == pytest.approx(want)
    assert scoring.score_at_queries(asked.limit(0), stacks, canonical_, queries.limit(0), s).count() == 0


def test_two_stages(spark, mini):
    flat = spark.createDataFrame([(b, 0, d, f) for b, fs in {1: "abc", 2: "abc", 3: "xyz", 4: "xya", 5: "abd"}.items() for d, f in enumerate(fs)], FLAT)
    texts = spark.createDataFrame([(5, 1, 0.5), (5, 2, 0.4), (5, 3, 0.3), (5, 99, 0.9)], SCORED)
    s = scoring.Settings("two_stage", params={"c": 0.0, "o": 0.0}, window_days=None, n_top=2, alpha=0.5)
    run = scoring.evaluate_two_stage(mini, flat, ids(spark, 5), texts, s)
    scores = {r.cand_id: r.score for r in run.scored.collect()}
    assert scores[1] == pytest.approx(0.5 * (2 / 3) / (0.5 * 0.5 + 0.5 * 2 / 3)) and scores[3] == scores[4] == pairs.NOT_RANKED and 99 not in scores
    assert [r.cand_id for r in run.ranked.orderBy("rec_rank").collect()] == [1, 2, 4, 3] and run.recall.first().queries == 1
    drawn = next(search.random_settings("two_stage", s, 1))
    assert 0 <= drawn.alpha <= 1 and 1 <= drawn.n_top < 400 and set(drawn.params) == {"c", "o"}
    assert search.measure_with(mini, flat, ids(spark, 5), texts)(s)[0] == run.recall.first().mrr


def test_positions_from_scores_are_those_of_ranks(spark, mini):
    rng = random.Random(2)
    scored = spark.createDataFrame([(q, c, rng.choice([0.1, 0.5, 0.9])) for q in (3, 4, 5) for c in range(1, 6)], SCORED)
    masters = cand.masters(mini)
    want = {tuple(r) for r in metrics.hit_positions(ranking.rank(scored), masters).collect()}
    assert {tuple(r) for r in metrics.bucket_positions(scored, masters).collect()} == want
    assert metrics.bucket_positions(scored.limit(0), masters).count() == 0


def test_random_chunks(spark, timeline):
    starts = splits.random_starts(timeline, 3, 4, 2, 5)
    drawn = [r.start_day for r in starts.orderBy("chunk").collect()]
    assert len(set(drawn)) == 3 and all(3 <= d <= 15 for d in drawn) and drawn == [r.start_day for r in splits.random_starts(timeline.repartition(3), 3, 4, 2, 5).orderBy("chunk").collect()]
    chunks = splits.random_chunks(timeline, 3, 4, 2, 5)
    for k, d in enumerate(drawn):
        assert parts(chunks.where(f"chunk = {k}").drop("chunk")) == parts(splits.chunk(timeline, d, 4, 2))
    assert splits.random_starts(timeline, 100, 4, 2, 5).count() == 13
    assert splits.random_chunks(timeline, 3, 4, 99, 5).count() == 0 and splits.random_chunks(timeline.limit(0), 3, 4, 1, 5).count() == 0


def test_reuse_and_first_attachments(spark):
    from stackweave.operators import attachments

    lists = "query_id long, cand_id long, score double, rec_rank int"
    made, older = spark.createDataFrame([(1, 5, 0.5, 1), (2, 6, 0.6, 1), (3, 7, 0.7, 1)], lists), spark.createDataFrame([(1, 8, 0.8, 1), (3, 9, 0.9, 1)], lists)
    order = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "query_id long, number int")
    assert {(r.query_id, r.cand_id) for r in ranking.reuse(made, older, order, 2).collect()} == {(1, 8), (3, 7)}
    assert {(r.query_id, r.cand_id) for r in ranking.reuse(made, older, order, 0).collect()} == {(1, 5), (2, 6), (3, 7)}
    near = attachments.NEAR_US
    rows = [(1, 10, 5, False), (1, 11, 6, True), (2, 20, near + 1, True), (2, 21, near + 2, True), (3, 31, 0, True), (3, 30, 0, True), (4, 40, None, True), (None, 50, 1, True), (5, 60, 1, False)]
    files = spark.createDataFrame(rows, "bug_id long, attachment_id long, at long, stack boolean")
    reports_ = spark.createDataFrame([(b, 0) for b in range(1, 6)], "bug_id long, ts long")
    assert {tuple(r) for r in attachments.first_attachment(reports_, files).collect()} == {(1, 10), (3, 30), (5, 60)}
    # Of those that hold a stack; one that came too late is not replaced by a later one.
    assert {tuple(r) for r in attachments.first_attachment(reports_, files, F.col("stack")).collect()} == {(1, 11), (3, 30)}
    assert attachments.first_attachment(reports_, files.limit(0)).count() == 0
