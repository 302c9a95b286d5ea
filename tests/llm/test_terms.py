"""Distinctive terms, n-gram counts, runs: against brute force and corner cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stackweave.llm import distinct, ngrams, runs

OCC = "bug_id long, stack_no int, depth int, term string, score string"


def frames(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], OCC)


def sample(seed, n=900):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(30)]
    rows = [(rng.randrange(40), rng.randrange(2), rng.randrange(12), rng.choice(["hot", "hot", *terms[: rng.randint(1, 30)], None])) for _ in range(n)]
    once = {r[:3]: r[3] for r in rows}
    return [(*k, v) for k, v in once.items()]


def test_idf_against_brute_force(spark):
    rows = sample(1)
    df = frames(spark, rows + rows[:100])  # copies count once
    total = len({r[0] for r in rows})
    n = Counter((r[0], r[3]) for r in rows if r[3])
    d = Counter(t for _, t in n)
    want = {}
    for (b, t), k in n.items():
        if d[t] >= 2:
            best = (-round(k * math.log(total / d[t]), 6), t)
            want[b] = min(want.get(b, best), best)
    counts = distinct.count_terms(df, "bug_id", ["stack_no", "depth"], "term")
    scored = distinct.score_terms(counts, df.agg(F.count_distinct("bug_id")).scalar(), "own", 2)
    assert {r.record: (-r.score + 0.0, r.term) for r in distinct.most_distinctive(scored).collect()} == {b: (s + 0.0, t) for b, (s, t) in want.items()}


def test_llr_against_brute_force(spark):
    rows = sample(2)
    counts = distinct.count_terms(frames(spark, rows), "bug_id", ["stack_no", "depth"], "term")
    n = Counter((r[0], r[3]) for r in rows if r[3])
    cf, size = Counter(), Counter()
    for (b, t), k in n.items():
        cf[t] += k
        size[b] += k
    total = sum(cf.values())

    def g2(b, t):
        k = n[b, t]
        table = [[k, cf[t] - k], [size[b] - k, total - cf[t] - size[b] + k]]
        out = 0.0
        for i in range(2):
            for j in range(2):
                row, col = (cf[t], total - cf[t])[i], (size[b], total - size[b])[j]
                if table[i][j]:
                    out += 2 * table[i][j] * math.log(table[i][j] * total / (row * col))
        return out if k * total >= size[b] * cf[t] else -out

    got = {(r.record, r.term): r.score for r in distinct.score_terms(counts, F.lit(40), "llr").collect()}
    assert got == pytest.approx({k: g2(*k) for k in n}, abs=2e-6)


def test_scores_of_nothing_and_of_one(spark):
    empty = distinct.count_terms(frames(spark, []), "bug_id", ["stack_no", "depth"], "term")
    for score in ("own", "llr"):
        assert distinct.score_terms(empty, F.lit(0), score).count() == 0
    one = distinct.count_terms(frames(spark, [(1, 0, 0, "a"), (1, 0, 1, None), (None, 0, 0, "b")]), "bug_id", ["stack_no", "depth"], "term")
    assert [tuple(r) for r in distinct.score_terms(one, F.lit(1), "own").collect()] == [(1, "a", 1, 1, 0.0)]
    assert distinct.score_terms(one, F.lit(1), "llr").first().score == 0.0
    with pytest.raises(ValueError):
        distinct.score_terms(one, F.lit(1), "other")


def test_ties_go_to_the_first_term(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "B", 2.0), (1, "a", 1.0)], "record long, term string, score double")
    assert [tuple(r) for r in distinct.most_distinctive(df).collect()] == [(1, "B", 2.0)]


def ngram_brute(rows, longest):
    at = {(b, s, d): t for b, s, d, t in rows if t}
    occurrences, records = Counter(), defaultdict(set)
    for (b, s, d), t in at.items():
        gram = []
        for k in range(longest):
            nxt = at.get((b, s, d + k))
            if nxt is None:
                break
            gram.append(nxt)
            occurrences[tuple(gram)] += 1
            records[tuple(gram)].add(b)
    return {g: (occurrences[g], len(records[g])) for g in occurrences}


@pytest.mark.parametrize("longest", [1, 2, 4])
@pytest.mark.parametrize("parts", [1000, 5])
def test_ngrams_against_brute_force(spark, longest, parts, monkeypatch):
    monkeypatch.setattr(ngrams, "PARTS", parts)
    monkeypatch.setattr(ngrams, "BLOCK", 5)  # sequences cross blocks
    rows = sample(3)
    df = frames(spark, rows).withColumn("field_name", F.lit("f"))
    cut = ngrams.suffixes(df, ["field_name"], "bug_id", ["stack_no"], "depth", "term", longest)
    got = {tuple(r.ngram.split(ngrams.SEP)): (r.occurrences, r.records) for r in ngrams.count_ngrams(cut, ["field_name"], longest).collect()}
    assert got == ngram_brute(rows, longest)


def test_ngrams_of_nothing_and_marks(spark):
    df = frames(spark, []).withColumn("field_name", F.lit("f"))
    assert ngrams.count_ngrams(ngrams.suffixes(df, ["field_name"], "bug_id", [], "", "term", 1), ["field_name"], 1).count() == 0
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "ngram string, records long")
    marks = {r.ngram: r.mark for r in ngrams.mark_terms(counts, F.lit(20)).collect()}
    assert marks == {"a": "rare", "b": None, "c": "common"}
    assert ngrams.mark_terms(counts, F.lit(2)).where("ngram = 'a'").first().mark == "rare"


def run_brute(rows):
    out, stacks = set(), defaultdict(dict)
    for b, s, d, t in rows:
        if t:
            stacks[b, s][d] = t
    for (b, s), at in stacks.items():
        for d in sorted(at):
            if at.get(d - 1) != at[d]:
                e = d
                while at.get(e + 1) == at[d]:
                    e += 1
                if e > d:
                    out.add((b, s, at[d], d, e, e - d + 1))
    return out


@pytest.mark.parametrize("block", [4096, 8, 2])
def test_exact_runs_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = {(rng.randrange(6), rng.randrange(2), rng.randrange(60)): rng.choice(["x", "x", "y", None]) for _ in range(500)}
    rows |= {(99, 0, d): "x" for d in range(-3, 50)}
    rows = [(*k, v) for k, v in rows.items()]
    df = frames(spark, rows + rows[:50])
    got = runs.collapse_runs(df, "bug_id", "stack_no", "depth", "term", block=block).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == run_brute(rows)


def near_brute(rows, least, gap):
    """One queue over each whole stack."""
    out, stacks = set(), defaultdict(dict)
    for b, s, d, t in rows:
        if t:
            stacks[b, s][d] = t
    for (b, s), at in stacks.items():
        ds = sorted(at)
        for names, f, l, _, _ in runs.agglomerate([{at[d]: (1, d)} for d in ds], ds, ds, least, gap):
            n = sum(c for c, _ in names.values())
            if n >= 2:
                out.add((b, s, runs.name_of(names), f, l, n))
    return out


def in_blocks(rows, least, gap, block):
    """The operator's two passes in this process."""
    import pyarrow as pa

    events = sorted({(b, s, d, t) for b, s, d, t in rows if t})
    if not events:
        return []
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*events)], names=list("abcd"))
    pieces = [batch.slice(k, 7) for k in range(0, len(events), 7)]
    made = [r for b in runs._collapser(least, gap, 2, block)(iter(pieces)) for r in b.to_pylist()]
    open_ = sorted((r for r in made if r["open"]), key=lambda r: (r["entity"], r["part"], r["first"]))
    joined = [r for b in runs._joiner(least, gap, 2)(iter([pa.RecordBatch.from_pylist(open_)] if open_ else [])) for r in b.to_pylist()]
    return [tuple(r[c] for c in runs._COLUMNS[:6]) for r in [*(r for r in made if not r["open"]), *joined]]


@pytest.mark.parametrize("block", [4, 5, 8, 16])
@pytest.mark.parametrize("least", [0.3, 0.5, 0.67, 1.0])
def test_near_runs_in_blocks_equal_one_queue(block, least):
    """With and without holes at the borders, few words and many, copies of rows."""
    for seed in range(150):
        rng = random.Random(seed)
        words = "abcdef"[: rng.randint(2, 6)]
        terms = ["_".join(rng.sample(words, rng.randint(1, min(3, len(words))))) for _ in range(rng.randint(2, 8))]
        holes, gap = rng.choice([0, 0.1, 0.5]), rng.randint(1, 3)
        rows = [(e, s, d, rng.choice(terms)) for e in range(2) for s in range(2) for d in range(rng.randint(-9, 5), 40) if rng.random() >= holes]
        got = in_blocks(rows, least, gap, block)
        assert len(got) == len(set(got)) and set(got) == near_brute(rows, least, gap), (seed, block, least)


@pytest.mark.parametrize("least", [0.5, 1.0])
def test_the_queue_merges_equal_events(least, monkeypatch):
    """Every event of a run is one of the queue's, equal ones too; a stretch of equal events leaves one open run in a block."""
    seen, queue = [], runs.agglomerate
    monkeypatch.setattr(runs, "agglomerate", lambda names, *a: seen.append([dict(m) for m in names]) or queue(names, *a))
    rows = [(1, 0, d, "x") for d in range(3)] + [(1, 0, 3, "y"), (1, 0, 5, "y")]
    assert in_blocks(rows, least, 1, 4096) == [(1, 0, "x", 0, 2, 3)]
    assert seen == [[{"x": (1, 0)}, {"x": (1, 1)}, {"x": (1, 2)}]]
    at = list(range(500))
    assert queue([{"x": (1, d)} for d in at], at, at, least, 1, left=True, right=True) == [({"x": (500, 0)}, 0, 499, True, False)]


def test_few_runs_stay_open():
    """What a block leaves to the second queue does not grow with the block, even where all neighbours are equally alike."""
    for terms in (["a_b", "b_c"], ["a", "a_b", "b", "b_c", "c"]):
        rng = random.Random(1)
        n = 4000
        names = [{terms[k % len(terms)] if len(terms) == 2 else rng.choice(terms): (1, k)} for k in range(n)]
        made = runs.agglomerate(names, list(range(n)), list(range(n)), 0.3, 1, left=True, right=True)
        assert sum(o for *_, o, _ in made) < 60


def test_runs_across_blocks_of_the_real_size(spark):
    rows = [(1, 0, d, "x") for d in range(3000, 8200)] + [(1, 0, 8200, "y"), (2, 0, 3095, "z"), (2, 0, 3096, "z"), (3, 0, 3096, "q"), (4, 0, 0, "x"), (5, 0, -1, "n"), (5, 0, 0, "n")]
    rows += [(1, 1, 10, "a"), (1, 1, 12, "a"), (1, 2, 1, None), (1, 2, 2, None)]
    got = {tuple(r) for r in runs.collapse_runs(frames(spark, rows), "bug_id", "stack_no", "depth", "term").collect()}
    assert got == {(1, 0, "x", 3000, 8199, 5200), (2, 0, "z", 3095, 3096, 2), (5, 0, "n", -1, 0, 2)}


def test_near_runs(spark):
    assert runs.likeness("fooBar", "foo_bar") == 1.0 and runs.likeness("a", "b") == 0.0 and runs.likeness("??", "!!") == 0.0
    df = frames(spark, [(1, 0, 0, "openFile"), (1, 0, 2, "openFileEx"), (1, 0, 5, "openFile")])
    assert [tuple(r) for r in runs.collapse_runs(df, "bug_id", "stack_no", "depth", "term", least=0.5, gap=2).collect()] == [(1, 0, "openFile", 0, 2, 2)]
    assert runs.collapse_runs(frames(spark, []), "bug_id", "stack_no", "depth", "term").count() == 0
    assert runs.collapse_runs(frames(spark, []), "bug_id", "stack_no", "depth", "term", least=0.5).count() == 0
    # With likeness 1 other spellings of the same words are other terms; below it they are one.
    same = frames(spark, [(1, 0, 0, "fooBar"), (1, 0, 1, "foo_bar")])
    assert runs.collapse_runs(same, "bug_id", "stack_no", "depth", "term").count() == 0
    assert runs.collapse_runs(same, "bug_id", "stack_no", "depth", "term", least=0.9).first().term == "fooBar"


def test_near_runs_around_a_border(spark):
    """Around the border of two blocks, at 3096, with a hole of one place on it; the more frequent term names the run."""
    rows = [(2, 0, 3094, "x"), (2, 0, 3096, "x"), (3, 0, 3095, "x"), (3, 0, 3097, "x")]
    rows += [(4, 0, 3094, "open_main"), (4, 0, 3095, "open_main"), *((4, 0, d, "open_main_file") for d in range(3096, 3100))]
    rows += [(5, 0, 100, "open_main"), (5, 0, 101, "open_main"), *((5, 0, d, "open_main_file") for d in range(102, 106))]
    found = runs.collapse_runs(frames(spark, rows), "bug_id", "stack_no", "depth", "term", least=0.5, gap=2)
    assert sorted(tuple(r) for r in found.collect()) == [
        (2, 0, "x", 3094, 3096, 2), (3, 0, "x", 3095, 3097, 2), (4, 0, "open_main_file", 3094, 3099, 6), (5, 0, "open_main_file", 100, 105, 6),
    ]
