"""Kernels: golden vectors, an independent programme in plain Python, properties."""

import math
import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackweave.functions import kernels as k

DF = {1: 50.0, 2: 20.0, 3: 10.0, 4: 5.0, 5: 1.0, 7: 2.0, 8: 4.0}
PAIRS = [([1, 2, 3, 4], [1, 2, 4]), ([1, 2, 2, 3, 5], [2, 1, 3, 5]), ([7], [8]), ([1, 2, 3], [1, 2, 3]), ([1, 2], [2, 1])]
W = partial(k.Weighted)
GOLDEN = [
    ("w", dict(), [0.224747391, 0.595145791, -1.0, 1.0, 0.624723240]),
    ("w", dict(reciprocal=False), [0.265570387, 0.603946341, -1.0, 1.0, 0.629493150]),
    ("w", dict(total=False), [0.224747391, 0.600781628, -0.549833997, 1.0, 0.624723240]),
    ("w", dict(no_norm=True), [0.149459348, 0.503126914, -1.489050799, 0.314829738, 0.088756449]),
    ("w", dict(const_match=True, const_gap=True, const_mismatch=True), [3.007471864, 2.357817659, -0.671568761, 9.528960066, -0.047425873]),
    ("w", dict(sigmoid=True), [0.216903253, 0.486767295, -1.0, 1.0, 0.587368750]),
    ("w", dict(sigmoid=True, idf=True), [0.523052585, -0.155806743, -1.0, 1.0, -0.443468080]),
    ("w", dict(linear=True), [0.473888805, -0.105986932, -1.0, 1.0, -0.121034941]),
    ("l", dict(), [0.744051032, 0.226623730, 0.0, 1.333333333, 0.0]),
    ("o", dict(), [0.857142857, 0.666666667, 0.0, 1.0, 0.25]),
    ("o", dict(indel=0.5, mismatch=1.0, match=2.0), [0.947368421, 0.72, 0.0, 1.0, 0.5]),
    ("e", dict(), [0.75, 0.6, 0.0, 1.0, 0.5]),
    ("e", dict(transpositions=False), [0.75, 0.6, 0.0, 1.0, 0.0]),
    ("p", dict(), [0.945508723, 0.604892533, 0.0, 1.0, 0.429816606]),
    ("m", dict(), [1.0, 0.75, 0.0, 1.0, 0.5]),
]


def score(kind, given, pairs):
    f = {
        "w": lambda g: k.weighted_alignment(g, k.Weighted(**given)), "l": partial(k.linear_alignment, **given), "o": partial(k.optimal_alignment, **given),
        "e": partial(k.edit_similarity, **given), "p": partial(k.positional_similarity, **given), "m": k.merge_overlap,
    }[kind]
    sides = [a for a, _ in pairs], [b for _, b in pairs]
    q, c = (pa.array(s) for s in sides)
    dq, dc = (pa.array([[DF[x] for x in r] for r in s]) for s in sides)
    return k.score_lists(f, q, c, dq, dc).to_pylist()


@pytest.mark.parametrize("kind,given,want", GOLDEN)
def test_golden(kind, given, want):
    assert score(kind, given, PAIRS) == pytest.approx(want, abs=1e-8)


def plain_weighted(q, c):
    """The default weighted alignment, cell by cell."""
    w = lambda s: [1 / (i + 1) ** 0.5 * math.exp(-0.1 * DF[x]) for i, x in enumerate(s)]
    wq, wc = w(q), w(c)
    m = [[0.0] * (len(c) + 1) for _ in range(len(q) + 1)]
    for j in range(len(c)):
        m[0][j + 1] = m[0][j] - wc[j]
    for i in range(len(q)):
        m[i + 1][0] = m[i][0] - wq[i]
        for j in range(len(c)):
            s = max(wq[i], wc[j]) * math.exp(-0.3 * abs(i - j)) if q[i] == c[j] else -(wq[i] + wc[j])
            m[i + 1][j + 1] = max(m[i][j + 1] - wq[i], m[i + 1][j] - wc[j], m[i][j] + s)
    mass = sum(max(sum(a for a, x in zip(wq, q) if x == t), sum(b for b, x in zip(wc, c) if x == t)) for t in set(q) | set(c))
    return m[-1][-1] / mass


def test_random_batches_of_mixed_lengths():
    rng = random.Random(3)
    pairs = [([rng.choice(list(DF)) for _ in range(rng.randint(1, 14))], [rng.choice(list(DF)) for _ in range(rng.randint(1, 14))]) for _ in range(300)]
    assert score("w", {}, pairs) == pytest.approx([plain_weighted(*p) for p in pairs], abs=1e-9)


def test_properties():
    rng = random.Random(4)
    pairs = [([rng.choice(list(DF)) for _ in range(rng.randint(1, 9))], [rng.choice(list(DF)) for _ in range(rng.randint(1, 9))]) for _ in range(120)]
    turned = [(b, a) for a, b in pairs]
    for kind in ("w", "o", "e", "p"):
        assert score(kind, {}, pairs) == pytest.approx(score(kind, {}, turned), abs=1e-9)
        assert score(kind, {}, [(a, a) for a, _ in pairs]) == pytest.approx([1.0] * len(pairs), abs=1e-9)


def test_zero_costs_and_missing_stacks():
    assert score("o", dict(indel=0, mismatch=0, match=0), PAIRS) == [0.0] * 5
    assert score("e", dict(insert=0, delete=0, substitute=0), PAIRS) == [0.0] * 5
    assert k.score_lists(k.merge_overlap, pa.array([None, [], [1]]), pa.array([[1], [1], [1]])).to_pylist() == [None, None, 1.0]
    sliced = pa.array([[9, 9], [1, 2], None, [1]]).slice(1)
    assert k.score_lists(k.merge_overlap, sliced, pa.array([[1, 2], [1], [1]])).to_pylist() == [1.0, None, 1.0]
    with pytest.raises(ValueError):
        k.Weighted(idf=True)
    with pytest.raises(ValueError):
        k.Weighted(idf=True, linear=True)


def test_columns(spark):
    df = spark.createDataFrame([(0, list("abcd"), list("abd")), (1, list("ab"), list("ba")), (2, [], list("a")), (3, None, list("a"))], "i int, q array<string>, c array<string>")
    q, c = F.col("q"), F.col("c")
    rows = df.select("i", k.common_prefix(q, c).alias("p"), k.multiset_overlap(q, c).alias("o"), k.pair_kernel(k.optimal_alignment)(q, c).alias("n")).orderBy("i").collect()
    assert [r.p for r in rows] == [0.5, 0.0, None, None]
    assert [r.o for r in rows] == [1.0, 1.0, None, None]
    assert [r.n for r in rows] == [pytest.approx(0.857142857), pytest.approx(0.25), None, None]


def test_module_distance(spark):
    rows = [(["m", "m"], ["m", "n"], ["f", "g"], ["f", "g"]), (["m"], ["m"], ["f"], ["f"]), ([""], [""], [""], [""]), ([], ["m"], [], ["f"])]
    df = spark.createDataFrame(rows, "qm array<string>, cm array<string>, qf array<string>, cf array<string>")
    got = [r[0] for r in df.select(k.module_kernel()("qm", "cm", "qf", "cf")).collect()]
    assert got == [0.5, 0.0, 1.0, None]
    assert spark.range(1).select(k.blend(F.lit(0.0), F.lit(0.0), 0.3)).first()[0] == 0.0
