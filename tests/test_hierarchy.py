"""Fragment contraction against walking each chain."""

import random

import pytest

from stackweave.operators.hierarchy import current_links, descendants, hierarchy


def walked(parent):
    out = {}
    for node, up in parent.items():
        if up not in parent:
            continue
        path, at, x = [node], {node: 0}, node
        while x in parent and parent[x] in parent:
            x = parent[x]
            if x in at:
                out[node] = (min(path[at[x] :]), -1, [], True)
                break
            at[x] = len(path)
            path.append(x)
        else:
            out[node] = (path[-1], len(path) - 1, path[::-1], False)
    return out


def solved(spark, parent, fragment):
    df = spark.createDataFrame(list(parent.items()), "id long, parent long")
    return {r.id: (r.root_id, r.depth, list(r.path), r.on_cycle) for r in hierarchy(df, fragment).collect()}


@pytest.mark.parametrize("fragment", [100_000, 40, 7])
def test_random_forests(spark, fragment):
    rng = random.Random(fragment)
    n = 300
    parent = {i: rng.choice([None, rng.randrange(n), rng.randrange(n + 20), max(0, i - 1), max(0, i - 1)]) for i in range(n)}
    assert solved(spark, parent, fragment) == walked(parent)


@pytest.mark.parametrize("fragment", [1000, 5])
def test_chain_star_and_cycles(spark, fragment):
    parent = {i: i - 1 if i else None for i in range(120)}  # a chain
    parent |= {1000 + i: 0 for i in range(60)}  # one hot parent
    parent |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2001, 2004: 2004, 2005: 2004, 2006: 9999}
    assert solved(spark, parent, fragment) == walked(parent)


def test_empty_nulls_and_missing(spark):
    assert solved(spark, {}, 10) == {}
    assert solved(spark, {1: None, 2: 7}, 10) == {}
    df = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "id long, parent long")
    assert [(r.id, r.root_id, r.depth) for r in hierarchy(df).collect()] == [(2, 1, 1)]


def test_current_and_descendants(spark):
    rows = [(1, None, 1, 5), (2, 9, 1, 1), (2, 1, 2, 0), (2, 9, 2, -1), (3, 2, 1, 1), (3, None, None, 9), (None, 1, 1, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "bug_id long, dup_id long, ts long, delivery long, path string")
    links = current_links(df, "bug_id", "dup_id", ["ts", "delivery"])
    assert {(r.id, r.parent) for r in links.collect()} == {(1, None), (2, 1), (3, 2)}
    pairs = descendants(hierarchy(links)).collect()
    assert {(r.ancestor_id, r.id, r.distance) for r in pairs} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_long_chain_in_one_fragment_streams():
    """Paths leave a fragment in bounded batches; none of them is held longer."""
    import numpy as np
    import pyarrow as pa

    from stackweave.operators import hierarchy as h

    n = 5000
    ids = np.random.default_rng(1).permutation(n) + 1  # in no order
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids - 1), pa.array([[i] for i in ids.tolist()], pa.list_(pa.int64()))], names=["id", "exit", "path"])
    seen = 0
    for b in h._contract(iter([batch])):
        assert len(b.column(2).values) <= h._IDS + n
        for i, exit_, path in zip(b.column(0).to_pylist()[::97], b.column(1).to_pylist()[::97], b.column(2)[::97]):
            assert exit_ == 0 and path.values.to_numpy().tolist() == list(range(1, i + 1))
        seen += b.num_rows
    assert seen == n
