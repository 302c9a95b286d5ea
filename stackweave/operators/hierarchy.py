"""Parent-child links to full hierarchies by fragment contraction.

Every partition follows the parent chains it holds to the place where they leave it (the
fragment's exit), to a root, or round a cycle. Only nodes that some other fragment exits to form
the quotient forest; it is written, solved the same way, and its paths extend those of the fragments.
A quotient that stops shrinking is solved by pointer doubling instead, which needs a number of
rounds that is logarithmic in the depth.

Tables of links are never broadcast, for they grow with the data and their paths with the depth.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import join_unique
from ..session import materialize

_log = logging.getLogger(__name__)
#: Nodes that one task contracts at a time.
FRAGMENT_NODES = 100_000
#: Levels of contraction before pointer doubling takes over.
MAX_LEVELS = 4

#: Rows, and ids in their paths, of one batch that leaves a fragment.
_ROWS, _IDS = 20_000, 2_000_000
_CONTRACTED = "id long, exit long, path array<long>, cycle long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, exit, path): each link becomes the chain up to the fragment's exit.

    ``path`` runs from the node below the exit down to the id. ``cycle`` is the smallest id
    of a cycle that lies within the fragment, for nodes on it or below it. Only links are held; where chains end is told by doubling
    steps, and paths are written one after the other in the order of a walk down the trees, so that each goes on from its parent's.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column(0).to_numpy()
    table = table.take(pa.array(np.argsort(ids, kind="stable")))
    ids, exits = table.column(0).to_numpy(), table.column(1).to_numpy()
    segments = table.column(2).combine_chunks()
    starts = segments.offsets.to_numpy().astype(np.int64)
    own, size, n = segments.values.to_numpy(), np.diff(starts), len(ids)
    at = np.minimum(np.searchsorted(ids, exits), n - 1)
    up = np.where(ids[at] == exits, at, -1)
    # Doubling: the last node inside, the length of the path, and the smallest id of as many steps.
    rounds = int(n).bit_length() + 1
    jump, length, step = np.where(up < 0, np.arange(n), up), np.where(up < 0, 0, size), np.where(up < 0, np.arange(n), up)
    least = np.minimum.reduceat(own, starts[:-1])
    for _ in range(rounds):
        length = length + length[jump]
        jump = jump[jump]
    looped = up[jump] >= 0
    if looped.any():
        for _ in range(rounds):
            least = np.minimum(least, least[step])
            step = step[step]
    length = np.where(looped, 0, length + size[jump])
    ring = np.flatnonzero(looped)
    for k in range(0, len(ring), _ROWS):
        part = ring[k : k + _ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[part]), pa.nulls(len(part), pa.int64()), pa.array([[]] * len(part), pa.list_(pa.int64())), pa.array(least[jump[part]])], names=["id", "exit", "path", "cycle"]
        )
    # Children of one parent follow each other.
    order = np.argsort(up, kind="stable")
    first = np.searchsorted(up[order], np.arange(-1, n + 1))
    order, first, up_, jump_, length_ = order.tolist(), first.tolist(), up.tolist(), jump.tolist(), length.tolist()
    path = np.empty(int(length.max(initial=0)), np.int64)
    rows: list[int] = []
    paths: list[np.ndarray] = []
    total = 0

    def made() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(paths)))
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(exits[jump[rows]]), lists, pa.nulls(len(rows), pa.int64())], names=["id", "exit", "path", "cycle"])

    stack = [i for i in order[first[0] : first[1]]]
    while stack:
        i = stack.pop()
        begin = length_[up_[i]] if up_[i] >= 0 else 0
        path[begin : length_[i]] = own[starts[i] : starts[i + 1]]
        rows.append(i)
        paths.append(path[: length_[i]].copy())
        total += length_[i]
        stack.extend(order[first[i + 1] : first[i + 2]])
        if len(rows) >= _ROWS or total >= _IDS:
            yield made()
            rows, paths, total = [], [], 0
    if rows:
        yield made()


def _double(links: DataFrame) -> DataFrame:
    """Solves (id, exit, path) by pointer doubling: (id, exit, path, cycle), exit being no id of ``links``."""
    state = materialize(links.select("id", "exit", "path", F.lit(None).cast("long").alias("cycle"), F.lit(True).alias("open")), "double")
    while True:
        up = state.groupBy(F.col("exit").alias("id")).agg(F.count("*").alias("n"))
        up = state.join(up.hint("merge"), "id").select(
            F.col("id").alias("exit"), F.col("exit").alias("up_exit"), F.col("path").alias("up_path"), F.col("cycle").alias("up_cycle"), "n"
        )
        up = materialize(up, "double-up")
        both = join_unique(state, up, ["exit"], "n", ["id"], "left", merge=True)
        met = F.col("up_exit").isNotNull() | F.col("up_cycle").isNotNull()
        path = F.when(F.col("up_exit").isNotNull(), F.concat("up_path", "path")).otherwise(F.col("path"))
        step = both.select(
            "id",
            F.when(met, F.col("up_exit")).otherwise(F.col("exit")).alias("exit"),
            path.alias("path"),
            F.coalesce("cycle", "up_cycle").alias("cycle"),
            met.alias("open"),
        )
        # The chain met its own exit: the part of the path above that place is the cycle.
        ring = F.array_contains("path", F.col("exit"))
        least = F.array_min(F.slice("path", 1, F.array_position("path", F.col("exit")).cast("int")))
        step = step.withColumn("cycle", F.coalesce(F.col("cycle"), F.when(ring, least)))
        closed = F.col("cycle").isNotNull()
        step = step.select(
            "id", F.when(~closed, F.col("exit")).alias("exit"), F.when(closed, F.array().cast("array<long>")).otherwise(F.col("path")).alias("path"), "cycle",
            (F.col("open") & ~closed).alias("open"),
        )
        state = materialize(step, "double")
        if state.where("open").isEmpty():
            return state.drop("open")


def _solve(links: DataFrame, count: int, fragment: int, level: int) -> DataFrame:
    """(id, exit, path, cycle) of links (id, exit, path) whose exits may be ids of ``links``; result exits are not.

    Fragments are ranges of ids, for links mostly lead to nodes of about the same time; at each level fewer nodes are left, so the ranges grow.
    """
    parts = max(1, -(-count // fragment))
    contracted = links.select("id", "exit", "path").repartitionByRange(parts, "id").mapInArrow(_contract, _CONTRACTED)
    if parts == 1:
        return materialize(contracted, "forest")
    contracted = materialize(contracted, "contracted")
    exits = contracted.where(F.col("exit").isNotNull()).groupBy(F.col("exit").alias("id")).agg(F.count("*").alias("n"))
    quotient = materialize(contracted.join(exits.hint("merge"), "id"), "quotient")
    left = quotient.count()
    _log.info("level %d: %d of %d nodes are left after contraction in %d fragments", level, left, count, parts)
    if left == 0:
        return contracted
    open_links = quotient.where(F.col("exit").isNotNull()).select("id", "exit", "path")
    closed = quotient.where(F.col("exit").isNull()).select("id", "exit", "path", "cycle")
    if level + 1 >= MAX_LEVELS or (left > fragment and left * 2 > count):
        solved = _double(open_links)
    else:
        solved = _solve(open_links, left, fragment, level + 1)
    # A chain may end in a node whose cycle was closed one level below.
    known = closed.select(F.col("id").alias("exit"), F.col("cycle").alias("closed_cycle"))
    solved = solved.join(known.hint("merge"), "exit", "left").select(
        "id", F.when(F.col("closed_cycle").isNull(), F.col("exit")).alias("exit"), "path", F.coalesce("cycle", "closed_cycle").alias("cycle")
    ).unionByName(closed)
    found = solved.join(quotient.select("id", "n").hint("merge"), "id").select(
        F.col("id").alias("exit"), F.col("exit").alias("top_exit"), F.col("path").alias("top_path"), F.col("cycle").alias("top_cycle"), "n"
    )
    found = materialize(found, "solved")
    both = join_unique(contracted, found, ["exit"], "n", ["id"], "left", merge=True)
    met = F.col("top_exit").isNotNull()
    cycle = F.coalesce("cycle", "top_cycle")
    return materialize(
        both.select(
            "id",
            F.when(cycle.isNull(), F.coalesce("top_exit", "exit")).alias("exit"),
            F.when(cycle.isNotNull(), F.array().cast("array<long>")).when(met, F.concat("top_path", "path")).otherwise(F.col("path")).alias("path"),
            cycle.alias("cycle"),
        ),
        "expanded",
    )


def current_links(rows: DataFrame, node: str, parent: str, order: list[str]) -> DataFrame:
    """``(id, parent)`` of each node's row that is last by ``order``; rows without a node are dropped, null orders come first."""
    kept = rows.where(F.col(node).isNotNull())
    latest = F.max_by(F.struct(F.col(parent).alias("p")), F.struct(*order))
    return kept.groupBy(F.col(node).alias("id")).agg(latest.alias("last")).select("id", F.col("last.p").cast("long").alias("parent"))


def hierarchy(links: DataFrame, fragment: int = FRAGMENT_NODES) -> DataFrame:
    """Full hierarchy of ``links`` (id unique, parent), one row per node whose parent is an id too.

    Columns: ``id``, ``root_id``, ``depth`` (root 0), ``path`` (ids from the root to the node) and
    ``on_cycle``. Nodes on a cycle, or below one, have the cycle's smallest id as root, depth -1
    and an empty path; a node that names itself is such a cycle. Null parents and parents that
    are no id count as none. Empty input gives an empty result. Extra columns are ignored.
    """
    links = materialize(links.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent")).where("id is not null"), "links")
    named = links.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    known = materialize(named.join(links.select(F.col("id").alias("parent")).hint("merge"), "parent").withColumn("there", F.lit(True)), "parents")
    edges = join_unique(links.where("parent is not null"), known, ["parent"], "n", ["id"], merge=True)
    edges = materialize(edges.select("id", F.col("parent").alias("exit"), F.array("id").alias("path")), "edges")
    solved = _solve(edges, edges.count(), fragment, 0)
    return solved.select(
        "id",
        F.coalesce("cycle", "exit").alias("root_id"),
        F.when(F.col("cycle").isNull(), F.size("path")).otherwise(-1).cast("int").alias("depth"),
        F.when(F.col("cycle").isNull(), F.concat(F.array("exit"), "path")).otherwise(F.array().cast("array<long>")).alias("path"),
        F.col("cycle").isNotNull().alias("on_cycle"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor_id, id, distance)`` for every node of ``hierarchy`` and every ancestor on its path; none for cycles."""
    return (
        tree.select("id", "depth", F.posexplode("path").alias("level", "ancestor_id"))
        .where(F.col("level") < F.col("depth"))
        .select("ancestor_id", "id", (F.col("depth") - F.col("level")).cast("int").alias("distance"))
    )
