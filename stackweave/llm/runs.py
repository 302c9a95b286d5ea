"""Runs of identical or near-identical consecutive events, by adjacent agglomeration.

In each entity the neighbouring runs that are most alike merge first: a linked list of runs and a priority
queue of the borders between neighbours, until none is alike enough and near enough. The likeness of two runs is
the number of words that all their events share over the number of words any of them has; merging never makes a
run more alike to a third, so a merge that beats both borders beside it is right whatever happens farther away.
That is what lets an entity be cut into blocks of positions, so that no task holds an unbounded one: a block makes
every merge that its own events decide and leaves open only the runs whose fate hangs on the next block. Those
are few, for equal likenesses are ordered by a hash of the place and so do not wait in line, and
a second queue settles them across the blocks. The result is that of one queue over the whole entity.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Positions of one block, and how far before position 0 a block begins: 0, where most sequences start, is no border.
BLOCK, BEFORE = 4096, 1000
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SCHEMA = (
    "entity long, part long, term string, first long, last long, n long, open boolean, starts boolean, ends boolean, linked boolean, "
    "names array<struct<term:string,n:long,first:long>>"
)
_NAMES = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), _NAMES]
_COLUMNS = ["entity", "part", "term", "first", "last", "n", "open", "starts", "ends", "linked", "names"]

#: Number and first position of each term of a run.
Names = dict[str, tuple[int, int]]


@lru_cache(200_000)
def words_of(term: str) -> frozenset[str]:
    """The words of a term in lower case; a term without letters and digits is its own word."""
    return frozenset(w.lower() for w in _WORD.findall(term)) or frozenset([term])


def _whole(term: str) -> frozenset[str]:
    return frozenset([term])


def likeness(a: str, b: str) -> float:
    """The share of common words among all words of both."""
    x, y = words_of(a), words_of(b)
    return len(x & y) / len(x | y)


def _mix(place: int) -> int:
    """A hash of a place, by which equal likenesses are ordered."""
    x = (place * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = (x * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)


def name_of(names: Names) -> str:
    """The most frequent term of a run, of equally frequent ones the earliest."""
    return min(names, key=lambda t: (-names[t][0], names[t][1]))


def agglomerate(
    names: list[Names], first: list[int], last: list[int], least: float, gap: int, left: bool = False, right: bool = False
) -> list[tuple[Names, int, int, bool, bool]]:
    """Merges neighbouring runs; rows (names, first, last, open, linked to the row before).

    ``left`` and ``right`` tell that more runs may precede the first and follow the last. Runs whose merging depends on those come
    out open: a merge is made only if it is no worse than any that an unknown neighbour could make before it. Two runs
    merge if they are alike by ``least`` and the second begins at most ``gap`` after the end of the first. Runs of likeness 1 merge
    whether open or not: that changes no words, and no neighbour can come before it and undo it.
    """
    n = len(first)
    split = _whole if least >= 1 else words_of
    common, every = [], []
    for m in names:
        sets = [split(t) for t in m]
        common.append(frozenset.intersection(*sets))
        every.append(frozenset.union(*sets))
    names, last = list(names), list(last)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    version, alive, is_open = [0] * n, [True] * n, [False] * n
    if n:
        is_open[0], is_open[-1] = left, right or (left and n == 1)
    queue: list[tuple[float, int, int, int, int, int]] = []
    tied: set[int] = set()

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and first[j] - last[i] <= gap:
            s = len(common[i] & common[j]) / len(every[i] | every[j])
            if s >= least:
                heapq.heappush(queue, (-s, _mix(first[j]), i, j, version[i], version[j]))

    for i in range(n):
        offer(i)
    while queue:
        unlike, _, i, j, vi, vj = heapq.heappop(queue)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        if unlike > -1 and (is_open[i] or is_open[j]):
            is_open[i] = is_open[j] = True
            tied.add(j)
            continue
        merged = dict(names[i])
        for t, (k, f) in names[j].items():
            have = merged.get(t)
            merged[t] = (k + have[0], have[1]) if have else (k, f)
        names[i], last[i], after[i] = merged, last[j], after[j]
        common[i], every[i] = common[i] & common[j], every[i] | every[j]
        alive[j], is_open[i] = False, is_open[i] or is_open[j]
        if after[j] >= 0:
            before[after[j]] = i
        version[i] += 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(names[i], first[i], last[i], is_open[i], i in tied) for i in range(n) if alive[i]]


def _collapser(least: float, gap: int, shortest: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (entity, part, position, term) in order to settled and open runs."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        entity, part, position = (t.column(i).to_numpy() for i in (0, 1, 2))
        coded = t.column(3).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code, terms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        same = np.zeros(len(entity), bool)
        same[1:] = (entity[1:] == entity[:-1]) & (part[1:] == part[:-1]) & ((position[1:] + BEFORE) // block == (position[:-1] + BEFORE) // block)
        copy = same.copy()
        copy[1:] &= position[1:] == position[:-1]
        if copy.any():
            entity, part, position, code, same = (x[~copy] for x in (entity, part, position, code, same))
        # Each event is a run of its own to the queue. A border of two events less alike than least never enters it, so sequences are cut there.
        linked = same.copy()
        linked[1:] &= position[1:] - position[:-1] <= gap
        if least >= 1:
            linked[1:] &= code[1:] == code[:-1]
        elif linked.any():
            where = np.flatnonzero(linked)
            pairs, back = np.unique(np.stack([code[where - 1], code[where]]), axis=1, return_inverse=True)
            alike = np.array([likeness(terms[int(a)].as_py(), terms[int(b)].as_py()) >= least for a, b in pairs.T], bool)
            linked[where] = alike[back.reshape(-1)]
        place = (position + BEFORE) % block
        starts = ~same & (place < gap)
        ends = np.append(~same[1:], True) & (place >= block - gap)
        heads = np.flatnonzero(~linked)
        tails = np.append(heads[1:], len(entity))
        alone = (tails - heads == 1) & ~starts[heads] & ~ends[tails - 1]
        plain = heads[alone]
        if shortest <= 1 and len(plain):
            no = pa.array(np.zeros(len(plain), bool))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entity[plain]), pa.array(part[plain]), terms.take(pa.array(code[plain])), pa.array(position[plain]), pa.array(position[plain]),
                    pa.array(np.ones(len(plain), np.int64)), no, no, no, no, pa.nulls(len(plain), _NAMES),
                ], names=_COLUMNS,
            )
        out, spelled = [], terms.to_pylist()
        for s, e in zip(heads[~alone].tolist(), tails[~alone].tolist()):
            at = position[s:e].tolist()
            given = [{spelled[c]: (1, f)} for c, f in zip(code[s:e].tolist(), at)]
            rows = agglomerate(given, at, at, least, gap, bool(starts[s]), bool(ends[e - 1]))
            for k, (names, f, l, is_open, tie) in enumerate(rows):
                total = sum(c for c, _ in names.values())
                if is_open or total >= shortest:
                    carried = [{"term": w, "n": c, "first": g} for w, (c, g) in names.items()] if is_open else None
                    edge = bool(starts[s]) and k == 0, bool(ends[e - 1]) and k == len(rows) - 1
                    out.append((int(entity[s]), int(part[s]), name_of(names), f, l, total, is_open, *edge, tie, carried))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < 2 * block:
                continue
            entity, part, position = (rest.column(i).to_numpy() for i in range(3))
            number = (position + BEFORE) // block
            change = (entity[1:] != entity[:-1]) | (part[1:] != part[:-1]) | (number[1:] != number[:-1])
            cut = np.flatnonzero(change)
            if len(cut):
                k = int(cut[-1]) + 1
                yield from work(rest.slice(0, k))
                rest = rest.slice(k)
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return run


def _joiner(least: float, gap: int, shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Open runs in order to settled ones: each stretch of neighbours, within a block or over its border, is merged by the queue."""

    def settle(held: list[dict]) -> Iterator[tuple]:
        names = [{x["term"]: (x["n"], x["first"]) for x in r["names"]} for r in held]
        for m, f, l, _, _ in agglomerate(names, [r["first"] for r in held], [r["last"] for r in held], least, gap):
            total = sum(c for c, _ in m.values())
            if total >= shortest:
                yield held[0]["entity"], held[0]["part"], name_of(m), f, l, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                follows = held and held[-1]["entity"] == r["entity"] and held[-1]["part"] == r["part"] and (r["linked"] or held[-1]["ends"] and r["starts"])
                if held and not follows:
                    out.extend(settle(held))
                    held = []
                held.append(r)
            if out:
                yield _batch(out)
        if held and (out := list(settle(held))):
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_COLUMNS[:6])

    return run


def collapse_runs(
    rows: DataFrame, entity: str, part: str, position: str, term: str, least: float = 1.0, gap: int = 1, shortest: int = 2, block: int = BLOCK
) -> DataFrame:
    """``entity, part, term, first, last, n`` of each run of ``shortest`` or more events.

    ``entity``, ``part`` and ``position`` are integers that together are unique but for copies, which count once; rows with a null
    in one of the four columns are no events. Neighbouring runs merge, the most alike first, if their likeness is ``least`` or more and the next begins at most
    ``gap`` after the end of the other; with ``least`` 1 only equal terms do. A run has the name of its most frequent term, of equally frequent ones the
    earliest. The result does not depend on ``block``.
    """
    named = rows.select(
        F.col(entity).cast("long").alias("entity"), F.col(part).cast("long").alias("part"), F.col(position).cast("long").alias("position"), F.col(term).alias("term")
    ).dropna()
    spread = named.repartition("entity", "part", F.floor((F.col("position") + BEFORE) / block)).sortWithinPartitions("entity", "part", "position")
    runs = materialize(spread.mapInArrow(_collapser(least, gap, shortest, block), _SCHEMA), "runs")
    # A few rows a block of a sequence that goes over blocks; they pass through as a stream, only one stretch of neighbours is held.
    edge = runs.where("open").repartition("entity", "part").sortWithinPartitions("entity", "part", "first")
    joined = edge.mapInArrow(_joiner(least, gap, shortest), "entity long, part long, term string, first long, last long, n long")
    return runs.where(~F.col("open")).select(*joined.columns).unionByName(joined)
