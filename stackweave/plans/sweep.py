"""Parts of the ranked lists without the lists: places of the right bucket, and the first few of each list.

Candidates are dealt into chunks by their bucket, each query meets each chunk in one task, and there a few array operations go over all candidates of the chunk. Which of them
score as high as the right one is told by bounds from common tokens; only where these leave it open is the kernel run. No pair is written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators.pairs import NO_STACK
from ..session import materialize

#: Candidates' stacks a chunk, and undecided pairs that are scored at a time.
CHUNK, PENDING = 50_000, 20_000
#: A bucket with so many more candidates than the fourth part of a chunk is dealt out.
LARGE = 100
_EVEN = 1e-9


def chunks_of(rows: DataFrame) -> int:
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // CHUNK)


def meet(rows: DataFrame, asked: DataFrame, chunks: int, by: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` over each chunk of ``rows``, dealt by ``by``, with all of ``asked``; chunks may be empty of rows."""
    left = rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    right = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "chunk")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(f, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column; null lists are empty."""
    column = table.column(name).combine_chunks()
    values, starts, length = kernels.lists(column)
    return values.to_numpy(zero_copy_only=False), starts, length


def _flat(starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, place in the values) of every token."""
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, at, np.repeat(starts, length) + at


@dataclass
class Stacks:
    """Stacks as codes of their tokens: ``row``, ``at`` and ``code`` of each token, rows in order; ``tokens`` are the codes' tokens, sorted."""

    size: int
    row: np.ndarray
    at: np.ndarray
    code: np.ndarray
    starts: np.ndarray
    length: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def of(values: np.ndarray, starts: np.ndarray, length: np.ndarray) -> "Stacks":
        row, at, place = _flat(starts, length)
        tokens, code = np.unique(values[place], return_inverse=True)
        return Stacks(len(length), row, at, code, np.cumsum(length) - length, length, tokens)

    def trimmed(self, kept: np.ndarray) -> "Stacks":
        """From the first to the last token whose code is kept."""
        good = np.flatnonzero(kept[self.code])
        first, last = np.full(self.size, len(self.row)), np.full(self.size, -1)
        np.minimum.at(first, self.row[good], good)
        np.maximum.at(last, self.row[good], good)
        length = np.maximum(last - first + 1, 0)
        inside = np.arange(len(self.row))
        inside = (inside >= first[self.row]) & (inside <= last[self.row])
        starts = np.cumsum(length) - length
        row = self.row[inside]
        return Stacks(self.size, row, np.arange(len(row)) - starts[row], self.code[inside], starts, length, self.tokens)

    def postings(self) -> None:
        order = np.argsort(self.code, kind="stable")
        self.p_row, self.p_at = self.row[order], self.at[order]
        self.p_start = np.searchsorted(self.code[order], np.arange(len(self.tokens) + 1))

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Codes of other tokens; those that no stack here has get codes of their own."""
        place = np.minimum(np.searchsorted(self.tokens, tokens), max(len(self.tokens) - 1, 0))
        found = self.tokens[place] == tokens if len(self.tokens) else np.zeros(len(tokens), bool)
        _, other = np.unique(tokens, return_inverse=True)
        return np.where(found, place, len(self.tokens) + other)

    def matches(self, codes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in ``codes``, place in the row) of all pairs of equal tokens in live rows."""
        at = [(i, self.p_start[c], self.p_start[c + 1]) for i, c in enumerate(codes.tolist()) if c < len(self.tokens)]
        if not at:
            return (np.empty(0, np.int64),) * 3
        row = np.concatenate([self.p_row[s:e] for _, s, e in at])
        j = np.concatenate([self.p_at[s:e] for _, s, e in at])
        i = np.repeat([i for i, _, _ in at], [e - s for _, s, e in at])
        keep = live[row]
        return row[keep], i[keep], j[keep]


def prefix_scores(stacks: Stacks, codes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the live rows that begin as ``codes`` do."""
    rows = np.empty(0, np.int64)
    if len(codes) and codes[0] < len(stacks.tokens):
        s, e = stacks.p_start[codes[0]], stacks.p_start[codes[0] + 1]
        rows = stacks.p_row[s:e][stacks.p_at[s:e] == 0]
        rows = rows[live[rows]]
    common = np.ones(len(rows), np.int64)
    at = np.arange(len(rows))
    for k in range(1, len(codes)):
        at = at[stacks.length[rows[at]] > k]
        at = at[stacks.code[stacks.starts[rows[at]] + k] == codes[k]]
        if not len(at):
            break
        common[at] += 1
    return rows, common / np.maximum(len(codes), stacks.length[rows])


class _Chunk:
    """Candidates of a chunk: one row for each stack, or one without tokens, and each stretch in which it is a candidate."""

    def __init__(self, table: pa.Table) -> None:
        self.cand, self.begin, self.end = _numbers(table, "cand_id"), _numbers(table, "begin"), _numbers(table, "end")
        self.buckets, self.bucket = np.unique(_numbers(table, "bucket"), return_inverse=True)
        self.all = Stacks.of(*_lists_of(table, "tokens"))

    def live(self, place: int) -> np.ndarray:
        return (self.begin <= place) & (place < self.end)


def _queries(table: pa.Table, order: str) -> Iterator[tuple[dict, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each query with the (tokens, percentages) of its stacks, by ``order``."""
    table = table.sort_by([(order, "ascending"), ("query_id", "ascending")])
    values, starts, length = _lists_of(table, "tokens")
    percent, p_starts, _ = _lists_of(table, "percent") if "percent" in table.column_names else (None, starts, None)
    columns = [c for c in table.column_names if c not in ("tokens", "percent", "chunk")]
    given = table.select(columns).to_pylist()
    k = 0
    while k < len(given):
        mine, stacks = given[k], []
        while k < len(given) and given[k]["query_id"] == mine["query_id"]:
            if length[k]:
                s, p, n = starts[k], p_starts[k], length[k]
                stacks.append((values[s : s + n], percent[p : p + n] if percent is not None else np.empty(0)))
            k += 1
        yield mine, stacks


FIRST = "query_id long, cand_id long, score double"


def first_of_chunk(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``n`` best candidates of each query by (prefix score, id) in the chunk, a report once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # Larger ids first, so the first rows of any kind are its best.
        chunk = _Chunk(left.sort_by([("cand_id", "descending")]))
        chunk.all.postings()
        stacked = chunk.all.length > 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, stacks in _queries(right, "place"):
            live = chunk.live(q["place"]) & (chunk.cand != q["query_id"])
            best: dict[int, float] = {}
            for tokens, _ in stacks:
                rows, score = prefix_scores(chunk.all, chunk.all.codes(tokens), live)
                # The first n different reports are among the rows with the best n x (rows of a report) scores, so rows go in order until n reports are there.
                for r in _in_order(-score, rows, 4 * n):
                    seen: set[int] = set()
                    for k in r:
                        c = int(chunk.cand[rows[k]])
                        best[c] = max(best.get(c, 0.0), float(score[k]))
                        seen.add(c)
                    if len(seen) >= n or len(r) == len(rows):
                        break
            for score, kind in ((0.0, live & stacked if stacks else None), (NO_STACK, live if not stacks else live & ~stacked)):
                if kind is None or len(best) >= n:
                    continue
                for r in np.flatnonzero(kind):
                    best.setdefault(int(chunk.cand[r]), score)
                    if len(best) >= n:
                        break
            first = sorted(best.items(), key=lambda x: (-x[1], -x[0]))[:n]
            if first:
                out.append((np.full(len(first), q["query_id"]), np.array([c for c, _ in first], np.int64), np.array([s for _, s in first])))
        return _table(["query_id", "cand_id", "score"], out, [pa.int64(), pa.int64(), pa.float64()])

    return run


def _in_order(key: np.ndarray, rows: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Places of the smallest ``least`` keys in order, then of twice as many, and so on; equal ones by row."""
    while True:
        if least >= len(rows):
            yield np.lexsort((rows, key))
            return
        # All that are as good as the last one, for ties go by row.
        cut = np.flatnonzero(key <= np.partition(key, least)[least])
        yield cut[np.lexsort((rows[cut], key[cut]))]
        least *= 4


def _table(names: list[str], parts: list[tuple], types: list[pa.DataType]) -> pa.Table:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(len(names))]
    return pa.table({n: pa.array(c, t, from_pandas=True) if parts else pa.array([], t) for n, c, t in zip(names, columns, types)})


def rows_of(found: DataFrame, stacks: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``cand_id, bucket, begin, end, tokens``: intervals with the stacks of their report, hashed, or without."""
    coded = stacks.select(F.col("bug_id").alias("cand_id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), *(more or []))
    return found.join(coded, "cand_id", "left")


def first_by_prefix(asked: DataFrame, found: DataFrame, stacks: DataFrame, n: int) -> DataFrame:
    """``query_id, cand_id, score``: of each chunk the first ``n`` of each query by common prefix, so the first ``n`` of all are among them."""
    rows = materialize(rows_of(found, stacks), "candidate-stacks")
    own = stacks.select(F.col("bug_id").alias("query_id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    return meet(rows, asked.select("query_id", "place").join(own, "query_id", "left"), chunks_of(rows), ["cand_id"], first_of_chunk(n), FIRST)


@dataclass(frozen=True)
class Bounds:
    """How a kernel's score is bounded by the pairs of equal tokens.

    ``value(i, j, ...)`` is what a pair of equal tokens adds at most, ``off(delta, m, n)`` what is lost where all pairs of one diagonal are aligned, and ``score`` makes
    a score of a sum. The score of stacks is at most that of the sum over all pairs of equal tokens, and at least that of the best diagonal.
    ``exact``: scores are fractions of integers, so equal ones are equal numbers.
    """

    value: Callable[..., np.ndarray]
    off: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    score: Callable[..., np.ndarray]
    exact: bool = False


def _within(delta: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """0 on diagonals that both stacks' ends allow, else what no sum makes up for."""
    return np.where((delta >= np.minimum(0, n - m)) & (delta <= np.maximum(0, n - m)), 0.0, -1e18)


def bounds_of(method: str, params: dict) -> Bounds | None:
    """None for methods and parameters without bounds."""
    if method == "edit" and not params:
        return Bounds(lambda i, j, *_: np.ones(len(i)), _within, lambda x, m, n, *_: np.clip(x, 0, np.minimum(m, n)) / np.maximum(m, n), True)
    if method == "alignment" and not params:
        return Bounds(lambda i, j, *_: np.ones(len(i)), _within, lambda x, m, n, *_: 2 * np.clip(x, 0, np.minimum(m, n)) / (m + n), True)
    if method == "positional":
        c, o = params.get("c", 0.1), params.get("o", 0.2)
        if c < 0 or o < 0:
            return None
        full = np.concatenate([[0.0], np.cumsum(np.exp(-c * np.arange(1000.0)))])
        return Bounds(lambda i, j, *_: np.exp(-c * np.minimum(i, j) - o * np.abs(i - j)), lambda d, m, n: np.zeros(len(d)), lambda x, m, n, *_: np.maximum(x, 0) / full[np.minimum(np.minimum(m, n), 1000)])
    if method == "linear" and not params:
        value = lambda i, j, m, wq, wc: wq[i] * np.exp(-np.abs(i - j) / 2)
        off = lambda d, m, n: -0.5 * (np.abs(d) + np.abs(n - m - d) - np.abs(n - m))
        return Bounds(value, off, lambda x, m, n, *_: np.maximum(x, 0) - 0.5 * np.abs(m - n))
    if method == "weighted" and not params:
        value = lambda i, j, m, wq, wc: np.maximum(wq[i], wc) * np.exp(-0.3 * np.abs(i - j)) + wq[i] + wc
        return Bounds(value, lambda d, m, n: np.zeros(len(d)), lambda x, m, n, whole, mass: (np.maximum(x, 0) - whole) / mass)
    return None


class _Frequencies:
    """Percentages of a chunk's tokens as queries are added one by one."""

    def __init__(self, stacks: Stacks, counts: np.ndarray, added: kernels.Added | None, trim: float | None, fixed: float | None) -> None:
        self.stacks, self.trim, self.fixed = stacks, trim, fixed
        self.count = np.zeros(len(stacks.tokens))
        self.count[stacks.code] = counts
        self.known = self.count == kernels.FIXED
        self.token = self.number = np.empty(0, np.int64)
        self.upto = 0
        if added is not None and len(stacks.tokens):
            held = added.tokens.to_numpy(zero_copy_only=False)
            place, number = added.keys // added.span, added.keys % added.span
            code = stacks.codes(held)[place]
            mine = np.flatnonzero(code < len(stacks.tokens))
            mine = mine[np.argsort(number[mine], kind="stable")]
            self.token, self.number = code[mine], number[mine]

    def at(self, number: int, total: float) -> np.ndarray:
        upto = int(np.searchsorted(self.number, number, side="right"))
        new = self.token[self.upto : upto]
        np.add.at(self.count, new[~self.known[new]], 1.0)
        self.upto = upto
        percent = self.count / total * 100.0
        return np.where(self.known, self.fixed, percent) if self.fixed is not None else percent

    def kept(self, percent: np.ndarray) -> np.ndarray:
        kept = np.ones(len(percent), bool) if self.trim is None else percent <= self.trim
        return kept | self.known if self.fixed is not None else kept


COUNTED = "query_id long, bucket long, n long, found boolean"
#: By how much percentages may drift before a chunk's weights are worked out anew.
_DRIFT = 0.02


def counted_in_chunk(
    method: str, params: dict, kernel: Callable, weighted: bool, split: frozenset[int], added: Callable[[], kernels.Added] | None, trim: float | None, fixed: float | None, plain: bool = False
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """How many of the chunk's buckets (``plain``: candidates) have a candidate that is as good as ``hit`` and ``hit_cand`` or better, and whether the query has any candidate.

    Buckets in ``split`` lie in several chunks, so they come out by themselves.
    """
    bounds = bounds_of(method, params)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, ids, buckets, counts, any_ = _Chunk(left), [], [], [], []
        apart = np.isin(chunk.buckets, np.array(sorted(split), np.int64)) if split else np.zeros(len(chunk.buckets), bool)
        rows = len(chunk.cand)
        frequencies = None
        if trim is not None or weighted:
            values, starts, length = _lists_of(left, "counts")
            frequencies = _Frequencies(chunk.all, values[_flat(starts, length)[2]], added() if added else None, trim, fixed)
        stacks, kept, base = None, None, None
        margin, waiting = _EVEN, _Waiting(kernel, weighted)
        unit = np.unique(chunk.cand, return_inverse=True)[1] if plain else chunk.bucket
        flags = np.zeros(int(unit.max(initial=-1)) + 1, bool)
        for q, own in _queries(right, "number"):
            live = chunk.live(q["place"]) & (chunk.cand != q["query_id"])
            if not live.any():
                continue
            ids.append(q["query_id"]), buckets.append(-1), counts.append(0), any_.append(True)
            if q["hit"] is None:
                continue
            flags[:] = False
            percent = frequencies.at(q["number"], float(q["total"])) if frequencies else None
            good = frequencies.kept(percent) if frequencies else None
            if stacks is None or frequencies and not np.array_equal(good, kept):
                stacks, kept, base = chunk.all.trimmed(good) if frequencies and trim is not None else chunk.all, good, None
                stacks.postings()
                n_of = stacks.length
            if method == "weighted" and (base is None or np.abs(percent - base).max(initial=0) > _DRIFT):
                base, token_weight = percent, np.exp(-0.1 * percent)
                row_weight = token_weight[stacks.code] / np.sqrt(stacks.at + 1.0)
                whole_c = np.bincount(stacks.row, row_weight, rows)
                repeats = np.zeros(rows, bool)
                seen = np.sort(stacks.row * (len(stacks.tokens) + 1) + stacks.code)
                repeats[seen[1:][seen[1:] == seen[:-1]] // (len(stacks.tokens) + 1)] = True
            hit, hit_cand = q["hit"], q["hit_cand"]
            better = chunk.cand >= hit_cand
            stacked = n_of > 0
            if hit == NO_STACK:
                # All with a score are better, the others go by their ids.
                flags[unit[live & (better | (stacked if own else False))]] = True
            for tokens, share in own if hit != NO_STACK else []:
                codes = stacks.codes(tokens)
                able = live & stacked
                if method == "prefix":
                    at, score = prefix_scores(stacks, codes, able)
                    flags[unit[at[(score > hit) | (score == hit) & better[at]]]] = True
                    if hit == 0:
                        flags[unit[able & better]] = True
                    continue
                m = len(codes)
                r, i, j = stacks.matches(codes, able)
                if method == "weighted":
                    wq = np.exp(-0.1 * share) / np.sqrt(np.arange(m) + 1.0)
                    wc = token_weight[codes[i]] / np.sqrt(j + 1.0)
                    margin = _EVEN + 8 * 0.1 * _DRIFT
                    common = np.bincount(r, np.minimum(wq[i], wc), rows)
                    whole = wq.sum() + whole_c
                    low_mass = np.maximum(whole - common, 1e-300)
                    high_mass = np.where(repeats | (len(np.unique(codes)) < m), whole, low_mass)
                else:
                    wq = (1 - share / 100) * (1 - np.arange(m) / m) if method == "linear" else None
                    wc = None
                value = bounds.value(i, j, m, wq, wc)
                summed = np.bincount(r, value, rows)

                def bound(x: np.ndarray, at: np.ndarray, upper: bool) -> np.ndarray:
                    if method != "weighted":
                        return bounds.score(x, m, n_of[at])
                    positive = x > whole[at]
                    return bounds.score(x, m, n_of[at], whole[at], np.where(positive == upper, low_mass[at], high_mass[at]))

                at = np.flatnonzero(able)
                most = bound(summed[at], at, True)
                possible = most >= hit - margin
                if bounds.exact:
                    possible &= better[at] | (most > hit + margin)
                at = at[possible & ~flags[unit[at]]]
                if not len(at):
                    continue
                place = np.full(rows, -1)
                place[at] = np.arange(len(at))
                mine = place[r] >= 0
                delta, width = (j - i)[mine], m + int(n_of[at].max())
                key = place[r[mine]] * width + delta + m
                # The best diagonal of each candidate.
                diagonals, inverse = np.unique(key, return_inverse=True)
                sums = np.bincount(inverse, value[mine], len(diagonals)) if len(diagonals) else np.empty(0)
                d_row, d_delta = diagonals // width, diagonals % width - m
                best = np.zeros(len(at))
                np.maximum.at(best, d_row, sums + bounds.off(d_delta, m, n_of[at[d_row]]))
                least = bound(best, at, False)
                sure = least > hit + margin
                if bounds.exact:
                    sure |= (least >= hit - margin) & better[at]
                none = summed[at] == 0
                if method != "weighted":
                    # Without equal tokens the score is known.
                    sure[none] = (least[none] > hit) | (least[none] == hit) & better[at[none]]
                flags[unit[at[sure]]] = True
                rest = at[~sure & ~(none & (method != "weighted"))]
                rest = rest[~flags[unit[rest]]]
                waiting.add(len(ids) - 1, hit, hit_cand, codes, share, rest, stacks, percent, chunk.cand, unit)
            found = np.flatnonzero(flags)
            # Pairs left open of buckets that another candidate or stack has decided are not scored.
            waiting.drop(len(ids) - 1, flags)
            alone = found[apart[found]] if not plain else found[:0]
            counts[-1] = len(found) - len(alone)
            for b in chunk.buckets[alone].tolist():
                ids.append(q["query_id"]), buckets.append(b), counts.append(1), any_.append(True)
            if waiting.size >= PENDING:
                waiting.score()
        for k, u in waiting.done():
            if not plain and apart[u]:
                ids.append(ids[k]), buckets.append(int(chunk.buckets[u])), counts.append(1), any_.append(True)
            else:
                counts[k] += 1
        return pa.table({"query_id": pa.array(ids, pa.int64()), "bucket": pa.array([None if b == -1 else b for b in buckets], pa.int64()), "n": pa.array(counts, pa.int64()), "found": pa.array(any_, pa.bool_())})

    return run


class _Waiting:
    """Pairs of which the bounds don't tell whether they are as good as the right one."""

    def __init__(self, kernel: Callable, weighted: bool) -> None:
        self.kernel, self.weighted, self.size = kernel, weighted, 0
        self.parts: list[tuple] = []
        self.passed: set[tuple[int, int]] = set()

    def add(self, k: int, hit: float, hit_cand: int, codes: np.ndarray, share: np.ndarray, rows: np.ndarray, stacks: Stacks, percent: np.ndarray | None, cand: np.ndarray, unit: np.ndarray) -> None:
        if len(rows):
            starts, length = stacks.starts[rows], stacks.length[rows]
            place = _flat(starts, length)[2]
            code = stacks.code[place]
            self.parts.append((k, hit, hit_cand, codes, share, code, length, percent[code] if self.weighted else None, cand[rows], unit[rows]))
            self.size += len(rows)

    def drop(self, k: int, flags: np.ndarray) -> None:
        at = len(self.parts) - 1
        while at >= 0 and self.parts[at][0] == k:
            p = self.parts[at]
            keep = ~flags[p[9]]
            if not keep.all():
                token = np.repeat(keep, p[6])
                self.parts[at] = (*p[:5], p[5][token], p[6][keep], None if p[7] is None else p[7][token], p[8][keep], p[9][keep])
                self.size -= int((~keep).sum())
            at -= 1

    def score(self) -> None:
        parts = [p for p in self.parts if len(p[6])]
        self.parts, self.size = [], 0
        if not parts:
            return
        times = np.array([len(p[6]) for p in parts])
        m = np.repeat([len(p[3]) for p in parts], times)
        q_starts = np.repeat(np.cumsum([len(p[3]) for p in parts]) - [len(p[3]) for p in parts], times)
        n = np.concatenate([p[6] for p in parts])
        q, c = np.concatenate([p[3] for p in parts]), np.concatenate([p[5] for p in parts])
        dq, dc = (np.concatenate([p[4] for p in parts]), np.concatenate([p[7] for p in parts])) if self.weighted else (None, None)
        score = kernels.score_numbers(self.kernel, (q, q_starts, m), (c, np.cumsum(n) - n, n), dq, dc)
        hit, hit_cand = np.repeat([p[1] for p in parts], times), np.repeat([p[2] for p in parts], times)
        good = (score > hit) | (score == hit) & (np.concatenate([p[8] for p in parts]) >= hit_cand)
        k, unit = np.repeat([p[0] for p in parts], times)[good], np.concatenate([p[9] for p in parts])[good]
        self.passed.update(zip(k.tolist(), unit.tolist()))

    def done(self) -> list[tuple[int, int]]:
        self.score()
        return sorted(self.passed)


def counted(found: DataFrame, asked: DataFrame, rows: DataFrame, make: Callable[[frozenset[int]], Callable[[pa.Table, pa.Table], pa.Table]]) -> DataFrame:
    """``query_id, n`` of each query with a candidate, summed over all chunks. Buckets that are large beside a chunk are dealt out by their members."""
    chunks = chunks_of(rows)
    large = found.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > F.lit(found.count() / (4 * chunks) + LARGE)).select("bucket")
    split = frozenset(r.bucket for r in large.collect())
    piece = F.when(F.col("bucket").isin(list(split)), F.col("cand_id")) if split else F.lit(None)
    out = meet(rows.withColumn("piece", piece.cast("long")), asked, chunks, ["bucket", "piece"], make(split), COUNTED)
    once = out.groupBy("query_id", "bucket").agg(F.when(F.col("bucket").isNull(), F.sum("n")).otherwise(1).alias("n"))
    return once.groupBy("query_id").agg(F.sum("n").alias("n"))


#: Queries whose lists are made at a time.
LISTED = 512


def rest_of_lists(asked: DataFrame, found: DataFrame, first: DataFrame) -> DataFrame:
    """``query_id, cand_id, rec_rank``: all candidates that are not in the ``first`` of their query, a written table, after these, larger ids first.

    Candidates are dealt into ranges of ids. A range's share of each list is counted, then made, in pieces of ``LISTED`` queries; nothing as large as the lists is shuffled.
    """
    chunks = chunks_of(found)
    ranged = materialize(found.repartitionByRange(chunks, F.desc("cand_id")).select("cand_id", "begin", "end", F.spark_partition_id().alias("chunk")), "ranges")
    block = F.explode(F.sequence(F.floor(F.col("begin") / LISTED), F.floor((F.col("end") - 1) / LISTED)))
    rows = ranged.select("chunk", "cand_id", "begin", "end", block.alias("block")).repartition(chunks, "chunk", "block").groupBy("chunk", "block")
    tops = first.groupBy("query_id").agg(F.collect_list("cand_id").alias("tops"))
    mine = materialize(asked.join(tops, "query_id", "left").select("query_id", "place", F.floor(F.col("place") / LISTED).alias("block"), "tops"), "listed")
    each = mine.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    counts = rows.cogroup(each.repartition(chunks, "chunk", "block").groupBy("chunk", "block")).applyInArrow(_rest_of(False), "query_id long, chunk int, n long")
    counts = materialize(counts.where("n > 0"), "list-parts")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("chunk")) - F.col("n")
    begin = counts.withColumn("before", before).join(mine, "query_id").withColumn("before", F.col("before") + F.coalesce(F.size("tops"), F.lit(0)))
    made = rows.cogroup(begin.drop("n").repartition(chunks, "chunk", "block").groupBy("chunk", "block")).applyInArrow(_rest_of(True), "query_id long, before long, ids array<long>")
    listed = made.select("query_id", "before", F.posexplode("ids").alias("at", "cand_id"))
    return listed.select("query_id", "cand_id", (F.col("before") + F.col("at") + 1).cast("int").alias("rec_rank"))


def _rest_of(make: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("cand_id", "descending")])
        cand, begin, end = _numbers(left, "cand_id"), _numbers(left, "begin"), _numbers(left, "end")
        parts = []
        for place, tops in zip(_numbers(right, "place").tolist(), right.column("tops").to_pylist()):
            ids = cand[(begin <= place) & (place < end)]
            for t in tops or []:
                ids = ids[ids != t]
            parts.append(ids if make else len(ids))
        if not make:
            return pa.table({"query_id": right.column("query_id"), "chunk": right.column("chunk"), "n": pa.array(parts, pa.int64())})
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64()))
        return pa.table({"query_id": right.column("query_id"), "before": right.column("before"), "ids": ids})

    return run


def bags_in_chunk(split: frozenset[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``counted_in_chunk`` by the cosine of bags, with ``tokens`` the terms and ``percent`` their weights.

    Scores that differ by the order of their sums only are equal, so these go by the candidates' ids.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left)
        stacks = chunk.all
        stacks.postings()
        values, starts, length = _lists_of(left, "percent")
        weight = values[_flat(starts, length)[2]]
        norm = np.sqrt(np.bincount(stacks.row, weight * weight, stacks.size))
        apart = np.isin(chunk.buckets, np.array(sorted(split), np.int64))
        out: list[tuple[int, int | None, int]] = []
        for q, own in _queries(right, "number"):
            live = chunk.live(q["place"]) & (chunk.cand != q["query_id"])
            if not live.any():
                continue
            better, held = chunk.cand >= (q["hit_cand"] or 0), stacks.length > 0
            if q["hit"] is None:
                good = np.zeros(len(live), bool)
            elif q["hit"] == NO_STACK or not own:
                good = live & (better | (held if own else False))
            else:
                tokens, wq = own[0]
                r, i, j = stacks.matches(stacks.codes(tokens), live)
                dot = np.bincount(r, wq[i] * weight[stacks.starts[r] + j], stacks.size)
                score = np.divide(dot, np.sqrt((wq * wq).sum()) * norm, out=np.zeros(stacks.size), where=norm > 0)
                good = live & held & ((score > q["hit"] + 1e-12) | (score >= q["hit"] - 1e-12) & better)
            found = np.unique(chunk.bucket[good])
            alone = found[apart[found]]
            out.append((q["query_id"], None, len(found) - len(alone)))
            out += [(q["query_id"], b, 1) for b in chunk.buckets[alone].tolist()]
        ids, buckets, counts = (list(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "bucket": pa.array(buckets, pa.int64()), "n": pa.array(counts, pa.int64()), "found": pa.array([True] * len(ids), pa.bool_())})

    return run
