"""Sequence similarity kernels.

Dynamic programmes run over many pairs at a time: the pairs of an Arrow batch are sorted into groups of like
lengths, padded, and each cell of the programme is one numpy operation over the whole group. A kernel's function gets two
arrays of tokens (texts or numbers) and, where it weighs tokens, two arrays of their document frequencies in percent.
Empty or null stacks give null, which callers replace by the score of missing pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 4096


@dataclass(frozen=True)
class Weighted:
    """Parameters of the weighted alignment; see ``weighted_alignment``."""

    df_coef: float = 0.1
    pos_coef: float = 0.5
    diff_coef: float = 0.3
    match: float = 1.0
    gap: float = 1.0
    mismatch: float = 1.0
    sigmoid: bool = False
    gamma: float = 1.0
    total: bool = True
    idf: bool = False
    const_match: bool = False
    reciprocal: bool = True
    no_norm: bool = False
    const_gap: bool = False
    const_mismatch: bool = False
    linear: bool = False

    def __post_init__(self) -> None:
        if self.linear and self.idf:
            raise ValueError("linear weights take document frequencies, not idf")
        if self.idf and not self.sigmoid and not self.linear:
            raise ValueError("idf needs sigmoid weights")


def frame_weights(df: np.ndarray, length: np.ndarray, p: Weighted) -> np.ndarray:
    """Local times global weight of padded frames: df in percent, one column a stack."""
    pos = np.arange(df.shape[0], dtype=np.float64)[:, None]
    if p.linear:
        return (1 - pos / length[None, :]) * (1 - df / 100)
    local = 1 / (pos + 1) ** p.pos_coef if p.reciprocal else np.exp(-p.pos_coef * pos)
    x = np.log(100 / np.where(df == 0, 100, df)) if p.idf else df
    if p.sigmoid:
        shared = 1 / (1 + np.exp(-p.df_coef * x + p.gamma))
        shared = shared if p.idf else 1 - shared
    else:
        shared = np.exp(-p.df_coef * x)
    return local * shared


def _common_mass(g: "Group", wq: np.ndarray, wc: np.ndarray) -> np.ndarray:
    """Sum over tokens of the larger of both stacks' summed weights."""
    size = g.size
    inside_q, inside_c = np.arange(len(g.q))[:, None] < g.m, np.arange(len(g.c))[:, None] < g.n
    tokens = int(max(g.q.max(initial=0), g.c.max(initial=0))) + 1
    pair = np.arange(size, dtype=np.int64) * tokens
    key = np.concatenate([(g.q + pair)[inside_q], (g.c + pair)[inside_c]])
    a = np.concatenate([wq[inside_q], np.zeros(int(inside_c.sum()))])
    b = np.concatenate([np.zeros(int(inside_q.sum())), wc[inside_c]])
    unique, where = np.unique(key, return_inverse=True)
    return np.bincount(unique // tokens, np.maximum(np.bincount(where, a), np.bincount(where, b)), size)


class Group:
    """Padded pairs of like lengths; frames go down the first axis, pairs along the second."""

    def __init__(self, q: np.ndarray, c: np.ndarray, m: np.ndarray, n: np.ndarray, dq: np.ndarray | None = None, dc: np.ndarray | None = None, fq: np.ndarray | None = None, fc: np.ndarray | None = None) -> None:
        self.q, self.c, self.m, self.n, self.dq, self.dc, self.fq, self.fc = q, c, m, n, dq, dc, fq, fc
        self.size = len(m)

    def ramp(self, side: np.ndarray, step: float) -> np.ndarray:
        """A border of the programme that grows by ``step``."""
        return np.broadcast_to(step * np.arange(len(side) + 1.0)[:, None], (len(side) + 1, self.size))

    def run(self, first_row: np.ndarray, first_column: np.ndarray, cell: Callable, keep_two: bool = False) -> np.ndarray:
        """Value at (m, n) of the programme whose inner cells are ``cell(i, j, up, left, diagonal, crossed)``.

        ``first_row`` is (columns + 1, pairs), ``first_column`` (rows + 1, pairs); i and j count from 0.
        """
        out, at = np.zeros(self.size), np.arange(self.size)
        before: np.ndarray | None = None
        above = first_row
        for i in range(len(self.q)):
            row = np.empty((len(self.c) + 1, self.size))
            row[0] = first_column[i + 1]
            for j in range(len(self.c)):
                row[j + 1] = cell(i, j, above[j + 1], row[j], above[j], before[j - 1] if keep_two and before is not None and j > 0 else None)
            done = self.m == i + 1
            if done.any():
                out[done] = row[self.n[done], at[done]]
            before, above = above, row
        return out


def weighted_alignment(g: Group, p: Weighted) -> np.ndarray:
    """Global alignment with weighted frames, divided by the stacks' common mass."""
    wq, wc = frame_weights(g.dq, g.m, p), frame_weights(g.dc, g.n, p)
    zero = np.zeros((1, g.size))
    first_row = np.concatenate([zero, -p.gap * np.cumsum(wc, 0)])
    first_column = np.concatenate([zero, -p.gap * np.cumsum(wq, 0)])

    def cell(i: int, j: int, up: np.ndarray, left: np.ndarray, diagonal: np.ndarray, _: object) -> np.ndarray:
        a, b = wq[i], wc[j]
        high = np.maximum(a, b)
        hit = p.match * (1.0 if p.const_match else high * np.exp(-p.diff_coef * abs(i - j)))
        miss = -p.mismatch * (1.0 if p.const_mismatch else (a + b if p.total else high))
        step = diagonal + np.where(g.q[i] == g.c[j], hit, miss)
        return np.maximum(np.maximum(up - p.gap * (1.0 if p.const_gap else a), left - p.gap * (1.0 if p.const_gap else b)), step)

    score = g.run(first_row, first_column, cell)
    if p.no_norm:
        return score
    mass = _common_mass(g, wq, wc)
    return np.divide(score, mass, out=np.zeros(g.size), where=mass != 0)


def linear_alignment(g: Group, coef_gap: float = 1.0, gap: float = 0.5, mismatch: float = 0.0) -> np.ndarray:
    """Alignment with a constant gap and matches that fade with rarity, place and distance; not normalised."""

    def cell(i: int, j: int, up: np.ndarray, left: np.ndarray, diagonal: np.ndarray, _: object) -> np.ndarray:
        hit = (1 - g.dq[i] / 100) * (1 - i / g.m) * np.exp(-coef_gap * abs(i - j) / 2)
        return np.maximum(np.maximum(up, left) - gap, diagonal + np.where(g.q[i] == g.c[j], hit, -mismatch))

    return g.run(g.ramp(g.c, -gap), g.ramp(g.q, -gap), cell)


def optimal_alignment(g: Group, indel: float = 1.0, mismatch: float = 1.0, match: float = 1.0) -> np.ndarray:
    """Needleman-Wunsch, scaled between the score without any match and that of a full match; 0 if both are equal."""
    borders = g.ramp(g.c, -indel), g.ramp(g.q, -indel)
    real = lambda i, j, up, left, diagonal, _: np.maximum(np.maximum(up, left) - indel, diagonal + np.where(g.q[i] == g.c[j], match, -mismatch))
    worst = lambda i, j, up, left, diagonal, _: np.maximum(np.maximum(up, left) - indel, diagonal - mismatch)
    score, low = g.run(*borders, real), _by_length(g, -indel, -indel, worst)
    span = np.minimum(g.m, g.n) * match - low
    return np.divide(score - low, span, out=np.zeros(g.size), where=span != 0)


def _by_length(g: Group, row_step: float, column_step: float, cell: Callable) -> np.ndarray:
    """A programme that looks at no token: one run gives it for all lengths of the group."""
    height, width = len(g.q), len(g.c)
    table = np.zeros((height + 1, width + 1))
    table[0] = row_step * np.arange(width + 1)
    table[:, 0] = column_step * np.arange(height + 1)
    for i in range(height):
        for j in range(width):
            table[i + 1, j + 1] = cell(i, j, table[i, j + 1], table[i + 1, j], table[i, j], None)
    return table[g.m, g.n]


def edit_similarity(g: Group, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, transpose: float = 1.0, transpositions: bool = True) -> np.ndarray:
    """1 less the edit distance over that of stacks without a common token; 0 if the latter is 0."""

    def real(i: int, j: int, up: np.ndarray, left: np.ndarray, diagonal: np.ndarray, crossed: np.ndarray | None) -> np.ndarray:
        best = np.minimum(np.minimum(up + delete, left + insert), diagonal + np.where(g.q[i] == g.c[j], 0.0, substitute))
        if transpositions and crossed is not None and i > 0:
            swapped = (g.q[i] == g.c[j - 1]) & (g.q[i - 1] == g.c[j]) & (g.q[i] != g.c[j])
            best = np.where(swapped, np.minimum(best, crossed + transpose), best)
        return best

    worst = lambda i, j, up, left, diagonal, _: np.minimum(np.minimum(up + delete, left + insert), diagonal + substitute)
    distance, most = g.run(g.ramp(g.c, insert), g.ramp(g.q, delete), real, True), _by_length(g, insert, delete, worst)
    return np.where(most != 0, 1 - np.divide(distance, most, out=np.zeros(g.size), where=most != 0), 0.0)


def positional_similarity(g: Group, c: float = 0.1, o: float = 0.2) -> np.ndarray:
    """Common subsequence whose matches fade with depth (c) and with the difference of depths (o)."""
    cell = lambda i, j, up, left, diagonal, _: np.maximum(np.maximum(up, left), diagonal + np.where(g.q[i] == g.c[j], np.exp(-c * min(i, j)) * np.exp(-o * abs(i - j)), 0.0))
    full = np.concatenate([[0.0], np.cumsum(np.exp(-c * np.arange(max(len(g.q), len(g.c)))))])
    return g.run(g.ramp(g.c, 0.0), g.ramp(g.q, 0.0), cell) / full[np.minimum(g.m, g.n)]


def merge_overlap(g: Group) -> np.ndarray:
    """Equal tokens met by two pointers that advance at the smaller token, over the shorter length."""
    i, j, hits = np.zeros(g.size, int), np.zeros(g.size, int), np.zeros(g.size)
    at = np.arange(g.size)
    for _ in range(len(g.q) + len(g.c)):
        live = (i < g.m) & (j < g.n)
        if not live.any():
            break
        a, b = g.q[np.minimum(i, len(g.q) - 1), at], g.c[np.minimum(j, len(g.c) - 1), at]
        hits += live & (a == b)
        i, j = i + (live & (a <= b)), j + (live & (a >= b))
    return hits / np.minimum(g.m, g.n)


def module_distance(
    g: Group, insert_same: float = 1.0, insert_new: float = 1.0, delete_same: float = 1.0, delete_last: float = 1.0, sub_module: float = 1.0, sub_function: float = 1.0, unknown_same: bool = False
) -> np.ndarray:
    """Edit distance of (function, module) pairs over that of the dearest edits. Tokens are modules, ``fq`` and ``fc`` functions; 0 is unknown in both."""
    height, width = len(g.q), len(g.c)

    def same_module(i: int, j: int) -> np.ndarray:
        if i >= height or j >= width:
            return np.zeros(g.size, bool)
        a, b = g.q[i], g.c[j]
        return (i < g.m) & (j < g.n) & np.where((a == 0) & (b == 0), unknown_same, a == b)

    dearest_in, dearest_out = max(insert_same, insert_new), max(delete_same, delete_last)
    dearest_sub = max(sub_module, sub_function)

    def cell(i: int, j: int, up: np.ndarray, left: np.ndarray, diagonal: np.ndarray, _: object) -> np.ndarray:
        here = same_module(i, j)
        insert = np.where(here | same_module(i + 1, j), insert_same, insert_new)
        delete = np.where(here | same_module(i, j + 1), delete_same, delete_last)
        equal_function = (g.fq[i] == g.fc[j]) & (g.fq[i] > 0)
        sub = np.where(~here, sub_module, np.where(equal_function, 0.0, sub_function))
        return np.minimum(np.minimum(up + delete, left + insert), diagonal + sub)

    worst = lambda i, j, up, left, diagonal, _: np.minimum(np.minimum(up + dearest_out, left + dearest_in), diagonal + dearest_sub)
    distance, most = g.run(g.ramp(g.c, dearest_in), g.ramp(g.q, dearest_out), cell), _by_length(g, dearest_in, dearest_out, worst)
    return np.divide(distance, most, out=np.zeros(g.size), where=most != 0)


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column; null lists have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.diff(offsets)
    if column.null_count:
        length = np.where(column.is_valid().to_numpy(zero_copy_only=False), length, 0)
    return column.values, offsets[:-1], length


def _codes(a: pa.Array, b: pa.Array, first: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides as numbers in the tokens' order; with ``first``, that token is 0 and the others follow."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if first is None and pa.types.is_integer(coded.dictionary.type):
        _, place = np.unique(coded.dictionary.to_numpy(zero_copy_only=False), return_inverse=True)
        return place[index[: len(a)]], place[index[len(a) :]]
    names = coded.dictionary.to_pylist()
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda k: (names[k] != first, names[k]) if first is not None else names[k])] = np.arange(len(names))
    if first is not None and first not in names:
        place += 1
    index = place[index] if len(names) else index
    return index[: len(a)], index[len(a) :]


def _pad(values: np.ndarray, starts: np.ndarray, length: np.ndarray, fill: float) -> np.ndarray:
    """(longest, rows) of the lists that begin at ``starts``."""
    at = np.arange(int(length.max()))[:, None]
    inside = at < length
    return np.where(inside, values[np.where(inside, starts + at, 0)], values.dtype.type(fill))


def score_lists(kernel: Callable[[Group], np.ndarray], q: pa.Array, c: pa.Array, dq: pa.Array | None = None, dc: pa.Array | None = None, fq: pa.Array | None = None, fc: pa.Array | None = None) -> pa.Array:
    """Scores of aligned list columns; null where a side is null or empty.

    ``dq``/``dc`` are the tokens' frequencies, ``fq``/``fc`` a second text of each frame, whose empty text, like that of the tokens then, is unknown.
    """
    (vq, sq, m), (vc, sc, n) = lists(q), lists(c)
    out = np.full(len(m), np.nan)
    at = np.flatnonzero((m > 0) & (n > 0))
    if len(at):
        kq, kc = _codes(vq, vc, "" if fq is not None else None)
        extra: list[tuple[np.ndarray, np.ndarray] | None] = [None] * 4
        if dq is not None:
            extra[:2] = [(v.to_numpy(zero_copy_only=False), s) for v, s, _ in (lists(dq), lists(dc))]
        if fq is not None:
            (v1, s1, _), (v2, s2, _) = lists(fq), lists(fc)
            extra[2:] = list(zip(_codes(v1, v2, ""), (s1, s2)))
        _scored(kernel, out, at, (kq, sq, m), (kc, sc, n), extra)
    return pa.array(out, pa.float64(), from_pandas=True)


def _scored(kernel: Callable[[Group], np.ndarray], out: np.ndarray, at: np.ndarray, q: tuple, c: tuple, extra: list[tuple | None]) -> None:
    """Puts the scores of the pairs ``at`` into ``out``; sides are (codes, starts, lengths)."""
    (kq, sq, m), (kc, sc, n) = q, c
    order = at[np.lexsort((n[at], m[at]))]
    for k in range(0, len(order), _GROUP):
        slice_ = order[k : k + _GROUP]
        # Rows are alike within a slice; halves by the columns keep these alike too.
        slice_ = slice_[np.argsort(n[slice_], kind="stable")]
        for part in np.array_split(slice_, 2 if len(slice_) > 512 else 1):
            more = [None if e is None else _pad(e[0], e[1][part], (m if side % 2 == 0 else n)[part], 0) for side, e in enumerate(extra)]
            g = Group(_pad(kq, sq[part], m[part], -1), _pad(kc, sc[part], n[part], -2), m[part], n[part], *more)
            out[part] = kernel(g)


def score_numbers(kernel: Callable[[Group], np.ndarray], q: tuple, c: tuple, dq: np.ndarray | None = None, dc: np.ndarray | None = None) -> np.ndarray:
    """``score_lists`` of sides that are (codes, starts, lengths) already, none of them empty; frequencies lie as the codes do."""
    out = np.full(len(q[2]), np.nan)
    _scored(kernel, out, np.arange(len(out)), q, c, [(dq, q[1]), (dc, c[1])] if dq is not None else [])
    return out


def pair_kernel(kernel: Callable[[Group], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A column builder over two token arrays."""

    def score(q: pa.Array, c: pa.Array) -> pa.Array:
        return score_lists(kernel, q, c)

    return _arrow(score, 2)


def weighted_kernel(kernel: Callable[[Group], np.ndarray]) -> Callable[[Column, Column, Column, Column], Column]:
    """A column builder over two token arrays and their document frequencies in percent."""

    def score(q: pa.Array, c: pa.Array, dq: pa.Array, dc: pa.Array) -> pa.Array:
        return score_lists(kernel, q, c, dq, dc)

    return _arrow(score, 4)


def prefix_similarity(g: Group) -> np.ndarray:
    """Length of the longest common prefix over the longer length, what ``common_prefix`` gives."""
    alive, length = np.ones(g.size, bool), np.zeros(g.size)
    for i in range(min(len(g.q), len(g.c))):
        alive &= g.q[i] == g.c[i]
        length += alive
    return length / np.maximum(g.m, g.n)


@dataclass(frozen=True)
class Added:
    """By how much the frequencies of tokens grow with each query: ``tokens``, unique; sorted ``keys`` = place of the token x ``span`` + number of the query."""

    tokens: pa.Array
    keys: np.ndarray
    span: int

    @staticmethod
    def of(tokens: pa.Array, numbers: np.ndarray) -> "Added":
        """From pairs of a token and the number (from 0) of a query that adds one to its count."""
        unique = tokens.unique()
        place = pc.index_in(tokens, value_set=unique).to_numpy(zero_copy_only=False).astype(np.int64)
        span = int(numbers.max(initial=0)) + 1
        return Added(unique, np.sort(place * span + numbers), span)

    def until(self, tokens: pa.Array, number: np.ndarray) -> np.ndarray:
        """What the queries up to ``number`` added to each token."""
        place = pc.fill_null(pc.index_in(tokens, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        low = np.searchsorted(self.keys, place * self.span)
        high = np.searchsorted(self.keys, place * self.span + np.minimum(number, self.span - 1), side="right")
        return np.where(place >= 0, high - low, 0)


#: Stands for the count of a token of an unknown function whose frequency is fixed.
FIXED = -1


def side_at_queries(tokens: pa.Array, counts: pa.Array, number: np.ndarray, total: np.ndarray, added: Added, trim: float | None, fixed: float | None) -> tuple[pa.Array, pa.Array]:
    """Tokens and their percentages when the queries of these numbers were scored, trimmed."""
    values, starts, length = lists(tokens)
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    values = values.take(pa.array(np.repeat(starts, length) + at))
    held, begin, _ = lists(counts)
    n = held.to_numpy(zero_copy_only=False)[np.repeat(begin, length) + at] if len(row) else np.empty(0)
    percent = (n + added.until(values, number[row])) / total[row] * 100.0
    if fixed is not None:
        percent = np.where(n == FIXED, fixed, percent)
    if trim is not None:
        kept = np.flatnonzero((percent <= trim) | ((n == FIXED) if fixed is not None else False))
        first, last = np.full(len(length), len(row)), np.full(len(length), -1)
        np.minimum.at(first, row[kept], kept)
        np.maximum.at(last, row[kept], kept)
        inside = (np.arange(len(row)) >= first[row]) & (np.arange(len(row)) <= last[row])
        values, percent, length = values.filter(pa.array(inside)), percent[inside], np.bincount(row[inside], minlength=len(length))
    offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(percent))


def kernel_at_queries(
    kernel: Callable[[Group], np.ndarray], weighted: bool, added: Callable[[], Added], trim: float | None, fixed: float | None
) -> Callable[..., Column]:
    """A column builder over two token arrays, their counts before all queries, the query's number and the number of documents then.

    Frequencies are those that stood when the query was scored; tokens above ``trim`` percent are dropped from both ends, those with count ``FIXED`` never, their
    frequency is ``fixed``. Null where a side is null, empty or left empty.
    """

    def score(q: pa.Array, c: pa.Array, nq: pa.Array, nc: pa.Array, number: pa.Array, total: pa.Array) -> pa.Array:
        numbers = pc.fill_null(number, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        totals = pc.fill_null(total, 1).to_numpy(zero_copy_only=False).astype(np.float64)
        (q, dq), (c, dc) = (side_at_queries(x, y, numbers, totals, added(), trim, fixed) for x, y in ((q, nq), (c, nc)))
        return score_lists(kernel, q, c, dq, dc) if weighted else score_lists(kernel, q, c)

    return _arrow(score, 6)


def module_kernel(**costs: float) -> Callable[[Column, Column, Column, Column], Column]:
    """A column builder over module and function arrays of both sides; empty texts are unknown modules and functions."""

    def score(qm: pa.Array, cm: pa.Array, qf: pa.Array, cf: pa.Array) -> pa.Array:
        return score_lists(lambda g: module_distance(g, **costs), qm, cm, fq=qf, fc=cf)

    return _arrow(score, 4)


def _arrow(score: Callable, arguments: int) -> Callable[..., Column]:
    # Annotations are texts in this module, so the kind of function is told here.
    score.__annotations__ = dict.fromkeys(score.__code__.co_varnames[:arguments], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(score, "double")


def common_prefix(q: Column, c: Column) -> Column:
    """Length of the longest common prefix over the longer length; null if a side is null or empty. Built-in functions only."""
    shorter = F.least(F.size(q), F.size(c))
    differs = F.array_position(F.zip_with(F.slice(q, 1, F.greatest(shorter, F.lit(0))), F.slice(c, 1, F.greatest(shorter, F.lit(0))), lambda a, b: a != b), True)
    length = F.when(differs == 0, shorter).otherwise(differs - 1)
    return F.when(shorter > 0, length / F.greatest(F.size(q), F.size(c)))


def multiset_overlap(q: Column, c: Column) -> Column:
    """Size of the multiset intersection over the shorter length; what ``merge_overlap`` gives for sorted stacks."""
    shorter = F.least(F.size(q), F.size(c))
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    hits = F.aggregate(F.array_distinct(q), F.lit(0), lambda acc, t: acc + F.least(times(q, t), times(c, t)))
    return F.when(shorter > 0, hits / shorter)


def blend(text: Column, positional: Column, alpha: float) -> Column:
    """Weighted harmonic blend of a text score and a positional one; 0 if both are 0."""
    low = alpha * positional + (1 - alpha) * text
    return F.when(low == 0, 0.0).otherwise(text * positional / low)

