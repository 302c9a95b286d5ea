"""Evaluation passages in training text: rare n-gram seeds, then local alignment.

The n-grams of all items are looked up in every document once to count in how many documents each
occurs; every window of ``passage`` words of an item is then represented by its rarest n-gram, its seed. A
document that holds such a window holds its seed, so no shared passage is missed. In a second
pass each document with a seed is aligned with the seed's items by Smith-Waterman over words, around
the places of the seeds only; the alignment's score decides, and the longest run of equal words tells whole passages.

Edited copies share no five words in a row where every fifth is another. For them three words out of four, in three shapes, that few documents
hold are seeds too, and an item is aligned with a document where several such seeds lie near one diagonal: that is what a copy with
words exchanged, left out or put in looks like, and what phrases that both merely use do not.
No text is shuffled: both passes work where the document is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

#: Words of a seed.
SEED = 5
#: Words of a passage that gives an item away.
PASSAGE = 13
#: Places of the words of the seeds of edited copies: at least one shape is spared if, in any stretch of five words, one is another.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Number of documents, and share of all, up to which such a seed counts.
RARE, RARE_SHARE = 100, 0.01
#: Seeds that must lie within two neighbouring bands of this many diagonals, and by how many diagonals an alignment may leave these.
LEAST_SEEDS, BAND, SLACK = 4, 8, 24
#: Words of items, padding included, that are aligned at a time.
ALIGNED = 100_000
#: Words of all items that are broadcast at a time; further items are taken in further blocks.
BLOCK_WORDS = 500_000
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score from which a document holds an edited copy: that of a whole passage.
COPIED = PASSAGE * MATCH
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case, mark-up tags left out."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


class Items:
    """The items of one block: their words as numbers, and the seeds' places in them."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int) -> None:
        self.seed = seed
        self.ids = np.array([i for i, _ in items], np.int64)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in items)))}
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]

    def code(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def grams(self, coded: np.ndarray, shape: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the n-grams of item words only; ``shape`` gives the places of their words."""
        places = shape or tuple(range(self.seed))
        n = len(coded) - places[-1]
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known = coded >= 0
        inside = known[:n].copy()
        for k in places[1:]:
            inside &= known[k : k + n]
        at = np.flatnonzero(inside)
        value = np.full(len(at), 0 if shape is None else 1 + sum(1 << k for k in shape), np.uint64)
        for k in places:
            value = (value ^ (coded[at + k].astype(np.uint64) + np.uint64(1))) * _PRIME
            value ^= value >> np.uint64(29)
        return at, value


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (best score, its end in the document, longest equal run, matches' end in the item)."""
    n = len(doc)
    ramp = np.arange(n, dtype=np.int64) * -GAP
    row = np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)
    best, best_end, best_item, longest = 0, 0, 0, 0
    for k, w in enumerate(item):
        equal = doc == w
        diagonal = np.empty(n, np.int64)
        diagonal[0], diagonal[1:] = 0, row[:-1]
        now = np.maximum(diagonal + np.where(equal, MATCH, MISMATCH), row + GAP)
        np.maximum(now, 0, out=now)
        # Gaps along the document: the best cell to the left, less its distance.
        now = np.maximum.accumulate(now + ramp) - ramp
        shifted = np.empty(n, np.int64)
        shifted[0], shifted[1:] = 0, run[:-1]
        run = np.where(equal, shifted + 1, 0)
        row = now
        at = int(now.argmax())
        if now[at] > best:
            best, best_end, best_item = int(now[at]), at, k
        longest = max(longest, int(run.max()))
    return best, best_end, longest, best_item


def align_bands(docs: list[np.ndarray], items: list[np.ndarray], low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align`` of many pairs at a time, each within ``2 * (BAND + SLACK)`` diagonals (place in the document less place in the item) from ``low - SLACK`` on: (scores, ends, longest runs).

    Rows of the programme go along the diagonals, so a match comes from the same column of the row before, a skipped word of the item from the next one.
    """
    width, longest, n = 2 * (BAND + SLACK), max(len(i) for i in items), len(items)
    item = np.full((n, longest), -2, np.int64)
    doc = np.full((n, longest + width), -1, np.int64)
    for k, (d, i) in enumerate(zip(docs, items)):
        item[k, : len(i)] = i
        begin = int(low[k]) - SLACK
        have = d[max(begin, 0) : max(begin + len(i) + width, 0)]
        doc[k, max(-begin, 0) : max(-begin, 0) + len(have)] = have
    ramp = np.arange(width, dtype=np.int64) * -GAP
    row, run = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    best, end, most = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for i in range(longest):
        equal = doc[:, i : i + width] == item[:, i : i + 1]
        now = row + np.where(equal, MATCH, MISMATCH)
        np.maximum(now[:, :-1], row[:, 1:] + GAP, out=now[:, :-1])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + ramp, axis=1) - ramp
        run = np.where(equal, run + 1, 0)
        at = row.argmax(axis=1)
        better = row[every, at] > best
        best = np.where(better, row[every, at], best)
        end = np.where(better, low - SLACK + i + at, end)
        most = np.maximum(most, run.max(axis=1))
    return best, end, most


def _frequencies(source: DataFrame, items: Items, shapes: tuple) -> DataFrame:
    """(gram, documents) of the items' n-grams, over all documents."""
    spark = source.sparkSession
    every = np.unique(np.concatenate([items.grams(c, shape)[1] for c in items.coded for shape in shapes] or [np.empty(0, np.uint64)]))
    sent = spark.sparkContext.broadcast((items, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = sent.value
        count = np.zeros(len(known), np.int64)
        for b in batches:
            for value in b.column(1):
                coded = held.code(value.as_py())
                if not len(known) or not (coded >= 0).any():
                    continue
                found = np.concatenate([held.grams(coded, shape)[1] for shape in shapes])
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                count[np.unique(at[known[at] == found])] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(count[some])], names=["gram", "documents"])

    return source.mapInArrow(run, "gram long, documents long").groupBy("gram").agg(F.sum("documents").alias("documents"))


def choose_seeds(items: Items, frequency: dict[int, int], passage: int) -> dict[int, list[int]]:
    """Of every window of ``passage`` words the rarest n-gram that documents hold: gram -> items.

    A document with the whole window holds all its n-grams, so this seed too. Windows of which no document holds any n-gram need no seed.
    """
    seeds: dict[int, set[int]] = {}
    per = passage - items.seed + 1
    for k, coded in enumerate(items.coded):
        grams = items.grams(coded)[1].view(np.int64).tolist()
        for s in range(len(grams) - per + 1):
            held = [g for g in grams[s : s + per] if g in frequency]
            if held:
                seeds.setdefault(min(held, key=lambda g: (frequency[g], g)), set()).add(k)
    return {g: sorted(v) for g, v in seeds.items()}


class Sown:
    """Seeds of edited copies: sorted ``grams``, and for each the items and places in them where it stands."""

    def __init__(self, items: Items, frequency: dict[int, int], most: int) -> None:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, coded in enumerate(items.coded):
            for shape in SHAPES:
                at, grams = items.grams(coded, shape)
                found.append((grams.view(np.int64), np.full(len(at), k), at))
        gram, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found)) or [[], [], []]))
        rare = np.array([0 < frequency.get(g, 0) <= most for g in gram.tolist()], bool)
        order = np.argsort(gram[rare], kind="stable")
        self.item, self.place = item[rare][order], place[rare][order]
        self.grams, self.start = np.unique(gram[rare][order], return_index=True)
        self.count = np.diff(np.append(self.start, len(order)))

    def bands(self, items: Items, coded: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of the pairs of bands in which enough seeds lie; of bands that follow each other every other one."""
        if not len(self.grams):
            return []
        hits = [items.grams(coded, shape) for shape in SHAPES]
        at, grams = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]).view(np.int64)
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        met = self.grams[slot] == grams
        at, slot = at[met], slot[met]
        if len(at) < LEAST_SEEDS:
            return []
        times = self.count[slot]
        row = np.repeat(np.arange(len(at)), times)
        other = self.start[slot][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        # Diagonals count from the longest item's last word at the document's first.
        zero = max(len(c) for c in items.coded)
        span = (len(coded) + zero) // BAND + 3
        bands, n = np.unique(self.item[other] * span + (at[row] - self.place[other] + zero) // BAND, return_counts=True)
        good = np.flatnonzero(n + np.append((np.diff(bands) == 1) * n[1:], 0) >= LEAST_SEEDS)
        out: list[tuple[int, int]] = []
        last = -9
        for b in bands[good].tolist():
            if b != last + 1:
                out.append((b // span, b % span * BAND - zero))
                last = b
        return out


def _block(source: DataFrame, block: list[tuple[int, list[str]]], seed: int, passage: int, most: int | None) -> DataFrame:
    spark = source.sparkSession
    items = Items(block, seed)
    shapes = (None,) if most is None else (None, *SHAPES)
    # At most one row for each n-gram of the block, which BLOCK_WORDS bounds.
    frequency = {r.gram: r.documents for r in _frequencies(source, items, shapes).collect()}
    seeds = choose_seeds(items, frequency, passage)
    keys = np.array(sorted(seeds), np.int64)
    sown = None if most is None else Sown(items, frequency, most)
    sent = spark.sparkContext.broadcast((items, keys, [seeds[g] for g in keys.tolist()], sown))
    names = ["doc_id", "item_id", "score", "longest_run", "doc_end"]

    def whole(held: Items, known: np.ndarray, owners: list[list[int]], coded: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, score, longest run, end) of the items whose seed of a whole passage the document holds."""
        if not len(known):
            return
        at, grams = held.grams(coded)
        grams = grams.view(np.int64)
        slot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        hit = known[slot] == grams
        places: dict[int, list[int]] = {}
        for p, s in zip(at[hit].tolist(), slot[hit].tolist()):
            for k in owners[s]:
                places.setdefault(k, []).append(p)
        for k, ps in places.items():
            item = held.coded[k]
            reach = 2 * len(item)
            best = (0, 0, 0)
            start = stop = None
            for p in [*ps, None]:
                if start is not None and (p is None or p - reach > stop):
                    lo, hi = max(0, start - reach), min(len(coded), stop + reach + held.seed)
                    score, end, longest, _ = align(coded[lo:hi], item)
                    best = (max(best[0], score), lo + end if score > best[0] else best[1], max(best[2], longest))
                    start = None
                if p is not None:
                    start, stop = (p, p) if start is None else (start, p)
            yield k, best[0], best[2], best[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, owners, more = sent.value
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        least = passage * MATCH

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def banded(waiting: list[tuple[int, np.ndarray, int, int]]) -> list[tuple]:
            waiting.sort(key=lambda w: len(held.coded[w[2]]))
            low = np.array([w[3] for w in waiting], np.int64)
            score, end, longest = align_bands([w[1] for w in waiting], [held.coded[w[2]] for w in waiting], low)
            return [(waiting[k][0], int(held.ids[waiting[k][2]]), int(score[k]), int(longest[k]), int(end[k])) for k in np.flatnonzero(score >= least).tolist()]

        for b in batches:
            out: list[tuple] = []
            waiting: list[tuple[int, np.ndarray, int, int]] = []
            load = 0
            for i in range(b.num_rows):
                coded = held.code(b.column(1)[i].as_py())
                if not (coded >= 0).any():
                    continue
                doc = b.column(0)[i].as_py()
                out.extend((doc, int(held.ids[k]), *found) for k, *found in whole(held, known, owners, coded) if found[0] >= least)
                if more is not None:
                    for k, low in more.bands(held, coded):
                        waiting.append((doc, coded, k, low))
                        load = max(load, len(held.coded[k]))
                        if load * len(waiting) >= ALIGNED:
                            out.extend(banded(waiting))
                            waiting, load = [], 0
            if waiting:
                out.extend(banded(waiting))
            if out:
                yield batch(out)

    return source.mapInArrow(run, "doc_id long, item_id long, score long, longest_run long, doc_end long")


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, seed: int = SEED, passage: int = PASSAGE, block_words: int = BLOCK_WORDS,
    edited: bool = False,
) -> DataFrame:
    """``doc_id, item_id, score, longest_run, doc_end`` of each document and item whose alignment scores as a whole passage does or higher.

    ``score`` is that of the best local alignment over words (2 for equal words, -1 for others and for gaps), ``longest_run`` the number of consecutive common words,
    ``doc_end`` the word where the alignment ends. Pairs that share ``passage`` consecutive words are complete. With ``edited`` pairs are looked for too that share
    ``LEAST_SEEDS`` seeds of three words near one diagonal, each in at most ``RARE`` documents or ``RARE_SHARE`` of all. Null and empty
    texts, and items of fewer than ``passage`` words, give no pair. Items are read block by block on the driver, so any
    number of them can be asked for; each block is a fixed query set against all documents.
    """
    source = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    most = max(RARE, int(source.count() * RARE_SHARE)) if edited else None
    found: list[DataFrame] = []
    block: list[tuple[int, list[str]]] = []
    held = 0
    wanted = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), F.col(text)).distinct()
    for number, content in wanted.toLocalIterator():
        ws = words(content)
        if len(ws) >= passage:
            block.append((number, ws))
            held += len(ws)
        if held >= block_words:
            found.append(materialize(_block(source, block, seed, passage, most), "leaks"))
            block, held = [], 0
    if block or not found:
        found.append(_block(source, block, seed, passage, most))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.where(F.col("score") >= passage * MATCH)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max_by("doc_end", "score").alias("doc_end")
    )
