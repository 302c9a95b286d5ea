"""Occurrences and records of every term or n-gram, by sorted suffixes.

Each position gives the suffix that starts there, cut to ``longest`` terms. Suffixes are first
counted by record, then routed by their first term and sorted in reverse order, so that all n-grams
with one prefix follow each other; one pass with a stack of the open prefixes gives the counts
and record sets of all of them. First terms with a large share of all suffixes are routed
by a hash of the record too; a record lies in one such part, so the parts' counts add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Separates terms in a suffix; sorts before all characters of terms.
SEP = "\x01"
#: No routed part holds more than about one in PARTS of all suffixes.
PARTS = 1000
#: Positions of one sequence that are ordered together.
BLOCK = 4096


def suffixes(rows: DataFrame, by: list[str], record: str, sequence: list[str], position: str, term: str, longest: int) -> DataFrame:
    """``by..., record, suffix``: at each position the terms at it and the next ones, as far as positions follow without a hole."""
    clean = F.translate(F.col(term), SEP, " ")
    named = rows.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    if longest == 1:
        return named.select(*by, F.col(record).alias("record"), clean.alias("suffix"))
    base = named.select(*by, F.col(record).alias("record"), *sequence, F.col(position).cast("long").alias("__p"), clean.alias("__t"))
    block = F.floor(F.col("__p") / BLOCK)
    # The first positions of a block also end suffixes of the block before.
    blocks = F.when(F.pmod(F.col("__p"), F.lit(BLOCK)) < longest - 1, F.array(block, block - 1)).otherwise(F.array(block))
    base = base.withColumn("__b", F.explode(blocks))
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "record", *sequence, "__b").orderBy("__p")
    parts = [F.col("__t")]
    for k in range(1, longest):
        parts.append(F.when(F.lead("__p", k).over(w) == F.col("__p") + k, F.lead("__t", k).over(w)))
    out = base.select(*by, "record", "__b", "__p", *[p.alias(f"__t{k}") for k, p in enumerate(parts)])
    return out.where(F.col("__b") == block).select(*by, "record", F.concat_ws(SEP, *[f"__t{k}" for k in range(longest)]).alias("suffix"))


def _stack(groups: int, keep_sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (groups..., suffix, record, n) in reverse order to (groups..., ngram, occurrences, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        open_: list[list] = []  # [prefix, occurrences, direct records, sets of records]
        out: list[tuple] = []

        def close(down_to: int) -> None:
            while len(open_) > down_to:
                prefix, count, direct, sets = open_.pop()
                if keep_sets:
                    held = np.unique(np.concatenate(sets)) if len(sets) > 1 else (sets[0] if sets else np.empty(0, np.int64))
                    records = len(held)
                else:
                    held, records = None, direct
                out.append((*group, prefix, count, records))
                if open_:
                    open_[-1][1] += count
                    if keep_sets:
                        open_[-1][3].append(held)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [pa.string()] * (groups + 1) + [pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f"c{i}" for i in range(len(types))])
            out.clear()
            return made

        for b in batches:
            if not b.num_rows:
                continue
            coded = [b.column(i).dictionary_encode() for i in range(groups + 1)]
            codes = [c.indices.to_numpy(zero_copy_only=False) for c in coded]
            changed = np.zeros(b.num_rows, bool)
            changed[0] = True
            for c in codes:
                changed[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changed)
            ends = np.append(starts[1:], b.num_rows)
            records = b.column(groups + 1).to_numpy(zero_copy_only=False)
            sums = np.add.reduceat(b.column(groups + 2).to_numpy(zero_copy_only=False), starts)
            for s, e, n in zip(starts.tolist(), ends.tolist(), sums.tolist()):
                this = tuple(coded[i].dictionary[int(codes[i][s])].as_py() for i in range(groups))
                suffix = coded[groups].dictionary[int(codes[groups][s])].as_py()
                if this != group:
                    close(0)
                    group = this
                terms = suffix.split(SEP)
                same = 0
                while same < len(open_) and same < len(terms) and open_[same][0].rsplit(SEP, 1)[-1] == terms[same]:
                    same += 1
                close(same)
                for k in range(len(open_), len(terms)):
                    open_.append([SEP.join(terms[: k + 1]), 0, 0, []])
                top = open_[-1]
                top[1] += n
                top[2] += e - s
                if keep_sets:
                    top[3].append(records[s:e])
            if len(out) >= 20_000:
                yield flush()
        if open_:
            close(0)
        if out:
            yield flush()

    return run


def count_ngrams(suffix_rows: DataFrame, by: list[str], longest: int) -> DataFrame:
    """``by..., ngram, occurrences, records`` of every n-gram of up to ``longest`` terms, terms joined by ``SEP``.

    ``by`` are string columns; records are longs. Empty input gives an empty result.
    """
    first = F.substring_index("suffix", SEP, 1)
    counted = materialize(suffix_rows.groupBy(*by, "suffix", "record").agg(F.count("*").alias("n")), "suffixes")
    weights = counted.groupBy(*by, first.alias("first")).agg(F.count("*").alias("rows"))
    total = counted.agg(F.count("*")).scalar().cast("double")
    hot = weights.where(F.col("rows").cast("double") * PARTS > total)
    hot = hot.select(*by, "first", F.ceil(F.col("rows") * PARTS / total).cast("int").alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("record"), F.col("salts")).cast("int"), F.lit(0))
    routed = counted.withColumn("first", first).join(F.broadcast(hot), [*by, "first"], "left").withColumn("salt", salt)
    routed = routed.repartition(*by, "first", "salt").select(*by, "salt", "suffix", F.col("record").cast("long").alias("record"), "n")
    ordered = routed.sortWithinPartitions(*by, "salt", F.desc("suffix"))
    schema = ", ".join(f"`{c}` string" for c in [*by, "salt", "ngram"]) + ", occurrences long, records long"
    parts = ordered.withColumn("salt", F.col("salt").cast("string")).mapInArrow(_renamed(_stack(len(by) + 1, longest > 1), [*by, "salt", "ngram", "occurrences", "records"]), schema)
    return parts.groupBy(*by, "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _renamed(run: Callable, names: list[str]) -> Callable:
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns(names)

    return named


def mark_terms(counts: DataFrame, records: "F.Column", rare_at_most: int = 1, common_over: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare``, ``common`` or null. A term that is both, as in a tiny collection, is rare."""
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > records.cast("double") * common_over, "common")
    return counts.withColumn("mark", mark)
