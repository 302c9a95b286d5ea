"""How characteristic a term is of a record: a two-by-two contingency table of each (record, term).

The cells are the term's count in the record (n), its count in all other records, and the counts
of all other terms there. A cell adds k x ln(k x total / (row x column)) to half of the log-likelihood ratio. ``llr`` is Dunning's ratio, all four
cells with margins in occurrences, signed by the direction. ``own`` is the record's own cell alone with margins in records: the log-likelihood ratio of n draws that
all gave the term, against its rate d / N in the collection, which is n x ln(N / d).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_unique
from ..session import materialize


def count_terms(occurrences: DataFrame, record: str, place: list[str], term: str) -> DataFrame:
    """``(record, term, n)``; an occurrence is one (record, place, term), copies of it count once, null terms not at all."""
    named = occurrences.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    once = named.select(F.col(record).alias("record"), *place, F.col(term).alias("term")).distinct()
    return once.groupBy("record", "term").agg(F.count("*").alias("n"))


def _g(k: Column, row: Column, column: Column, total: Column) -> Column:
    return F.when(k > 0, k * F.ln(k * total / (row * column))).otherwise(0.0)


def score_terms(counts: DataFrame, records: Column, score: str = "llr", least_records: int = 1) -> DataFrame:
    """``record, term, n, d, score`` (``llr`` or ``own``) of each counted (record, term) whose term occurs in ``least_records`` records or more.

    ``records`` is the number N of all records, a literal or scalar subquery. Scores are rounded to six
    decimals. A term of one record in a collection of one has score 0. A term with a large share of all
    rows, or a record with one, does not end in one task. Empty input gives an empty result.
    """
    counts = materialize(counts, "term-counts")
    terms = materialize(counts.groupBy("term").agg(F.count("*").alias("d"), F.sum("n").alias("cf")), "terms")
    kept = terms.where(F.col("d") >= least_records).withColumn("weight", F.col("d"))
    if score == "own":
        joined = join_unique(counts, kept.drop("cf"), ["term"], "weight", ["record"])
        # The record's row holds the n draws, the term's column d of the N records.
        n, d = F.col("n").cast("double"), F.col("d").cast("double")
        value = _g(n, n, d, records.cast("double"))
    elif score == "llr":
        sizes = materialize(counts.groupBy("record").agg(F.sum("n").alias("size"), F.count("*").alias("weight")), "sizes")
        joined = join_unique(join_unique(counts, kept, ["term"], "weight", ["record"]), sizes, ["record"], "weight", ["term"])
        total = terms.agg(F.sum("cf")).scalar().cast("double")
        n, cf, size = (F.col(c).cast("double") for c in ("n", "cf", "size"))
        g2 = 2 * (
            _g(n, size, cf, total)
            + _g(cf - n, total - size, cf, total)
            + _g(size - n, size, total - cf, total)
            + _g(total - size - cf + n, total - size, total - cf, total)
        )
        value = F.when(n * total >= size * cf, g2).otherwise(-g2)
    else:
        raise ValueError(score)
    return joined.select("record", "term", "n", "d", F.round(value, 6).alias("score"))


def most_distinctive(scored: DataFrame) -> DataFrame:
    """``record, term, score`` of each record's highest score; of equal ones the term first in code-point order."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best")
    return scored.groupBy("record").agg(best).select("record", F.col("best.term").alias("term"), (-F.col("best.s")).alias("score"))
