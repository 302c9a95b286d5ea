"""Scores of report pairs: every stack of one with every stack of the other, then one score a pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_unique
from .ordered import running_sums

# Scores that stand for missing ones.
NO_STACK = -9999999.99
NOT_RANKED = -999999999.99

AGGREGATES = ("max", "avg_query", "avg_cand", "avg_short", "avg_long", "avg_query_cand")


def stack_pairs(pairs: DataFrame, stacks: DataFrame, coded: bool = True, how: str = "inner", more: list[str] | None = None) -> DataFrame:
    """``query_id, cand_id, q_stack, c_stack, q, c`` and, if stacks have them, their frequencies ``dq`` and ``dc``.

    ``coded`` tokens are 64-bit hashes, which are an eighth of the size in the joins and serve all kernels that only compare for equality; two
    tokens of one pair share a hash once in 10^19 comparisons. Kernels that need the tokens' order take them as they are. ``more`` names columns of the pairs to keep.
    """
    weighed = "df" in stacks.columns
    if coded:
        stacks = stacks.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))
    side = lambda report, stack, tokens, df: stacks.select(
        F.col("bug_id").alias(report), F.col("stack_no").alias(stack), F.col("tokens").alias(tokens), *([F.col("df").alias(df)] if weighed else [])
    )
    return pairs.select("query_id", "cand_id", *(more or [])).join(side("query_id", "q_stack", "q", "dq"), "query_id", how).join(
        side("cand_id", "c_stack", "c", "dc"), "cand_id", how
    )


def score_cells(pairs: DataFrame, stacks: DataFrame, kernel: Callable[..., Column], weighted: bool = False, coded: bool = True) -> DataFrame:
    """``query_id, cand_id, q_stack, c_stack, score`` of all stack pairs.

    The narrow pairs are first spread by their key: candidates come out of a join on buckets, one of which may be hot, and kernels cost far more than that shuffle.
    """
    if not weighted:
        stacks = stacks.select("bug_id", "stack_no", "tokens")
    cells = stack_pairs(pairs.select("query_id", "cand_id").repartition("query_id", "cand_id"), stacks, coded)
    score = kernel(F.col("q"), F.col("c"), F.col("dq"), F.col("dc")) if weighted else kernel(F.col("q"), F.col("c"))
    return cells.select("query_id", "cand_id", "q_stack", "c_stack", score.alias("score"))


def best_of_pairs(pairs: DataFrame, stacks: DataFrame, kernel: Callable[..., Column], weighted: bool = False, coded: bool = True) -> DataFrame:
    """``query_id, cand_id, score`` of all pairs: the best stack pair, the score for missing stacks where a side has none.

    Pairs are spread once by their key and keep that place through the joins and the maximum, so nothing else of their size is shuffled.
    """
    if not weighted:
        stacks = stacks.select("bug_id", "stack_no", "tokens")
    cells = stack_pairs(pairs.select("query_id", "cand_id").repartition("query_id", "cand_id"), stacks, coded, "left")
    score = kernel(F.col("q"), F.col("c"), F.col("dq"), F.col("dc")) if weighted else kernel(F.col("q"), F.col("c"))
    return cells.groupBy("query_id", "cand_id").agg(F.coalesce(F.max(score), F.lit(NO_STACK)).alias("score"))


def aggregate_cells(cells: DataFrame, how: str = "max") -> DataFrame:
    """``query_id, cand_id, score`` of each pair with cells.

    ``max`` is the best cell; ``avg_query`` the mean over query stacks of their best cell, ``avg_cand`` over the other side's,
    ``avg_short`` and ``avg_long`` over the side with fewer or more stacks (the query's on a tie), ``avg_query_cand`` the mean of both.
    """
    if how == "max":
        return cells.groupBy("query_id", "cand_id").agg(F.max("score").alias("score"))
    if how not in AGGREGATES:
        raise ValueError(how)

    def mean(side: str, name: str) -> DataFrame:
        best = cells.groupBy("query_id", "cand_id", side).agg(F.max("score").alias("best"))
        return best.groupBy("query_id", "cand_id").agg(F.avg("best").alias(name), F.count("*").alias(f"n_{name}"))

    if how == "avg_query":
        return mean("q_stack", "score").drop("n_score")
    if how == "avg_cand":
        return mean("c_stack", "score").drop("n_score")
    both = mean("q_stack", "row").join(mean("c_stack", "col"), ["query_id", "cand_id"])
    pick = {
        "avg_short": F.when(F.col("n_row") <= F.col("n_col"), F.col("row")).otherwise(F.col("col")),
        "avg_long": F.when(F.col("n_col") <= F.col("n_row"), F.col("row")).otherwise(F.col("col")),
        "avg_query_cand": (F.col("row") + F.col("col")) / 2,
    }[how]
    return both.select("query_id", "cand_id", pick.alias("score"))


def weighted_mean(cells: DataFrame, stacks: DataFrame, side: str = "query", weight: str = "avg") -> DataFrame:
    """Mean over one side's stacks of their best cell, weighed by 100 less the ``avg`` or smallest (``max``) frequency of the stack."""
    report, stack = ("query_id", "q_stack") if side == "query" else ("cand_id", "c_stack")
    weights = stacks.select(F.col("bug_id").alias(report), F.col("stack_no").alias(stack), stack_weight(F.col("df"), weight).alias("w"))
    best = cells.groupBy("query_id", "cand_id", stack).agg(F.max("score").alias("best")).join(weights, [report, stack])
    return best.groupBy("query_id", "cand_id").agg(F.try_divide(F.sum(F.col("w") * F.col("best")), F.sum("w")).alias("score"))


def stack_weight(df: Column, how: str) -> Column:
    rare = F.transform(df, lambda d: 100 - d)
    if how == "max":
        return F.array_max(rare)
    return F.aggregate(rare, F.lit(0.0), lambda a, x: a + x) / F.size(rare)


def with_missing(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """All pairs; those without a score get the one for missing stacks."""
    return pairs.select("query_id", "cand_id").join(scored, ["query_id", "cand_id"], "left").select(
        "query_id", "cand_id", F.coalesce("score", F.lit(NO_STACK)).alias("score")
    )


def select_one(stacks: DataFrame) -> DataFrame:
    """Of each report the stack with the rarest token; ties go to the rarer mean, then to the first stack."""
    best = F.max_by(
        F.struct("stack_no", "tokens", "df"), F.struct(stack_weight(F.col("df"), "max"), F.round(stack_weight(F.col("df"), "avg"), 9), -F.col("stack_no"))
    )
    return stacks.groupBy("bug_id").agg(best.alias("s")).select("bug_id", "s.stack_no", "s.tokens", "s.df")


def top_tokens(stacks: DataFrame, frequency: DataFrame, k: float) -> DataFrame:
    """Stacks that hold a token of the rarest share ``k`` of all distinct tokens.

    The threshold is the value at place int((1 - k) x V) of 100 - percent in rising order, V the number of distinct tokens.
    """
    if not 0 < k <= 1:
        raise ValueError(k)
    # Equal percentages share a rank, so the running count over distinct values is enough.
    values = frequency.groupBy((100 - F.col("percent")).alias("rare")).agg(F.count("*").alias("n"))
    ranked = running_sums(values, ["rare"], {"upto": F.col("n")})
    total = frequency.agg(F.count("*")).scalar()
    place = F.floor((1 - F.lit(k)) * total)
    least = ranked.where(F.col("upto") > F.least(place, total - 1)).agg(F.min("rare")).scalar()
    return stacks.where(F.array_max(F.transform("df", lambda d: 100 - d)) >= least)


def bag_weights(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """``bug_id, term, w``: tf/length x idf."""
    size = bags.groupBy("bug_id").agg(F.sum("freq").alias("size"))
    sized = bags.join(size, "bug_id")
    met = join_unique(sized, idf.select(F.col("token").alias("term"), "idf", "df"), ["term"], "df", ["bug_id"])
    return met.select("bug_id", "term", (F.col("freq") / F.col("size") * F.col("idf")).alias("w"))


def bag_cosine(bags: DataFrame, idf: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id, cand_id, score``: cosine of tf/length x idf bags; pairs without a common term score 0, without a bag nothing.

    ``idf`` holds ``token, idf, df`` and should be a written table.
    """
    return cosine(bag_weights(bags, idf), pairs)


def cosine(w: DataFrame, pairs: DataFrame) -> DataFrame:
    """``bag_cosine`` of weights ``bug_id, term, w``."""
    norm = w.groupBy("bug_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = w.select(F.col("bug_id").alias("query_id"), "term", F.col("w").alias("wq"))
    c = w.select(F.col("bug_id").alias("cand_id"), "term", F.col("w").alias("wc"))
    dots = pairs.join(q, "query_id").join(c, ["cand_id", "term"]).groupBy("query_id", "cand_id").agg(F.sum(F.col("wq") * F.col("wc")).alias("dot"))
    both = pairs.join(norm.select(F.col("bug_id").alias("query_id"), F.col("norm").alias("nq")), "query_id").join(
        norm.select(F.col("bug_id").alias("cand_id"), F.col("norm").alias("nc")), "cand_id"
    )
    return both.join(dots, ["query_id", "cand_id"], "left").select(
        "query_id", "cand_id", F.coalesce(F.try_divide(F.col("dot"), F.col("nq") * F.col("nc")), F.lit(0.0)).alias("score")
    )
