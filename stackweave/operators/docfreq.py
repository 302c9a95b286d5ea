"""Document frequencies: static, by stack, and as they stood at each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import join_unique
from ..session import materialize
from .ordered import running_sums


def document_frequency(stacks: DataFrame, by_stack: bool = False) -> DataFrame:
    """``token, df, percent``: reports, or stacks, that hold each token, and their share of all."""
    key = ["bug_id", "stack_no"] if by_stack else ["bug_id"]
    total = stacks.select(*key).distinct().agg(F.count("*")).scalar()
    held = stacks.select(*key, F.explode("tokens").alias("token")).distinct()
    counted = held.groupBy("token").agg(F.count("*").alias("df"))
    return counted.select("token", "df", percent_of(F.col("df"), total).alias("percent"))


def percent_of(count: Column, total: Column) -> Column:
    return count.cast("double") / total.cast("double") * 100


def inverse_frequency(frequency: DataFrame, total: "F.Column") -> DataFrame:
    """``token, idf, df``; idf = documents / df, not logged."""
    return frequency.select("token", (total.cast("double") / (F.col("df") + F.lit(1e-11))).alias("idf"), "df")


def frequency_at_queries(stacks: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """``query_ord, bug_id, token, df, total``: frequencies of each query's own tokens when it is scored.

    ``queries`` holds ``query_ord`` and ``bug_id``; ``base`` the other reports that count from the beginning. A query is
    added before it is scored, so the k-th sees the base and the first k queries; repeated queries count each time.
    The running count goes over one token's queries, not over its reports, and no token's queries end in one task.
    """
    held = stacks.select("bug_id", F.explode("tokens").alias("token")).distinct()
    base_df = held.join(base.select("bug_id"), "bug_id", "left_semi").groupBy("token").agg(F.count("*").alias("base_df"))
    # A query without stacks counts as a document too.
    total = base.agg(F.count("*")).scalar()
    asked = queries.select("query_ord", "bug_id").join(held, "bug_id")
    asked = running_sums(asked, ["query_ord"], {"added": F.lit(1).cast("long")}, by=["token"])
    counts = asked.groupBy("token").agg(F.count("*").alias("n")).join(base_df, "token", "left")
    met = join_unique(asked, materialize(counts, "token-counts"), ["token"], "n", ["query_ord"])
    return met.select(
        "query_ord", "bug_id", "token", (F.coalesce("base_df", F.lit(0)) + F.col("added")).alias("df"), (total + F.col("query_ord") + 1).alias("total")
    )


def unit_tfidf(tokens: DataFrame) -> DataFrame:
    """``doc_id, term, weight``: tf x ln(N / df), each document scaled to unit length; documents of zero length give no row.

    ``tokens`` holds ``doc_id`` and ``terms``, an array. Terms in every document weigh 0.
    """
    total = tokens.agg(F.count("*")).scalar().cast("double")
    tf = materialize(tokens.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "tf")
    df = materialize(tf.groupBy("term").agg(F.count("*").alias("df"), F.count("*").alias("n")), "df")
    raw = join_unique(tf, df, ["term"], "n", ["doc_id"]).select("doc_id", "term", (F.col("tf") * F.ln(total / F.col("df"))).alias("w"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").where(F.col("norm") > 0).select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
