"""Ranked recommendation lists: order, cut, repair, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import number_rows
from .pairs import NOT_RANKED


def rank(scored: DataFrame) -> DataFrame:
    """Adds ``rec_rank`` from 1 by (score, cand_id), both descending; a query is no candidate of itself.

    Whole lists: rows are ranged by (query, score), so a query with very many candidates is ranked by many tasks.
    """
    order = [F.desc("score"), F.desc("cand_id")]
    numbered = number_rows(scored.where(F.col("query_id") != F.col("cand_id")), order, "rec_rank", ["query_id"])
    return numbered.withColumn("rec_rank", (F.col("rec_rank") + 1).cast("int"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each list, with ``rec_rank``. Each task keeps the best ``n`` of its own rows first, so nothing larger is shuffled."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cand_id"))
    kept = scored.where(F.col("query_id") != F.col("cand_id")).withColumn("rec_rank", F.row_number().over(w))
    return kept.where(F.col("rec_rank") <= n)


def top_or_first_hit(ranked: DataFrame, masters: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n``, for a duplicate on to its first candidate of its own bucket; one without such a candidate keeps all."""
    q = masters.select(F.col("bug_id").alias("query_id"), F.col("master_id").alias("q_master"))
    c = masters.select(F.col("bug_id").alias("cand_id"), F.col("master_id").alias("c_master"))
    known = ranked.join(q, "query_id").join(c, "cand_id", "left")
    hit = F.when(F.col("c_master") == F.col("q_master"), F.col("rec_rank"))
    first = known.groupBy("query_id").agg(F.min(hit).alias("first_hit"), F.first("q_master").alias("q_master"))
    limit = F.when(F.col("q_master") == F.col("query_id"), F.lit(n)).when(F.col("first_hit").isNull(), F.lit(2**31 - 1)).otherwise(F.greatest(F.col("first_hit"), F.lit(n)))
    return ranked.join(first.select("query_id", limit.alias("limit")), "query_id").where(F.col("rec_rank") <= F.col("limit")).select(*ranked.columns)


def repair(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Appends missing candidates at the score of unranked ones, larger ids first; ranks go on from the list's end."""
    asked = candidates.select("query_id", "cand_id")
    missing = asked.join(ranked.select("query_id", "cand_id"), ["query_id", "cand_id"], "left_anti").select("query_id", "cand_id", F.lit(NOT_RANKED).alias("score"))
    both = ranked.select("query_id", "cand_id", "score", F.col("rec_rank").alias("old")).unionByName(missing.withColumn("old", F.lit(None).cast("int")))
    placed = number_rows(both, [F.asc_nulls_last("old"), F.desc("cand_id")], "rec_rank", ["query_id"])
    return placed.select("query_id", "cand_id", "score", (F.col("rec_rank") + 1).cast("int").alias("rec_rank"))


def reuse(made: DataFrame, older: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """Lists of which the first ``n`` queries' are those of an older run, the others the new ones.

    ``order`` holds ``query_id`` and ``number`` from 0. A query among the first ``n`` that the older run lacks has no list.
    """
    early = order.where(F.col("number") < n).select("query_id")
    columns = ["query_id", "cand_id", "score", "rec_rank"]
    kept = older.join(early, "query_id", "left_semi").select(*columns)
    return kept.unionByName(made.join(early, "query_id", "left_anti").select(*columns))


def violations(ranked: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, problem``: lists with foreign candidates, lists of no query, and queries without a list."""
    keys = ["query_id", "cand_id"]
    foreign = ranked.join(candidates, keys, "left_anti").select("query_id", F.lit("foreign candidate").alias("problem"))
    listed = ranked.select("query_id").distinct()
    asked = queries.select(F.col("bug_id").alias("query_id")).distinct()
    unasked = listed.join(asked, "query_id", "left_anti").select("query_id", F.lit("not a query").alias("problem"))
    missing = asked.join(listed, "query_id", "left_anti").select("query_id", F.lit("no list").alias("problem"))
    return foreign.unionByName(unasked).unionByName(missing).distinct()
