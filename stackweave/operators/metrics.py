"""Quality of ranked lists: recall rate at k, mean reciprocal rank, ROC and AUC of the best score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import running_sums


def hit_positions(ranked: DataFrame, masters: DataFrame, by_bucket: bool = True) -> DataFrame:
    """``query_id, position`` for each listed duplicate: place of the first right candidate, null if there is none.

    With ``by_bucket`` a place counts distinct buckets, each at its best candidate.
    """
    q = masters.select(F.col("bug_id").alias("query_id"), F.col("master_id").alias("q_master")).where("query_id <> q_master")
    c = masters.select(F.col("bug_id").alias("cand_id"), F.col("master_id").alias("c_master"))
    known = ranked.join(q, "query_id").join(c, "cand_id")
    hit = known.where("c_master = q_master").groupBy("query_id").agg(F.min("rec_rank").alias("hit_rank"))
    if by_bucket:
        buckets = known.groupBy("query_id", "c_master").agg(F.min("rec_rank").alias("r"))
        place = buckets.join(hit, "query_id").where(F.col("r") <= F.col("hit_rank")).groupBy("query_id").agg(F.count("*").cast("int").alias("position"))
    else:
        place = hit.select("query_id", F.col("hit_rank").alias("position"))
    return known.select("query_id").distinct().join(place, "query_id", "left")


def bucket_positions(scored: DataFrame, masters: DataFrame) -> DataFrame:
    """``hit_positions`` by bucket straight from ``query_id, cand_id, score``, without an order of the whole lists.

    A bucket stands where its best candidate by (score, cand_id) does, so the right bucket's place is the number of buckets that are as good or better.
    """
    q = masters.select(F.col("bug_id").alias("query_id"), F.col("master_id").alias("q_master")).where("query_id <> q_master")
    c = masters.select(F.col("bug_id").alias("cand_id"), F.col("master_id").alias("c_master"))
    known = scored.where(F.col("query_id") != F.col("cand_id")).join(q, "query_id").join(c, "cand_id")
    best = known.groupBy("query_id", "q_master", "c_master").agg(F.max(F.struct("score", "cand_id")).alias("best"))
    best = materialize(best, "bucket-best")
    hit = best.where("c_master = q_master").select("query_id", F.col("best").alias("hit"))
    place = best.join(hit, "query_id", "left").groupBy("query_id").agg(F.count_if(F.col("best") >= F.col("hit")).alias("n"), F.first("hit").isNotNull().alias("found"))
    return place.select("query_id", F.when(F.col("found"), F.col("n")).cast("int").alias("position"))


def recall_and_mrr(positions: DataFrame, longest: int = 20) -> DataFrame:
    """One row: ``queries``, ``mrr`` and ``recall`` (an array for k = 1 .. ``longest``); null values without any query."""
    reciprocal = F.coalesce(1 / F.col("position"), F.lit(0.0))
    at = [F.avg(F.coalesce((F.col("position") <= k).cast("double"), F.lit(0.0))) for k in range(1, longest + 1)]
    return positions.agg(F.count("*").alias("queries"), F.avg(reciprocal).alias("mrr"), F.array(*at).alias("recall"))


def roc(best: DataFrame) -> DataFrame:
    """``threshold, tpr, fpr`` at each distinct score, falling. ``best`` holds ``score`` and ``positive``; null scores and labels are left out.

    Scores are first counted, so the running sum goes over distinct values only.
    """
    counted = best.where("score is not null and positive is not null").groupBy("score").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("n")
    )
    counted = materialize(counted, "roc")
    totals = counted.agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    run = running_sums(counted, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}).withColumnRenamed("score", "threshold")
    return run.select(
        "threshold", F.try_divide(F.col("tp"), totals.select("p").scalar()).alias("tpr"), F.try_divide(F.col("fp"), totals.select("n").scalar()).alias("fpr")
    )


def auc(best: DataFrame) -> DataFrame:
    """One row ``auc``: chance that a positive scores above a negative, ties half; null without both kinds."""
    counted = best.where("score is not null and positive is not null").groupBy("score").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("n")
    )
    below = running_sums(counted, ["score"], {"upto": F.col("n")}).withColumn("lower", F.col("upto") - F.col("n"))
    won = F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2))
    return below.agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def final_bucket(predictions: DataFrame, masters: DataFrame) -> DataFrame:
    """Predicted buckets followed through predictions to a report that predicts none: ``query_id, bucket``.

    ``predictions`` holds ``query_id`` and ``predicted`` (null for none). Chains are solved as a forest; those that run in
    circles end at the smallest id. Predictions resolve to the predicted report's own master in the end.
    """
    from .hierarchy import hierarchy

    tree = hierarchy(predictions.select(F.col("query_id").alias("id"), F.col("predicted").alias("parent")))
    ends = predictions.join(tree.select(F.col("id").alias("query_id"), "root_id"), "query_id", "left")
    last = F.coalesce("root_id", "predicted", "query_id")
    return ends.select("query_id", last.alias("bug_id")).join(masters, "bug_id", "left").select("query_id", F.coalesce("master_id", "bug_id").alias("bucket"))


def loss(mrr: float | None, auc_value: float | None) -> float:
    """2 less both; missing values count as 0."""
    return 2.0 - ((mrr or 0.0) + (auc_value or 0.0))
