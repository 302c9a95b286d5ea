"""Candidates of a query: all earlier reports whose bucket was lately active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import day

#: Chunks of days in one window, and parts of a chunk's buckets.
PARTS, SPREAD = 16, 16
#: A bucket with more than one part in HOT_PARTS of all reports is met in as many pieces as it has of these.
HOT_PARTS = 1000


def universe(reports: DataFrame, queries: DataFrame) -> DataFrame:
    """Reports not later than the newest query by (ts, bug_id), and the queries themselves."""
    newest = reports.join(queries.select("bug_id").distinct(), "bug_id", "left_semi").agg(F.max(F.struct("ts", "bug_id"))).scalar()
    return reports.where(F.struct("ts", "bug_id") <= newest)


def _pieces(size: Column, reports: DataFrame) -> Column:
    return (1 + F.floor(size * HOT_PARTS / reports.agg(F.count("*")).scalar())).cast("int")


def stretches(reports: DataFrame, window_days: int) -> DataFrame:
    """``bucket, first, until, size``: the stretches of time in which a query finds the bucket active.

    From after its ``first`` member (ts, bug_id) to the day ``until``. Members of a bucket are first reduced to one row a chunk of days, within which they are near
    enough to each other, so no window holds more rows than there are chunks.
    """
    size = max(1, window_days // PARTS)
    held = reports.groupBy("bucket", F.floor(day(F.col("ts")) / size).alias("chunk")).agg(
        F.min(F.struct("ts", "bug_id")).alias("first"), F.max(day(F.col("ts"))).alias("last"), F.count("*").alias("n")
    )
    w = Window.partitionBy("bucket").orderBy("chunk")
    fresh = F.when(day(F.col("first.ts")) - F.lag("last").over(w) <= window_days, 0).otherwise(1)
    cut = held.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(w)).withColumn("size", F.sum("n").over(Window.partitionBy("bucket")))
    return cut.groupBy("bucket", "span").agg(F.min("first").alias("first"), (F.max("last") + window_days).alias("until"), F.max("size").alias("size")).drop("span")


def _spans(reports: DataFrame, window_days: int) -> DataFrame:
    """``stretches`` with the number of ``pieces`` of each bucket."""
    spans = stretches(reports, window_days)
    return spans.withColumn("pieces", _pieces(F.col("size"), reports)).drop("size")


def _active(reports: DataFrame, queries: DataFrame, window_days: int) -> DataFrame:
    """``query_id, query_ts, bucket, pieces``; every active bucket of a query once."""
    size = max(1, window_days // PARTS)
    chunk = lambda d: F.floor(d / size)
    q = queries.select("bug_id").distinct().join(reports, "bug_id").select(F.col("bug_id").alias("query_id"), F.col("ts").alias("query_ts"))
    q = q.withColumn("chunk", chunk(day(F.col("query_ts")))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spans = _spans(reports, window_days).withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(SPREAD)).cast("int"))
    spans = spans.withColumn("chunk", F.explode(F.sequence(chunk(day(F.col("first.ts"))), chunk(F.col("until")))))
    met = q.join(spans, ["chunk", "part"])
    later = F.col("first") < F.struct(F.col("query_ts").alias("ts"), F.col("query_id").alias("bug_id"))
    return met.where(later & (day(F.col("query_ts")) <= F.col("until"))).select("query_id", "query_ts", "bucket", "pieces")


def bucket_activity(reports: DataFrame, queries: DataFrame, window_days: int) -> DataFrame:
    """``query_id, query_ts, bucket``: buckets with a member before the query and within ``window_days`` days of it.

    Buckets become stretches of activity, which queries meet by the chunk of days they fall in, an equi-join.
    """
    return _active(reports, queries, window_days).drop("pieces")


def candidates(reports: DataFrame, queries: DataFrame, window_days: int | None) -> DataFrame:
    """``query_id, cand_id``: reports strictly earlier than the query by (ts, bug_id), of buckets active in the window.

    Without a window (None or 0) every earlier report is a candidate: an ordered join that grows with queries times reports, as
    asked. With one, both joins are equi-joins, on day chunks and on buckets, a large bucket in pieces. Queries that are no report have no candidates.
    """
    if window_days:
        active = _active(reports, queries, window_days)
        # Fewer than HOT_PARTS buckets have more than one piece.
        sizes = reports.groupBy("bucket").agg(F.count("*").alias("size")).select("bucket", _pieces(F.col("size"), reports).alias("pieces")).where("pieces > 1")
        members = reports.select("bug_id", "bucket", "ts").join(F.broadcast(sizes), "bucket", "left")
        members = members.select("bug_id", "bucket", "ts", F.pmod(F.xxhash64("bug_id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))
        asked = active.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        met = asked.join(members, ["bucket", "piece"])
    else:
        q = queries.select("bug_id").distinct().join(reports, "bug_id").select(F.col("bug_id").alias("query_id"), F.col("ts").alias("query_ts"))
        met = q.join(reports.select("bug_id", "ts"), F.col("ts") <= F.col("query_ts"))
    earlier = F.struct(F.col("ts"), F.col("bug_id")) < F.struct(F.col("query_ts").alias("ts"), F.col("query_id").alias("bug_id"))
    return met.where(earlier).select("query_id", F.col("bug_id").alias("cand_id"))


def evaluated(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """Queries that are scored: those whose label is not false."""
    return queries.join(reports.select("bug_id", "label"), "bug_id").where(F.coalesce("label", F.lit(True))).drop("label")


def masters(reports: DataFrame) -> DataFrame:
    """``bug_id, master_id`` of each report."""
    return reports.select("bug_id", F.col("bucket").alias("master_id"))


def master_sets(reports: DataFrame) -> DataFrame:
    """``master_id, members, first_member, last_member`` of each bucket with a duplicate."""
    sets = reports.groupBy(F.col("bucket").alias("master_id")).agg(F.count("*").alias("members"), F.min("bug_id").alias("first_member"), F.max("bug_id").alias("last_member"))
    return sets.where("members > 1")


def order_violations(reports: DataFrame) -> DataFrame:
    """Members whose master has the larger id, which the input of an evaluation must not have."""
    return reports.where(F.col("dup_id") > F.col("bug_id")).select("bug_id", "dup_id")
