"""Candidates as intervals: queries stand in order of time, and a report is a candidate of a few stretches of them.

Pairs of queries and candidates grow with both; intervals grow with the reports. What only needs a part of the pairs works on intervals,
and the pairs themselves are read off them without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import DAY_US
from ..joins import join_unique
from ..session import materialize
from .candidates import stretches
from .ordered import running_sums

#: Queries whose ids stand in one array.
BLOCK = 1024
_LAST = 2**63 - 1


def intervals(reports: DataFrame, queries: DataFrame, window_days: int | None) -> tuple[DataFrame, DataFrame]:
    """(``query_id, bucket, place``, ``cand_id, bucket, begin, end``), both written: queries by their place in time from 0, and the places from ``begin`` to before
    ``end`` at which a report is a candidate, what ``candidates`` gives. The intervals of one report do not overlap."""
    asked = queries.select("bug_id").distinct().join(reports, "bug_id")
    kinds = ["kind", "bucket", "ts", "id", "size", "span"]
    none = F.lit(None).cast("long")
    # Queries come before what else has their instant and id: a report is no candidate of itself.
    points = asked.select(F.lit(0).alias("kind"), "bucket", "ts", F.col("bug_id").alias("id"), none.alias("size"), none.alias("span"))
    points = points.unionByName(reports.select(F.lit(1).alias("kind"), "bucket", "ts", F.col("bug_id").alias("id"), none.alias("size"), none.alias("span")))
    if window_days:
        spans = stretches(reports, window_days).select("bucket", "first", "until", "size", F.col("first.ts").alias("span"))
        points = points.unionByName(spans.select(F.lit(2).alias("kind"), "bucket", F.col("first.ts").alias("ts"), F.col("first.bug_id").alias("id"), "size", "span"))
        points = points.unionByName(spans.select(F.lit(3).alias("kind"), "bucket", ((F.col("until") + 1) * DAY_US - 1).alias("ts"), F.lit(_LAST).alias("id"), "size", "span"))
    run = materialize(running_sums(points.select(*kinds), ["ts", "id", "kind"], {"rank": (F.col("kind") == 0).cast("long")}), "places")
    asked = run.where("kind = 0").select(F.col("id").alias("query_id"), "bucket", (F.col("rank") - 1).alias("place"))
    members = run.where("kind = 1").select(F.col("id").alias("cand_id"), "bucket", "rank")
    if window_days:
        spans = run.where("kind > 1").groupBy("bucket", "span").agg(F.min("rank").alias("begin"), F.max("rank").alias("end"), F.max("size").alias("size"))
        spans = spans.groupBy("bucket").agg(F.collect_list(F.struct("begin", "end")).alias("spans"), F.max("size").alias("size"))
        met = join_unique(members, materialize(spans, "spans"), ["bucket"], "size", ["cand_id"])
        met = met.select("cand_id", "bucket", "rank", F.explode("spans").alias("s")).select("cand_id", "bucket", F.greatest("rank", "s.begin").alias("begin"), F.col("s.end").alias("end"))
    else:
        met = members.select("cand_id", "bucket", F.col("rank").alias("begin"), F.lit(asked.count()).cast("long").alias("end"))
    return asked, materialize(met.where(F.col("begin") < F.col("end")), "intervals")


def pairs_of(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, cand_id`` of all intervals. The queries' ids are broadcast, 8 bytes each; no pair is shuffled, and a task's pairs come by blocks of
    queries, the same ids again and again, which a columnar file holds in little room."""
    blocks = asked.groupBy(F.floor(F.col("place") / BLOCK).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "query_id"))), lambda r: r["query_id"]).alias("ids"))
    block = F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    low, high = F.greatest(F.col("begin") - F.col("block") * BLOCK, F.lit(0)), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK))
    cut = found.select("cand_id", "begin", "end", block.alias("block")).select("cand_id", "block", low.cast("int").alias("low"), high.cast("int").alias("high"))
    # Written, for an order before a join is dropped by the optimizer.
    met = materialize(cut.sortWithinPartitions("block", "low", "high"), "cuts").join(F.broadcast(blocks), "block")
    return met.select("cand_id", F.slice("ids", F.col("low") + 1, F.col("high") - F.col("low")).alias("ids")).select(F.explode("ids").alias("query_id"), "cand_id")


def known(reports: DataFrame, queries: DataFrame, window_days: int | None, listed: DataFrame) -> DataFrame:
    """``query_id, cand_id`` of those listed pairs that are pairs of a query and its candidate; each listed pair meets the few intervals of its candidate."""
    asked, found = intervals(reports, queries, window_days)
    pairs = listed.select("query_id", "cand_id").dropna().distinct().join(asked.select("query_id", "place"), "query_id")
    met = pairs.join(found.select("cand_id", "begin", "end"), "cand_id").where((F.col("begin") <= F.col("place")) & (F.col("place") < F.col("end")))
    return met.select("query_id", "cand_id")
