"""Canonical duplicate buckets: missing masters, cycles, trees, oldest masters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import join_unique
from ..session import materialize
from .hierarchy import hierarchy


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with equal ``key`` the first by ``order``; null keys are dropped."""
    others = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("best")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*").select(*rows.columns)


def accept(rows: DataFrame, newest_us: int | None = None, texts: list[str] | None = None) -> DataFrame:
    """Reports not later than ``newest_us`` whose ``texts`` are all neither null nor blank."""
    out = rows if newest_us is None else rows.where(F.col("ts") <= newest_us)
    for t in texts or []:
        out = out.where(F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit("")) != "")
    return out


def adopt_orphans(reports: DataFrame) -> DataFrame:
    """Gives buckets whose master is no report their oldest member, by (ts, bug_id), as master.

    ``reports`` holds ``bug_id, dup_id, ts``. Reports that already name the new master stay with it, so both sets merge.
    """
    ids = reports.select(F.col("bug_id").alias("dup_id"), F.lit(True).alias("known"))
    lost = reports.where("dup_id is not null").join(ids, "dup_id", "left_anti")
    heads = lost.groupBy("dup_id").agg(F.min_by("bug_id", F.struct("ts", "bug_id")).alias("head"), F.count("*").alias("n"))
    heads = materialize(heads, "heads")
    both = join_unique(reports, heads, ["dup_id"], "n", ["bug_id"], "left")
    new = F.when(F.col("head").isNull(), F.col("dup_id")).when(F.col("head") != F.col("bug_id"), F.col("head"))
    return both.withColumn("dup_id", new).select(*reports.columns)


def break_cycles(links: DataFrame) -> DataFrame:
    """``id, parent`` without cycles: of each cycle the smallest id loses its parent. A node that names itself loses it too."""
    tree = hierarchy(links)
    cut = tree.where("on_cycle and id = root_id").select("id", F.lit(True).alias("cut"))
    return links.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"))


def break_two_cycles(links: DataFrame) -> DataFrame:
    """Of two nodes that name each other the smaller loses its parent."""
    back = links.select(F.col("id").alias("parent"), F.col("parent").alias("id"), F.lit(True).alias("back"))
    both = links.join(back, ["id", "parent"], "left")
    return both.select("id", F.when(F.col("back").isNull() | (F.col("id") > F.col("parent")), F.col("parent")).alias("parent"))


def flatten(links: DataFrame) -> DataFrame:
    """``id, parent`` with every node's parent its root; ``links`` must be free of cycles."""
    tree = hierarchy(links).select("id", "root_id")
    return links.select("id").join(tree, "id", "left").select("id", F.col("root_id").alias("parent"))


def nested_masters(links: DataFrame) -> DataFrame:
    """``id, parent`` of nodes whose parent has a parent; empty for flat buckets."""
    inner = links.where("parent is not null").select(F.col("id").alias("parent"))
    return links.join(inner, "parent", "left_semi").select("id", "parent")


def remaster_oldest(reports: DataFrame) -> DataFrame:
    """``bug_id, original_bug_id, dup_id``: the oldest member by (ts, bug_id) masters its bucket and gets the smallest id.

    If a smaller id exists in the bucket, the two reports swap ids and both keep theirs in ``original_bug_id``, null for all others.
    ``reports`` holds ``bug_id, bucket, ts``. Members are compared with their bucket's row by a join, never gathered.
    """
    heads = reports.groupBy("bucket").agg(F.min_by("bug_id", F.struct("ts", "bug_id")).alias("oldest"), F.min("bug_id").alias("least"), F.count("*").alias("n"))
    both = join_unique(reports.select("bug_id", "bucket"), materialize(heads, "bucket-heads"), ["bucket"], "n", ["bug_id"])
    swapped = F.col("oldest") != F.col("least")
    new = F.when(swapped & (F.col("bug_id") == F.col("oldest")), F.col("least")).when(swapped & (F.col("bug_id") == F.col("least")), F.col("oldest")).otherwise(F.col("bug_id"))
    out = both.withColumn("new", new)
    return out.select(
        F.col("new").alias("bug_id"), F.when(F.col("new") != F.col("bug_id"), F.col("bug_id")).alias("original_bug_id"), F.when(F.col("new") != F.col("least"), F.col("least")).alias("dup_id")
    )


def masters_of_labels(rows: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``bug_id, dup_id`` from bucket labels: the first by (ts, bug_id) is master.

    ``rows`` holds ``bug_id, bucket, ts``. With ``labelled`` (a table of ``bug_id``), unlabelled members of buckets of more than one are dropped first.
    """
    kept = rows
    if labelled is not None:
        sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count("*").alias("size")), "bucket-sizes")
        known = labelled.select("bug_id").distinct().withColumn("known", F.lit(True))
        kept = join_unique(rows, sizes, ["bucket"], "n", ["bug_id"]).join(known, "bug_id", "left").where((F.col("size") == 1) | F.col("known")).select(*rows.columns)
    heads = kept.groupBy("bucket").agg(F.min_by("bug_id", F.struct("ts", "bug_id")).alias("head"), F.count("*").alias("n"))
    both = join_unique(kept, materialize(heads, "label-heads"), ["bucket"], "n", ["bug_id"])
    return both.select("bug_id", F.when(F.col("head") != F.col("bug_id"), F.col("head")).alias("dup_id"))


def enrich_dates(rows: DataFrame, dates: DataFrame, fallback: str) -> DataFrame:
    """Adds ``created``: the date that ``dates`` (``bug_id, created``) has, or else ``fallback`` read as ``Www Mmm dd hh:mm:ss yyyy``; null if unreadable."""
    text = F.regexp_extract(fallback, r"^\w{3} (\w{3} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4})$", 1)
    read = F.try_to_timestamp(F.regexp_replace(text, " +", " "), F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz")
    named = dates.select("bug_id", F.col("created").alias("__known"))
    return rows.join(named, "bug_id", "left").withColumn("created", F.coalesce("__known", read)).drop("__known")


def clean_output(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Drops ``_id``, ``attachments`` and columns named ``*.txt``; missing texts become empty."""
    kept = [c for c in rows.columns if c not in ("_id", "attachments") and not c.endswith(".txt")]
    return rows.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) if c in texts else F.col(f"`{c}`") for c in kept])
