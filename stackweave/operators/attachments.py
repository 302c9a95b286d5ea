"""Which attachment of a report counts as its own trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how long after the report an attachment may come, in microseconds.
NEAR_US = 600_000_000


def first_attachment(reports: DataFrame, attachments: DataFrame, holds_stack: Column | None = None, near_us: int = NEAR_US) -> DataFrame:
    """``bug_id, attachment_id``: each report's earliest attachment, if it came within ``near_us`` of the report.

    ``reports`` holds ``bug_id, ts``, ``attachments`` ``bug_id, attachment_id, at``. With ``holds_stack``, a condition on the attachments, the earliest of those that hold a stack
    is looked at, else the earliest of all; a later one never takes the place of one that came too late. Ties go to the smaller id; nulls in a key give no row.
    """
    some = attachments.where(F.col("bug_id").isNotNull() & F.col("at").isNotNull())
    if holds_stack is not None:
        some = some.where(holds_stack)
    first = some.groupBy("bug_id").agg(F.min(F.struct("at", "attachment_id")).alias("a"))
    near = first.join(reports.select("bug_id", "ts"), "bug_id").where(F.col("a.at") - F.col("ts") <= near_us)
    return near.select("bug_id", F.col("a.attachment_id").alias("attachment_id"))
