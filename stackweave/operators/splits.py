"""Splits by time: fractions of duplicates, counts since a date, dates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import DAY_US, day
from .ordered import number_rows


def _border(duplicates: DataFrame, place: "F.Column | int") -> "F.Column":
    """(ts, bug_id) of the duplicate at a place of their order, as a scalar; null if there is none."""
    numbered = number_rows(duplicates.select("ts", "bug_id"), ["ts", "bug_id"])
    return numbered.where(F.col("place") == place).agg(F.first(F.struct("ts", "bug_id"))).scalar()


def split_fraction(reports: DataFrame, test_share: float) -> DataFrame:
    """Adds ``part``: reports up to the duplicate at int((1 - share) x duplicates) train, the later ones test.

    ``reports`` holds ``bug_id, ts, seen_before``; without any duplicate all train.
    """
    duplicates = reports.where("seen_before")
    place = F.floor((1 - F.lit(test_share)) * duplicates.agg(F.count("*")).scalar())
    border = _border(duplicates, place)
    later = F.struct("ts", "bug_id") > border
    return reports.withColumn("part", F.when(later, "test").otherwise("training"))


def split_after(reports: DataFrame, since_us: int, count: int) -> DataFrame:
    """Adds ``part``: training lasts until ``count`` duplicates were seen since ``since_us``."""
    if count <= 0:
        return split_date(reports, since_us)
    border = _border(reports.where(F.col("seen_before") & (F.col("ts") >= since_us)), count - 1)
    later = (F.col("ts") >= since_us) & (F.struct("ts", "bug_id") > border)
    return reports.withColumn("part", F.when(later, "test").otherwise("training"))


def split_date(reports: DataFrame, date_us: int) -> DataFrame:
    """Adds ``part``: reports before the date train, the others test."""
    return reports.withColumn("part", F.when(F.col("ts") < date_us, "training").otherwise("test"))


def split_validation(parts: DataFrame, share: float | None = None, date_us: int | None = None) -> DataFrame:
    """Cuts ``validation`` off the training part: after its duplicate at int((1 - share) x duplicates), or from a date on."""
    training = parts.where("part = 'training'")
    if date_us is not None:
        later = F.col("ts") >= date_us
    else:
        duplicates = training.where("seen_before")
        later = F.struct("ts", "bug_id") > _border(duplicates, F.floor((1 - F.lit(share)) * duplicates.agg(F.count("*")).scalar()))
    return parts.withColumn("part", F.when((F.col("part") == "training") & later, "validation").otherwise(F.col("part")))


def chunk(reports: DataFrame, start_day: int, test_days: int, validation_duplicates: int) -> DataFrame:
    """``bug_id, part, duplicate`` around a start day: test from it on for ``test_days``, validation back to the given number of duplicates, training before.

    ``reports`` holds ``bug_id, ts, dup_id``. Reports after the window are left out. With fewer duplicates all earlier reports validate.
    """
    start, end = start_day * DAY_US, (start_day + test_days) * DAY_US
    before = reports.where(F.col("ts") < start)
    count = before.where("dup_id is not null").agg(F.count("*")).scalar()
    border = _border(before.where("dup_id is not null"), count - validation_duplicates)
    early = (F.struct("ts", "bug_id") < border)
    part = F.when(F.col("ts") >= start, "test").when(early, "training").otherwise("validation")
    return reports.where(F.col("ts") < end).select("bug_id", part.alias("part"), F.col("dup_id").isNotNull().alias("duplicate"))


def random_starts(reports: DataFrame, count: int, test_days: int, earliest_duplicates: int, seed: int) -> DataFrame:
    """``chunk, start_day``: ``count`` different days drawn at random, the same for the same seed.

    Days run from that of the duplicate number ``earliest_duplicates`` to ``test_days`` before the newest report; with fewer days than asked for all come out,
    and none without so many duplicates. ``reports`` holds ``bug_id, ts, dup_id``.
    """
    border = _border(reports.where("dup_id is not null"), earliest_duplicates - 1)
    days = reports.agg(day(F.max("ts")).alias("newest")).select(day(border["ts"]).alias("lo"), (F.col("newest") - test_days).alias("hi"))
    every = days.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("start_day"))
    drawn = every.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "start_day"))).orderBy("draw", "start_day").limit(count)
    return drawn.select((F.row_number().over(Window.orderBy("draw", "start_day")) - 1).alias("chunk"), "start_day")


def random_chunks(reports: DataFrame, count: int, test_days: int, validation_duplicates: int, seed: int, earliest_duplicates: int = 0) -> DataFrame:
    """``chunk, bug_id, part, duplicate`` of ``chunk`` around each of ``random_starts``; the days drawn, ``count`` numbers, are read by the driver.

    The first day has ``earliest_duplicates``, or else ``validation_duplicates``, duplicates up to it.
    """
    starts = random_starts(reports, count, test_days, earliest_duplicates or validation_duplicates, seed).collect()
    out = reports.select(F.lit(0).alias("chunk"), "bug_id", F.lit("").alias("part"), F.lit(False).alias("duplicate")).limit(0)
    for r in starts:
        made = chunk(reports, r.start_day, test_days, validation_duplicates)
        out = out.unionByName(made.select(F.lit(r.chunk).alias("chunk"), "bug_id", "part", "duplicate"))
    return out


def not_after(reports: DataFrame, ts: int, bug_id: int) -> DataFrame:
    """Reports with (ts, bug_id) not after the given one."""
    return reports.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("bug_id") <= bug_id)))
