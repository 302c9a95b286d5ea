"""Report collections as JSON: scan, lookups, sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REPORT, STACK


def _as_struct(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ":", 1) for c in columns.split(","))


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Reports of one JSON array, or of JSON lines, which unlike an array can be read by many tasks.

    Null rows are dropped; an empty list as ``dup_id`` is null; a bare stack is a list of one.
    """
    if lines:
        raw = spark.read.schema(REPORT).json(path)
    else:
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{_as_struct(REPORT)}>>")).alias("r"))
        raw = whole.select("r.*")
    raw = raw.where("bug_id is not null")
    text = F.when(F.col("stacktrace").startswith("["), F.col("stacktrace")).otherwise(F.concat(F.lit("["), "stacktrace", F.lit("]")))
    return raw.withColumn("dup_id", F.col("dup_id").try_cast("long")).withColumn("stacktrace", F.from_json(text, f"array<{STACK}>"))


def lookup(reports: DataFrame, bug_id: int) -> DataFrame:
    return reports.where(F.col("bug_id") == bug_id)


def last_of_each(reports: DataFrame, order: str) -> DataFrame:
    """The index view: of equal ids the last row by ``order``."""
    others = [c for c in reports.columns if c != "bug_id"]
    return reports.groupBy("bug_id").agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select("bug_id", "r.*")


def contained(reports: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(reports.select("bug_id"), "bug_id", "left_semi")


def flat_frames(reports: DataFrame) -> DataFrame:
    """``bug_id, stack_no, position, depth, function`` of main and first nested stacks."""
    stacks = reports.select("bug_id", F.posexplode("stacktrace").alias("stack_no", "s"))
    joined = F.concat(F.col("s.frames"), F.coalesce(F.get(F.col("s.nested"), F.lit(0))["frames"], F.slice(F.col("s.frames"), 1, 0)))
    frames = stacks.select("bug_id", "stack_no", F.posexplode(joined).alias("position", "f"))
    return frames.select("bug_id", "stack_no", "position", "f.depth", "f.function")


def write_reports(reports: DataFrame, path: str, time_column: str = "creation_ts") -> None:
    """JSON lines; times become seconds since 1970."""
    kinds = dict(reports.dtypes)
    out = reports
    if kinds.get(time_column, "").startswith("timestamp"):
        from ..functions.instants import epoch_us

        seconds = epoch_us(F.col(time_column).cast("timestamp_ntz")) / 1e6
        out = reports.withColumn(time_column, seconds)
    out.write.mode("errorifexists").json(path)
