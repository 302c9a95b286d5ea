"""Folders of crash reports: bucket / report / file, plain or gzip, in Latin-1."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import file_priority


def printable(text: Column) -> Column:
    """Control, format and unassigned characters but line ends, and replacement characters, as ``?``."""
    return F.regexp_replace(text, r"[\p{C}�&&[^\n]]", "?")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``bucket, bug_id, file, text`` of every file below ``folder``; gzip files are unpacked by their ending."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("latin-1"))

    text = F.pandas_udf(decode, "string")
    path = F.split(F.col("path"), "/")
    at = lambda k: F.url_decode(F.regexp_replace(F.element_at(path, k), r"\+", "%2B"))
    return raw.select(at(-3).alias("bucket"), at(-2).try_cast("long").alias("bug_id"), at(-1).alias("file"), printable(text("content")).alias("text"))


def first_trace(files: DataFrame) -> DataFrame:
    """``bucket, bug_id, file, text`` of each report's trace file that is tried first."""
    ranked = files.withColumn("place", file_priority(F.col("file"))).where("place is not null")
    best = F.min_by(F.struct("file", "text"), "place").alias("best")
    return ranked.groupBy("bucket", "bug_id").agg(best).select("bucket", "bug_id", "best.file", "best.text")
