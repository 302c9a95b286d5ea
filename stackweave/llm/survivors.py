"""Best representative of each group of duplicates, field by field.

Fields are unpivoted to long rows; values that only say they are missing drop out. ``elect`` sums
votes of source trust times recency decay per normalised value and takes the winner by max_by;
``prefer`` takes the row that is first by a given order instead. ``pivot_back`` makes one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that only say that a value is missing, in lower case.
MISSING = [
    "null", "none", "nil", "nan", "nat", "n/a", "na", "not set", "not specified", "not available", "not recorded", "not given", "not applicable",
    "unset", "unknown", "unspecified", "undefined", "untitled", "missing", "empty", "blank", "tbd", "(no title)", "(none)", "(null)", "(empty)", "(unknown)",
    "(not set)", "(unspecified)", "no summary", "no title", "no value", "no description", "no subject", "(no subject)", "(no summary)", "<none>", "<unknown>", "<null>",
]
HALF_LIFE_DAYS = 365.0


def is_missing(value: Column) -> Column:
    """Null, blank, punctuation only, or a word that says so, in any letter case."""
    t = F.lower(F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " ")))
    return value.isNull() | t.isin(MISSING) | ~t.rlike(r"[\p{L}\p{N}]")


def unpivot(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per field: ``keys..., field_name, value``, missing values as null."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(~is_missing(F.col(f)), F.col(f)).alias("value")) for f in fields])
    return rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.field_name", "e.value")


def prefer(long: DataFrame, group: str, item: str, order: list[Column]) -> DataFrame:
    """``group, field_name, item, value``: of each group of two or more items, each field's row that is last by ``order``.

    Null orders lose. Groups and fields without a value give no row; copies of a row count once.
    """
    has = F.col("value").isNotNull()
    best = F.max(F.when(has, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(item).alias("item"), "value")))
    won = long.where(F.col(group).isNotNull()).groupBy(group, "field_name").agg(best.alias("best"), F.min(item).alias("lo"), F.max(item).alias("hi"))
    won = won.where(F.col("best").isNotNull() & (F.col("lo") != F.col("hi")))
    return won.select(group, "field_name", F.col("best.item").alias(item), F.col("best.value").alias("value"))


def elect(
    long: DataFrame, group: str, item: str, trust: str, instant: str, half_life_days: float = HALF_LIFE_DAYS, now: Column | None = None
) -> DataFrame:
    """``group, field_name, value, vote``: each field's normalised value with the largest sum of votes.

    A vote is 1/trust rank, halved for every ``half_life_days`` of age before ``now``, an instant in microseconds, else the latest one of ``long``, which
    is then read twice; an unknown trust or instant
    votes as rank 100 or 20 years. Copies vote once; of equal sums the value that is first in code-point order wins.
    """
    latest = long.agg(F.max(instant)).scalar() if now is None else now
    age = F.coalesce((latest - F.col(instant)) / 86_400e6, F.lit(7305.0))
    vote = F.exp(-F.ln(F.lit(2.0)) * age / half_life_days) / F.coalesce(F.col(trust), F.lit(100))
    norm = F.lower(F.trim(F.regexp_replace("value", r"[\s\p{Z}]+", " ")))
    once = long.where(F.col("value").isNotNull() & F.col(group).isNotNull()).select(group, "field_name", item, trust, instant, norm.alias("value")).distinct()
    summed = once.groupBy(group, "field_name", "value").agg(F.sum(vote).alias("vote"))
    # Scaled votes are tiny for old items; the sums compare as they are.
    won = summed.groupBy(group, "field_name").agg(F.min(F.struct((-F.col("vote")).alias("v"), "value")).alias("best"))
    return won.select(group, "field_name", F.col("best.value").alias("value"), (-F.col("best.v")).alias("vote"))


def pivot_back(won: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One record a group with its surviving values."""
    return won.groupBy(group).pivot("field_name", fields).agg(F.first("value"))
