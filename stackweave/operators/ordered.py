"""Places and running sums over any order, without bringing a group to one task.

Rows are cut into ranges of the order and written; every range is worked on by itself, and a table of one row a range and
group says where it goes on from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _cut(rows: DataFrame, order: list[Column]) -> DataFrame:
    return materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def _columns(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running_sums(rows: DataFrame, order: list[Column | str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows up to this one in ``order``, of equal ``by`` where given.

    ``order`` should be total: of rows that it leaves equal some come first. Sums of integers are longs.
    """
    by, order = by or [], _columns(order)
    cut = _cut(rows.withColumns({f"__v_{n}": c for n, c in sums.items()}), [*map(F.col, by), *order])
    totals = cut.groupBy("__part", *by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__part", *by, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    here = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"__h_{n}": F.sum(f"__v_{n}").over(here) for n in sums})
    on = F.col("l.__part") == F.col("r.__part")
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    joined = out.alias("l").join(before.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns if c not in sums], *[(F.col(f"l.__h_{n}") + F.col(f"r.__b_{n}")).alias(n) for n in sums])


def number_rows(rows: DataFrame, order: list[Column | str], name: str = "place", by: list[str] | None = None) -> DataFrame:
    """Adds the place from 0 in the order of all rows, or of those of equal ``by``."""
    counted = running_sums(rows, order, {name: F.lit(1).cast("long")}, by)
    return counted.withColumn(name, F.col(name) - 1)


def number_falls(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds how often ``value`` failed to rise from one row of its group to the next, up to this row."""
    cut = _cut(rows, [*map(F.col, by), F.col(order)])
    here = Window.partitionBy("__part", *by).orderBy(order)
    fall = lambda now, last: F.when(last.isNull() | (now > last), 0).otherwise(1)
    inner = cut.withColumn("__fall", fall(F.col(value), F.lag(value).over(here))).withColumn("__sum", F.sum("__fall").over(here))
    ends = inner.groupBy("__part", *by).agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"), F.sum("__fall").alias("__n"))
    across = Window.partitionBy(*by).orderBy("__part")
    ends = ends.withColumn("__border", fall(F.col("__first"), F.lag("__last").over(across)))
    ends = ends.withColumn("__before", F.sum(F.col("__border") + F.col("__n")).over(across) - F.col("__n"))
    return inner.join(ends.select("__part", *by, "__before"), ["__part", *by]).withColumn(name, F.col("__sum") + F.col("__before")).select(*rows.columns, name)
