"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in HOT_PARTS of all rows, so fewer than
#: HOT_PARTS keys can be hot whatever the size of the data.
HOT_PARTS = 1000


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    weight: str,
    row_id: list[str],
    how: str = "inner",
    parts: int = HOT_PARTS,
    merge: bool = False,
) -> DataFrame:
    """Joins ``left`` to the unique-key table ``right`` without a hot key ending in one task.

    ``weight`` is a column of ``right``: the number of rows of ``left`` with the key. A key with
    more than ``1/parts`` of the summed weight is met in as many pieces as it has such parts: its row of ``right`` is repeated for each, and
    its rows of ``left`` are dealt out by ``row_id``. All rows meet in one shuffled join. Only the hashes of hot keys
    and their numbers of pieces are broadcast, fewer than ``parts`` pairs of 12 bytes; at most two times ``parts`` rows of ``right`` are repeats, however wide.
    Null keys match nothing and are dealt out too. ``right`` should be a
    written table or cheap, for it is read twice. Columns of ``right`` must not clash with those
    of ``left`` but for ``on``. ``how`` is ``inner`` or ``left``. ``merge`` keeps Spark from broadcasting ``right`` even while it is below its threshold.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    values = [c for c in right.columns if c not in on and c != weight]
    total = right.agg(F.sum(weight)).scalar()
    share = F.col(weight).cast("double") * parts / total.cast("double")
    # Keys of one hash share the larger number of pieces on both sides.
    hot = right.where(share > 1).groupBy(F.xxhash64(*on).alias("__hash")).agg(F.max(F.ceil(share)).cast("int").alias("__pieces"))
    cut = lambda rows: rows.withColumn("__hash", F.xxhash64(*on)).join(F.broadcast(hot), "__hash", "left").drop("__hash")
    pieces = F.coalesce("__pieces", F.lit(1))
    for c in on:
        pieces = F.when(F.col(c).isNull(), F.lit(parts)).otherwise(pieces)
    dealt = cut(left).withColumn("__piece", F.when(pieces == 1, 0).otherwise(F.pmod(F.xxhash64(*row_id), pieces)).cast("int"))
    repeated = cut(right.select(*on, *values)).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    if merge:
        repeated = repeated.hint("merge")
    return dealt.join(repeated, [*on, "__piece"], how).select(*left.columns, *values)
