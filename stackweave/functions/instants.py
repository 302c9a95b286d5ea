"""Time columns whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def epoch_us(local: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone that means UTC."""
    whole = F.unix_date(local.cast("date")).cast("long") * 86400 + F.hour(local) * 3600 + F.minute(local) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("long")


def day(us: Column) -> Column:
    return F.floor(us / DAY_US).cast("long")
