"""Mixed timestamp texts to one instant: a distinct-value dictionary, parsed once and joined back.

The dictionary holds one row per (text, home zone, date order). It is a Parquet table that grows
by the texts it has not met yet; every row of the input then finds its instant by a join. All
parsing is done by built-in expressions; zone rules are those of the JVM, where a clock time
that occurs twice means the first and a skipped one moves forward by the gap.
"""

from __future__ import annotations

import hashlib
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..joins import join_unique
from ..session import materialize, shared_dir, work_path

# Zone abbreviations by home zone, minutes east of UTC.
ABBREVIATIONS = {
    "America/New_York": {"EST": -300, "EDT": -240},
    "America/Los_Angeles": {"PST": -480, "PDT": -420},
    "America/Chicago": {"CST": -360, "CDT": -300},
    "America/Denver": {"MST": -420, "MDT": -360},
    "Europe/London": {"GMT": 0, "BST": 60},
    "Europe/Berlin": {"CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120},
    "Europe/Paris": {"CET": 60, "CEST": 120},
    "Asia/Kolkata": {"IST": 330},
    "Asia/Tokyo": {"JST": 540},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660},
    "Pacific/Auckland": {"NZST": 720, "NZDT": 780},
    "UTC": {},
}
# The range that real instants lie in, seconds since 1970 (2009-01-01, 2021-01-01).
FIRST_S, LAST_S = 1_230_768_000, 1_609_459_200

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MON = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|\[?[a-z]+(?:/[a-z0-9_+-]+)+\]?|\[[a-z0-9_+-]+\])?"
_GAP = r"(?:t|,?\s+)"

#: (pattern, year|month|day|hour|minute|second|fraction|half of the day|zone as groups) by the place of the parts.
_FORMS = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:{_GAP}{_TIME})?\s*{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_DAY}(\d{{1,2}})[-\s]+{_MON}[-\s,]+(\d{{4}})(?:{_GAP}{_TIME})?\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:{_GAP}{_TIME})?\s*{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+{_TIME}\s+(?:{_ZONE}\s+)?(\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t\s]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?)?\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
]
_YEAR_LAST = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:{_GAP}{_TIME})?\s*{_ZONE}$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _known_zones(spark: SparkSession) -> list[str]:
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _seconds(local: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_date(local.cast("date")).cast("long") * 86400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def parse_dictionary(distinct: DataFrame, text: str, home_zone: str, date_order: str) -> DataFrame:
    """Adds ``instant_us``, microseconds since 1970-01-01 UTC, null where the text denotes none.

    Null, blank and unreadable texts, dates and times that do not exist, unknown zones and
    abbreviations foreign to the home zone give null. ``date_order`` other than ``dmy`` or
    ``mdy`` leaves dates with the year last unreadable.
    """
    spark = distinct.sparkSession
    clean = F.lower(F.trim(F.col(text), F.lit(WHITE_SPACE)))
    df = distinct.withColumn("__t", clean)
    t = F.col("__t")
    form = F.lit(None).cast("string")
    order = F.col(date_order)
    cases = [(t.rlike(p), F.regexp_replace(t, p, r)) for p, r in _FORMS]
    cases += [
        (t.rlike(_YEAR_LAST) & (order == "dmy"), F.regexp_replace(t, _YEAR_LAST, "$4|$3|$1|$5|$6|$7|$8|$9|$10")),
        (t.rlike(_YEAR_LAST) & (order == "mdy"), F.regexp_replace(t, _YEAR_LAST, "$4|$1|$3|$5|$6|$7|$8|$9|$10")),
    ]
    for test, made in reversed(cases):
        form = F.when(test, made).otherwise(form)
    number = t.rlike(r"^\d{1,20}(?:\.\d+)?$")
    df = df.withColumn("__parts", F.split(form, r"\|"))
    df = df.withColumn("__whole", F.when(number, F.regexp_extract(t, r"^\d+", 0).try_cast("long")))
    df = df.withColumn("__frac", F.when(number, F.rpad(F.regexp_extract(t, r"\.(\d+)$", 1), 6, "0")))

    whole, frac = F.col("__whole"), F.col("__frac")
    inside = lambda unit: (whole >= F.lit(FIRST_S * unit)) & (whole < F.lit(LAST_S * unit))
    counted = (
        F.when(inside(1), whole * 1_000_000 + F.coalesce(frac.try_cast("long"), F.lit(0)))
        .when(inside(1000), whole * 1000 + F.coalesce(F.substring(frac, 1, 3).try_cast("long"), F.lit(0)))
        .when(inside(1_000_000), whole)
        .when(inside(1_000_000_000), F.expr("__whole div 1000"))
    )

    part = lambda i: F.get(F.col("__parts"), F.lit(i))
    given = lambda i: F.when(part(i) == "", F.lit("0")).otherwise(part(i))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part(1), 1, 3)).cast("int")
    half, hour = part(7), _int(given(3))
    clock = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(None)).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
    second = _int(given(5))
    local = F.try_make_timestamp_ntz(
        _int(part(0)),
        F.coalesce(_int(part(1)), F.when(named > 0, named)),
        _int(part(2)),
        clock,
        _int(given(4)),
        F.when(second < 60, second).cast("decimal(16,6)"),
    )
    df = df.select(
        *distinct.columns,
        counted.alias("__counted"),
        local.alias("__local"),
        F.coalesce(F.substring(F.rpad(part(6), 6, "0"), 1, 6).try_cast("long"), F.lit(0)).alias("__us"),
        F.upper(F.regexp_replace(part(8), r"[\[\]]", "")).alias("__zone"),
    )

    zone, local = F.col("__zone"), F.col("__local")
    ids = _known_zones(spark)
    exact = {z.upper(): z for z in ids if "/" in z}
    by_zone = {f"{z}|{a}": m for z, names in ABBREVIATIONS.items() for a, m in names.items()}
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    home = F.when(F.col(home_zone).isin(ids), F.col(home_zone))
    signed = F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 1)
    hours = F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 3).try_cast("int"), F.lit(0))
    offset = (
        F.when(zone.isin("Z", "UTC", "GMT", "UT"), F.lit(0))
        .when((signed != "") & (hours <= 18) & (minutes < 60), F.when(signed == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes))
        .otherwise(F.try_element_at(as_map(by_zone), F.concat_ws("|", home_zone, zone)))
    )
    region = F.when(zone == "", home).when(zone.contains("/"), F.try_element_at(as_map(exact), zone))
    df = df.select(*distinct.columns, "__counted", "__local", "__us", offset.alias("__offset"), region.alias("__region"))
    regional = _seconds(F.convert_timezone(F.coalesce(F.col("__region"), F.lit("UTC")), F.lit("UTC"), local))
    seconds = F.when(F.col("__offset").isNotNull(), _seconds(local) - F.col("__offset") * 60).when(F.col("__region").isNotNull(), regional)
    return df.select(*distinct.columns, F.coalesce(F.col("__counted"), seconds * 1_000_000 + F.col("__us")).cast("long").alias("instant_us"))


_KEY = ["text", "home_zone", "date_order"]


def dictionary_path(spark: SparkSession) -> str:
    """The dictionary that the shared folder keeps over calls and sessions; rules of parsing are part of its name."""
    rules = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]
    return f"{shared_dir(spark)}/stackweave/instants-{rules}"


def _increments(spark: SparkSession, path: str) -> list[str]:
    """Folders of the dictionary that were written to the end."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/increment-*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().getParent().toString() for s in found or []]


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Parses those (text, home_zone, date_order) of ``keys`` that the dictionary at ``path`` lacks, appends them, returns the dictionary.

    ``keys`` may repeat; the first call makes the dictionary. Each call adds one folder, which counts once it is complete, so a call that fails
    leaves nothing behind; a text that two callers add at a time comes out once.
    """
    spark = keys.sparkSession
    schema = "text string, home_zone string, date_order string, instant_us long"
    held = _increments(spark, path)
    fresh = keys.select(*_KEY).distinct()
    if held:
        fresh = fresh.join(spark.read.schema(schema).parquet(*held).select(*_KEY), _KEY, "left_anti")
    parse_dictionary(fresh, *_KEY).write.parquet(f"{path}/increment-{uuid.uuid4().hex}")
    held = _increments(spark, path)
    whole = spark.read.schema(schema).parquet(*held)
    return whole if len(held) == 1 else whole.groupBy(*_KEY).agg(F.max("instant_us").alias("instant_us"))


def normalize_timestamps(
    rows: DataFrame, sources: DataFrame, row_id: str, text: str, source: str, dictionary: str | None = None
) -> DataFrame:
    """``(row_id, instant_us)`` of each row whose text denotes an instant.

    ``sources`` holds ``source``, ``home_zone`` and ``date_order`` and must be small: it is
    broadcast only while Spark's size estimate allows it. Repeated (row_id, instant) pairs come
    out once; null texts, ids and sources give no row. ``dictionary`` names the kept table; without it
    the dictionary lives for this call. A text with a large share of these rows, which are counted in each call, does not end in
    one task (``join_unique``).
    """
    spark = rows.sparkSession
    keyed = (
        rows.where(F.col(text).isNotNull() & F.col(row_id).isNotNull())
        .select(F.col(row_id).alias("__id"), F.col(text).alias("text"), F.col(source).alias("__source"))
        .join(sources.select(F.col(source).alias("__source"), "home_zone", "date_order").dropDuplicates(["__source"]), "__source")
        .select("__id", "text", F.coalesce("home_zone", F.lit("")).alias("home_zone"), F.coalesce("date_order", F.lit("")).alias("date_order"))
    )
    counts = materialize(keyed.groupBy(*_KEY).agg(F.count("*").alias("n")), "ts-counts")
    known = extend_dictionary(counts, dictionary or work_path(spark, "ts-dictionary"))
    readable = materialize(counts.join(known.where(F.col("instant_us").isNotNull()), _KEY), "ts-readable")
    joined = join_unique(keyed, readable, _KEY, "n", ["__id"])
    return joined.select(F.col("__id").alias(row_id), "instant_us").distinct()
