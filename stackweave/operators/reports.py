"""Canonical reports and their stacks from deliveries and flat frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions.instants import epoch_us
from ..joins import join_unique
from ..session import materialize
from .ordered import number_falls


def canonical_reports(deliveries: DataFrame) -> DataFrame:
    """``bug_id, dup_id, bucket, ts, label`` of each report.

    The delivery with the latest ``ingest_ts`` (then the largest ``delivery_id``) is current; ``ts`` is the earliest
    ingest in microseconds. A ``dup_id`` that names no report or the report itself is null; the bucket is it, or else the report.
    """
    order = F.struct("ingest_ts", "delivery_id")
    current = (
        deliveries.where("bug_id is not null")
        .groupBy("bug_id")
        .agg(F.max_by(F.struct(F.col("dup_id").alias("dup"), F.col("label").alias("label")), order).alias("last"), F.min("ingest_ts").alias("first"))
        .select("bug_id", F.col("last.dup").alias("dup"), F.col("last.label").alias("label"), epoch_us(F.col("first")).alias("ts"))
    )
    current = materialize(current, "current")
    named = current.where("dup is not null").groupBy("dup").agg(F.count("*").alias("n"))
    known = named.join(current.select(F.col("bug_id").alias("dup")), "dup").withColumn("known", F.lit(True))
    out = join_unique(current, materialize(known, "named"), ["dup"], "n", ["bug_id"], "left")
    dup = F.when(F.col("known") & (F.col("dup") != F.col("bug_id")), F.col("dup"))
    return out.select("bug_id", dup.alias("dup_id"), F.coalesce(dup, F.col("bug_id")).alias("bucket"), "ts", "label")


def stack_names(flat: DataFrame, max_depth: int = fr.MAX_DEPTH) -> DataFrame:
    """``bug_id, stack_no, names``: each stack's names by depth from 0, null at depths without a frame.

    Frames at ``max_depth`` or below are dropped before they are gathered, so no stack is larger. A key that
    occurs twice keeps the first name in code-point order. Negative and null depths are dropped.
    """
    kept = flat.where((F.col("depth") >= 0) & F.col("bug_id").isNotNull() & F.col("stack_no").isNotNull())
    if max_depth > 0:
        kept = kept.where(F.col("depth") < max_depth)
    once = kept.groupBy("bug_id", "stack_no", "depth").agg(F.min("function").alias("name"))
    made = once.groupBy("bug_id", "stack_no").agg(F.map_from_entries(F.collect_list(F.struct("depth", "name"))).alias("at"), F.max("depth").alias("deepest"))
    return made.select("bug_id", "stack_no", F.transform(F.sequence(F.lit(0), F.col("deepest")), lambda d: F.try_element_at("at", d)).alias("names"))


def encode(stacks: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """``bug_id, stack_no, tokens``: canonical names, unknown ones by report or shared."""
    unknown = fr.unknown_token(F.col("bug_id"), keep_unknown)
    return stacks.select("bug_id", "stack_no", F.transform("names", lambda n: F.coalesce(fr.canonical_name(n), unknown)).alias("tokens"))


def split_by_depth(frames: DataFrame, keys: list[str], order: str, depth: str) -> DataFrame:
    """Numbers the segments of concatenated traces: a depth that does not rise begins a new one. Adds ``segment`` from 0; keys must not be null."""
    return number_falls(frames, keys, order, depth, "segment")


def distinct_stacks(stacks: DataFrame) -> DataFrame:
    """Drops stacks of a report that equal an earlier one of it."""
    return stacks.groupBy("bug_id", "tokens").agg(F.min("stack_no").alias("stack_no")).select("bug_id", "stack_no", "tokens")


def remove_recursion(stacks: DataFrame, mode: str | None, keep_unknown: bool = False) -> DataFrame:
    """``repeats`` collapses repeats, ``jumps`` jumps past recursions, None leaves stacks as they are."""
    if mode is None:
        return stacks
    unknown = fr.unknown_token(F.col("bug_id"), keep_unknown)
    done = {"repeats": fr.collapse_repeats, "jumps": fr.skip_recursion}[mode](F.col("tokens"), unknown)
    return stacks.withColumn("tokens", done)


def with_frequencies(stacks: DataFrame, frequency: DataFrame, default: float = 0.0) -> DataFrame:
    """Adds ``df``: each token's document frequency in percent, aligned with ``tokens``.

    The tokens are exploded and met with the table, a written one, by a join that spreads hot tokens, so the table may be of any size.
    """
    flat = stacks.select("bug_id", "stack_no", F.posexplode("tokens").alias("at", "token"))
    met = join_unique(flat, frequency.select("token", "df", F.col("percent")), ["token"], "df", ["bug_id", "stack_no", "at"], "left")
    rows = met.groupBy("bug_id", "stack_no").agg(F.sort_array(F.collect_list(F.struct("at", "token", F.coalesce("percent", F.lit(default)).alias("p")))).alias("rows"))
    return rows.select("bug_id", "stack_no", F.col("rows.token").alias("tokens"), F.col("rows.p").alias("df"))


def trim(stacks: DataFrame, most_percent: float, ends_only: bool = True, exempt: Callable[[Column], Column] | None = None) -> DataFrame:
    """Drops tokens of more than ``most_percent`` from both ends, or everywhere, but for those that ``exempt`` names; stacks left empty go."""
    stops = F.transform("df", lambda d: d > most_percent)
    if exempt is not None:
        stops = F.zip_with("df", "tokens", lambda d, t: (d > most_percent) & ~exempt(t))
    cut = fr.trim_stops if ends_only else fr.drop_stops
    out = stacks.withColumn("__stops", stops)
    out = out.withColumn("__t", cut(F.col("tokens"), F.col("__stops"))).withColumn("df", cut(F.col("df"), F.col("__stops")))
    return out.select("bug_id", "stack_no", F.col("__t").alias("tokens"), "df").where(F.size("tokens") > 0)


def bag(stacks: DataFrame, longest: int = 1, coded: bool = False) -> DataFrame:
    """``bug_id, term, freq`` of the n-grams of all stacks of a report; none spans two stacks. ``coded`` terms are 64-bit hashes."""
    terms = stacks.select("bug_id", F.explode(fr.ngram_bag(F.col("tokens"), longest)).alias("term"))
    return (terms.select("bug_id", F.xxhash64("term").alias("term")) if coded else terms).groupBy("bug_id", "term").agg(F.count("*").alias("freq"))


def flag_duplicates(reports: DataFrame) -> DataFrame:
    """Adds ``seen_before``: whether another member of the bucket is earlier by (ts, bug_id)."""
    first = materialize(reports.groupBy("bucket").agg(F.min(F.struct("ts", "bug_id")).alias("first"), F.count("*").alias("n")), "first-members")
    both = join_unique(reports, first, ["bucket"], "n", ["bug_id"])
    return both.withColumn("seen_before", F.struct("ts", "bug_id") > F.col("first")).drop("first")


def percent(count: Column, total: Column) -> Column:
    return count.cast("double") / total.cast("double") * 100
