"""Queries of the training-data problems p2, p3, p4, p6, p8, p9 and p10, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import function_term, library_term
from ..joins import join_unique
from ..operators.hierarchy import current_links, hierarchy
from ..operators.timestamps import dictionary_path, normalize_timestamps
from ..session import materialize
from ..tables import table
from . import distinct, leakage, ngrams, runs, stuffing, survivors, tokenizer
from .sql import SQL  # noqa: F401


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stack_frame")


def _record_count(frames: DataFrame):
    return frames.agg(F.count_distinct("bug_id")).scalar()


def _term_counts(frames: DataFrame) -> DataFrame:
    named = frames.withColumn("term", function_term(F.col("function")))
    return distinct.count_terms(named, "bug_id", ["stack_no", "depth"], "term")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    frames = _frames(spark, folder)
    scored = distinct.score_terms(_term_counts(frames), _record_count(frames), "own", least_records=2)
    return distinct.most_distinctive(scored).select(F.col("record").alias("bug_id"), "term")


def p2_llr(spark: SparkSession, folder: str) -> DataFrame:
    """Each report's function with the highest log-likelihood ratio."""
    frames = _frames(spark, folder)
    scored = distinct.score_terms(_term_counts(frames), _record_count(frames), "llr", least_records=2)
    return distinct.most_distinctive(scored).select(F.col("record").alias("bug_id"), "term", F.col("score").alias("llr"))


def _field_terms(frames: DataFrame) -> DataFrame:
    """(field_name, record, suffix) of both fields, copies of a frame once."""
    once = frames.select("bug_id", "stack_no", "depth", function_term(F.col("function")).alias("f"), library_term(F.col("dylib")).alias("l")).distinct()
    fields = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(c).alias("term")) for name, c in (("function", "f"), ("dylib", "l"))])
    long = once.select("bug_id", F.explode(fields).alias("e")).select("bug_id", "e.field_name", "e.term")
    return ngrams.suffixes(long, ["field_name"], "bug_id", [], "", "term", 1)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and reports of every term of both fields, with its mark."""
    frames = _frames(spark, folder)
    counts = ngrams.count_ngrams(_field_terms(frames), ["field_name"], 1)
    return ngrams.mark_terms(counts, _record_count(frames)).withColumnRenamed("ngram", "term")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_counts(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p3_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and reports of every run of one to three function terms at consecutive depths."""
    frames = _frames(spark, folder).withColumn("term", function_term(F.col("function"))).where("term is not null")
    once = frames.select(F.lit("function").alias("field_name"), "bug_id", "stack_no", "depth", "term").distinct()
    cut = ngrams.suffixes(once, ["field_name"], "bug_id", ["stack_no"], "depth", "term", 3)
    counts = ngrams.count_ngrams(cut, ["field_name"], 3)
    return counts.select(F.translate("ngram", ngrams.SEP, "\n").alias("ngram"), "occurrences", "records")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    frames = _frames(spark, folder).withColumn("term", function_term(F.col("function")))
    found = runs.collapse_runs(frames, "bug_id", "stack_no", "depth", "term")
    return found.select(
        F.col("entity").alias("bug_id"), F.col("part").cast("int").alias("stack_no"), F.col("first").cast("int").alias("first_depth"), F.col("last").cast("int").alias("last_depth")
    )


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of alike functions (half of their words or more in common, at most one depth missing), with count and span."""
    frames = _frames(spark, folder).withColumn("term", function_term(F.col("function")))
    found = runs.collapse_runs(frames, "bug_id", "stack_no", "depth", "term", least=0.5, gap=2)
    return found.select(
        F.col("entity").alias("bug_id"), F.col("part").cast("int").alias("stack_no"), "term", F.col("first").alias("first_depth"), F.col("last").alias("last_depth"),
        F.col("n").alias("frames"), (F.col("last") - F.col("first") + 1).alias("span"),
    )


_P6_FIELDS = ["short_desc", "version", "os", "bug_severity"]


def _p6_long(spark: SparkSession, folder: str) -> DataFrame:
    """(root_id, delivery_id, trust, instant_us, ingest_ts, field_name, value) of all deliveries."""
    reports, trackers = table(spark, folder, "bug_report"), table(spark, folder, "tracker")
    kept = reports.where("bug_id is not null")
    sizes = kept.groupBy("bug_id").agg(F.count("*").alias("n"))
    tree = hierarchy(current_links(reports, "bug_id", "dup_id", ["ingest_ts", "delivery_id"])).select(F.col("id").alias("bug_id"), "root_id")
    roots = materialize(sizes.join(tree, "bug_id", "left").select("bug_id", F.coalesce("root_id", "bug_id").alias("root_id"), "n"), "roots")
    instants = normalize_timestamps(reports, trackers, "delivery_id", "creation_ts", "tracker_id", dictionary_path(spark))
    base = kept.select("bug_id", "delivery_id", "tracker_id", "ingest_ts", *_P6_FIELDS)
    base = join_unique(base, roots, ["bug_id"], "n", ["delivery_id"]).drop("bug_id")
    ranks = trackers.groupBy("tracker_id").agg(F.min("trust_rank").alias("trust"))
    base = base.join(ranks, "tracker_id", "left").join(instants, "delivery_id", "left")
    return survivors.unpivot(base, ["root_id", "delivery_id", "trust", "instant_us", "ingest_ts"], _P6_FIELDS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    order = [-F.col("trust"), F.col("instant_us"), F.col("ingest_ts")]
    return survivors.prefer(_p6_long(spark, folder), "root_id", "delivery_id", order).drop("value")


def p6_votes(spark: SparkSession, folder: str) -> DataFrame:
    """One record a group, each field's value by the sum of its votes; ages count from the latest instant of all deliveries."""
    won = survivors.elect(materialize(_p6_long(spark, folder), "fields"), "root_id", "delivery_id", "trust", "instant_us")
    return survivors.pivot_back(won, "root_id", _P6_FIELDS)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str, edited: bool = False) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"), "doc_id", "item_id", "text", edited=edited)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("longest_run") >= leakage.PASSAGE).select("doc_id", "item_id")


def p9_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item's passage whole or edited: score of the best local alignment and longest run of equal words."""
    return _leaks(spark, folder, edited=True).select("doc_id", "item_id", "score", "longest_run")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = stuffing.find_stuffed(table(spark, folder, "documents"), "doc_id", "text")
    return found.where(F.col("stuffed_words") * 2 > F.col("words")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_llr, p3_found, p3_counts, p3_ngrams, p4_found, p4_runs, p6_found, p6_votes, p8_ids, p9_found, p9_alignments, p10_found)
}
