"""Queries of the crash-report operators over the whole test tables; their SQL is in ``reference_sql``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import kernels, parsing, text
from ..functions.instants import DAY_US, day, epoch_us
from ..operators import attachments
from ..operators import candidates as cand
from ..operators import canonical, docfreq, intervals, metrics, ordered, pairs, ranking, reports, splits
from ..plans import scoring, sweep
from ..session import materialize, spread
from ..sources import datasets, recommendations
from ..tables import table
from .reference_sql import SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Window of candidates, in days.
WINDOW = 730
#: 2015-01-01 and 2017-01-01 in days since 1970.
DAY_2015, DAY_2017 = 16436, 17167


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _add(name: str, f: Query) -> None:
    f.__name__ = name
    query(f)


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return reports.canonical_reports(table(spark, folder, "bug_report"))


def _stacks(spark: SparkSession, folder: str, max_depth: int = fr.MAX_DEPTH) -> DataFrame:
    return reports.encode(reports.stack_names(table(spark, folder, "stack_frame"), max_depth))


def _weighed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    stacks = materialize(_stacks(spark, folder), "stacks")
    frequency = materialize(docfreq.document_frequency(stacks), "frequency")
    return reports.with_frequencies(stacks, frequency), frequency


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_report").select("bug_id").where("bug_id is not null").distinct()


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended pairs, copies once."""
    return table(spark, folder, "recommendation").select("query_id", "cand_id").dropna().distinct()


def _six(c: str | Column) -> Column:
    return F.round(c, 6)


# Reports, frames, stacks.


@query
def reports_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder)


@query
def frames_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _stacks(spark, folder)


@query
def frames_maxdepth(spark: SparkSession, folder: str) -> DataFrame:
    return _stacks(spark, folder, 5)


@query
def frames_distinct_stacks(spark: SparkSession, folder: str) -> DataFrame:
    return reports.distinct_stacks(_stacks(spark, folder))


@query
def fn_canonical(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "stack_frame").select("function").where("function is not null").distinct()
    return names.select("function", fr.canonical_name(F.col("function")).alias("canonical"))


@query
def fn_module_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stack_frame").select("function", "file", "dylib").where("function is not null").distinct()
    space, file = fr.module_of(F.col("function"), "namespace"), fr.module_of(F.col("function"), "file", F.col("file"), F.col("dylib"))
    return rows.select("function", "file", "dylib", space["function"].alias("inner_function"), space["module"].alias("namespace"), file["module"].alias("file_module"))


_JAVA_CALL = r"\tat ([\w.$]+)\("


@query
def fn_package(spark: SparkSession, folder: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(_JAVA_CALL), F.lit(1))
    docs = _documents(spark, folder).select("doc_id", names.alias("names")).where(F.size("names") > 0)
    return docs.select("doc_id", fr.package_tokens(F.col("names"), F.col("doc_id"), max_depth=0).alias("packages"))


@query
def depth_segments(spark: SparkSession, folder: str) -> DataFrame:
    """All stacks of a report as one run of frames, cut again where the depth falls."""
    once = table(spark, folder, "stack_frame").select("bug_id", "stack_no", "depth").distinct()
    placed = once.withColumn("place", F.col("stack_no").cast("long") * 100_000 + F.col("depth"))
    return reports.split_by_depth(placed, ["bug_id"], "place", "depth").select("bug_id", "place", "depth", F.col("segment").cast("int").alias("segment"))


@query
def recursion_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.remove_recursion(_stacks(spark, folder), "repeats")


@query
def recursion_jumps(spark: SparkSession, folder: str) -> DataFrame:
    return reports.remove_recursion(_stacks(spark, folder), "jumps")


# Document frequencies and bags.


@query
def df_reports(spark: SparkSession, folder: str) -> DataFrame:
    return docfreq.document_frequency(_stacks(spark, folder)).select("token", "df", _six("percent").alias("percent"))


@query
def df_stacks(spark: SparkSession, folder: str) -> DataFrame:
    return docfreq.document_frequency(_stacks(spark, folder), by_stack=True).select("token", "df", _six("percent").alias("percent"))


@query
def df_asof(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "query_report").select("chunk_id", "query_ord", "bug_id").where("bug_id is not null").distinct()
    numbered = materialize(ordered.number_rows(asked, ["chunk_id", "query_ord", "bug_id"]).select(F.col("place").alias("query_ord"), "bug_id"), "numbered")
    canonical_ = materialize(_reports(spark, folder), "canonical")
    base = cand.universe(canonical_, numbered).join(numbered, "bug_id", "left_anti")
    return docfreq.frequency_at_queries(materialize(_stacks(spark, folder), "stacks"), numbered, base)


@query
def bow_idf(spark: SparkSession, folder: str) -> DataFrame:
    stacks = _stacks(spark, folder)
    total = stacks.agg(F.count_distinct("bug_id")).scalar()
    return docfreq.inverse_frequency(docfreq.document_frequency(stacks), total).select("token", _six("idf").alias("idf"))


@query
def trim_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return reports.trim(_weighed(spark, folder)[0], 5.0).select("bug_id", "stack_no", "tokens")


@query
def drop_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return reports.trim(_weighed(spark, folder)[0], 5.0, ends_only=False).select("bug_id", "stack_no", "tokens")


@query
def tf_bag(spark: SparkSession, folder: str) -> DataFrame:
    return reports.bag(_stacks(spark, folder))


@query
def ngram_bag(spark: SparkSession, folder: str) -> DataFrame:
    return reports.bag(_stacks(spark, folder), 3)


@query
def tfidf_unit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    terms = docs.select("doc_id", text.alphanumeric_tokens(F.lower("text")).alias("terms"))
    return docfreq.unit_tfidf(terms).select("doc_id", "term", _six("weight").alias("weight"))


# Candidates.


@query
def cands_all(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.pairs_of(*intervals.intervals(materialize(_reports(spark, folder), "canonical"), _asked(spark, folder), None))


@query
def cands_window(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.pairs_of(*intervals.intervals(materialize(_reports(spark, folder), "canonical"), _asked(spark, folder), WINDOW))


@query
def bucket_activity(spark: SparkSession, folder: str) -> DataFrame:
    return cand.bucket_activity(materialize(_reports(spark, folder), "canonical"), _asked(spark, folder), WINDOW).select("query_id", "bucket")


@query
def cands_universe(spark: SparkSession, folder: str) -> DataFrame:
    return cand.universe(_reports(spark, folder), _asked(spark, folder)).select("bug_id", "ts")


@query
def queries_evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return cand.evaluated(_asked(spark, folder), _reports(spark, folder))


# Kernels, over all stack pairs of all recommended pairs.


def _cells(spark: SparkSession, folder: str, kernel: Callable[..., Column], weighted: bool = False, coded: bool = True) -> DataFrame:
    stacks = _weighed(spark, folder)[0] if weighted else _stacks(spark, folder)
    cells = pairs.score_cells(_listed(spark, folder), stacks, kernel, weighted, coded)
    return cells.withColumn("score", _six("score"))


def _pair_query(name: str, make: Callable[[], Callable[..., Column]], weighted: bool = False, coded: bool = True) -> None:
    _add(name, lambda spark, folder: _cells(spark, folder, make(), weighted, coded))


_pair_query("sim_prefix", lambda: kernels.common_prefix)
_pair_query("sim_overlap", lambda: lambda q, c: kernels.multiset_overlap(q, c))
_pair_query("sim_overlap_merge", lambda: lambda q, c: kernels.pair_kernel(kernels.merge_overlap)(F.array_sort(q), F.array_sort(c)), coded=False)
_pair_query("sim_nw", lambda: kernels.pair_kernel(partial(kernels.optimal_alignment, indel=0.5, mismatch=1.0, match=2.0)))
_pair_query("sim_positional", lambda: kernels.pair_kernel(kernels.positional_similarity))
_pair_query("sim_dl", lambda: kernels.pair_kernel(kernels.edit_similarity))
_pair_query("sim_levenshtein", lambda: kernels.pair_kernel(partial(kernels.edit_similarity, transpositions=False)))
_pair_query("sim_linear", lambda: kernels.weighted_kernel(kernels.linear_alignment), True)
WEIGHTED_SETTINGS: dict[str, dict] = {
    "default": {}, "exponential": {"reciprocal": False}, "no_sum": {"total": False}, "no_norm": {"no_norm": True},
    "const": {"const_match": True, "const_gap": True, "const_mismatch": True}, "sigmoid": {"sigmoid": True}, "sigmoid_idf": {"sigmoid": True, "idf": True}, "linear": {"linear": True},
}
for _name, _given in WEIGHTED_SETTINGS.items():
    _pair_query(f"sim_weighted_{_name}", lambda given=_given: kernels.weighted_kernel(partial(kernels.weighted_alignment, p=kernels.Weighted(**given))), True)


@query
def sim_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Module-aware distance; modules are namespaces, functions what is left of the name."""
    stacks = _stacks(spark, folder)
    unknown = lambda t: t.startswith("??")
    module = lambda t: F.when(unknown(t), "").otherwise(F.coalesce(fr.module_of(t, "namespace")["module"], F.lit("")))
    function = lambda t: F.when(unknown(t), "").otherwise(fr.module_of(t, "namespace")["function"])
    both = stacks.select("bug_id", "stack_no", F.transform("tokens", module).alias("m"), F.transform("tokens", function).alias("f"))
    q = both.select(F.col("bug_id").alias("query_id"), F.col("stack_no").alias("q_stack"), F.col("m").alias("qm"), F.col("f").alias("qf"))
    c = both.select(F.col("bug_id").alias("cand_id"), F.col("stack_no").alias("c_stack"), F.col("m").alias("cm"), F.col("f").alias("cf"))
    cells = _listed(spark, folder).join(q, "query_id").join(c, "cand_id")
    score = kernels.module_kernel(insert_same=0.5, insert_new=1.0, delete_same=0.5, delete_last=1.0, sub_module=1.0, sub_function=0.6)
    return cells.select("query_id", "cand_id", "q_stack", "c_stack", _six(score(F.col("qm"), F.col("cm"), F.col("qf"), F.col("cf"))).alias("score"))


@query
def sim_bow(spark: SparkSession, folder: str) -> DataFrame:
    stacks = materialize(_stacks(spark, folder), "stacks")
    total = stacks.agg(F.count_distinct("bug_id")).scalar()
    return scoring.score_bags(_listed(spark, folder), stacks, total, 2).withColumn("score", _six("score"))


@query
def sim_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The stored score as text score, blended with the positional one for the first ten of each list."""
    stored = recommendations.dense_ranks(table(spark, folder, "recommendation")).where("score is not null").groupBy("query_id", "cand_id").agg(F.max("score").alias("score"))
    s = scoring.Settings(params={"c": 0.1, "o": 0.2}, alpha=0.4, n_top=10)
    blended = scoring.blend_stages(_reports(spark, folder), table(spark, folder, "stack_frame"), stored, s)
    return blended.withColumn("score", _six("score"))


# Aggregates and stack filters, over prefix scores of all recommended pairs.


def _aggregate(how: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        cells = pairs.score_cells(_listed(spark, folder), _stacks(spark, folder), kernels.common_prefix)
        return pairs.with_missing(_listed(spark, folder), pairs.aggregate_cells(cells, how)).withColumn("score", _six("score"))

    return run


for _how in pairs.AGGREGATES:
    _add(f"agg_{_how}", _aggregate(_how))


@query
def agg_weighted(spark: SparkSession, folder: str) -> DataFrame:
    stacks = materialize(_weighed(spark, folder)[0], "weighed")
    cells = pairs.score_cells(_listed(spark, folder), stacks, kernels.common_prefix)
    return pairs.weighted_mean(cells, stacks).withColumn("score", _six("score"))


@query
def filter_select_one(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.select_one(_weighed(spark, folder)[0]).select("bug_id", "stack_no")


@query
def filter_top_k(spark: SparkSession, folder: str) -> DataFrame:
    weighed, frequency = _weighed(spark, folder)
    return pairs.top_tokens(weighed, frequency, 0.5).select("bug_id", "stack_no")


# Ranking and metrics.


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates by prefix score, candidates, reports) of all evaluated queries."""
    canonical_ = materialize(_reports(spark, folder), "canonical")
    wanted = cand.evaluated(_asked(spark, folder), canonical_)
    asked = cand.candidates(canonical_, wanted, WINDOW)
    scored = pairs.best_of_pairs(asked, materialize(_stacks(spark, folder), "stacks"), kernels.common_prefix).withColumn("score", _six("score"))
    return scored, asked, canonical_


def _ranked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scored, asked, canonical_ = _scored(spark, folder)
    return ranking.rank(scored), asked, canonical_


def _first(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluated queries, intervals of their candidates, top-five lists)."""
    canonical_ = materialize(_reports(spark, folder), "canonical")
    asked, found = intervals.intervals(canonical_, cand.evaluated(_asked(spark, folder), canonical_), WINDOW)
    first = sweep.first_by_prefix(asked, found, materialize(_stacks(spark, folder), "stacks"), 5)
    return asked, found, ranking.top(first.withColumn("score", _six("score")), 5)


@query
def rank_top5(spark: SparkSession, folder: str) -> DataFrame:
    return _first(spark, folder)[2]


@query
def rank_topn_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    ranked, _, canonical_ = _ranked(spark, folder)
    return ranking.top_or_first_hit(materialize(ranked, "ranked"), cand.masters(canonical_), 5)


@query
def rank_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Top-five lists with all other candidates appended."""
    asked, found, first = _first(spark, folder)
    first = materialize(first, "top")
    rest = sweep.rest_of_lists(asked, found, first).select("query_id", "cand_id", F.lit(pairs.NOT_RANKED).alias("score"), "rec_rank")
    return first.select("query_id", "cand_id", "score", "rec_rank").unionByName(rest)


@query
def rank_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the stored lists as lists of the query table."""
    listed = recommendations.dense_ranks(table(spark, folder, "recommendation"))
    canonical_ = materialize(_reports(spark, folder), "canonical")
    # Only the listed pairs are looked up among the candidates.
    return ranking.violations(listed, intervals.known(canonical_, _asked(spark, folder), WINDOW, listed), _asked(spark, folder))


@query
def rank_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Top-five lists; of the first half of the queries by their first place in the query table those of the stored run."""
    stored = recommendations.dense_ranks(table(spark, folder, "recommendation")).where("score is not null")
    older = ranking.top(stored.groupBy("query_id", "cand_id").agg(F.max("score").alias("score")), 5)
    rows = table(spark, folder, "query_report").where("bug_id is not null")
    first = rows.groupBy(F.col("bug_id").alias("query_id")).agg(F.min(F.struct("chunk_id", "query_ord")).alias("place"))
    order = materialize(ordered.number_rows(first, ["place", "query_id"], "number").select("query_id", "number"), "order")
    return ranking.reuse(rank_top5(spark, folder), older, order, order.count() // 2)


def _stored_first(spark: SparkSession, folder: str) -> DataFrame:
    stored = recommendations.dense_ranks(table(spark, folder, "recommendation")).where("score is not null")
    return ranking.top(stored.groupBy("query_id", "cand_id").agg(F.max("score").alias("score")), 1)


def _positions(spark: SparkSession, folder: str, by_bucket: bool) -> DataFrame:
    canonical_ = materialize(_reports(spark, folder), "canonical")
    s = scoring.Settings("prefix", window_days=WINDOW)
    return scoring.positions(canonical_, table(spark, folder, "stack_frame"), table(spark, folder, "query_report"), s, by_bucket)


@query
def metric_positions(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder, True)


@query
def metric_positions_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder, False)


@query
def metric_rr_mrr(spark: SparkSession, folder: str) -> DataFrame:
    canonical_ = materialize(_reports(spark, folder), "canonical")
    # Only duplicates have a position, so only they are scored.
    wanted = cand.evaluated(_asked(spark, folder), canonical_).join(canonical_.where("bucket <> bug_id").select("bug_id"), "bug_id", "left_semi")
    asked = cand.candidates(canonical_, wanted, WINDOW)
    scored = pairs.best_of_pairs(asked, materialize(_stacks(spark, folder), "stacks"), kernels.common_prefix).withColumn("score", _six("score"))
    found = metrics.recall_and_mrr(metrics.bucket_positions(scored, cand.masters(canonical_)))
    return found.select("queries", _six("mrr").alias("mrr"), F.transform("recall", lambda r: F.round(r, 6)).alias("recall"))


def _best(spark: SparkSession, folder: str) -> DataFrame:
    positive = _reports(spark, folder).select(F.col("bug_id").alias("query_id"), F.col("dup_id").isNotNull().alias("positive"))
    return _stored_first(spark, folder).join(positive, "query_id").select("score", "positive")


@query
def metric_roc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc(_best(spark, folder)).select("threshold", _six("tpr").alias("tpr"), _six("fpr").alias("fpr"))


@query
def metric_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.auc(_best(spark, folder)).select(_six("auc").alias("auc"))


@query
def chain_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Each stored query's first candidate as its predicted bucket, followed to the end."""
    predicted = _stored_first(spark, folder).select("query_id", F.col("cand_id").alias("predicted"))
    return metrics.final_bucket(predicted, cand.masters(_reports(spark, folder)))


# Canonicalisation.


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select(F.col("bug_id").alias("id"), F.col("dup_id").alias("parent"))


@query
def master_by_report(spark: SparkSession, folder: str) -> DataFrame:
    return cand.masters(_reports(spark, folder))


@query
def master_sets(spark: SparkSession, folder: str) -> DataFrame:
    return cand.master_sets(_reports(spark, folder))


@query
def master_violations(spark: SparkSession, folder: str) -> DataFrame:
    return cand.order_violations(_reports(spark, folder))


@query
def first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Of each report the first delivery, of those with a text that says something."""
    rows = table(spark, folder, "bug_report").select("bug_id", "delivery_id", epoch_us(F.col("ingest_ts")).alias("ts"), "short_desc")
    return canonical.first_of_each(canonical.accept(rows, DAY_2017 * DAY_US, ["short_desc"]), "bug_id", ["ts", "delivery_id"])


@query
def adopt_orphans(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "bug_report").groupBy("bug_id").agg(
        F.max_by(F.struct(F.col("dup_id").alias("d")), F.struct("ingest_ts", "delivery_id")).alias("l"), F.min("ingest_ts").alias("f")
    )
    rows = raw.select("bug_id", F.col("l.d").alias("dup_id"), epoch_us(F.col("f")).alias("ts"))
    return canonical.adopt_orphans(materialize(rows, "raw-links"))


@query
def break_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.break_cycles(_links(spark, folder))


@query
def break_two_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.break_two_cycles(_links(spark, folder))


@query
def flatten_tree(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.flatten(materialize(canonical.break_cycles(_links(spark, folder)), "acyclic"))


@query
def nested_masters(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.nested_masters(_links(spark, folder))


@query
def remaster_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.remaster_oldest(_reports(spark, folder).select("bug_id", "bucket", "ts"))


@query
def masters_of_labels(spark: SparkSession, folder: str) -> DataFrame:
    canonical_ = materialize(_reports(spark, folder), "canonical")
    return canonical.masters_of_labels(canonical_.select("bug_id", "bucket", "ts"), canonical_.where("label is not null"))


# Splits.


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(reports.flag_duplicates(_reports(spark, folder)).select("bug_id", "ts", "seen_before"), "seen")


@query
def flag_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return _seen(spark, folder).select("bug_id", "seen_before")


@query
def split_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_fraction(_seen(spark, folder), 0.3).select("bug_id", "part")


@query
def split_after_n(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_after(_seen(spark, folder), DAY_2015 * DAY_US, 50).select("bug_id", "part")


@query
def split_date(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_date(_seen(spark, folder), DAY_2015 * DAY_US).select("bug_id", "part")


@query
def split_validation(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_validation(materialize(splits.split_date(_seen(spark, folder), DAY_2017 * DAY_US), "parts"), share=0.2).select("bug_id", "part")


@query
def split_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return splits.chunk(materialize(_reports(spark, folder), "canonical"), DAY_2017, 365, 100)


@query
def split_random_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return splits.random_chunks(materialize(_reports(spark, folder), "canonical"), 3, 365, 20, 7)


@query
def reports_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).groupBy(day(F.col("ts")).alias("day")).agg(F.count("*").alias("reports"))


# Parsing, over the whole texts of all documents.


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text").where("text is not null"))


@query
def parse_gdb(spark: SparkSession, folder: str) -> DataFrame:
    lines = _documents(spark, folder).select("doc_id", F.posexplode(parsing.lines_of(F.col("text"))).alias("line_no", "line")).where(F.col("line").startswith("#"))
    # A generator, for a filter on the parsed column would parse each line twice.
    return lines.select("doc_id", "line_no", F.inline(F.array_compact(F.array(parsing.frame_of(F.col("line"))))))


@query
def parse_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = _documents(spark, folder).select("doc_id", F.posexplode(parsing.grouped_lines(F.col("text"))).alias("group_no", "g"))
    return groups.select("doc_id", "group_no", F.col("g.line").alias("line"), F.size("g.extras").alias("lines"), parsing.file_of_extras(F.col("g.extras"))["file"].alias("file"))


@query
def parse_long(spark: SparkSession, folder: str) -> DataFrame:
    traces = materialize(_documents(spark, folder).select("doc_id", parsing.long_frames(F.col("text")).alias("frames")).where(F.size("frames") > 0), "long-traces")
    return parsing.fill_numbers(traces, "doc_id", "frames")


@query
def parse_threads(spark: SparkSession, folder: str) -> DataFrame:
    """The threads of every native report, its stacks written as a debugger does."""
    texts = parsing.threads_text(table(spark, folder, "stack_frame"))
    return texts.select("bug_id", F.posexplode(parsing.threads_of(F.col("text"))).alias("thread_no", "body"))


@query
def parse_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """One stack a thread out of the same texts."""
    texts = materialize(parsing.threads_text(table(spark, folder, "stack_frame")), "threads")
    stacks = texts.select("bug_id", F.posexplode(parsing.thread_stacks(F.col("text"))).alias("stack_no", "s"))
    return stacks.select("bug_id", "stack_no", F.posexplode("s").alias("place", "f")).select("bug_id", "stack_no", "place", "f.*")


@query
def parse_python(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.inline(parsing.python_frames(F.col("text"))))


@query
def field_names(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "bug_report").select(F.col("delivery_id").alias("DELIVERY_ID"), F.col("bug_id").alias("Bug_Id"), F.col("short_desc").alias("Title"))
    return parsing.normal_field_names(raw).distinct()


@query
def parse_top(spark: SparkSession, folder: str) -> DataFrame:
    tops = _documents(spark, folder).select("doc_id", F.posexplode(parsing.top_frames(F.regexp_replace("text", "\r\n?", "\n"))).alias("frame_no", "f"))
    return tops.select("doc_id", "frame_no", "f.function", "f.file")


@query
def parse_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.explode(parsing.fields_of(F.col("text"))).alias("field_name", "value"))


@query
def parse_java(spark: SparkSession, folder: str) -> DataFrame:
    traces = _documents(spark, folder).where(F.col("text").rlike("(?i)(?:Exception|Error)")).select("doc_id", F.posexplode(parsing.parse_java(F.col("text"))).alias("trace_no", "t"))
    return traces.select("doc_id", "trace_no", "t.exception", "t.message", F.size("t.frames").alias("frames"), F.transform("t.nested", lambda n: n["exception"]).alias("caused_by"))


@query
def parse_locations(spark: SparkSession, folder: str) -> DataFrame:
    groups = _documents(spark, folder).select("doc_id", F.posexplode(parsing.grouped_lines(F.col("text"))).alias("group_no", "g"))
    return groups.select("doc_id", "group_no", parsing.recover_location(F.col("g.extras")).alias("r")).select("doc_id", "group_no", "r.*").where("dylib is not null or file is not null")


@query
def null_unknown(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "stack_frame").select("function").distinct()
    return names.select("function", parsing.null_unknown(F.col("function")).alias("known"))


def _attachments(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "documents").where("doc_kind = 'attachment'")
    return kept.select("bug_id", F.col("doc_id").alias("attachment_id"), epoch_us(F.col("posted_ts")).alias("at"), "text")


@query
def first_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Of each report the earliest attachment among the documents, if it came within 600 s after the report."""
    found = attachments.first_attachment(_reports(spark, folder), _attachments(spark, folder))
    return found.withColumnRenamed("attachment_id", "doc_id")


@query
def first_traced_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Of each report the earliest document that holds a stack, if it came within 600 s after the report; documents of all kinds are taken as its attachments."""
    docs = table(spark, folder, "documents").select("bug_id", F.col("doc_id").alias("attachment_id"), epoch_us(F.col("posted_ts")).alias("at"), "text")
    holds = F.coalesce(F.size(parsing.thread_stacks(F.col("text"))) > 0, F.lit(False))
    return attachments.first_attachment(_reports(spark, folder), docs, holds).withColumnRenamed("attachment_id", "doc_id")


# Text functions, over the whole texts of all documents.


def _on_tokens(f: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tokens = text.whitespace_tokens(F.col("text"))
        return _documents(spark, folder).select("doc_id", F.array_join(F.transform(tokens, lambda x: f(x)), " ").alias("out"))

    return run


def _on_text(f: Callable[[Column], Column]) -> Query:
    return lambda spark, folder: _documents(spark, folder).select("doc_id", f(F.col("text")).alias("out"))


for _name, _f in {
    "text_lower": text.lower_case, "text_digits": text.digits_to_zero, "text_number": text.number_to_zero, "text_html": text.drop_html_symbols, "text_stop": text.drop_stop_word,
    "text_module": text.module_function, "text_symbols": text.replace_symbols, "text_url": text.url, "text_repeat": text.collapse_punctuation, "text_no_punct": text.drop_punctuation,
    "text_strip": text.strip_punctuation, "text_unusual": text.drop_unusual, "text_filters": text.load_filters(["lower_case", "number_to_zero", "url", "strip_punctuation"]),
}.items():
    _add(_name, _on_tokens(_f))
for _name, _f in {
    "text_whitespace": text.whitespace_tokens, "text_camel": text.camel_tokens, "text_alnum": text.alphanumeric_tokens, "text_words": text.word_tokens,
    "text_quotes": lambda t: text.directed_quotes(text.whitespace_tokens(t)), "text_clean": text.clean_description, "text_soft": text.soft_clean, "text_stripped": text.stripped_or_empty,
}.items():
    _add(_name, _on_text(_f))


@query
def text_field(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.field_or_none(F.col("text")).alias("out"))


# Stored lists and query datasets.


@query
def recommendation_lists(spark: SparkSession, folder: str) -> DataFrame:
    return recommendations.dense_ranks(table(spark, folder, "recommendation"))


@query
def dataset_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_report").distinct().withColumnRenamed("chunk_id", "chunk")
    return datasets.dataset_lines(rows)


# Whole evaluations.


def _evaluation(s: scoring.Settings) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        canonical_ = materialize(_reports(spark, folder), "canonical")
        return _figures(metrics.recall_and_mrr(scoring.positions(canonical_, table(spark, folder, "stack_frame"), table(spark, folder, "query_report"), s)))

    return run


def _figures(recall: DataFrame) -> DataFrame:
    return recall.select("queries", _six("mrr").alias("mrr"), F.round(F.get("recall", F.lit(0)), 6).alias("recall_1"), F.round(F.get("recall", F.lit(9)), 6).alias("recall_10"))


_TRIMMED = {"window_days": WINDOW, "trim_percent": 20.0, "recursion": "repeats"}
EVALUATIONS = {
    "eval_prefix": scoring.Settings("prefix", window_days=WINDOW), "eval_weighted": scoring.Settings("weighted", **_TRIMMED), "eval_linear": scoring.Settings("linear", **_TRIMMED),
    "eval_alignment": scoring.Settings("alignment", **_TRIMMED), "eval_edit": scoring.Settings("edit", **_TRIMMED), "eval_positional": scoring.Settings("positional", **_TRIMMED),
    "eval_bag": scoring.Settings("bag", window_days=WINDOW, n_gram=2),
}
for _name, _s in EVALUATIONS.items():
    _add(_name, _evaluation(_s))


@query
def eval_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    """The two-stage run over the stored scores as text scores, the first 500 of each list."""
    stored = recommendations.dense_ranks(table(spark, folder, "recommendation")).where("score is not null").groupBy("query_id", "cand_id").agg(F.max("score").alias("score"))
    s = scoring.Settings("two_stage", params={"c": 0.1, "o": 0.2}, alpha=0.4, n_top=500)
    done = scoring.evaluate_two_stage(materialize(_reports(spark, folder), "canonical"), table(spark, folder, "stack_frame"), table(spark, folder, "query_report"), stored, s)
    return _figures(done.recall)
