"""One evaluation: candidates, encoded stacks, pair scores, ranked lists, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import candidates as cand
from ..operators import docfreq, intervals, metrics, ordered, pairs, ranking, reports
from ..session import materialize
from . import sweep

#: Methods by name: (kernel over groups of pairs, whether it weighs tokens by document frequency).
METHODS: dict[str, tuple[Callable, bool]] = {
    "weighted": (lambda **p: partial(kernels.weighted_alignment, p=kernels.Weighted(**p)), True),
    "linear": (lambda **p: partial(kernels.linear_alignment, **p), True),
    "alignment": (lambda **p: partial(kernels.optimal_alignment, **p), False),
    "edit": (lambda **p: partial(kernels.edit_similarity, **p), False),
    "positional": (lambda **p: partial(kernels.positional_similarity, **p), False),
    "prefix": (lambda **p: kernels.prefix_similarity, False),
    "merge": (lambda **p: kernels.merge_overlap, False),
}
#: Tokens of queries whose growth of frequencies is broadcast at a time; further queries are scored in further blocks.
BLOCK_TOKENS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Knobs that all methods share; ``params`` are the method's own."""

    method: str = "prefix"
    params: dict = field(default_factory=dict)
    aggregate: str = "max"
    window_days: int | None = 730
    max_depth: int = 300
    keep_unknown: bool = False
    distinct_stacks: bool = False
    frequency_by_stack: bool = False
    frequency_of_unknown: float | None = None
    recursion: str | None = None
    trim_percent: float | None = None
    keep: str | None = None
    keep_share: float = -1.0
    n_gram: int = 1
    top: int = 5
    alpha: float = 0.5
    n_top: int = 500


def _is_unknown(s: Settings) -> Column:
    return F.col("token") == "??" if s.keep_unknown else F.col("token").rlike(r"^\?\?-?\d+$")


def tokens_of(flat: DataFrame, s: Settings) -> DataFrame:
    """Stacks with tokens under the settings."""
    if s.trim_percent is not None and s.trim_percent <= 0:
        raise ValueError("trim_percent must be positive")
    stacks = reports.encode(reports.stack_names(flat, s.max_depth), s.keep_unknown)
    stacks = reports.remove_recursion(stacks, s.recursion, s.keep_unknown)
    return reports.distinct_stacks(stacks) if s.distinct_stacks else stacks


def encoded(flat: DataFrame, s: Settings) -> DataFrame:
    """``tokens_of``, written."""
    return materialize(tokens_of(flat, s), "stacks")


def weigh(stacks: DataFrame, frequency: DataFrame, s: Settings) -> DataFrame:
    """Stacks with the frequencies of their tokens, trimmed and filtered under the settings; ``frequency`` is written and holds ``token, df, percent``.

    Unknown functions of a fixed frequency are never trimmed.
    """
    weighed = reports.with_frequencies(stacks, frequency)
    if s.trim_percent is not None:
        weighed = reports.trim(weighed, s.trim_percent, exempt=_is_unknown_token(s) if s.frequency_of_unknown is not None else None)
    return _kept(weighed, frequency, s)


def fixed_unknown(frequency: DataFrame, s: Settings) -> DataFrame:
    """The frequency table with the fixed frequency of unknown functions, if there is one."""
    if s.frequency_of_unknown is None:
        return frequency
    return frequency.withColumn("percent", F.when(_is_unknown(s), F.lit(s.frequency_of_unknown)).otherwise(F.col("percent")))


def prepare(flat: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(stacks with tokens and frequencies, frequencies) under the settings, the frequencies those of all stacks given."""
    stacks = encoded(flat, s)
    frequency = materialize(fixed_unknown(docfreq.document_frequency(stacks, s.frequency_by_stack), s), "frequency")
    return weigh(stacks, frequency, s), frequency


def _is_unknown_token(s: Settings) -> Callable[[Column], Column]:
    return (lambda t: t == "??") if s.keep_unknown else (lambda t: t.rlike(r"^\?\?-?\d+$"))


def _kept(weighed: DataFrame, frequency: DataFrame, s: Settings) -> DataFrame:
    if s.keep == "select_one":
        return pairs.select_one(weighed)
    if s.keep == "top_k":
        return pairs.top_tokens(weighed, frequency, s.keep_share)
    return weighed


def score_pairs(asked: DataFrame, stacks: DataFrame, s: Settings) -> DataFrame:
    """``query_id, cand_id, score`` of all asked pairs, the missing score where a side has no stack left; frequencies are those of ``stacks``."""
    build, weighted = METHODS[s.method]
    made = build(**s.params)
    kernel = kernels.common_prefix if s.method == "prefix" else kernels.weighted_kernel(made) if weighted else kernels.pair_kernel(made)
    return _aggregated(asked, stacks, kernel, s, weighted)


def _aggregated(asked: DataFrame, stacks: DataFrame, kernel: Callable[..., Column], s: Settings, weighted: bool) -> DataFrame:
    coded = s.method != "merge"
    if s.aggregate == "max":
        return pairs.best_of_pairs(asked, stacks, kernel, weighted, coded)
    cells = pairs.score_cells(asked, stacks, kernel, weighted, coded).where("score is not null")
    return pairs.with_missing(asked, pairs.aggregate_cells(cells, s.aggregate))


@dataclass
class _Order:
    """Queries in the order in which they are scored, with what each adds to the frequencies."""

    queries: DataFrame  # query_id, number, total, block
    events: DataFrame  # token, number, block
    base: DataFrame  # token, n
    blocks: int


def _order_of(stacks: DataFrame, canonical: DataFrame, queries: DataFrame, s: Settings) -> _Order:
    """The queries' order is that of their first row by ``chunk_id`` and ``query_ord`` where given, then by their report's (ts, bug_id)."""
    place = [F.col(c) for c in ("chunk_id", "query_ord") if c in queries.columns]
    first = queries.where("bug_id is not null").groupBy("bug_id").agg(F.min(F.struct(*place, F.lit(0).alias("same"))).alias("place"))
    asked = first.join(canonical.select("bug_id", "ts"), "bug_id")
    asked = materialize(ordered.number_rows(asked, ["place", "ts", "bug_id"], "number").select("bug_id", "number"), "asked")
    rest = cand.universe(canonical, asked).select("bug_id").join(asked, "bug_id", "left_anti")
    rest = materialize(rest, "base")
    key = ["bug_id", "stack_no"] if s.frequency_by_stack else ["bug_id"]
    held = stacks.select(*key, F.explode("tokens").alias("token")).distinct()
    base = held.join(rest, "bug_id", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # A report without stacks counts as a document, but is no stack.
    sizes = stacks.groupBy("bug_id").agg(F.count("*").alias("documents")) if s.frequency_by_stack else None
    count = lambda rows: rows.join(sizes, "bug_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0))) if sizes is not None else rows.withColumn("documents", F.lit(1).cast("long"))
    events = materialize(held.join(asked, "bug_id").select("token", "number"), "events")
    load = events.groupBy("number").agg(F.count("*").alias("load"))
    loaded = count(asked).join(load, "number", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    run = ordered.running_sums(loaded, ["number"], {"documents": F.col("documents"), "load": F.col("load")})
    total = count(rest).agg(F.coalesce(F.sum("documents"), F.lit(0))).scalar()
    block = F.floor((F.col("load") - 1) / BLOCK_TOKENS).cast("int")
    placed = materialize(run.select(F.col("bug_id").alias("query_id"), "number", (F.col("documents") + total).alias("total"), F.greatest(block, F.lit(0)).alias("block")), "order")
    blocks = placed.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first().n
    return _Order(placed, events.join(placed.select("number", "block"), "number"), materialize(base, "base-counts"), blocks)


def score_at_queries(asked: DataFrame, stacks: DataFrame, canonical: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """``query_id, cand_id, score`` of all asked pairs, with the frequencies that stood when each query was scored.

    A query, one that is not evaluated too, is added to the frequencies of the reports that are no queries before it is scored, once however often it is asked. The growth over
    a block of queries is broadcast, ``BLOCK_TOKENS`` tokens and those of one more query at most; what came before the block is joined to the stacks.
    Stack filters other than trimming (``keep``) go by the frequencies before the block.
    """
    done: list[DataFrame] = []
    for block in _blocks(stacks, canonical, queries, s):
        done.append(_scored_in(block, asked, s))
        if not block.last:
            done[-1] = materialize(done[-1], "scored")
    if not done:
        return pairs.with_missing(asked, asked.select("query_id", "cand_id", F.lit(0.0).alias("score")).limit(0))
    return _together(done)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class _Block:
    """A block of queries: their numbers and totals, the stacks with the counts of their tokens before it, and what its queries add to these, broadcast."""

    queries: DataFrame
    weighed: DataFrame
    sent: Broadcast
    last: bool


def _blocks(stacks: DataFrame, canonical: DataFrame, queries: DataFrame, s: Settings) -> Iterator[_Block]:
    coded = s.method != "merge"
    order = _order_of(stacks, canonical, queries, s)
    spark = stacks.sparkSession
    for block in range(order.blocks):
        before = order.events.where(F.col("block") < block).groupBy("token").agg(F.count("*").alias("n"))
        counts = order.base.unionByName(before).groupBy("token").agg(F.sum("n").alias("n")) if block else order.base
        if s.frequency_of_unknown is not None:
            unknown = stacks.select(F.explode("tokens").alias("token")).where(_is_unknown(s)).distinct().select("token", F.lit(kernels.FIXED).cast("long").alias("n"))
            counts = counts.where(~_is_unknown(s)).unionByName(unknown)
        # Counts take the place of percentages; the number of rows for spreading is the count too.
        counts = materialize(counts.select("token", F.abs("n").alias("df"), F.col("n").cast("double").alias("percent")), "counts")
        weighed = reports.with_frequencies(stacks, counts)
        if s.keep is not None:
            total = order.queries.where(F.col("block") == block).agg(F.min("total")).scalar()
            share = F.transform("df", lambda n: F.when(n == kernels.FIXED, F.lit(s.frequency_of_unknown)).otherwise(n / total * 100))
            rare = _kept(weighed.withColumn("df", share), counts.withColumn("percent", F.col("percent") / total * 100), s)
            weighed = weighed.join(rare.select("bug_id", "stack_no"), ["bug_id", "stack_no"], "left_semi")
        weighed = materialize(weighed, "weighed")
        mine = order.events.where(F.col("block") == block).select(F.xxhash64("token").alias("token") if coded else "token", "number")
        table = mine.toArrow()
        sent = spark.sparkContext.broadcast(kernels.Added.of(table.column(0).combine_chunks(), table.column(1).to_numpy()))
        yield _Block(order.queries.where(F.col("block") == block).select("query_id", "number", "total"), weighed, sent, block + 1 == order.blocks)


def _scored_in(block: _Block, asked: DataFrame, s: Settings) -> DataFrame:
    build, weighted = METHODS[s.method]
    at_query = kernels.kernel_at_queries(build(**s.params), weighted, lambda sent=block.sent: sent.value, s.trim_percent, s.frequency_of_unknown)
    wanted = asked.join(block.queries, "query_id").select("query_id", "cand_id", "number", "total")
    cells = pairs.stack_pairs(wanted.repartition("query_id", "cand_id"), block.weighed, s.method != "merge", "left", ["number", "total"])
    score = at_query(F.col("q"), F.col("c"), F.col("dq"), F.col("dc"), F.col("number"), F.col("total"))
    if s.aggregate == "max":
        return cells.groupBy("query_id", "cand_id").agg(F.coalesce(F.max(score), F.lit(pairs.NO_STACK)).alias("score"))
    scored = cells.select("query_id", "cand_id", "q_stack", "c_stack", score.alias("score")).where("score is not null")
    return pairs.with_missing(wanted, pairs.aggregate_cells(scored, s.aggregate))


def score_bags(asked: DataFrame, stacks: DataFrame, total: Column, n_gram: int = 1) -> DataFrame:
    """Bag-of-n-grams cosine of all asked pairs."""
    return pairs.with_missing(asked, pairs.bag_cosine(*_bags(stacks, total, n_gram), asked))


def _bags(stacks: DataFrame, total: Column, n_gram: int, coded: bool = False) -> tuple[DataFrame, DataFrame]:
    bags = materialize(reports.bag(stacks, n_gram, coded), "bags")
    df = bags.groupBy(F.col("term").alias("token")).agg(F.count("*").alias("df"))
    return bags, materialize(docfreq.inverse_frequency(df, total), "idf")


@dataclass
class Evaluation:
    """Lazy results of one run; ``scored`` is written, ``ranked`` the whole lists in order."""

    scored: DataFrame
    ranked: DataFrame
    positions: DataFrame
    recall: DataFrame
    auc: DataFrame


def _asked_of(canonical: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    every = queries.select("bug_id").where("bug_id is not null").distinct()
    wanted = cand.evaluated(every, canonical)
    return materialize(cand.candidates(cand.universe(canonical, every), wanted, s.window_days), "candidates")


def _measured(scored: DataFrame, canonical: DataFrame) -> Evaluation:
    scored = materialize(scored, "scored")
    positions = metrics.bucket_positions(scored, cand.masters(canonical))
    first = scored.where("query_id <> cand_id").groupBy("query_id").agg(F.max("score").alias("score"))
    best = first.join(canonical.select(F.col("bug_id").alias("query_id"), F.col("dup_id").isNotNull().alias("positive")), "query_id")
    return Evaluation(scored, ranking.rank(scored), positions, metrics.recall_and_mrr(positions), metrics.auc(best.select("score", "positive")))


def evaluate(canonical: DataFrame, flat: DataFrame, queries: DataFrame, s: Settings) -> Evaluation:
    """Runs one method: scores, ranked lists, positions of the right bucket, recall rates with MRR, and the AUC of the best score.

    Methods that weigh or trim tokens see the frequencies as they stood at each query (``score_at_queries``); bags of words are static.
    """
    asked = _asked_of(canonical, queries, s)
    if s.method == "bag":
        stacks = encoded(flat, s)
        return _measured(score_bags(asked, stacks, stacks.select("bug_id").distinct().agg(F.count("*")).scalar(), s.n_gram), canonical)
    return _measured(_scored(asked, flat, canonical, queries, s), canonical)


def _scored(asked: DataFrame, flat: DataFrame, canonical: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    stacks = encoded(flat, s)
    if METHODS[s.method][1] or s.trim_percent is not None or s.keep is not None:
        return score_at_queries(asked, stacks, canonical, queries, s)
    return score_pairs(asked, stacks, s)


def evaluate_two_stage(canonical: DataFrame, flat: DataFrame, queries: DataFrame, text_scores: DataFrame, s: Settings) -> Evaluation:
    """The two-stage run: candidates are scored by text first, and the first ``s.n_top`` of each query blended with the positional score of their stacks.

    ``text_scores`` holds ``query_id, cand_id, score``, of which candidates of the window count; all other candidates have the score of unranked ones.
    """
    asked = _asked_of(canonical, queries, s)
    known = text_scores.join(asked, ["query_id", "cand_id"], "left_semi")
    first = materialize(ranking.top(known, s.n_top).select("query_id", "cand_id", F.col("score").alias("text")), "first-stage")
    exact = _scored(first, flat, canonical, queries, replace(s, method="positional")).withColumnRenamed("score", "positional")
    both = first.join(exact, ["query_id", "cand_id"]).select("query_id", "cand_id", kernels.blend(F.col("text"), F.col("positional"), s.alpha).alias("score"))
    rest = asked.join(first, ["query_id", "cand_id"], "left_anti").select("query_id", "cand_id", F.lit(pairs.NOT_RANKED).alias("score"))
    return _measured(both.unionByName(rest), canonical)


def blend_stages(canonical: DataFrame, flat: DataFrame, text_scores: DataFrame, s: Settings) -> DataFrame:
    """``query_id, cand_id, score`` of all given pairs: the first ``s.n_top`` candidates by text score, blended with the positional score of their stacks.

    Candidates after ``n_top`` have the score of unranked ones. Scores of pairs only, without a window or frequencies of queries.
    """
    ranked = materialize(ranking.rank(text_scores), "text-ranked")
    first = ranked.where(F.col("rec_rank") <= s.n_top)
    stacks, _ = prepare(flat, s)
    exact = score_pairs(first, stacks, replace(s, method="positional")).withColumnRenamed("score", "positional")
    both = ranked.join(exact, ["query_id", "cand_id"], "left")
    blended = F.when(F.col("positional").isNotNull(), kernels.blend(F.col("score"), F.col("positional"), s.alpha))
    return both.select("query_id", "cand_id", F.coalesce(blended, F.lit(pairs.NOT_RANKED)).alias("score"))


def _by_frequency(s: Settings) -> bool:
    return s.method != "bag" and (METHODS[s.method][1] or s.trim_percent is not None or s.keep is not None)


def _countable(s: Settings, by_bucket: bool) -> bool:
    if s.method == "bag":
        return by_bucket
    return s.aggregate == "max" and (not _by_frequency(s) if s.method == "prefix" else sweep.bounds_of(s.method, s.params) is not None)


def positions(canonical: DataFrame, flat: DataFrame, queries: DataFrame, s: Settings, by_bucket: bool = True) -> DataFrame:
    """``query_id, position``: the positions of ``evaluate``, without its lists: how many buckets (or candidates) are as good as the right one.

    Only the pairs within buckets are scored as such; for the rest see ``sweep``. What that has no bounds for goes by the lists.
    """
    if not _countable(s, by_bucket):
        run = evaluate(canonical, flat, queries, s)
        return run.positions if by_bucket else metrics.hit_positions(materialize(run.ranked, "ranked"), cand.masters(canonical), by_bucket=False)
    every = queries.select("bug_id").where("bug_id is not null").distinct()
    wanted = cand.evaluated(every, canonical).join(canonical.where("bucket <> bug_id").select("bug_id"), "bug_id", "left_semi")
    asked, found = intervals.intervals(cand.universe(canonical, every), wanted, s.window_days)
    inside = (F.col("begin") <= F.col("place")) & (F.col("place") < F.col("end")) & (F.col("query_id") != F.col("cand_id"))
    own = materialize(asked.join(found, "bucket").where(inside).select("query_id", "cand_id"), "own-buckets")
    stacks = encoded(flat, s)
    if s.method == "bag":
        return _bag_positions(asked, found, own, stacks, s)
    build, weighted = METHODS[s.method]
    kernel = build(**s.params)
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    done = []
    if not _by_frequency(s):
        hits = _hits(score_pairs(own, stacks, s))
        mine = asked.join(hits, "query_id", "left").join(stacks.select(F.col("bug_id").alias("query_id"), hashed.alias("tokens")), "query_id", "left")
        mine = mine.select("query_id", "place", F.col("place").alias("number"), "hit", "hit_cand", "tokens")
        rows = materialize(sweep.rows_of(found, stacks), "candidate-stacks")
        make = lambda split: sweep.counted_in_chunk(s.method, s.params, kernel, weighted, split, None, None, None, not by_bucket)
        done.append(_placed(sweep.counted(found, mine, rows, make), hits))
    else:
        for block in _blocks(stacks, canonical, queries, s):
            hits = _hits(_scored_in(block, own, s))
            held = block.weighed.select(F.col("bug_id").alias("query_id"), hashed.alias("tokens"), F.col("df").alias("counts"))
            mine = asked.join(block.queries, "query_id").join(hits, "query_id", "left").join(held, "query_id", "left")
            mine = mine.select("query_id", "place", "number", "total", "hit", "hit_cand", "tokens", "counts").mapInArrow(
                _sides(block.sent, s), "query_id long, place long, number long, total long, hit double, hit_cand long, tokens array<long>, percent array<double>"
            )
            rows = materialize(sweep.rows_of(found, block.weighed, [F.col("df").alias("counts")]), "candidate-stacks")
            added = lambda sent=block.sent: sent.value
            make = lambda split, added=added: sweep.counted_in_chunk(s.method, s.params, kernel, weighted, split, added, s.trim_percent, s.frequency_of_unknown, not by_bucket)
            done.append(_placed(sweep.counted(found, materialize(mine, "query-stacks"), rows, make), hits))
            if not block.last:
                done[-1] = materialize(done[-1], "positions")
    return _together(done) if done else asked.select("query_id", F.lit(None).cast("int").alias("position")).limit(0)


def _bag_positions(asked: DataFrame, found: DataFrame, own: DataFrame, stacks: DataFrame, s: Settings) -> DataFrame:
    bags, idf = _bags(stacks, stacks.select("bug_id").distinct().agg(F.count("*")).scalar(), s.n_gram, True)
    weights = materialize(pairs.bag_weights(bags, idf), "bag-weights")
    hits = _hits(pairs.with_missing(own, pairs.cosine(weights, own)))
    terms = F.sort_array(F.collect_list(F.struct("term", "w")))
    held = weights.groupBy("bug_id").agg(terms.alias("terms")).select("bug_id", F.col("terms.term").alias("tokens"), F.col("terms.w").alias("percent"))
    held = materialize(held, "weighed-bags")
    mine = asked.join(hits, "query_id", "left").join(held.withColumnRenamed("bug_id", "query_id"), "query_id", "left")
    mine = materialize(mine.select("query_id", "place", F.col("place").alias("number"), "hit", "hit_cand", "tokens", "percent"), "query-bags")
    rows = materialize(found.join(held.withColumnRenamed("bug_id", "cand_id"), "cand_id", "left"), "candidate-bags")
    return _placed(sweep.counted(found, mine, rows, sweep.bags_in_chunk), hits)


def _hits(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", "cand_id")).alias("best"))
    return materialize(best.select("query_id", F.col("best.score").alias("hit"), F.col("best.cand_id").alias("hit_cand")), "hits")


def _placed(counts: DataFrame, hits: DataFrame) -> DataFrame:
    met = counts.join(hits, "query_id", "left")
    return met.select("query_id", F.when(F.col("hit").isNotNull(), F.col("n")).cast("int").alias("position"))


def _sides(sent: Broadcast, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    trim, fixed = s.trim_percent, s.frequency_of_unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, total = b.column("number").to_numpy(), b.column("total").to_numpy().astype(float)
            tokens, percent = kernels.side_at_queries(b.column("tokens"), b.column("counts"), number, total, sent.value, trim, fixed)
            names = ["query_id", "place", "number", "total", "hit", "hit_cand"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), tokens, percent], [*names, "tokens", "percent"])

    return run
