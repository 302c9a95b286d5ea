"""Online scoring: reports arrive as a stream, each is scored against those before it, then kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import candidates as cand
from ..operators import docfreq, ranking
from ..plans.scoring import METHODS, Settings, fixed_unknown, score_pairs, tokens_of, weigh
from ..session import materialize, work_scope

#: After so many batches the counts of tokens are summed up, so that a batch reads one sum and fewer than this many increments.
SUM_EVERY = 20


class OnlineScorer:
    """Scores micro-batches of reports against all reports before them in (ts, bug_id).

    State is Parquet tables under ``state``, each batch in a folder of its own number, so a batch that is run again after a
    failure writes the same place: reports, their encoded stacks, and by how much each batch adds to the frequencies of tokens, which are
    summed up now and then. A batch encodes its own frames only and reads the stacks of its candidates and the counts of their tokens. Frequencies are those of all
    reports up to the batch. A batch's result goes to ``out`` the same way. With a window, older state of inactive buckets drops out of every join.
    """

    def __init__(self, spark: SparkSession, state: str, out: str, settings: Settings) -> None:
        self.spark, self.state, self.out, self.settings = spark, state, out, settings

    def _kept(self, name: str, below: int) -> DataFrame | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}")
        if not root.getFileSystem(conf).exists(root):
            return None
        return self.spark.read.parquet(f"{self.state}/{name}").where(F.col("batch") < below)

    def _add(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        """Writes a batch's rows, returns those of all batches up to it."""
        path = f"{self.state}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        fresh, old = self.spark.read.schema(rows.schema).parquet(path), self._kept(name, batch)
        return fresh if old is None else old.drop("batch").unionByName(fresh)

    def _counts(self, stacks: DataFrame, number: int) -> DataFrame:
        """``token, n`` over all reports up to the batch; the row without a token has the number of documents."""
        key = ["bug_id", "stack_no"] if self.settings.frequency_by_stack else ["bug_id"]
        held = stacks.select(*key, F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
        documents = stacks.select(*key).distinct().agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("token"), "n")
        path = f"{self.state}/counts/batch={number}"
        held.unionByName(documents).write.mode("overwrite").parquet(path)
        sums, since = self._kept("sums", number), -1
        if sums is not None:
            since = sums.agg(F.max("batch").alias("b")).first().b
            since = -1 if since is None else since
        counts = self._kept("counts", number + 1).where(F.col("batch") > since).select("token", "n")
        if since >= 0:
            counts = counts.unionByName(sums.where(F.col("batch") == since).select("token", "n"))
        total = counts.groupBy("token").agg(F.sum("n").alias("n"))
        if number % SUM_EVERY == SUM_EVERY - 1:
            total.write.mode("overwrite").parquet(f"{self.state}/sums/batch={number}")
        return total

    def process(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of ``bug_id, dup_id, bucket, ts, label, frames`` (array of ``stack_no, depth, function``)."""
        s = self.settings
        with work_scope(self.spark):
            fresh = materialize(batch, "batch")
            reports = self._add(fresh.select("bug_id", "dup_id", "bucket", "ts", "label"), "reports", number)
            mine = materialize(tokens_of(fresh.select("bug_id", F.inline("frames")), s), "tokens")
            stacks = self._add(mine, "stacks", number)
            counts = self._counts(mine, number)
            asked = materialize(cand.candidates(reports, fresh.select("bug_id"), s.window_days), "asked")
            wanted = asked.select(F.col("cand_id").alias("bug_id")).union(fresh.select("bug_id")).distinct()
            near = materialize(stacks.join(wanted, "bug_id", "left_semi"), "near")
            if METHODS[s.method][1] or s.trim_percent is not None or s.keep is not None:
                needed = near.select(F.explode("tokens").alias("token")).distinct()
                known = counts if s.keep == "top_k" else counts.join(needed, "token", "left_semi")
                documents = counts.where("token is null").agg(F.first("n")).scalar()
                frequency = known.where("token is not null").select("token", F.col("n").alias("df"), docfreq.percent_of(F.col("n"), documents).alias("percent"))
                near = weigh(near, materialize(fixed_unknown(frequency, s), "frequency"), s)
            ranked = ranking.top(score_pairs(asked, near, s), s.top)
            ranked.write.mode("overwrite").parquet(f"{self.out}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, late_days: int) -> DataFrame:
    """Counts of reports by day of arrival with a watermark; ``stream`` holds ``at``, a timestamp, and ``bug_id``."""
    return stream.withWatermark("at", f"{late_days} days").groupBy(F.window("at", "1 day")).agg(F.count("*").alias("reports"))
