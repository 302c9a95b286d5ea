"""Query datasets: three lines of text with a title, the ids asked for, and the duplicates among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``chunk, query_ord, bug_id, is_duplicate`` in the order of the file; words that are no number are dropped, their place stays."""
    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    words = lambda i: F.filter(F.split(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), r"\s+"), lambda x: x != "")
    raw = spark.read.text(path, wholetext=True).select(F.get(lines, F.lit(0)).alias("chunk"), words(1).alias("ids"), words(2).alias("dups"))
    rows = raw.select("chunk", "dups", F.posexplode("ids").alias("query_ord", "id"))
    return rows.select("chunk", "query_ord", F.col("id").try_cast("long").alias("bug_id"), F.array_contains("dups", F.col("id")).alias("is_duplicate")).where("bug_id is not null")


def dataset_lines(queries: DataFrame) -> DataFrame:
    """``chunk, ids, duplicates`` as text: a dataset's second and third line. A dataset is one file by its format, so its ids are gathered."""
    order = F.sort_array(F.collect_list(F.struct("query_ord", "bug_id", "is_duplicate"))).alias("q")
    made = queries.groupBy("chunk").agg(order)
    ids = F.array_join(F.transform("q", lambda r: r["bug_id"].cast("string")), " ")
    dups = F.array_join(F.transform(F.filter("q", lambda r: F.coalesce(r["is_duplicate"], F.lit(False))), lambda r: r["bug_id"].cast("string")), " ")
    return made.select("chunk", ids.alias("ids"), dups.alias("duplicates"))


def write_datasets(queries: DataFrame, path: str) -> None:
    """One text file a dataset, under a folder for its chunk."""
    text = F.concat_ws("\n", F.col("chunk").cast("string"), "ids", "duplicates")
    dataset_lines(queries).select(F.col("chunk").alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").mode("errorifexists").text(path)
