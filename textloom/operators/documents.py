"""Documents, pages and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.profile import Profile
from textloom.sources.store import stored


def sentences(docs: DataFrame, p: Profile, id_col: str = "doc_id", text_col: str = "text", first_id: int = 1) -> DataFrame:
    """One row per sentence of the cleaned text, numbered from ``first_id`` within the document."""
    parts = X.split_sentences(X.clean_text(F.col(text_col)), p.sentence_marks)
    return docs.select(id_col, F.posexplode(parts).alias("pos", "text")).select(id_col, (F.col("pos") + first_id).alias("sentence_id"), "text")


def best_candidate(candidates: DataFrame, page: str = "page", text_col: str = "text", order: str = "ord") -> DataFrame:
    """Of several extractions of a page the most readable, the first of equals."""
    score = X.quality_score(F.col(text_col))
    rank = F.struct(score, -F.col(order))
    return candidates.groupBy(page).agg(F.max_by(text_col, rank).alias(text_col), F.max(score).alias("quality"))


def page_ranges(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Each key's page numbers (counted from 0) as "1-3, 7", by gaps and islands."""
    w = Window.partitionBy(key).orderBy(page)
    isle = pages.select(key, page).distinct().withColumn("isle", F.col(page) - F.row_number().over(w))
    runs = isle.groupBy(key, "isle").agg(F.min(page).alias("a"), F.max(page).alias("z"))
    name = F.when(F.col("a") == F.col("z"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("a") + 1, F.col("z") + 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("a", name.alias("n")))), lambda x: x["n"])
    return runs.groupBy(key).agg(F.array_join(listed, ", ").alias("pages"))


def doc_metadata(files: DataFrame, p: Profile, name: str = "file_name", title: str = "title") -> DataFrame:
    """Documents numbered by file name, with their topic: the first rule a keyword of which the title has.

    Numbers come from a range partitioning by name: each partition is counted, and its rows get the
    count before it, so no task holds all files. The partitioned rows are stored, so both steps see the same ranges.
    """
    spark = files.sparkSession
    ranged = files.select(name, title).repartitionByRange(F.col(name)).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(name)
    counted = stored(ranged, "ranges").withColumn("within", F.row_number().over(w))
    sizes = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    at = F.broadcast(spark.createDataFrame(before or [(0, 0)], "part int, before long"))
    topic = X.infer_type(F.coalesce(F.col(title), F.lit("")), p.topic_rules, p.default_topic)
    return counted.join(at, "part").select(F.format_string("DOC%03d", F.col("before") + F.col("within")).alias("doc_no"), F.col(name).alias("file_name"), F.col(title).alias("title"), topic.alias("topic"))
