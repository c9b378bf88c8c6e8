"""Documents that arrive while a graph exists."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as X
from textloom.operators import graph as G
from textloom.profile import Profile


def new_sentences(stream: DataFrame, p: Profile, watermark: str = "7 days") -> DataFrame:
    """Sentences of streamed documents (doc_id, text, loaded_at), each (doc_id, sentence_id) once within the
    watermark, so a document delivered again adds nothing."""
    parts = X.split_sentences(X.clean_text(F.col("text")), p.sentence_marks)
    rows = stream.withWatermark("loaded_at", watermark).select("doc_id", "loaded_at", F.posexplode(parts).alias("pos", "text"))
    return rows.withColumn("sentence_id", F.col("pos") + 1).drop("pos").dropDuplicatesWithinWatermark(["doc_id", "sentence_id"])


BUCKETS = 64


def merge_nodes(mentions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the node table below ``path`` up to date with streamed mentions: nodes not yet known are added, known ones
    stay as they were first seen.

    A batch writes only its new nodes, to a folder of its own, cut into buckets by id; known ids are read from the
    buckets it touches. It counts once its name is in ``current``; a batch run again finds its name there and changes
    nothing, or its unfinished folder and writes it anew. Batches are named by checkpoint and epoch, so a stream with
    another checkpoint doesn't pass for this one."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, epoch: int) -> None:
        spark, name = df.sparkSession, f"{stream}-{epoch}"
        done = _batches(spark, path)
        if name in done:
            return
        new = G.nodes(df).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        if done:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            new = new.join(_read(spark, path, done).where(F.col("bucket").isin(touched)).select("id"), "id", "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/current")

    return mentions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[str]:
    try:
        return [r["batch"] for r in spark.read.schema("batch string").parquet(f"{path}/current").distinct().collect()]
    except AnalysisException:
        return []


def _read(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    schema = "id string, name string, entity_type string, source_doc string, bucket int"
    parts = [spark.read.schema(schema).parquet(f"{path}/{b}") for b in batches]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def read_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """The node table, or None before the first batch."""
    done = _batches(spark, path)
    return _read(spark, path, done).drop("bucket") if done else None
