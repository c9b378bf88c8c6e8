"""Sources and sinks: text corpora, JSON lines, CSV, graph exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "﻿"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text: every text file whole, as one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content: files as bytes, for a page parser."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """An input of at most ``most_bytes`` (by the optimizer's estimate) that comes in fewer partitions than half the cores
    is spread over all; others stay as read: shuffling a large one costs more than it gains."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= most_bytes else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by a schema; blank lines are skipped, broken ones come out null."""
    return spark.read.schema(schema).json(path).dropna(how="all")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, as strings; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet that an earlier run's result keeps, unless forced; a failed write leaves nothing behind."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def export_csv(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One CSV file with a byte order mark, for spreadsheets; refuses more rows than ``most``."""
    rows = _bounded(df, most)
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows([["" if v is None else v for v in r] for r in rows])


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One JSON object of nodes and edges, for a small graph."""
    body = {"nodes": [r.asDict() for r in _bounded(nodes, most)], "edges": [r.asDict() for r in _bounded(edges, most)]}
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2), encoding="utf-8")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written as parquet below ``path``; an absent graph is an empty one."""
    from pyspark.errors import AnalysisException

    schemas = ("id string, name string, entity_type string, source_doc string",
               "source string, relation string, target string, doc_id string, sentence_id int, evidence string")
    out = []
    for name, schema in zip(("nodes", "edges"), schemas, strict=True):
        try:
            out.append(spark.read.schema(schema).parquet(f"{path}/{name}"))
        except AnalysisException:
            out.append(spark.createDataFrame([], schema))
    return out[0], out[1]


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def send_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hand the rows to an outside store in batches, from the tasks that hold them; a task may be run again, so
    ``send`` must be an upsert."""

    def run(rows: Iterable) -> None:
        batch = []
        for r in rows:
            batch.append(r.asDict())
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


# The graph store's statements.
CONSTRAINT = "CREATE CONSTRAINT entity_id IF NOT EXISTS FOR (n:Entity) REQUIRE n.id IS UNIQUE"


def _label(kind: str | None) -> str:
    """A name as a label or relation of the store's language, quoted."""
    return "`" + (kind or "Concept").replace("`", "``") + "`"


def node_statement(kind: str | None) -> str:
    """Merges rows (id, name, entity_type, source_doc) of one type by id and gives them the type as a second label."""
    return f"UNWIND $rows AS r MERGE (n:Entity {{id: r.id}}) SET n:{_label(kind)}, n.name = r.name, n.entity_type = r.entity_type, n.source_doc = r.source_doc"


def edge_statement(relation: str) -> str:
    """Merges rows (source, target, doc_id, sentence_id, evidence) of one relation; ends that aren't there are skipped."""
    return (f"UNWIND $rows AS r MATCH (a:Entity {{id: r.source}}) MATCH (b:Entity {{id: r.target}}) "
            f"MERGE (a)-[e:{_label(relation)} {{doc_id: r.doc_id, sentence_id: r.sentence_id}}]->(b) SET e.evidence = r.evidence")


def send_graph(nodes: DataFrame, edges: DataFrame, connect: Callable[[], Callable[[str, dict], None]], size: int = 500) -> None:
    """Upsert a graph into a store that takes statements: the constraint first, then the nodes, then the edges.

    ``connect`` is called in each task and gives a function of a statement and its parameters; rows go out in batches
    of one type (relation), at most ``size`` each. Edges follow once all nodes are there; a repeated task merges the same."""
    connect()(CONSTRAINT, {})

    def sender(kind: str, statement: Callable[[str], str]) -> Callable[[Iterable], None]:
        def run(rows: Iterable) -> None:
            send, waiting = connect(), {}
            for r in rows:
                batch = waiting.setdefault(r[kind], [])
                batch.append(r.asDict())
                if len(batch) == size:
                    send(statement(r[kind]), {"rows": batch})
                    waiting[r[kind]] = []
            for k, batch in waiting.items():
                if batch:
                    send(statement(k), {"rows": batch})

        return run

    nodes.foreachPartition(sender("entity_type", node_statement))
    edges.foreachPartition(sender("relation", edge_statement))


def doccano(sentences: DataFrame) -> DataFrame:
    """Records for an annotation tool: text and a struct of where it is from."""
    return sentences.select("text", F.struct("doc_id", "title", "sentence_id").alias("meta"))


def from_doccano(records: DataFrame) -> DataFrame:
    return records.select("meta.doc_id", "meta.title", "meta.sentence_id", "text")


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a folder instead")
    return rows
