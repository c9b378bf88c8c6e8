"""Stages from the command line: python -m textloom.plans.cli --stage STAGE --input PATH --output PATH [--force]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import documents as D
from textloom.operators import evaluate as E
from textloom.operators import graph as G
from textloom.operators import ner as N
from textloom.operators import relations as R
from textloom.operators import terms as T
from textloom.plans.pipeline import finalized
from textloom.profile import LATIN, ZH
from textloom.sources import io

STAGES = ("preprocess", "terms", "finalize", "extract", "clean", "relation", "annotate", "kg", "evaluate")


def run(spark: SparkSession, stage: str, source: str, output: str, force: bool = False, other: str | None = None, profile: str = "zh", size: int = 3000) -> DataFrame | None:
    """One stage from stored tables to a stored table; ``other`` is its second input (terms, replies of a review, gold)."""
    p = LATIN if profile == "latin" else ZH
    read = lambda x: io.read_texts(spark, x).withColumnRenamed("file_name", "doc_id") if stage in ("preprocess", "terms") and not x.endswith(".parquet") else spark.read.parquet(x)
    df = read(source)
    if stage == "kg":
        io.write_once(G.nodes(df), f"{output}/nodes", force)
        io.write_once(G.edges(spark.read.parquet(other)) if other else G.edges(R.clean_relations(R.raw_relations(df, p), p)), f"{output}/edges", force)
        return None
    made = {
        "preprocess": lambda: D.sentences(df, p),
        "terms": lambda: T.extract_terms(df, p),
        "finalize": lambda: finalized(df, p, size, spark.read.parquet(other) if other else None),
        "extract": lambda: N.find_mentions(df, spark.read.parquet(other), p),
        "clean": lambda: N.clean_mentions(df, p, spark.read.parquet(other) if other else None),
        "relation": lambda: R.clean_relations(R.raw_relations(df, p), p),
        "annotate": lambda: io.doccano(df if "title" in df.columns else df.withColumn("title", F.lit(None).cast("string"))),
        "evaluate": lambda: E.metrics(spark.read.parquet(other), E.annotated(df, spark.read.parquet(other)), [c for c in ("doc_id", "sentence_id", "head", "relation", "tail", "entity", "entity_type") if c in df.columns and not (c == "entity_type" and "head" in df.columns)]),
    }[stage]()
    io.write_once(made, output, force)
    return made


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--stage", choices=STAGES, required=True)
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--other")
    a.add_argument("--profile", choices=("zh", "latin"), default="zh")
    a.add_argument("--force", action="store_true")
    x = a.parse_args(args)
    run(SparkSession.builder.getOrCreate(), x.stage, x.input, x.output, x.force, x.other, x.profile)


if __name__ == "__main__":
    main()
