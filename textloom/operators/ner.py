"""Entity mentions: dictionary matches, longest first, and patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.profile import Profile

MENTIONS = "entity string, entity_type string, start_pos int, end_pos int, source string"


class Matcher:
    """Finds the terms of a dictionary and the patterns of a profile in one text after another."""

    def __init__(self, terms: list[tuple[str, str]], patterns: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.kinds = {t: k for t, k in terms if t}
        self.patterns = [(re.compile(p), k) for p, k in patterns]
        self.auto = ahocorasick.Automaton() if self.kinds else None
        for t in self.kinds:
            self.auto.add_word(t, t)
        if self.auto:
            self.auto.make_automaton()

    def dictionary(self, text: str) -> list[tuple[str, int]]:
        """(term, start) of every term, left to right, no occurrence overlapping one of the same term."""
        out, free = [], {}
        for end, t in self.auto.iter(text) if self.auto else ():
            start = end - len(t) + 1
            if start >= free.get(t, 0):
                out.append((t, start))
                free[t] = end + 1
        return out

    def mentions(self, text: str) -> list[tuple[str, str, int, int, str]]:
        """Longest terms first, then patterns in order; what overlaps an earlier one is dropped."""
        taken: list[tuple[str, str, int, int, str]] = []
        wanted = [(t, self.kinds[t], s, s + len(t), "dictionary") for t, s in sorted(self.dictionary(text), key=lambda x: (-len(x[0]), x[0], x[1]))]
        wanted += [(m.group(), k, m.start(), m.end(), "rule") for p, k in self.patterns for m in p.finditer(text)]
        for x in wanted:
            if all(x[3] <= y[2] or x[2] >= y[3] for y in taken):
                taken.append(x)
        return sorted(taken, key=lambda x: (x[2], -(x[3] - x[2])))


def last_types(terms: DataFrame, order: str | None = None) -> DataFrame:
    """term, entity_type: of each term the type of its last row by ``order``; without an order the greatest type."""
    t = terms.where("term is not null and term <> ''")
    last = F.max("entity_type") if order is None else F.max_by("entity_type", order)
    return t.groupBy("term").agg(last.alias("entity_type"))


def find_mentions(sentences: DataFrame, terms: DataFrame, p: Profile, keys: tuple[str, ...] = ("doc_id", "sentence_id"), greedy: bool = True,
                  patterns: bool = True, most: int = 500_000, order: str | None = None) -> DataFrame:
    """Mentions in each sentence; ``greedy`` resolves overlaps, else all dictionary occurrences are given.

    The dictionary (term, entity_type; of a repeated term the last row by ``order``) is checked to have at
    most ``most`` terms and broadcast; sentences are matched where they are, without a shuffle.
    """
    spark = sentences.sparkSession
    rows = last_types(terms, order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the dictionary is too large to broadcast")
    sent = spark.sparkContext.broadcast((sorted((r["term"], r["entity_type"]) for r in rows), p.entity_patterns if patterns and greedy else ()))
    keys = list(keys)
    schema = ", ".join(f"{k} {sentences.schema[k].dataType.simpleString()}" for k in keys) + ", text string, " + MENTIONS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(*sent.value)
        for q in parts:
            out = []
            for row in q.itertuples(index=False):
                if greedy:
                    out += [(*row, *x) for x in m.mentions(row[-1])]
                else:
                    out += [(*row, t, m.kinds[t], s, s + len(t), "dictionary") for t, s in m.dictionary(row[-1])]
            if out:
                yield pd.DataFrame(out, columns=[*keys, "text", "entity", "entity_type", "start_pos", "end_pos", "source"])

    return sentences.where("text is not null").select(*keys, "text").mapInPandas(run, schema)


def clean_mentions(raw: DataFrame, p: Profile, types: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "sentence_id"), order: str | None = None) -> DataFrame:
    """Mentions that are no trigger word, number, punctuation or single character, typed by ``types`` (term,
    entity_type, of a repeated term the last row by ``order``; the default type never overrides), the leftmost of each entity in a sentence."""
    e = F.col("entity")
    good = raw.where(e.isNotNull() & ~e.isin(*p.trigger_words) & (F.length(e) > 1) & ~e.rlike(r"\A[0-9]+\.?[0-9]*\z") & ~e.rlike(r"(?U)\A[\s\W]+\z"))
    if types is not None:
        t = last_types(types, order).select(F.col("term").alias("entity"), F.col("entity_type").alias("t_type")).where(F.col("t_type") != p.default_type)
        good = good.join(t, "entity", "left").withColumn("entity_type", F.coalesce("t_type", "entity_type")).drop("t_type")
    w = Window.partitionBy(*keys, "entity").orderBy("start_pos", "end_pos", "source", F.col("entity_type"))
    return good.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
