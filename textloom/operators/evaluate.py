"""Precision, recall and F1 of extractions, and gold sets drawn from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")]


def metrics(gold: DataFrame, predicted: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """precision, recall, f1, tp, fp, fn over the distinct keys; ``by`` one of them: a row for each of its values.

    Both sides are made one and counted by key, so the key is shuffled once. Null equals null.
    """
    g = gold.select(*keys).withColumn("side", F.lit(1))
    both = g.unionByName(predicted.select(*keys).withColumn("side", F.lit(2)))
    on = F.bit_or("side")
    sides = both.groupBy(*keys).agg(on.alias("on"))
    n = lambda v: F.coalesce(F.sum(F.when(F.col("on") == v, 1).otherwise(0)), F.lit(0))
    grouped = sides.groupBy(*([by] if by else []))
    return grouped.agg(n(3).alias("a"), n(2).alias("b"), n(1).alias("c")).select(*([by] if by else []), *_scores(F.col("a"), F.col("b"), F.col("c")))


def gold_sentences(relations: DataFrame, target: int = 1200) -> DataFrame:
    """The sentences with most relations until they hold ``target``; the one that reaches it is included.

    Sentences are counted first and the running sum is taken over the counts (one row for each
    number of relations), so no task sees all sentences; within the last number, by document and
    sentence.
    """
    per = relations.groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("k")).over(w), F.lit(0))).where(F.col("before") < target)
    near = per.join(F.broadcast(before), "n")
    whole = near.where(F.col("before") + F.col("n") * F.col("k") <= target)
    last = near.where(F.col("before") + F.col("n") * F.col("k") > target)
    row = last.orderBy("doc_id", "sentence_id").limit(target)
    w2 = Window.orderBy("doc_id", "sentence_id")
    cut = row.withColumn("i", F.row_number().over(w2)).where(F.col("before") + (F.col("i") - 1) * F.col("n") < target)
    return whole.select("doc_id", "sentence_id", "n").union(cut.select("doc_id", "sentence_id", "n"))


def hash_share(*cols: str, salt: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    h = F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_number(*cols: str) -> Column:
    """A whole number of 60 bits that depends on the columns' values alone, the same in any engine."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def perturbed_relations(gold: DataFrame, drop: float = 0.15, relabel: float = 0.05) -> DataFrame:
    """Gold relations less a share, some with another name; drawn by hash, so the same on every run."""
    k = ["doc_id", "sentence_id", "head", "relation", "tail"]
    other = F.when(hash_share(*k, salt="relabel") < relabel, "相关").otherwise(F.col("relation"))
    return gold.where(hash_share(*k, salt="drop") >= drop).select("doc_id", "sentence_id", "head", other.alias("relation"), "tail")


def perturbed_entities(gold: DataFrame, drop: float = 0.10, retype: float = 0.05) -> DataFrame:
    k = ["doc_id", "sentence_id", "entity", "entity_type"]
    other = F.when(hash_share(*k, salt="retype") < retype, "Concept").otherwise(F.col("entity_type"))
    return gold.where(hash_share(*k, salt="drop") >= drop).select("doc_id", "sentence_id", "entity", other.alias("entity_type"))


def annotated(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions in sentences that the gold set has."""
    return rows.join(gold.select("doc_id", "sentence_id").distinct(), ["doc_id", "sentence_id"], "left_semi")


# Modifiers, and relation names by the types of head and tail, of synthetic gold sets.
MODIFIERS = ("", "新型", "前沿", "复杂", "轻量化", "分布式")
TYPE_PAIRS = {
    ("Structure", "Mechanism"): "实现", ("Mechanism", "Performance"): "提升", ("ControlMethod", "Structure"): "驱动",
    ("Concept", "Aircraft"): "指导设计", ("Parameter", "Performance"): "影响", ("Structure", "Aircraft"): "组成",
}
OTHER_RELATIONS = ("包含", "属于", "影响", "应用于", "优化", "降低", "提升", "计算", "控制", "驱动", "连接", "组成", "评估")


def synthetic_entities(terms: DataFrame, sentences: DataFrame, modifiers: tuple[str, ...] = MODIFIERS) -> DataFrame:
    """Each term with each modifier as an entity of some sentence; which one depends on the entity's hash.

    ``terms``: term, entity_type. The sentences are numbered by hash buckets and joined by bucket.
    """
    n = max(1, sentences.count())
    e = terms.select(F.explode(F.transform(F.array(*[F.lit(m) for m in modifiers]), lambda m: F.concat(m, F.col("term")))).alias("entity"), "entity_type")
    at = hash_number("entity") % n
    ranked = sentences.select("doc_id", "sentence_id", (hash_number("doc_id", "sentence_id") % n).alias("slot"))
    one = ranked.groupBy("slot").agg(F.min(F.struct("doc_id", "sentence_id")).alias("s"))
    return e.withColumn("slot", at).join(one, "slot").select("s.doc_id", "s.sentence_id", "entity", "entity_type")


def synthetic_relations(entities: DataFrame) -> DataFrame:
    """A relation from each entity to the one that follows it in the order of hashes of its doc_id, named by the
    types of both, else by hash."""
    w = Window.partitionBy("doc_id").orderBy(hash_number("entity"), "entity")
    p = entities.withColumn("tail", F.lead("entity").over(w)).withColumn("t_type", F.lead("entity_type").over(w)).where("tail is not null and tail <> entity")
    name = F.element_at(F.array(*[F.lit(x) for x in OTHER_RELATIONS]), (hash_number("entity", "tail") % len(OTHER_RELATIONS) + 1).cast("int"))
    for (h, t), r in TYPE_PAIRS.items():
        name = F.when((F.col("entity_type") == h) & (F.col("t_type") == t), r).otherwise(name)
    return p.select("doc_id", "sentence_id", F.col("entity").alias("head"), name.alias("relation"), "tail")
