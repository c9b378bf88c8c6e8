"""Relations between the mentions of a sentence: trigger phrases or a model's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.profile import Profile

KEYS = ("doc_id", "sentence_id")


def entity_pairs(mentions: DataFrame, p: Profile) -> DataFrame:
    """Heads and tails of a sentence, the head first by position, at most ``max_distance`` characters apart.

    The distance is made an equi-join on slices of the sentence, so a sentence with very many
    mentions yields only its close pairs.
    """
    width = p.max_distance + 1
    m = mentions.where((F.length("text") >= p.min_sentence) & F.col("entity").isNotNull())
    place = F.struct("start_pos", "end_pos", "entity")
    cell = F.floor(F.col("end_pos") / width)
    h = m.select(*KEYS, "text", F.col("entity").alias("head"), F.col("entity_type").alias("head_type"), F.col("start_pos").alias("h_start"),
                 F.col("end_pos").alias("h_end"), place.alias("h_place"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    t = m.select(*KEYS, F.col("entity").alias("tail"), F.col("entity_type").alias("tail_type"), F.col("start_pos").alias("t_start"),
                 place.alias("t_place"), F.floor(F.col("start_pos") / width).alias("cell"))
    near = (F.col("h_place") < F.col("t_place")) & (F.abs(F.col("t_start") - F.col("h_end")) <= p.max_distance)
    return h.join(t, [*KEYS, "cell"]).where(near).drop("cell", "h_place", "t_place")


def trigger_relation(span: Column, p: Profile) -> Column:
    """The relation of the first trigger, in the order of the table, that the span contains."""
    out = None
    for word, relation in p.triggers:
        hit = span.contains(word)
        out = F.when(hit, relation) if out is None else out.when(hit, relation)
    return F.lit(None).cast("string") if out is None else out


def type_allowed(p: Profile, relation: str = "relation", head: str = "head_type", tail: str = "tail_type", strict: bool = False) -> Column:
    """Whether the types fit the relation; a relation without a rule fits all, with ``strict`` none."""
    out = None
    for r, (heads, tails) in p.constraints.items():
        ok = F.lit(True)
        if heads is not None:
            ok = ok & F.coalesce(F.col(head).isin(*heads), F.lit(False))
        if tails is not None:
            ok = ok & F.coalesce(F.col(tail).isin(*tails), F.lit(False))
        out = F.when(F.col(relation) == r, ok) if out is None else out.when(F.col(relation) == r, ok)
    return F.lit(not strict) if out is None else out.otherwise(F.lit(not strict))


def raw_relations(mentions: DataFrame, p: Profile) -> DataFrame:
    """Triples of all triggers that stand between two close mentions, the leftmost of each in a sentence."""
    names = [t for t, _ in p.triggers]
    pairs = entity_pairs(mentions.where(~F.col("entity").isin(*names)), p).where("head <> tail")
    span = F.when(F.col("h_end") <= F.col("t_start"), F.expr("substring(text, h_end + 1, t_start - h_end)")).otherwise(F.expr("substring(text, t_start + 1, h_end - t_start)"))
    low = F.lower(span) if p.name == "latin" else span
    got = pairs.withColumn("relation", trigger_relation(low, p)).where("relation is not null")
    first = F.struct("h_start", "t_start", "h_end", "head_type", "tail_type", "text")
    return (got.groupBy(*KEYS, "head", "relation", "tail").agg(F.min(first).alias("x"))
            .select(*KEYS, "head", F.col("x.head_type").alias("head_type"), "relation", "tail", F.col("x.tail_type").alias("tail_type"), F.col("x.text").alias("evidence")))


def clean_relations(raw: DataFrame, p: Profile, strict: bool = False) -> DataFrame:
    return raw.where(type_allowed(p, strict=strict))


def relation_requests(mentions: DataFrame, p: Profile, batch_size: int = 200) -> DataFrame:
    """Sentences with two close, different entities as requests to a model: id, sentence, entities, batch.

    Batches are numbered by a hash of the id, so no task orders all sentences.
    """
    some = entity_pairs(mentions, p).where("head <> tail").select(*KEYS).distinct()
    first = mentions.groupBy(*KEYS, "entity").agg(F.min(F.struct("start_pos", "entity_type", "text")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("x.start_pos").alias("at"), F.col("entity").alias("name"), F.col("x.entity_type").alias("type"))))
    got = first.join(some, list(KEYS), "left_semi").groupBy(*KEYS).agg(listed.alias("e"), F.min("x.text").alias("sentence"))
    n = max(1, -(-some.count() // batch_size))
    rid = F.concat_ws("_", *KEYS)
    return got.select(rid.alias("id"), *KEYS, "sentence", F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("entities"),
                      F.pmod(F.xxhash64(rid), F.lit(n)).alias("batch"))


REPLY = "array<struct<id:string,relations:array<struct<head:string,tail:string,relation:string>>>>"


def validate_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Triples from model replies (reply STRING, JSON or fenced): a known id, two different entities of its
    sentence; the types are attached, the relation's name is free."""
    r = replies.select(F.inline(F.from_json(X.strip_fences(F.col("reply")), REPLY))).select("id", F.inline("relations"))
    r = r.where("head is not null and tail is not null and relation is not null and relation <> '' and head <> tail").distinct()
    got = requests.join(r, "id")
    known = lambda c: F.exists("entities", lambda e: e["name"] == F.col(c))
    good = got.where(known("head") & known("tail"))
    one = lambda c: F.when(known(c), F.filter("entities", lambda e: e["name"] == F.col(c))[0]["type"])
    return good.select(*KEYS, "head", one("head").alias("head_type"), "relation", "tail", one("tail").alias("tail_type"), F.col("sentence").alias("evidence"))
