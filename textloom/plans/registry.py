"""Queries of the engine for the driver contract, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import pages as PG
from textloom.functions import text as X
from textloom.operators import documents as D
from textloom.operators import evaluate as E
from textloom.operators import graph as G
from textloom.operators import ner as N
from textloom.operators import relations as R
from textloom.operators import terms as T
from textloom.plans import pipeline
from textloom.plans import sql as S
from textloom.profile import ZH
from textloom.sources import io
from textloom.sources.store import scratch, stored

P = ZH
HUB = "低可探测风洞模型"
TOP = 300
ALLOWED = ("ControlMethod", "Mechanism", "Structure", "Performance", "Mission", "Parameter", "Aircraft", "Document", "Concept")


# Inputs: each delivered row once.
def documents(spark: SparkSession, d: str) -> DataFrame:
    return io.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/all_sentences.parquet").where("text is not null")
    return s.groupBy("doc_id", "sentence_id").agg(F.min("text").alias("text"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/entities_clean.parquet").where("entity is not null")
    cols = ("doc_id", "sentence_id", "text", "entity", "entity_type", "start_pos", "end_pos", "source")
    one = m.groupBy("mention_id").agg(*[F.min(c).alias(c) for c in cols])
    return one.withColumn("entity_type", F.coalesce("entity_type", F.lit("Concept")))


def reference(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/term_reference.parquet").select(F.col("canonical").alias("term"), "entity_type")


def terms(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/terms_clean.parquet")
    one = t.groupBy("term_id").agg(*[F.min(c).alias(c) for c in ("term", "freq", "score", "entity_type", "alias")])
    return one.withColumn("freq", F.coalesce("freq", F.lit(1)))


def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    """One row per term as written: its greatest frequency and score, its least type."""
    t = terms(spark, d).where("term is not null and trim(term) <> ''")
    return t.groupBy("term").agg(F.max("freq").alias("freq"), F.round(F.max(F.coalesce("score", F.lit(0.0))), 6).alias("score"), F.min("entity_type").alias("entity_type"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_relations(R.raw_relations(mentions(spark, d), P), P)


def kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph's nodes and its edges; the edges, which several steps of a query read, are stored."""
    return G.nodes(mentions(spark, d)), stored(G.edges(relations(spark, d)), "edges")


# Text.
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.normalize_page_text(F.col("text")).alias("clean"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return D.sentences(documents(spark, d), P)


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = D.sentences(documents(spark, d), P)
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


def garbled_flag(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.is_garbled(F.col("text")).alias("garbled"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.round(X.quality_score(F.col("text")), 5).alias("quality"))


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    c = documents(spark, d).where("text is not null")
    both = c.select(F.col("doc_id").alias("page"), "text", F.lit(0).alias("ord")).union(c.select("doc_id", X.normalize_page_text(F.col("text")), F.lit(1)))
    return D.best_candidate(both).select("page", F.length("text").alias("length"), F.round("quality", 5).alias("quality"))


def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    return D.doc_metadata(spark.read.parquet(f"{d}/doc_meta.parquet"), P)


def ascii_names(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/doc_meta.parquet")
    slug = F.lower(F.regexp_replace("title", "[^A-Za-z0-9]+", "_"))
    return m.select("doc_id", X.slug_name(F.col("doc_id"), F.when(slug.rlike("[a-z]"), slug)).alias("ascii_file_name"))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/all_sentences.parquet").where("page_no is not null").select("doc_id", (F.col("page_no") - 1).alias("page"))
    return D.page_ranges(s, "doc_id", "page")


# Terms.
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return T.token_freq(documents(spark, d), P)


def noise_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    t = distinct_terms(spark, d)
    return t.select("term", X.is_noise(F.col("term"), P).alias("noise"), X.valid_token(F.col("term"), P).alias("valid"), X.normalize_term(F.col("term")).alias("normal"))


def term_types(spark: SparkSession, d: str) -> DataFrame:
    t = distinct_terms(spark, d)
    return t.select("term", X.infer_type(F.col("term"), P.type_rules, P.default_type).alias("coarse"), X.infer_type(F.col("term"), P.fine_type_rules, P.default_type).alias("fine"))


def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.ngram_candidates(documents(spark, d), P)


def ngram_sentence_bounded(spark: SparkSession, d: str) -> DataFrame:
    return T.ngram_candidates(D.sentences(documents(spark, d), P).select("text"), P)


def tfidf_raw(spark: SparkSession, d: str) -> DataFrame:
    return T.tfidf(documents(spark, d), P).select("term", F.round("tfidf", 5).alias("tfidf"))


def tfidf_l2(spark: SparkSession, d: str) -> DataFrame:
    return T.tfidf(documents(spark, d), P, l2=True).select("term", F.round("tfidf", 5).alias("tfidf"))


def pmi_char(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return T.pmi(docs, T.ngram_candidates(docs, P), P.max_pmi).select("term", F.round("pmi", 5).alias("pmi"))


def pmi_token(spark: SparkSession, d: str) -> DataFrame:
    return T.pmi_tokens(documents(spark, d), P).select("term", "freq", F.round("pmi", 5).alias("pmi"))


def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    got = T.extract_terms(documents(spark, d), P)
    return got.select("term", "freq", F.round("tfidf", 3).alias("tfidf"), F.round("pmi", 3).alias("pmi"), F.round("score", 3).alias("score"), "entity_type", "keep", "alias")


def term_scores(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_terms(documents(spark, d), P).select("term", "freq", F.round("score", 3).alias("score"), "entity_type")


def term_topk(spark: SparkSession, d: str) -> DataFrame:
    return T.top_terms(distinct_terms(spark, d), TOP).select("term", "freq", "score")


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    got = T.finalize_terms(terms(spark, d), P)
    return got.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def finalize_terms(spark: SparkSession, d: str) -> DataFrame:
    return T.finalize_terms(terms(spark, d), P).where("reject_reason is null").select("term_id", "term", "entity_type", "alias")


def review(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model's review that depends on the terms alone."""
    n = F.length("term")
    return distinct_terms(spark, d).where(n % 2 == 0).select("term", F.when(n % 3 == 0, "Mechanism").otherwise("Concept").alias("entity_type"), F.concat(F.lit("又名"), "term").alias("alias"))


def finalize_reviewed(spark: SparkSession, d: str) -> DataFrame:
    got = T.finalize_terms(terms(spark, d), P, review(spark, d))
    return got.where("reject_reason is null").select("term_id", "term", "entity_type", "alias")


def llm_batches(spark: SparkSession, d: str) -> DataFrame:
    return T.request_batches(distinct_terms(spark, d), 240, 80)


def llm_merge(spark: SparkSession, d: str) -> DataFrame:
    t = T.top_terms(distinct_terms(spark, d), 240)
    n = F.length("term")
    row = F.struct("term", F.when(n % 4 == 0, "N").otherwise("Y").alias("keep"), F.when(n % 3 == 0, F.upper("term")).otherwise("").alias("canonical"),
                   F.when(n % 5 == 0, "Tool").when(n % 2 == 0, "Mechanism").otherwise("Mission").alias("entity_type"))
    replies = t.groupBy((n % 7).alias("b")).agg(F.concat(F.lit("```json\n"), F.to_json(F.collect_list(row)), F.lit("\n```")).alias("reply"))
    return T.merge_replies(t, replies, ALLOWED)


def review_merge(spark: SparkSession, d: str) -> DataFrame:
    t = distinct_terms(spark, d)
    known = t.where(F.length("term") % 3 == 0).select("term", "freq", F.lit("Y").alias("keep"), "entity_type", F.lit("").alias("alias"))
    reviewed = t.select("term", F.when(F.length("term") % 2 == 0, "Y").otherwise("N").alias("keep"), F.lit("Mission").alias("entity_type"), F.lit("x").alias("alias"))
    return T.merge_reviewed(known, t, reviewed, 100)


# Mentions.
def ner_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return N.find_mentions(sentences(spark, d), reference(spark, d), P, greedy=False).select("doc_id", "sentence_id", "entity", "start_pos", "end_pos")


def ner_greedy(spark: SparkSession, d: str) -> DataFrame:
    return N.find_mentions(sentences(spark, d), _halves(spark, d), P, patterns=False).select("doc_id", "sentence_id", "entity", "start_pos", "end_pos")


def ner_with_rules(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary and patterns together: the dictionary goes first, what overlaps it is dropped."""
    return N.find_mentions(sentences(spark, d), _halves(spark, d), P).select("doc_id", "sentence_id", "entity", "start_pos", "end_pos", "source")


def rule_positions(spark: SparkSession, d: str) -> DataFrame:
    none = reference(spark, d).limit(0)
    return N.find_mentions(sentences(spark, d), none, P).select("doc_id", "sentence_id", "entity", "entity_type", "start_pos", "end_pos")


def last_types(spark: SparkSession, d: str) -> DataFrame:
    return N.last_types(terms(spark, d), "term_id")


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """The reference names and their two halves of fixed length, so that terms overlap."""
    r = reference(spark, d)
    return r.union(r.select(F.substring("term", 1, 4), "entity_type")).union(r.select(F.expr("substring(term, 3, 4)"), "entity_type")).distinct()


def rule_entities(spark: SparkSession, d: str) -> DataFrame:
    none = reference(spark, d).limit(0)
    got = N.find_mentions(sentences(spark, d), none, P)
    return got.groupBy("doc_id", "sentence_id", "entity", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def entities_clean(spark: SparkSession, d: str) -> DataFrame:
    return N.clean_mentions(mentions(spark, d), P, reference(spark, d)).select("doc_id", "sentence_id", "entity", "entity_type", "start_pos")


# Relations.
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_pairs(mentions(spark, d), P).select("doc_id", "sentence_id", "head", "tail", "h_start", "t_start")


def relations_raw(spark: SparkSession, d: str) -> DataFrame:
    return R.raw_relations(mentions(spark, d), P)


def relations_clean(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d)


def llm_relation_requests(spark: SparkSession, d: str) -> DataFrame:
    r = R.relation_requests(mentions(spark, d), P)
    return r.select("id", F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), "|").alias("entities"))


def llm_relation_validate(spark: SparkSession, d: str) -> DataFrame:
    q = R.relation_requests(mentions(spark, d), P)
    e = lambda i: F.col("entities")[i]["name"]
    rel = lambda h, t, r: F.struct(h.alias("head"), t.alias("tail"), F.lit(r).alias("relation"))
    body = F.array(F.struct("id", F.array(rel(e(0), e(1), "foo"), rel(e(0), e(0), "is_a"), rel(e(1), F.lit("nobody"), "is_a")).alias("relations")))
    return R.validate_replies(q, q.select(F.to_json(body).alias("reply"))).select("doc_id", "sentence_id", "head", "head_type", "relation", "tail", "tail_type")


# Graph.
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(mentions(spark, d))


def kg_nodes_canonical(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(mentions(spark, d), spark.read.parquet(f"{d}/alias_final.parquet"))


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(relations(spark, d))


def rdf_triples(spark: SparkSession, d: str) -> DataFrame:
    return G.triples(*kg(spark, d))


def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.turtle_lines(*kg(spark, d)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/nodes.parquet").select("id", "name", "entity_type", "node_no")
    return G.upsert(G.upsert(t.limit(0), t.where("node_no % 2 = 0"), ["id"], "node_no"), t.where("node_no % 2 = 1"), ["id"], "node_no")


def matched_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = kg(spark, d)
    return G.matched_edges(e, n.where("entity_type <> 'Concept'")).select("source", "relation", "target", "doc_id", "sentence_id")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(*kg(spark, d))


def graph_stats_types(spark: SparkSession, d: str) -> DataFrame:
    return T.type_distribution(kg_nodes(spark, d), "entity_type")


def graph_stats_relations(spark: SparkSession, d: str) -> DataFrame:
    return T.type_distribution(kg_edges(spark, d), "relation")


def degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(kg_edges(spark, d))


def search_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.search(kg_nodes(spark, d), " Model").select("id", "name", "entity_type")


def search_menu(spark: SparkSession, d: str) -> DataFrame:
    return G.search(kg_nodes(spark, d), "模型", G.MENU).select("id", "name", "entity_type")


def legend_order(spark: SparkSession, d: str) -> DataFrame:
    return G.legend(kg_nodes(spark, d))


def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_detail(*kg(spark, d), HUB)


def subgraph_1hop(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(*kg(spark, d), HUB, 1)


def subgraph_2hop(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(*kg(spark, d), HUB, 2, budget=10_000_000)


def subgraph_2hop_budget(spark: SparkSession, d: str) -> DataFrame:
    """As it is served: no step beyond one with more than 200 nodes."""
    return G.subgraph(*kg(spark, d), HUB, 2).select("id", "degree")


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph_edges(kg(spark, d)[1], HUB, 2)


def overview_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.overview_edges(*kg(spark, d), 2000)


def overview_topn(spark: SparkSession, d: str) -> DataFrame:
    return G.overview(*kg(spark, d), 2000)


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return G.of_types(*kg(spark, d), ["Structure", "Mechanism", "ControlMethod"]).select("source", "relation", "target", "doc_id", "sentence_id")


# Evaluation.
def gold_select(spark: SparkSession, d: str) -> DataFrame:
    return E.gold_sentences(relations(spark, d), 400)


def gold_perturb(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d)
    return E.perturbed_relations(E.annotated(r, E.gold_sentences(r, 400)))


def eval_relations(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d)
    return E.metrics(E.perturbed_relations(r), r, ["doc_id", "sentence_id", "head", "relation", "tail"])


def eval_entities(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    return E.metrics(E.perturbed_entities(m), m, ["doc_id", "sentence_id", "entity", "entity_type"])


def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    return E.metrics(E.perturbed_entities(m), m, ["doc_id", "sentence_id", "entity", "entity_type"], "entity_type")


def doccano_export(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/all_sentences.parquet").select("doc_id", "title", "sentence_id", "text").distinct()
    return io.from_doccano(io.doccano(s))


def gold_entities(spark: SparkSession, d: str) -> DataFrame:
    """The mentions in the sentences of the gold relations."""
    r = relations(spark, d)
    return E.annotated(mentions(spark, d).select("doc_id", "sentence_id", "entity", "entity_type"), E.gold_sentences(r, 400))


def synthetic_gold(spark: SparkSession, d: str) -> DataFrame:
    return E.synthetic_entities(reference(spark, d), sentences(spark, d).select("doc_id", "sentence_id"))


def synthetic_gold_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.synthetic_relations(synthetic_gold(spark, d))


# Pages and files.
def _readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stand-in for parsers and a recogniser: each document is a page, read whole and with its Han characters or its
    blanks lost, and every third has a recognised text in a fence."""
    docs = documents(spark, d).where("text is not null").select("doc_id", (F.col("doc_id") % 7).alias("page"), "text")
    say = lambda o, c: docs.select("doc_id", "page", F.lit(o).alias("ord"), c.alias("text"))
    odd = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[一-鿿]", "%")).otherwise(F.col("text"))
    every = say(0, odd).union(say(1, F.regexp_replace(odd, " ", ""))).union(say(2, F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.lit(""))))
    return every, docs.where("doc_id % 3 = 0").select("doc_id", "page", F.concat(F.lit("```text\n"), "text", F.lit("\n```")).alias("reply"))


def page_cascade(spark: SparkSession, d: str) -> DataFrame:
    every, replies = _readings(spark, d)
    return PG.join_pages(PG.read_pages(every, replies)).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("length"))


def recognition_replay(spark: SparkSession, d: str) -> DataFrame:
    every, replies = _readings(spark, d)
    got = PG.with_recognition(every.where("ord = 0").drop("ord"), replies, ["doc_id", "page"])
    return got.select("doc_id", F.md5("text").alias("digest"))


def glyph_repair(spark: SparkSession, d: str) -> DataFrame:
    """Names written as glyph numbers of their GBK bytes, and back."""
    r = reference(spark, d).select("term").distinct()
    coded = F.pandas_udf(lambda names: names.map(lambda t: "".join(f"(cid:{int.from_bytes(c.encode('gbk'), 'big')})" for c in t + t)), "string")
    return r.select("term", PG.repaired_glyphs(coded("term")).alias("text"))


def latex_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of a report made of all entries, numbered."""
    r = spark.read.parquet(f"{d}/term_reference.parquet")
    text = F.concat(F.lit("intro\n\\section{"), "canonical", F.lit("}\nbody\n\\section{"), "name_en", F.lit("} end"))
    return r.select("ref_id", F.posexplode(X.sections(text)).alias("pos", "chapter"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m, path = spark.read.parquet(f"{d}/doc_meta.parquet").select("doc_id", "title", "file_name", "topic"), scratch(spark, "jsonl")
    io.write_jsonl(m, path)
    return io.read_jsonl(spark, path, m.schema)


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Null and empty are the same in CSV."""
    m, path = spark.read.parquet(f"{d}/doc_meta.parquet").select("doc_id", "title", "file_name", "topic"), scratch(spark, "csv")
    io.write_csv(m, path)
    return io.read_csv(spark, path).select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "file_name", "topic")])


def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A graph saved and loaded, and a second save that an earlier one keeps from happening."""
    path = scratch(spark, "graph")
    io.save_graph(*kg(spark, d), path)
    n, e = io.load_graph(spark, path)
    io.write_once(n, f"{path}/once")
    io.write_once(n.limit(0), f"{path}/once")
    return spark.read.parquet(f"{path}/once").select("id", "name").unionByName(e.select(F.col("source").alias("id"), F.col("target").alias("name")))


def graph_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: documents to sentences, dictionary, mentions, relations and the top-degree overview."""
    docs = documents(spark, d)
    n, e = pipeline.graph(D.sentences(docs, P), pipeline.dictionary(docs, P, P.max_terms), P)
    return G.overview(n, e, 2000)


_QUERIES = (
    clean_text, page_text, split_sentences, sentence_stats, garbled_flag, text_quality, best_candidate, doc_metadata, ascii_names, page_ranges,
    token_freq, noise_filter_audit, term_types, ngram_candidates, ngram_sentence_bounded, tfidf_raw, tfidf_l2, pmi_char, pmi_token, term_scores, extract_terms, term_topk,
    reject_reasons, finalize_terms, finalize_reviewed, llm_batches, llm_merge, review_merge, ner_occurrences, ner_greedy, ner_with_rules, rule_positions, last_types, rule_entities, entities_clean,
    entity_pairs, relations_raw, relations_clean, llm_relation_requests, llm_relation_validate, kg_nodes, kg_nodes_canonical, kg_edges, rdf_triples,
    turtle_lines, upsert_merge, matched_edges, graph_stats, graph_stats_types, graph_stats_relations, degree, search_entities, search_menu, legend_order, entity_detail,
    subgraph_1hop, subgraph_2hop, subgraph_2hop_budget, subgraph_edges, overview_edges, overview_topn, type_filter, gold_select, gold_perturb, eval_relations, eval_entities, eval_by_type, doccano_export,
    gold_entities, synthetic_gold, synthetic_gold_relations, page_cascade, recognition_replay, glyph_repair, latex_sections, jsonl_round_trip, csv_round_trip,
    graph_round_trip, graph_from_documents,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return S.oracles(P, hub=HUB, pmi_cap=P.max_pmi, top=TOP, allowed=ALLOWED)
