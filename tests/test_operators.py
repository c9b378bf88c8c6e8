import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import pages as PG
from textloom.operators import documents as D
from textloom.operators import evaluate as E
from textloom.operators import graph as G
from textloom.operators import ner as N
from textloom.operators import relations as R
from textloom.operators import terms as T
from textloom.plans import cli
from textloom.plans.pipeline import Catalog, Versions, graph
from textloom.profile import LATIN, ZH
from textloom.sources import io
from textloom.streaming import incremental as I


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [
    ("a\r\n12\r------------\n x   y ", "a\nx y"), ("12345", "12345"), ("a\x07b\xa0c", "ab c"), (None, ""), ("", ""), (" \n\t\n", ""), ("　机翼　", "机翼"), ("x" * 50000, ""),
])
def test_clean_text(spark, text, want):
    assert one(spark, text, X.clean_text) == want


def test_page_text_keeps_numbers(spark):
    assert one(spark, "12\n\n a \n============", X.normalize_page_text) == "12\na"


def test_sentences(spark):
    assert one(spark, "甲。乙！c;d", lambda c: X.split_sentences(c, ZH.sentence_marks)) == ["甲。", "乙！", "c;", "d"]
    assert one(spark, "a. b", lambda c: X.split_sentences(c, ZH.sentence_marks)) == ["a. b"]
    df = spark.createDataFrame([(1, "甲。\n12\n乙"), (2, None), (3, " ")], "doc_id int, text string")
    assert [(r.doc_id, r.sentence_id, r.text) for r in D.sentences(df, ZH).orderBy("doc_id", "sentence_id").collect()] == [(1, 1, "甲。"), (1, 2, "乙")]
    assert D.sentences(df, ZH, first_id=0).agg(F.min("sentence_id")).first()[0] == 0


@pytest.mark.parametrize("text,want", [("九个字符的文本很短", True), ("这是一段完全正常的中文文本内容", False), ("正常的中文文本内容啊\x01好的", True), (None, True),
                                       ("This is a normal English sentence.", False), ("%$#@!&*()_+%$#@!", True)])
def test_garbled(spark, text, want):
    assert one(spark, text, X.is_garbled) is want


def test_quality_prefers_text(spark):
    assert one(spark, "机翼机翼", X.quality_score) > one(spark, "a%b%c%", X.quality_score) and one(spark, "", X.quality_score) == 0
    df = spark.createDataFrame([(1, "机翼", 0), (1, "机翼", 1), (1, "%%", 2)], "page int, text string, ord int")
    assert D.best_candidate(df).first()["text"] == "机翼"


def test_page_ranges(spark):
    df = spark.createDataFrame([("a", p) for p in (0, 1, 2, 5, 5)], "k string, p int")
    assert D.page_ranges(df, "k", "p").first()["pages"] == "1-3, 6"


def test_metadata(spark):
    df = spark.createDataFrame([(f"f{i:04}", "变体飞行器控制" if i % 2 else None) for i in range(30)], "file_name string, title string")
    got = {r.file_name: (r.doc_no, r.topic) for r in D.doc_metadata(df, ZH).collect()}
    assert got["f0000"] == ("DOC001", "综合") and got["f0029"] == ("DOC030", "变构飞行器")
    assert D.doc_metadata(df.limit(0), ZH).count() == 0


@pytest.mark.parametrize("term,noise", [("研究", True), ("机翼", False), ("第三章", True), ("图12", True), ("Morphing", False), ("Lift", True), ("MPC", False), ("机翼wing", True), ("学报编辑部", True)])
def test_noise(spark, term, noise):
    assert one(spark, term, lambda c: X.is_noise(c, ZH)) is noise


def test_types(spark):
    f = lambda t: one(spark, t, lambda c: X.infer_type(c, ZH.type_rules, "Concept"))
    assert (f("控制机翼"), f("机翼"), f("词")) == ("ControlMethod", "Structure", "Concept")


def test_fences_sections_names(spark):
    assert one(spark, "```json\n[1]\n```", X.strip_fences) == "[1]"
    assert one(spark, "x\\section{a}b\\section{c}", X.sections) == ["\\section{a}b", "\\section{c}"]
    assert one(spark, "  a　b ", X.entity_id) == "a_b"
    got = spark.createDataFrame([("DOC1", None)], "d string, s string").select(X.slug_name(F.col("d"), F.col("s"))).first()[0]
    assert got == "doc1_file.txt"


@pytest.mark.parametrize("text,term,want", [("aaaaa", "aa", [0, 2]), ("aaaa", "aa", [0, 2]), ("abc", "x", []), ("", "a", []), ("abc", "", [])])
def test_occurrences(spark, text, term, want):
    df = spark.createDataFrame([(text, term)], "a string, b string")
    assert df.select(X.occurrences(F.col("a"), F.col("b")).alias("y")).first()["y"] == want


def test_ngrams_bridge(spark):
    df = spark.createDataFrame([(1, "机翼，研究，变形")], "doc_id int, text string")
    assert {r.term for r in T.ngram_candidates(df, ZH, min_freq=1).collect()} == {"机翼", "变形", "机翼变形"}
    assert T.ngram_candidates(df.limit(0), ZH).count() == 0


def test_needles_and_pmi(spark):
    df = spark.createDataFrame([(1, "aaaa机翼"), (2, "机翼变形机翼"), (3, None)], "doc_id int, text string")
    got = {r.needle: r.n for r in T.needle_counts(df, ["aa", "机翼", "变", "zz"]).collect()}
    assert got == {"aa": 2, "机翼": 3, "变": 1}
    cand = spark.createDataFrame([("机翼", 3), ("翼变形", 1), ("无此", 9)], "term string, freq long")
    got = {r.term: r.pmi for r in T.pmi(df, cand, 10).collect()}
    import math

    size = 6 + 6 + 0 + 2
    assert abs(got["机翼"] - math.log2(3 * size / (3 * 3))) < 1e-9 and "无此" not in got


def test_reject_and_review(spark):
    t = spark.createDataFrame([(1, "包括", None, None), (2, "首先", None, ""), (3, "word", None, ""), (4, "机", None, ""), (5, "12", None, ""), (6, "图1", None, ""), (7, "如果机翼", "", ""),
                               (8, "机翼", "", "w"), (9, None, None, None), (10, "升阻比", "Mission", "")], "term_id long, term string, entity_type string, alias string")
    got = {r.term_id: (r.reject_reason, r.entity_type) for r in T.finalize_terms(t, ZH).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["trigger", "noise", "foreign", "short", "digits", "caption", "pragmatic", None, "blank", None]
    assert got[8][1] == "Structure" and got[10][1] == "Mission"
    r = spark.createDataFrame([("机翼", "Mechanism", "翅")], "term string, entity_type string, alias string")
    got = {r.term_id: r for r in T.finalize_terms(t, ZH, r).where("reject_reason is null").collect()}
    assert set(got) == {8} and (got[8].entity_type, got[8].alias) == ("Mechanism", "w")


def test_bad_replies(spark):
    t = spark.createDataFrame([("a", 1, 1.0, "Concept")], "term string, freq long, score double, entity_type string")
    r = spark.createDataFrame([("no json",), (None,), ('```\n[{"term":"a","keep":"Y","canonical":"A","entity_type":"Tool"}]\n```',)], "reply string")
    got = T.merge_replies(t, r, ("Mission",)).collect()
    assert [(x.canonical, x.entity_type) for x in got] == [("A", "Concept")]


DICT = [("变体飞行器", "Aircraft"), ("飞行器", "Aircraft"), ("机翼", "Structure"), ("升阻比", "Performance")]


def test_greedy_mentions():
    m = N.Matcher(DICT, ZH.entity_patterns)
    assert [x[:2] for x in m.mentions("变体飞行器")] == [("变体飞行器", "Aircraft")]
    assert m.mentions("机翼")[0][4] == "dictionary"
    assert [x[0] for x in m.mentions("12m/s 与 3.5°")] == ["12m/s", "3.5°"]
    assert N.Matcher([], ()).mentions("abc") == []


@given(st.text("ab机翼", max_size=20), st.lists(st.text("ab机翼", min_size=1, max_size=4), max_size=6))
@settings(max_examples=60, deadline=None)
def test_mentions_never_overlap(text, terms):
    got = N.Matcher([(t, "x") for t in terms], ()).mentions(text)
    assert all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False)) and all(text[x[2] : x[3]] == x[0] for x in got)
    # Brute force: longest first, self-scan before rejection.
    wanted = []
    for t in sorted(set(terms), key=lambda t: (-len(t), t)):
        i = text.find(t)
        while i >= 0:
            wanted.append((i, i + len(t)))
            i = text.find(t, i + len(t))
    taken = []
    for a, z in wanted:
        if all(z <= b or a >= c for b, c in taken):
            taken.append((a, z))
    assert sorted(taken) == [(x[2], x[3]) for x in got]


MENTION = "doc_id string, sentence_id int, text string, entity string, entity_type string, start_pos int, end_pos int, source string"


def mentions(spark, rows):
    return spark.createDataFrame(rows, MENTION)


def sentence(gap, trigger="影响", a=("机翼", "Structure"), b=("升阻比", "Performance")):
    text = a[0] + trigger + "填" * (gap - len(trigger)) + b[0]
    return [("d", 1, text, *a, 0, len(a[0]), "rule"), ("d", 1, text, *b, len(a[0]) + gap, len(text), "rule")]


@pytest.mark.parametrize("gap,n", [(80, 1), (81, 0)])
def test_distance(spark, gap, n):
    assert R.raw_relations(mentions(spark, sentence(gap)), ZH).count() == n


def test_triggers_and_types(spark):
    rel = lambda t: R.raw_relations(mentions(spark, sentence(9, t)), ZH).first()["relation"]
    assert (rel("影响采用"), rel("属于"), rel("组成部分")) == ("uses_method", "part_of", "has_component")
    raw = R.raw_relations(mentions(spark, sentence(9, "具有", ("升阻比", "Performance"), ("折叠", "Mechanism"))), ZH)
    assert raw.count() == 1 and R.clean_relations(raw, ZH).count() == 0
    foo = raw.withColumn("relation", F.lit("foo"))
    assert R.clean_relations(foo, ZH).count() == 1 and R.clean_relations(foo, ZH, strict=True).count() == 0


def test_many_mentions_in_one_sentence(spark):
    text = "影响" * 4000
    rows = [("d", 1, text, f"e{i % 50}", "Structure", i * 16, i * 16 + 2, "rule") for i in range(500)]
    got = R.entity_pairs(mentions(spark, rows), ZH).count()
    want = sum(1 for i in range(500) for j in range(i + 1, 500) if abs(j * 16 - i * 16 - 2) <= 80)
    assert got == want


def test_clean_mentions(spark):
    rows = [("d", 1, "t", e, "Concept", i, i + 1, "rule") for i, e in enumerate(["飞行器", "包括", "机", "12.5", "。，", "飞行器", None])]
    types = spark.createDataFrame([("飞行器", "Aircraft")], "term string, entity_type string")
    got = N.clean_mentions(mentions(spark, rows), ZH, types).collect()
    assert [(r.entity, r.entity_type, r.start_pos) for r in got] == [("飞行器", "Aircraft", 0)]


EDGE = "source string, relation string, target string, doc_id string, sentence_id int, evidence string"
NODE = "id string, name string, entity_type string, source_doc string"


def test_graph_queries(spark):
    n = spark.createDataFrame([(c, c.upper(), "Structure" if c < "c" else "Concept", "d") for c in "abcde"], NODE)
    e = spark.createDataFrame([(s, "is_a", t, "d", i, "x") for i, (s, t) in enumerate(["ab", "bc", "cd", "aa", "zz"])], EDGE)
    assert {r.id: r.degree for r in G.degrees(e).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1, "z": 2}
    assert {r.id for r in G.neighbourhood(e, "a", 1).collect()} == {"a", "b"} and {r.id for r in G.neighbourhood(e, "a", 2).collect()} == {"a", "b", "c"}
    assert {r.id for r in G.neighbourhood(e, "b", 2, budget=2).collect()} == {"a", "b", "c"}
    assert [r.id for r in G.overview(n, e, 2).collect()] == ["a", "b"]
    assert {r.id: r.symbol_size for r in G.subgraph(n, e, "a").collect()} == {"a": 28.0, "b": 10.0}
    assert G.matched_edges(e, n).count() == 4 and G.of_types(n, e, ["Structure"]).count() == 2
    assert [r.id for r in G.search(n, " B ").collect()] == ["b"] and G.search(n, "").count() == 0
    assert sorted(r.direction for r in G.entity_detail(n, e, "a").collect()) == ["in", "out", "out"]
    s = G.stats(n, e).first()
    assert (s.entities, s.relations, s.documents) == (5, 5, 1) and G.stats(n.limit(0), e.limit(0)).first().entities == 0
    assert G.triples(n, e.union(e)).count() == 5 * 2 + 5 + 4


def test_first_node_wins_and_upsert(spark):
    rows = [("d", 2, "t", "a b", "Mission", 0, 1, "rule"), ("d", 1, "t", "a  b", "Structure", 5, 6, "rule")]
    assert [(r.id, r.entity_type) for r in G.nodes(mentions(spark, rows)).collect()] == [("a_b", "Structure")]
    base = spark.createDataFrame([("x", 1, 0)], "id string, v int, o int")
    new = spark.createDataFrame([("x", 2, 1), ("x", 3, 2), ("y", 4, 1)], "id string, v int, o int")
    assert {r.id: r.v for r in G.upsert(base, new, ["id"], "o").collect()} == {"x": 3, "y": 4}


def test_metrics(spark):
    k = lambda a: spark.createDataFrame([(x,) for x in a], "k int")
    r = E.metrics(k(range(444)), k([*range(433), *range(1000, 1064), *range(433)]), ["k"]).first()
    assert (r.precision, r.recall, r.f1) == (0.8712, 0.9752, 0.9203) and r.tp + r.fp == 497
    z = E.metrics(k([]), k([]), ["k"]).first()
    assert (z.precision, z.recall, z.f1, z.tp) == (0.0, 0.0, 0.0, 0)


def test_cumulative_take(spark):
    rows = [("d", s, i) for s, n in enumerate([700, 400, 200, 100]) for i in range(n)]
    got = E.gold_sentences(spark.createDataFrame(rows, "doc_id string, sentence_id int, i int"), 1200)
    assert sorted(r.sentence_id for r in got.collect()) == [0, 1, 2]


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "texts"
    d.mkdir()
    (d / "a.txt").write_text("甲。\n乙。", encoding="utf-8")
    assert [(r.file_name, r.text) for r in io.read_texts(spark, str(d)).collect()] == [("a.txt", "甲。\n乙。")]
    assert io.read_pages(spark, str(d)).first()["file_name"] == "a.txt"
    (tmp_path / "t.csv").write_text("﻿term,freq\n机翼,2\n", encoding="utf-8")
    assert io.read_csv(spark, str(tmp_path / "t.csv")).columns == ["term", "freq"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    n = spark.createDataFrame([("a", "A", "Concept", "d")], NODE)
    e = spark.createDataFrame([("a", "is_a", "a", "d", 1, "x")], EDGE)
    io.export_csv(n, str(tmp_path / "n.csv"))
    assert (tmp_path / "n.csv").read_bytes().startswith(b"\xef\xbb\xbfid,")
    io.export_graph(n, e, str(tmp_path / "kg.json"))
    assert json.loads((tmp_path / "kg.json").read_text(encoding="utf-8"))["edges"][0]["source"] == "a"
    with pytest.raises(ValueError):
        io.export_csv(n, str(tmp_path / "m.csv"), most=0)
    io.save_graph(n, e, str(tmp_path / "g"))
    assert [x.count() for x in io.load_graph(spark, str(tmp_path / "g"))] == [1, 1] and io.load_graph(spark, str(tmp_path / "none"))[0].count() == 0
    io.write_once(n, str(tmp_path / "once"))
    io.write_once(n.union(n), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1
    io.send_batches(n, lambda b: None)
    s = spark.createDataFrame([("t", "d", "T", 1)], "text string, doc_id string, title string, sentence_id int")
    assert io.from_doccano(io.doccano(s)).first()["title"] == "T"


def test_pipeline_and_catalog(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "变体飞行器采用折叠机构。机翼影响升阻比。" * 3) for i in range(4)], "doc_id string, text string")
    terms = spark.createDataFrame(DICT + [("折叠机构", "Mechanism")], "term string, entity_type string")
    n, e = graph(D.sentences(docs, ZH), terms, ZH)
    assert {r.relation for r in e.select("relation").distinct().collect()} == {"uses_method", "affects"} and n.count() == 4
    c = Catalog(spark, str(tmp_path / "graphs"))
    n1, e1 = c.add("g", docs.limit(2))
    n2, e2 = c.add("g", docs)
    assert c.has("g") and c.get("g")[0].count() == n2.count() and Versions(spark, c._path("g", "documents")).read().count() == 4
    assert [r["name"] for r in c.list().collect()] == ["g"]
    c.delete("g")
    assert not c.has("g") and e1 is not None and e2 is not None and n1 is not None


def test_glyphs_and_recognition(spark):
    assert PG.glyph(int.from_bytes("机".encode("gbk"), "big")) == "机" and PG.glyph(70000) is None
    coded = "".join(f"(cid:{int.from_bytes(c.encode('gbk'), 'big')})" for c in "变体飞行器的机翼可以折叠")
    df = spark.createDataFrame([(1, coded), (2, "(cid:70000)"), (3, None), (4, "普通的文本不需要任何修复")], "page int, text string")
    got = {r.page: r.t for r in df.select("page", PG.repaired_glyphs(F.col("text")).alias("t")).collect()}
    assert got == {1: "变体飞行器的机翼可以折叠", 2: "(cid:70000)", 3: None, 4: "普通的文本不需要任何修复"}
    replies = spark.createDataFrame([(2, "```\n识别出来的文字\n```"), (4, "不该用")], "page int, reply string")
    got = {r.page: r.text for r in PG.with_recognition(df, replies, ["page"]).collect()}
    assert got[2] == "识别出来的文字" and got[4].startswith("普通") and got[3] is None


def test_synthetic_gold(spark):
    terms = spark.createDataFrame(DICT, "term string, entity_type string")
    s = spark.createDataFrame([("d", i) for i in range(50)], "doc_id string, sentence_id int")
    e = E.synthetic_entities(terms, s)
    assert e.select("entity").distinct().count() == e.count() > 4
    r = E.synthetic_relations(e).collect()
    assert len(r) == e.count() - 1 and all(x.head != x.tail for x in r)


def test_cli(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("机翼影响升阻比。变体飞行器采用折叠机构。", encoding="utf-8")
    at = lambda x: str(tmp_path / x)
    spark.createDataFrame(DICT + [("折叠机构", "Mechanism")], "term string, entity_type string").write.parquet(at("dict.parquet"))
    cli.run(spark, "preprocess", at("t"), at("s.parquet"))
    cli.run(spark, "terms", at("t"), at("terms.parquet"))
    cli.run(spark, "extract", at("s.parquet"), at("m.parquet"), other=at("dict.parquet"))
    cli.run(spark, "clean", at("m.parquet"), at("c.parquet"), other=at("dict.parquet"))
    cli.run(spark, "relation", at("c.parquet"), at("r.parquet"))
    cli.run(spark, "annotate", at("s.parquet"), at("a.parquet"))
    cli.run(spark, "kg", at("c.parquet"), at("kg"), other=at("r.parquet"))
    assert cli.run(spark, "evaluate", at("r.parquet"), at("e.parquet"), other=at("r.parquet")).first()["f1"] == 1.0
    assert spark.read.parquet(at("kg/edges")).count() == 2


def test_latin_profile(spark):
    text = "the station is a building of the harbour"
    rows = [("d", 1, text, "station", "Mechanism", 4, 11, "dictionary"), ("d", 1, text, "building", "ControlMethod", 17, 25, "dictionary")]
    assert R.raw_relations(mentions(spark, rows), LATIN).first()["relation"] == "is_a"
    assert {r.token for r in T.token_freq(spark.createDataFrame([(1, text)], "doc_id int, text string"), LATIN).collect()} == {"station", "building", "harbour"}


def test_streaming(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    docs = spark.createDataFrame([("a", "机翼影响升阻比。乙。"), ("a", "机翼影响升阻比。乙。"), ("b", "丙")], "doc_id string, text string").withColumn("loaded_at", F.current_timestamp())
    docs.write.parquet(str(src))
    s = I.new_sentences(spark.readStream.schema(docs.schema).parquet(str(src)), ZH)
    q = s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 3
    m = mentions(spark, [("d", 1, "t", "机翼", "Structure", 0, 2, "rule"), ("d", 2, "t", "机翼", "Mission", 0, 2, "rule")])
    m.write.parquet(str(tmp_path / "m"))
    for _ in range(2):
        I.merge_nodes(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), str(tmp_path / "nodes"), str(tmp_path / "c2")).awaitTermination(120)
    assert [(r.id, r.entity_type) for r in I.read_nodes(spark, str(tmp_path / "nodes")).collect()] == [("机翼", "Structure")]


def test_contract(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
