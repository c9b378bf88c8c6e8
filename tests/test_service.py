"""Serving, restarts and storage."""

import shutil

import pytest
from pyspark.sql import functions as F

from textloom.functions import pages as PG
from textloom.functions import text as X
from textloom.operators import graph as G
from textloom.operators import ner as N
from textloom.plans import service
from textloom.plans.pipeline import Catalog, Versions
from textloom.profile import ZH
from textloom.sources import io
from textloom.streaming import incremental as I

EDGE = "source string, relation string, target string, doc_id string, sentence_id int, evidence string"
NODE = "id string, name string, entity_type string, source_doc string"


def star(spark, k=30):
    """A hub with k neighbours, each with one of its own, and a far pair."""
    e = [("hub", "has", f"n{i}", "d", i, "x") for i in range(k)] + [(f"m{i}", "of", f"n{i}", "d", i, "y") for i in range(k)] + [("p", "is", "q", "d", 1, None)]
    ids = sorted({x for r in e for x in (r[0], r[2])})
    return spark.createDataFrame([(i, i, "Structure" if i.startswith("n") else None, "d") for i in ids], NODE), spark.createDataFrame(e, EDGE)


def test_subgraph_with_budget(spark):
    n, e = star(spark)
    ids = lambda **k: {r["id"] for r in G.neighbourhood(e, "hub", 2, **k).collect()}
    assert len(ids()) == 61 and len(ids(budget=20)) == 31 and len(ids(budget=31)) == 61
    got = {r["id"]: r for r in G.subgraph(n, e, "hub", 1).collect()}
    assert got["hub"]["border_width"] == 3 and got["n1"]["border_color"] == "transparent" and got["hub"]["symbol_size"] == 28.0 and got["n1"]["labelled"]
    assert {(r["source"], r["target"]) for r in G.subgraph_edges(e, "hub", 1).collect()} == {("hub", f"n{i}") for i in range(30)}
    assert G.subgraph_edges(e, "nobody", 1).count() == 0
    assert {r["source"] for r in G.overview_edges(n, e, 3).collect()} == {"hub"}
    assert [(r["entity_type"], r["place"]) for r in G.legend(n).orderBy("place").collect()] == [("Concept", 1), ("Structure", 2)]


def test_service(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "g"))
    assert service.handle(c, "GET", "/api/graphs") == (200, [])
    assert service.handle(c, "GET", "/api/graphs/none/stats")[0] == 404 and service.handle(c, "POST", "/api/graphs", {})[0] == 422
    assert service.handle(c, "POST", "/api/graphs", {"name": "a"})[1]["status"] == "empty"
    io.save_graph(*star(spark), str(tmp_path / "g" / "a"))
    ask = lambda p, **k: service.handle(c, "GET", f"/api/graphs/a/{p}", k)
    assert ask("stats")[1]["entities"] == 63 and ask("stats")[1]["entity_type_distribution"] == {"Concept": 33, "Structure": 30}
    assert ask("search", q=" N1 ")[1][0]["id"] == "n1" and ask("search", q=" ")[1] == [] and ask("entity/hub")[1]["color"] == "#374151"
    assert len(ask("entity/n1")[1]["in_relations"]) == 2 and ask("entity/x")[0] == 404 and ask("subgraph/x")[0] == 404
    got = ask("subgraph/hub", hops="2")[1]
    assert len(got["nodes"]) == 61 and len(got["edges"]) == 60 and got["center"] == "hub"
    assert [ask("subgraph/hub", hops=h)[0] for h in (0, 3, "x", 1)] == [422, 422, 422, 200]
    assert [ask("overview", limit=h)[0] for h in (49, 5001, 50)] == [422, 422, 200] and len(ask("overview", limit=50)[1]["nodes"]) == 50
    assert service.handle(c, "PUT", "/api/graphs/a")[0] == 404 and service.handle(c, "GET", "/else")[0] == 404
    assert service.handle(c, "DELETE", "/api/graphs/a") == (200, {"deleted": "a"}) and service.handle(c, "GET", "/api/graphs/a")[0] == 404


def test_status_of_a_failed_build(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "g"))
    bad = spark.createDataFrame([("d", "变体飞行器采用折叠机构。")], "doc_id string, text string").withColumn("text", F.when(F.raise_error(F.lit("lost")).isNull(), "x"))
    with pytest.raises(Exception, match="lost"):
        c.build("g", bad)
    assert c.meta("g")["status"] == "error" and "lost" in c.meta("g")["error"]
    c.add("g", spark.createDataFrame([("d", "变体飞行器采用折叠机构。变体飞行器采用折叠机构。")], "doc_id string, text string"))
    m = c.meta("g")
    assert m["status"] == "ready" and m["error"] is None and m["entities"] >= 0 and c.list().count() == 1


def test_versions_survive_a_broken_write(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.read() is None
    v.write(spark.range(3))
    (tmp_path / "t" / "v1").mkdir()  # a write that never ended
    assert v.read().count() == 3 and v.write(v.read().union(spark.range(2))).count() == 5 and v.numbers() == [0, 1]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    m = spark.createDataFrame([("d", 1, "t", "机翼", "Structure", 0, 2, "rule"), ("d", 2, "t", "尾翼", "Structure", 0, 2, "rule")],
                              "doc_id string, sentence_id int, text string, entity string, entity_type string, start_pos int, end_pos int, source string")
    src, nodes, check = (str(tmp_path / x) for x in ("m", "nodes", "c"))
    run = lambda: I.merge_nodes(spark.readStream.schema(m.schema).parquet(src), nodes, check).awaitTermination(120)
    m.write.parquet(src)
    run()
    before = sorted(map(tuple, I.read_nodes(spark, nodes).collect()))
    for x in (tmp_path / "c" / "commits").iterdir():  # the batch was written, but its commit was lost
        x.unlink()
    run()
    assert sorted(map(tuple, I.read_nodes(spark, nodes).collect())) == before and len(before) == 2
    for x in (tmp_path / "c" / "commits").iterdir():
        x.unlink()
    shutil.rmtree(tmp_path / "nodes" / "current")  # the batch was not finished
    run()
    assert sorted(map(tuple, I.read_nodes(spark, nodes).collect())) == before
    m.withColumn("entity_type", F.lit("Mission")).union(m.withColumn("entity", F.lit("舵面"))).write.mode("append").parquet(src)
    run()
    assert {(r["id"], r["entity_type"]) for r in I.read_nodes(spark, nodes).collect()} == {("机翼", "Structure"), ("尾翼", "Structure"), ("舵面", "Structure")}


def test_page_cascade(spark):
    good, fine, bad = "这是一段完全正常的中文文本内容。", "另一段也可以读懂的中文文本内容在此", "%$#@!&*()_+%$#@!"
    coded = "".join(f"(cid:{int.from_bytes(c.encode('gbk'), 'big')})" for c in "变体飞行器的机翼可以折叠")
    rows = [("a", 0, 0, bad), ("a", 0, 1, good), ("a", 0, 2, fine * 3), ("a", 1, 0, bad), ("a", 1, 2, fine), ("b", 0, 0, bad), ("b", 1, 0, None), ("b", 2, 0, coded), ("c", 0, 0, bad)]
    got = PG.read_pages(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string"),
                        spark.createDataFrame([("b", 0, f"```text\n{good}\n```"), ("b", 1, bad)], "doc_id string, page int, reply string"))
    assert {(r["doc_id"], r["page"]): r["text"] for r in got.collect()} == {("a", 0): good, ("a", 1): fine, ("b", 0): good, ("b", 1): "", ("b", 2): "变体飞行器的机翼可以折叠", ("c", 0): ""}
    assert {r["doc_id"]: r["text"] for r in PG.join_pages(got).collect()} == {"a": f"{good}\n{fine}", "b": f"{good}\n\n变体飞行器的机翼可以折叠", "c": ""}


def test_replies_and_types(spark):
    df = spark.createDataFrame([(x,) for x in ("```json\n[1]\n```", " ```\na\nb\nend", "plain\ntext", "```", None)], "x string")
    assert [r["y"] for r in df.select(X.drop_fence_lines(F.col("x")).alias("y")).collect()] == ["[1]", "a\nb", "plain\ntext", "", None]
    t = spark.createDataFrame([("机翼", "Structure", 2), ("机翼", "Aircraft", 3), ("机翼", "Mission", 1), (None, "x", 1)], "term string, entity_type string, ord int")
    assert N.last_types(t, "ord").first()["entity_type"] == "Aircraft" and N.last_types(t).first()["entity_type"] == "Structure"
    s = spark.createDataFrame([("d", 1, "机翼折叠")], "doc_id string, sentence_id int, text string")
    assert N.find_mentions(s, t, ZH, order="ord").first()["entity_type"] == "Aircraft"


def test_graph_store(spark, tmp_path):
    out = str(tmp_path / "log")

    def connect():
        def send(statement, params):
            with open(f"{out}-{abs(hash((statement, str(params))))}", "w") as f:
                f.write(f"{statement}\n{len(params.get('rows', ()))}")

        return send

    n, e = star(spark, 5)
    io.send_graph(n.coalesce(1), e.coalesce(1), connect, size=3)
    said = [p.read_text().rsplit("\n", 1) for p in tmp_path.iterdir()]
    assert sum(int(k) for s, k in said if "MERGE (n:Entity" in s) == 13 and sum(int(k) for s, k in said if "MATCH" in s) == 11
    assert any("CONSTRAINT" in s for s, _ in said) and max(int(k) for _, k in said) == 3
    assert "n:`Structure`" in io.node_statement("Structure") and "[e:`a``b`" in io.edge_statement("a`b") and "`Concept`" in io.node_statement(None)
