"""The whole job where a cut once was."""

import math

from textloom.operators import terms as T
from textloom.plans import registry
from textloom.plans.pipeline import dictionary
from textloom.profile import ZH


def _written(spark, tmp_path):
    """Documents with 90 terms, each twice, and others that repeat or overlap themselves."""
    words = [chr(0x4E00 + 40 * i) + chr(0x4E11 + 40 * i) for i in range(90)]
    texts = ["。".join(words[i::3]) + "。翼翼翼翼。翼机翼机翼" for i in range(3)] * 2
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return docs, texts


def test_cohesion_of_all_candidates(spark, tmp_path):
    docs, texts = _written(spark, tmp_path)
    got = {r.term: r.pmi for r in registry.pmi_char(spark, str(tmp_path)).collect()}
    joined = "\n".join(texts)
    cut = lambda t, i: math.log2(joined.count(t) * len(joined) / max(1, joined.count(t[:i])) / max(1, joined.count(t[i:])))
    want = {r.term: min(cut(r.term, i) for i in range(1, len(r.term))) for r in T.ngram_candidates(docs, ZH).collect() if r.term in joined}
    assert len(want) > 90 and got == {t: round(x, 5) for t, x in want.items()}
    plain = {r.term: r.score for r in T.term_scores(T.ngram_candidates(docs, ZH), T.tfidf(docs, ZH), T.pmi(docs, T.ngram_candidates(docs, ZH), 0), ZH).collect()}
    for r in registry.term_scores(spark, str(tmp_path)).collect():
        assert abs(r.score - plain[r.term] - 0.1 * max(0, want.get(r.term, 0))) < 2e-3, r.term


def test_dictionary_is_ranked_with_cohesion(spark):
    docs = spark.createDataFrame([("a", "乾坤。乾坤。舵翼。舵翼。乾乾乾乾乾坤坤坤坤坤")], "doc_id string, text string")  # 乾坤 is first by term alone
    assert [r.term for r in dictionary(docs, ZH, 1).collect()] == ["舵翼"]


def test_graph_takes_its_terms_from_the_documents(spark, tmp_path):
    docs = [("a", "折翼飞机采用变形驱动。折翼飞机，变形驱动"), ("b", "折翼飞机。变形驱动")]
    spark.createDataFrame(docs, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "canonical string, entity_type string").write.parquet(str(tmp_path / "term_reference.parquet"))
    assert registry.graph_from_documents(spark, str(tmp_path)).count() > 0
