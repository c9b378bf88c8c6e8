"""Queries of this package for the driver contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.aliases import map_names
from textloom.llm.common import scratch, sql_fold_width, table
from textloom.llm.copies import DASHES, collapse_copies
from textloom.llm.encodings import find_damage
from textloom.llm.leaks import find_leaks
from textloom.llm.scans import find_traces
from textloom.llm.sentences import split_sentences
from textloom.llm.spam import find_spam
from textloom.llm.terms import TermLedger, distinctive_terms, top_terms
from textloom.llm.tokens import encode


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, files and verdict: the rows arrive in two batches, the first half by time of
    loading and then the later ones, with the records delivered again among them, as deltas."""
    rows = table(spark, d, "terms_clean")
    middle = rows.agg(F.percentile_approx(F.unix_micros(F.col("loaded_at").cast("timestamp")), 0.5).alias("m")).first()["m"]
    late = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")) > F.lit(middle), F.lit(False))
    ledger = TermLedger(spark, scratch(spark, "ledger"))
    for batch in (rows.where(~late), rows.where(late)):
        ledger.apply(batch)
    return ledger.verdicts()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).where("verdict <> 'kept'").select("term", "verdict")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    field = F.when(F.col("page_no").isNull(), "digital").otherwise("page")
    return find_damage(table(spark, d, "all_sentences", spread=True), field=field)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).where("damaged > 0.5").select("doc_id", "sentence_id")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The damaged rows with the text that was brought back; ``lost`` where some of it is gone."""
    return _p2(spark, d).where("damaged > 0.5").select(
        "doc_id", "sentence_id", "chain", F.col("repaired").contains("�").alias("lost"), "repaired")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_terms(distinctive_terms(table(spark, d, "terms_clean"))).select("doc_id", "term")


def p3_zscores(spark: SparkSession, d: str) -> DataFrame:
    """Each file's terms with tfidf and the z-score of their log-odds."""
    return distinctive_terms(table(spark, d, "terms_clean")).select("doc_id", "term", "f", "d", "tfidf", F.round("z", 4).alias("z"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "all_sentences", spread=True).where("page_no is null")
    bad = find_damage(rows).where("damaged > 0.5").select("doc_id", "sentence_id", F.lit(True).alias("bad"))
    units = split_sentences(rows).dropDuplicates(["doc_id", "sentence_id"]).join(bad, ["doc_id", "sentence_id"], "left")
    starts = F.when(F.col("bad"), F.slice("starts", 1, 1)).otherwise(F.col("starts"))
    return units.select("doc_id", "sentence_id", F.explode(starts).alias("unit_start"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "term_reference")
    parts = [map_names(table(spark, d, t), ref, i, v).select(F.lit(o).alias("origin"), F.col("id").alias("row_id"), "ref_id")
             for o, t, i, v in (("alias", "alias_final", "alias_id", "alias"), ("entity", "entities_clean", "mention_id", "entity"))]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = collapse_copies(table(spark, d, "nodes"))
    return got.where("node_no <> keep_no").select("keep_no", F.col("node_no").alias("copy_no"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct node with the rows it stood for."""
    return collapse_copies(table(spark, d, "nodes")).where("node_no = keep_no").select("keep_no", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("doc_id", "sentence_id")


def p7_mended(spark: SparkSession, d: str) -> DataFrame:
    """The rows with traces of scanning as continuous text."""
    return _p7(spark, d).select("doc_id", "sentence_id", "mended")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return find_traces(table(spark, d, "all_sentences", spread=True), check_damage=True)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents", spread=True))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", spread=True), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spam(table(spark, d, "documents", spread=True)).select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_repaired, p3_found, p3_zscores, p4_found, p5_found, p6_found, p6_groups, p7_found, p7_mended, p8_ids, p9_found, p10_found)}


_NORMAL = f"lower(trim(regexp_replace({sql_fold_width('term')}, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')))"
_TERMS = f"""
WITH one AS (
  SELECT term_id, min({{{{'loaded_at': loaded_at, 'doc_id': doc_id, 'term': term, 'freq': freq}}}}) AS r FROM terms_clean GROUP BY term_id),
named AS (SELECT r.doc_id AS doc_id, r.term AS term, coalesce(r.freq, 1) AS freq FROM one WHERE r.term IS NOT NULL),
t AS (SELECT doc_id, {_NORMAL} AS term, freq FROM named),
f AS (SELECT doc_id, term, sum(freq)::BIGINT AS f FROM t WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM f),
w AS (SELECT term, sum(f)::BIGINT AS freq, count(*) AS files FROM f GROUP BY term)
""".replace("{{", "{").replace("}}", "}")
_VERDICT = "CASE WHEN files > 0.1 * n THEN 'common' WHEN files = 1 AND freq < 3 THEN 'rare' ELSE 'kept' END"


def _canonical(c: str) -> str:
    """The canonical form of copies, without lookaround: what belongs to a value is put aside first."""
    s = f"lower(translate({sql_fold_width(c)}, '{DASHES}', '{'-' * len(DASHES)}'))"
    ends = r"[;,|、，；\n\r]+"
    parts = rf"regexp_split_to_array(regexp_replace({s}, '/([^/=:;,|、，；\n\r]*[=:])', ';\1', 'g'), '{ends}')"
    bare = lambda x: rf"regexp_replace({x}, '[\t-\r \x{{85}}\p{{Z}}]+', '', 'g')"
    # Marks that can't be left over stand for point and minus: letters of a private area.
    dots = lambda x: rf"regexp_replace(regexp_replace({x}, '([0-9])\.([0-9])', '\1' || chr(57600) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57600) || '\2', 'g')"
    minus = lambda x: rf"regexp_replace({x}, '([=:])-(\.?[0-9])', '\1' || chr(57601) || '\2', 'g')"
    kept = lambda x: rf"replace(replace(regexp_replace({minus(dots(bare(x)))}, '[\p{{P}}\p{{S}}\p{{Cc}}\p{{Cf}}]', '', 'g'), chr(57600), '.'), chr(57601), '-')"
    real = f"list_filter({parts}, lambda x: length({kept('x')}) > 0)"
    entries = f"(len({real}) > 1 AND len(list_filter({real}, lambda x: regexp_matches(x, '[=:]'))) = len({real}))"
    return f"CASE WHEN {entries} THEN array_to_string(list_sort(list_transform({real}, lambda x: {kept('x')})), '|') ELSE {kept(s)} END"


_GROUPS = f"""WITH k AS (SELECT node_no, {_canonical('name')} AS a, {_canonical('entity_type')} AS b FROM nodes),
g AS (SELECT node_no, min(node_no) OVER w AS keep_no, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY a, b))"""
_Z = f"""{_TERMS}, a AS (SELECT doc_id, sum(f) AS nd FROM f GROUP BY doc_id), e AS (SELECT sum(f)::DOUBLE AS everything FROM f),
j AS (SELECT f.doc_id, f.term, f.f, w.files AS d, n, nd::DOUBLE AS nd, everything, f.f + 1000.0::DOUBLE / everything * w.freq AS here, w.freq - f.f + 1000.0::DOUBLE / everything * w.freq AS rest
      FROM f JOIN w ON f.term = w.term JOIN a ON a.doc_id = f.doc_id, n, e),
o AS (SELECT *, nd + 1000.0::DOUBLE - here AS hn, everything - nd + 1000.0::DOUBLE - rest AS rn FROM j)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_TERMS} SELECT term, {_VERDICT} AS verdict FROM w, n WHERE {_VERDICT} <> 'kept'",
        "p1_counts": f"{_TERMS} SELECT term, freq, files, {_VERDICT} AS verdict FROM w, n",
        "p3_found": f"""{_TERMS}, s AS (
            SELECT doc_id, f.term, round(f * (ln((1.0 + n) / (1 + files)) + 1), 6) AS score FROM f JOIN w ON f.term = w.term, n WHERE files >= 2)
            SELECT doc_id, term FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 3""",
        "p3_zscores": f"""{_Z} SELECT doc_id, term, f, d, round(f * (ln((1.0::DOUBLE + n) / (1 + d)) + 1), 6) AS tfidf,
            round(CASE WHEN hn > 0 AND rn > 0 THEN (ln(here) - ln(hn) - ln(rest) + ln(rn)) / sqrt(1 / here + 1 / rest) ELSE 0 END, 4) AS z FROM o""",
        "p6_found": f"{_GROUPS} SELECT keep_no, node_no AS copy_no FROM g WHERE node_no <> keep_no",
        "p6_groups": f"{_GROUPS} SELECT keep_no, copies FROM g WHERE node_no = keep_no",
    }
