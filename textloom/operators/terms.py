"""Candidate terms: n-grams, TF-IDF, cohesion, scores, and the merges that curate a dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.profile import Profile
from textloom.sources.store import stored


def _parts(p: Profile, text_col: str) -> Column:
    c = F.coalesce(F.col(text_col), F.lit(""))
    return F.split(c, "[^一-鿿A-Za-z0-9]+") if p.name == "zh" else F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))


def tokens(docs: DataFrame, p: Profile, text_col: str = "text") -> DataFrame:
    """docs with ``tokens``: the valid tokens of the whole text in order, in normal form."""
    return docs.withColumn("tokens", F.transform(F.filter(_parts(p, text_col), lambda t: X.valid_token(t, p)), X.normalize_term))


def token_counts(docs: DataFrame, p: Profile, by: str | None = None, text_col: str = "text") -> DataFrame:
    """(by,) term, tf of the valid tokens. Noise is judged once per distinct token, after the first count."""
    keys = ["d"] if by else []
    cols = [F.col(by).alias("d")] if by else []
    raw = docs.select(*cols, F.explode(_parts(p, text_col)).alias("token")).where(X.token_shape(F.col("token"), p))
    n = raw.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf")).where(~X.is_noise(F.col("token"), p))
    return n.groupBy(*keys, X.normalize_term(F.col("token")).alias("term")).agg(F.sum("tf").alias("tf"))


def token_freq(docs: DataFrame, p: Profile) -> DataFrame:
    return token_counts(docs, p).select(F.col("term").alias("token"), F.col("tf").alias("freq"))


def _ngram_arrays(c: Column, n: int, sep: str) -> Column:
    at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(c, i, n), sep))


def ngram_candidates(docs: DataFrame, p: Profile, min_freq: int | None = None) -> DataFrame:
    """term, freq of n-grams over the valid tokens of each document.

    The windows run over the filtered tokens, so they bridge dropped tokens and sentence ends; pass
    sentences instead of documents for bounded ones. Counted per n and document first, so what
    is shuffled are partial counts.
    """
    sep = "" if p.name == "zh" else " "
    grams = F.flatten(F.array(*[_ngram_arrays(F.col("tokens"), n, sep) for n in range(1, p.max_ngram + 1)]))
    t = tokens(docs, p).select(F.explode(grams).alias("term")).where(F.length("term").between(2, p.max_term))
    counted = t.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).where(~X.is_noise(F.col("term"), p))
    least = p.min_freq if min_freq is None else min_freq
    return counted.where((F.col("freq") >= least) & X.valid_token(F.col("term"), p)) if least > 1 else counted


def tfidf(docs: DataFrame, p: Profile, id_col: str = "doc_id", l2: bool = False, vocabulary: int = 8000) -> DataFrame:
    """term, tfidf summed over the documents, with the smooth idf ln((1+N)/(1+df))+1.

    ``l2``: the vocabulary is cut to the most frequent tokens, valid or not, each document's vector over it has length
    1, and only then are the valid ones taken, added up by normal form. Counts by document and token are stored: they
    give the document frequencies, the norms and the sums.
    """
    n = docs.count()
    if not l2:
        tf = stored(token_counts(docs, p, id_col), "tf")
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return tf.join(df, "term").groupBy("term").agg(F.sum(F.col("tf") * (F.ln((F.lit(1.0) + n) / (1 + F.col("df"))) + 1)).alias("tfidf"))
    parts = docs.select(F.col(id_col).alias("d"), F.explode(_parts(p, "text")).alias("token")).where("token <> ''")
    tf = stored(parts.groupBy("d", "token").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.col("total").desc(), "token").limit(vocabulary)
    w = tf.join(F.broadcast(df), "token").withColumn("w", F.col("tf") * (F.ln((F.lit(1.0) + n) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("d").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    valid = w.where(X.valid_token(F.col("token"), p))
    return valid.join(norm, "d").groupBy(X.normalize_term(F.col("token")).alias("term")).agg(F.sum(F.col("w") / F.col("norm")).alias("tfidf"))


def needle_counts(docs: DataFrame, needles: list[str], text_col: str = "text") -> DataFrame:
    """needle, n: non-overlapping occurrences of each needle in the lower-cased texts.

    The needles are a capped list; one automaton per task finds them all in one pass over the texts.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sorted(set(needles) - {""}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words = sent.value
        one, plain, bordered = {}, ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, w in enumerate(words):
            if len(w) == 1:
                one[w] = i
            else:  # only a needle that begins as it ends can overlap itself
                (bordered if any(w.startswith(w[k:]) for k in range(1, len(w))) else plain).add_word(w, i)
        chars, found = Counter(), Counter()
        for a in (plain, bordered):
            if len(a):
                a.make_automaton()
        for p in parts:
            for t in p["t"]:
                chars.update(t)
                if len(plain):
                    found.update(map(itemgetter(1), plain.iter(t)))
                free: dict[int, int] = {}
                for end, i in bordered.iter(t) if len(bordered) else ():
                    if end - len(words[i]) + 1 >= free.get(i, 0):
                        found[i] += 1
                        free[i] = end + 1
        found.update({i: chars[w] for w, i in one.items() if chars[w]})
        if found:
            yield pd.DataFrame({"needle": [words[i] for i in found], "n": list(found.values())})

    if not sent.value:
        return spark.createDataFrame([], "needle string, n long")
    low = docs.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return low.mapInPandas(run, "needle string, n long").groupBy("needle").agg(F.sum("n").alias("n"))


def pmi(docs: DataFrame, candidates: DataFrame, cap: int, text_col: str = "text") -> DataFrame:
    """term, pmi: the least log2(tf*C/(left*right)) over all ways to cut the term in two.

    ``candidates`` (term, freq) is cut to the ``cap`` first by frequency, length and term; C is the
    number of characters of all texts joined by line ends. Terms that don't occur have no score.
    """
    top = candidates.where(F.length("term") > 1).orderBy(F.col("freq").desc(), F.length("term").desc(), "term").limit(cap).select("term")
    at = F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("i")
    cuts = stored(top.select("term", at).select("term", F.expr("substring(term, 1, i)").alias("l"), F.expr("substring(term, i + 1)").alias("r")), "cuts")
    needles = cuts.select(F.explode(F.array("term", "l", "r")).alias("x")).distinct().toArrow()["x"].to_pylist()
    counts = stored(needle_counts(docs, needles, text_col), "needles")
    size = docs.agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))) + F.count(F.lit(1)) - 1).first()[0] or 0
    few = F.broadcast if len(needles) <= 1_000_000 else (lambda df: df)
    n = lambda k: few(counts.select(F.col("needle").alias(k), F.col("n").alias(f"n_{k}")))
    got = cuts.join(n("term"), "term").join(n("l"), "l", "left").join(n("r"), "r", "left")
    many = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(1)).cast("double")
    return got.groupBy("term").agg(F.min(F.log2(F.col("n_term") * F.lit(float(size)) / (many("n_l") * many("n_r")))).alias("pmi"))


def pmi_tokens(docs: DataFrame, p: Profile, min_freq: int | None = None) -> DataFrame:
    """term (tokens joined by a space), freq, pmi: cohesion of n-grams on token boundaries, the least
    log2(c*N/(left*right)) over all cuts, with N tokens in all.

    Counts, not texts, are joined, so the cost follows the number of distinct n-grams; no cap is needed.
    """
    least = p.min_freq if min_freq is None else min_freq
    grams = F.flatten(F.array(*[_ngram_arrays(F.col("tokens"), n, " ") for n in range(1, p.max_ngram + 1)]))
    c = tokens(docs, p).select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("parts", F.split("g", " "))
    total = c.where(F.size("parts") == 1).agg(F.sum("c")).first()[0] or 0
    many = c.where((F.size("parts") > 1) & (F.col("c") >= least))
    cut = many.select("g", F.col("c").alias("freq"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    cut = cut.select("g", "freq", F.array_join(F.slice("parts", F.lit(1), F.col("i")), " ").alias("l"), F.array_join(F.slice("parts", F.col("i") + 1, F.size("parts")), " ").alias("r"))
    side = lambda k: c.select(F.col("g").alias(k), F.col("c").cast("double").alias(f"n_{k}"))
    got = cut.join(side("l"), "l").join(side("r"), "r")
    return got.groupBy(F.col("g").alias("term"), "freq").agg(F.min(F.log2(F.col("freq") * F.lit(float(total)) / (F.col("n_l") * F.col("n_r")))).alias("pmi"))


def term_scores(freq: DataFrame, weights: DataFrame, cohesion: DataFrame, p: Profile) -> DataFrame:
    """All columns of a term table, scored 0.6 freq + 0.3 tfidf + 0.1 positive pmi."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        freq.join(weights, "term", "left").join(cohesion, "term", "left")
        .select("term", "freq", z("tfidf").alias("tfidf"), z("pmi").alias("pmi"),
                F.round(0.6 * F.col("freq") + 0.3 * z("tfidf") + 0.1 * F.greatest(z("pmi"), F.lit(0.0)), 6).alias("score"),
                X.infer_type(F.col("term"), p.type_rules, p.default_type).alias("entity_type"))
    )


def extract_terms(docs: DataFrame, p: Profile, id_col: str = "doc_id") -> DataFrame:
    """The raw term table of a corpus: every candidate with freq, tfidf, pmi, score, entity_type, keep and alias.

    The candidates are counted once and stored; the ranking for cohesion and the scores read them.
    """
    freq = stored(ngram_candidates(docs, p), "candidates")
    got = term_scores(freq, tfidf(docs, p, id_col), pmi(docs, freq, p.max_pmi), p)
    return got.withColumn("keep", F.lit("Y")).withColumn("alias", F.lit(""))


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """The k best terms by score, frequency and term: a total order."""
    return scored.orderBy(F.col("score").desc(), F.col("freq").desc(), "term").limit(k)


def reject_reason(c: Column, p: Profile) -> Column:
    """Why a term doesn't enter the dictionary, the first rule that hits; null if none does."""
    out = F.when(c == "", "blank").when(c.isin(*p.trigger_words), "trigger").when(c.isin(*p.final_noise), "noise")
    out = out.when(c.rlike(X.ASCII_WORD) & ~F.lower(c).isin(*p.final_latin_keep), "foreign")
    out = out.when(F.length(c) <= 1, "short").when(c.rlike(r"\A[0-9]+\z"), "digits").when(c.rlike("\\A[图表式第][0-9]"), "caption")
    return out.when(c.rlike("|".join(f"(?:{x})" for x in p.pragmatic)), "pragmatic")


def finalize_terms(terms: DataFrame, p: Profile, replies: DataFrame | None = None) -> DataFrame:
    """terms with ``reject_reason``, and the type and alias the dictionary takes.

    ``replies`` (term, entity_type, alias): a model's review; if it has any row, terms it lacks are
    rejected, and its types other than the default and its aliases for terms without one hold.
    """
    t = terms.withColumn("term", X.strip(F.coalesce("term", F.lit(""))))
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit(""))
    base = t.withColumn("reject_reason", reject_reason(F.col("term"), p)).withColumn("kind", F.when(blank("entity_type") == "", p.default_type).otherwise(blank("entity_type")))
    base = base.withColumn("alias", blank("alias"))
    if replies is not None:
        r = replies.select(X.strip(F.col("term")).alias("term"), F.col("entity_type").alias("r_type"), F.col("alias").alias("r_alias"), F.lit(True).alias("reviewed"))
        any_reply = replies.limit(1).count() > 0
        base = base.join(r, "term", "left")
        if any_reply:
            base = base.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("reviewed").isNull(), F.lit("unreviewed"))))
        good = F.coalesce(F.col("r_type"), F.lit("")).isin("", p.default_type)
        base = base.withColumn("kind", F.when(~good, F.col("r_type")).otherwise(F.col("kind"))).withColumn(
            "alias", F.when(F.col("alias") == "", F.coalesce("r_alias", F.lit(""))).otherwise(F.col("alias"))).drop("r_type", "r_alias", "reviewed")
    inferred = X.infer_type(F.col("term"), p.fine_type_rules, p.default_type)
    return base.withColumn("entity_type", F.when(F.col("kind") == p.default_type, inferred).otherwise(F.col("kind"))).drop("kind")


def request_batches(terms: DataFrame, top_n: int, batch_size: int) -> DataFrame:
    """term, batch, place: the first ``top_n`` terms in order of score, in batches for a model."""
    w = Window.orderBy(F.col("score").desc(), F.col("freq").desc(), "term")
    first = top_terms(terms, top_n).withColumn("place", F.row_number().over(w))
    return first.select("term", F.floor((F.col("place") - 1) / batch_size).cast("int").alias("batch"), "place")


REPLY = "array<struct<term:string,keep:string,canonical:string,entity_type:string>>"


def merge_replies(terms: DataFrame, replies: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Terms a model keeps, with its canonical name and, if allowed, its type.

    ``replies``: reply STRING (JSON, maybe fenced). A reply that isn't JSON yields nothing.
    """
    r = (replies.select(F.inline(F.from_json(X.strip_fences(F.col("reply")), REPLY)))
         .where("keep = 'Y' and term is not null").dropDuplicates(["term"]).withColumnRenamed("entity_type", "r_type"))
    return terms.join(r.select("term", "canonical", "r_type"), "term").select(
        "term", "freq", "score", F.coalesce(F.when(F.col("canonical") != "", F.col("canonical")), F.col("term")).alias("canonical"),
        F.when(F.col("r_type").isin(*allowed), F.col("r_type")).otherwise(F.col("entity_type")).alias("entity_type"))


def merge_reviewed(known: DataFrame, raw: DataFrame, reviewed: DataFrame, cap: int = 300) -> DataFrame:
    """A dictionary grown by reviewed terms: of the terms not yet known the best ``cap`` are reviewed, all
    others enter with keep N. Columns: term, freq, keep, entity_type, alias."""
    new = raw.join(known.select("term"), "term", "left_anti")
    sent = new.orderBy(F.col("score").desc(), "term").limit(cap).select("term", F.lit(True).alias("sent"))
    r = reviewed.select("term", F.col("keep").alias("r_keep"), F.col("entity_type").alias("r_type"), F.col("alias").alias("r_alias"))
    fresh = new.join(sent, "term", "left").join(r, "term", "left").select(
        "term", "freq", F.when(F.col("sent") & (F.col("r_keep") == "Y"), "Y").otherwise("N").alias("keep"),
        F.when(F.col("sent"), F.coalesce("r_type", "entity_type")).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(F.col("sent"), F.coalesce("r_alias", F.lit(""))).otherwise(F.lit("")).alias("alias"))
    return known.select("term", "freq", "keep", "entity_type", "alias").unionByName(fresh)


def type_distribution(rows: DataFrame, col: str) -> DataFrame:
    """Each value of a column with its rows and share, null as empty."""
    n = rows.groupBy(F.coalesce(F.col(col), F.lit("")).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
