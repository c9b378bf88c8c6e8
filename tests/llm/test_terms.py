import math
import random

from textloom.llm.common import scratch
from textloom.llm.terms import TermLedger, distinctive_terms, top_terms

SCHEMA = "term_id long, doc_id string, term string, freq long, loaded_at string, n long"


def rows(seed, n=300):
    r = random.Random(seed)
    words = ["Wing", " wing ", "ｗｉｎｇ", "flap  a", "机翼", None, "  ", "rare1"] + [f"w{i}" for i in range(20)]
    out = [(i, f"d{r.randint(0, 9) if r.random() < 0.6 else 0}", r.choice(words), r.choice([None, 1, 2, 5]), "a", 7) for i in range(n)]
    return out + [(*x[:4], "b", 7) for x in out[:20]]


def brute(data):
    import unicodedata

    seen, occ, files, docs = set(), {}, {}, set()
    for i, d, t, f, *_ in data:
        if i in seen or t is None or not t.strip():
            continue
        seen.add(i)
        k = " ".join(unicodedata.normalize("NFKC", t).lower().split())
        occ[k] = occ.get(k, 0) + (1 if f is None else f)
        files.setdefault(k, set()).add(d)
        docs.add(d)
    return {k: (occ[k], len(files[k])) for k in occ}, len(docs)


def test_ledger_counts_and_deltas(spark):
    data = rows(1)
    want, n = brute(data)
    df = spark.createDataFrame(data, SCHEMA)
    full = TermLedger(spark, scratch(spark, "t"), buckets=3)
    full.apply(df)
    got = {r.term: (r.freq, r.files) for r in full.counts().collect()}
    assert got == want and full.n_files() == n
    step = TermLedger(spark, scratch(spark, "t"), buckets=3)
    step.apply(df.where("term_id % 2 = 0"))
    step.apply(df.where("term_id % 2 = 1"))
    changed = [(*x[:3], 9, "c", 7) for x in data[:5] if x[2] and x[2].strip()]
    step.apply(spark.createDataFrame(changed, SCHEMA))
    step.apply(df.where(f"term_id < 5"))
    assert {r.term: (r.freq, r.files) for r in step.counts().collect()} == want
    step.apply(None, deleted=df.select("term_id"))
    assert step.counts().count() == 0


def test_ledger_grows_and_forgets(spark):
    data = rows(5)
    df = spark.createDataFrame(data, SCHEMA)
    led = TermLedger(spark, scratch(spark, "t"), buckets=2, bucket_rows=40)
    led.apply(df, deleted=df.where("term_id >= 50").select("term_id"))  # what is deleted at once never counts
    want, n = brute([x for x in data if x[0] < 50])
    assert {r.term: (r.freq, r.files) for r in led.counts().collect()} == want and led.n_files() == n
    for a in (50, 150, 250):
        led.apply(df.where(f"term_id >= {a} and term_id < {a + 100}"))
    assert led._manifest()[1] > 2  # written anew in more buckets
    changed = [(60, "d99", "wholly new", 4, "z", 0)]
    led.apply(spark.createDataFrame(changed, SCHEMA), deleted=df.where("term_id = 61").select("term_id"))
    want, n = brute([(60, "d99", "wholly new", 4)] + [x for x in data if x[0] not in (60, 61)])
    assert {r.term: (r.freq, r.files) for r in led.counts().collect()} == want and led.n_files() == n


def test_empty_and_verdicts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    led = TermLedger(spark, scratch(spark, "t"), buckets=2)
    led.apply(empty)
    assert led.verdicts().count() == 0
    assert top_terms(distinctive_terms(empty)).count() == 0
    data = [(i, f"d{i % 12}", "common", 1, "a", 0) for i in range(24)] + [(99, "d1", "once", 1, "a", 0), (98, "d1", "often", 3, "a", 0)]
    led = TermLedger(spark, scratch(spark, "t"), buckets=2)
    led.apply(spark.createDataFrame(data, SCHEMA))
    assert {r.term: r.verdict for r in led.verdicts().collect()} == {"common": "common", "once": "rare", "often": "kept"}


def test_weights(spark):
    data = rows(3)
    got = distinctive_terms(spark.createDataFrame(data, SCHEMA)).collect()
    n = got[0]["n"]
    for r in got:
        assert abs(r["tfidf"] - round(r["f"] * (math.log((1 + n) / (1 + r["d"])) + 1), 6)) < 2e-6
        assert math.isfinite(r["z"])
    top = top_terms(distinctive_terms(spark.createDataFrame(data, SCHEMA))).collect()
    for r in top:
        better = [x for x in got if x["doc_id"] == r["doc_id"] and x["d"] >= 2 and (-x["tfidf"], x["term"]) < (-r["tfidf"], r["term"])]
        assert len(better) == r["rank"] - 1
