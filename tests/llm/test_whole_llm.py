"""The whole job where a cut once was."""

import random

import numpy as np

from textloom.llm.common import usual
from textloom.llm.encodings import pair_counts
from textloom.llm.leaks import Items, _best, find_leaks
from textloom.llm.scans import Contexts, _masked, codes, context_counts


def test_statistics_follow_the_data(spark):
    rows = spark.createDataFrame([("机翼可以折叠",)] * 8, "text string")
    got = [sorted(map(tuple, counts(rows.repartition(k)).collect())) for counts in (context_counts, lambda d: usual(pair_counts(d), "pairs")) for k in (1, 8)]
    assert got[0] == got[1] and got[2] == got[3] and {n for _, n in got[0] + got[2]} == {8}
    rng = np.random.default_rng(5)
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1000))) for _ in range(300)]
    kept = context_counts(spark.createDataFrame([(t,) for t in many * 2], "text string")).toPandas()
    assert len(kept) > 1 << 19
    found = Contexts(kept["key"].to_numpy(), kept["n"].to_numpy()).at(_masked(codes(many[0])))
    assert (np.maximum(found["s1"], found["s2"]) > 0).all()


def test_leak_beside_a_repeated_phrase(spark):
    r = random.Random(3)
    draw = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    item = draw(300)
    docs = [draw(400) + item[:30] * 40 + draw(900) + item[60:240] + draw(400), item[:30] * 40 + draw(900), draw(900) + item[100:280] + draw(900)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {x.doc_id for x in find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string"), cosine=0.3).collect()} == {0, 2}


def test_every_stretch_is_weighed():
    r = random.Random(4)
    for _ in range(200):
        it = Items([1], ["".join(r.choice("甲乙丙丁") for _ in range(30))])
        seq = np.array([r.choice(it.terms[0].tolist()) for _ in range(60)])
        reach = np.minimum(np.searchsorted(p := np.cumsum([r.randint(1, 9) for _ in seq]), p + 60), 60)
        most = max(it.common(0, seq[s : reach[s]]) for s in range(60))
        for need in (most - 0.5, most, most + 0.3):
            assert (_best(it, 0, seq, reach, need, need) >= need) == (most >= need)
