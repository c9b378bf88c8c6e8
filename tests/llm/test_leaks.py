"""How the places of the items' terms are found, stored and read again."""

import random

import numpy as np
import pytest

from textloom.llm.leaks import Items, _batches, find_leaks, folded, grams, item_hits


def han(r, n):
    return "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))


def test_places_are_those_of_a_plain_search():
    r = random.Random(2)
    it = Items([1], [han(r, 20_000)], log_slots=10)
    assert it.rest and (it.slot[1] >= 0).any()  # terms in both tables and in neither
    h = np.concatenate([it.vocabulary, np.random.default_rng(2).integers(0, 1 << 62, 200_000), [-1]])[np.random.default_rng(3).permutation(len(it.vocabulary) + 200_001)]
    number = {x: i for i, x in enumerate(it.vocabulary.tolist())}
    want = [(at, number[x]) for at, x in enumerate(h.tolist()) if x in number]
    at, term = it.places(h)
    assert list(zip(at.tolist(), term.tolist(), strict=True)) == want and len(want) == len(number)


@pytest.mark.parametrize(("letters", "size"), [(400, 6), (70_000, 8)])
def test_hits_are_stored_as_bytes(spark, letters, size):
    r = random.Random(letters)
    item = han(r, letters)
    texts = [item[:300], "z" * 40, item[20:90] + "z" * 70_000 + item[5:50], None, "", "，。", "z" + item[100:104], item[-200:] + "z" * 5 + item[:9]]
    it = Items([1], [item])
    sent, docs = spark.sparkContext.broadcast(it), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    hits = item_hits(docs, "doc_id", "text", sent, 0.3).where("what = 'hits'").select("d", "at", "term")
    assert [f.dataType.simpleString() for f in hits.schema.fields[1:]] == ["binary", "binary"]
    got, used, total = {}, sum(len(x.at) + len(x.term) for x in hits.collect()), 0
    for cut in (1, 60, 150_000):
        for p, a, z, at, term, starts, ends in _batches(hits.toArrow().combine_chunks().to_batches(), it.number, cut):
            assert (starts[1:] == ends[:-1] + 1).all() and starts[0] == 0
            for d, s, e in zip(p.column(0).to_pylist()[a:z], starts, ends, strict=True):
                mine = (at >= s) & (at < e)
                got.setdefault(d, []).append(list(zip((at[mine] - s).tolist(), term[mine].tolist(), strict=True)))
    number = {x: i for i, x in enumerate(it.vocabulary.tolist())}
    for d, t in enumerate(texts):
        want = [(i, number[x]) for i, x in enumerate(grams(folded([t])[0]).tolist()) if x in number] if t else []
        total += len(want)
        assert got.get(d, [[]] * 3) == [want] * 3
    assert used == size * total and {d for d in got} == {0, 2, 6, 7}


def test_leak_far_into_a_text(spark):
    r = random.Random(6)
    items = [(i, han(r, 200)) for i in range(3)]
    docs = [(0, "z" * 70_000 + items[0][1] + "z" * 90_000 + items[2][1][:150]), (1, items[0][1][:20] + "z" * 70_000 + items[0][1][20:60]), (2, han(r, 300) + items[1][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 3, 8):
        assert {(x.doc_id, x.item_id) for x in find_leaks(d.repartition(k), q).collect()} == {(0, 0), (0, 2), (2, 1)}
