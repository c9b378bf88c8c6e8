import random

import numpy as np

from textloom.llm import encodings, scans
from textloom.llm.encodings import PairModel, find_stretches
from textloom.llm.scans import SEP, Contexts, Forms, Slots, _keys, _masked, codes, features, misread_as, traces
from textloom.llm.sentences import _MARK, _marks

CLEAN = [f"在第{i % 7}次飞行中，带有冗余的控制律使升力系数提高，这一结论得到重现。" for i in range(60)] + [f"The hinge type load model number {i} holds the angle of attack below the limit." for i in range(60)]
TAKEN = {"力": "刀", "系": "糸", "o": "0", "l": "1"}


def contexts(texts):
    c = codes(SEP.join(texts))
    m = _masked(c)
    return Contexts(*np.unique(np.concatenate([((k << 21) | m)[c != 0x1E] for k in _keys(m)]), return_counts=True))


def spoilt(seed):
    r = random.Random(seed)
    out = []
    for t in CLEAN:
        t = t.replace("力", "刀") if r.random() < 0.3 else t.replace("load", "l0ad") if r.random() < 0.3 else t
        at = r.randrange(len(t))
        t = t[:at] + r.choice(["", "", "\n", "-\n", " 第 3 页 ", "qzx", "\n— 12 —\n"]) + t[at:]
        out.append(t)
    return [*out, "1. angle\n2. limit\n3. qzxj", "a\tb\nqzx\tw", "", "力 系 数 提 高 的", "a\x1eb"]


def test_lookups_are_where_they_matter(monkeypatch):
    ctx, texts, asked = contexts(CLEAN), spoilt(1), []
    place = Slots._place
    monkeypatch.setattr(Slots, "_place", lambda self, keys, t: (asked.append(len(keys)), place(self, keys, t))[1])
    got = misread_as(texts, [], ctx)
    chars = len(SEP.join(texts))
    assert sum(asked) < 3 * chars  # two tables of four kinds would be eight a character
    c = codes(SEP.join(t.replace(SEP, " ") for t in texts))
    m, x = _masked(c), ctx.at(_masked(c))
    hit = np.flatnonzero((x["b1"] != m) & (x["b1"] == x["b2"]) & (x["b1"] > 0x40) & (c > 0x2F) & (np.minimum(x["n1"], x["n2"]) >= np.maximum(x["s1"], x["s2"]) + 4) & (np.minimum(x["d1"], x["d2"]) >= 6))
    assert got == [(chr(m[i]), chr(x["b1"][i])) for i in hit] and ("刀", "力") in got


def test_places_without_a_possible_edit_are_not_tagged(monkeypatch):
    ctx, forms = contexts(CLEAN), Forms(["— 0 —", "第 0 页"])
    lists = ["1. angle\n2. limit\n3. qzxj", "a\tb\nqzx\tw"]
    assert len(features(lists, [1, 2], ctx, forms, TAKEN, all_places=False)[2]["at"])
    assert not len(features(lists, [1, 2], ctx, forms, TAKEN, all_places=False, checked=True)[2]["at"])
    every = features
    for seed in range(4):  # whatever the weights, no edit is lost
        w = np.random.default_rng(seed).normal(size=(1 << 18, 5)).astype(np.float32)
        texts = spoilt(seed)
        pages = [i % 20 for i in range(len(texts))]
        monkeypatch.setattr(scans, "features", every)
        less = traces(texts, pages, ctx, w, forms, TAKEN)
        monkeypatch.setattr(scans, "features", lambda *a, checked, **k: every(*a, **k))
        assert less == traces(texts, pages, ctx, w, forms, TAKEN) and any(less)


def test_damage_is_weighed_with_few_lookups(monkeypatch):
    zh = [f"在第{i}次飞行中，带有冗余的控制律使升力系数提高了{i}%，这一结论得到重现。" for i in range(60)]
    fr = [f"Après l’étude numérique, le montage n° {i} s’écarte très peu du modèle, à charge réduite." for i in range(60)]
    c = encodings.codes(SEP.join(zh + fr))
    pair = encodings.pairs_of(c)[(c[:-1] != 0x1E) & (c[1:] != 0x1E)]
    model, asked = PairModel(*np.unique(pair, return_counts=True)), []
    of_pairs = PairModel.of_pairs
    monkeypatch.setattr(PairModel, "of_pairs", lambda self, p: (asked.append(len(p)), of_pairs(self, p))[1])
    texts = zh + fr + [zh[3].encode("gbk").decode("big5", "replace"), fr[3].encode("cp1252", "ignore").decode("mac_roman"), "？？", "什么??吗", "a??b????", ""]
    found = find_stretches(texts, model)
    assert sum(asked) < 1.3 * len(SEP.join(texts))  # what stands there is looked up once, not anew for each chain
    row = len(zh) + len(fr) + 1
    at = {(s, e, was): g for r, s, e, chain, was, g in found if (r, chain) == (row, "cp1252>mac_roman")}
    score = lambda t: float(of_pairs(model, encodings.pairs_of(encodings.codes(SEP + t + SEP))).astype(np.float64).sum())
    t = texts[row]
    assert at and all(abs(score(t[:s] + was + t[e:]) - score(t) - g) < 1e-3 for (s, e, was), g in at.items())
    assert [(r - row, s, e, was) for r, s, e, chain, was, _ in found if chain == "lost" and r > row] == [(2, 2, 4, "??"), (3, 1, 3, "??"), (3, 4, 8, "????")]


def test_undone_characters_are_those_of_the_codecs():
    for true, read in encodings.ONE_TO_ONE_NARROW:
        table = encodings._undo(true, read)
        for b in range(0x80, 0x100):
            shown, was = bytes([b]).decode(read, "replace"), bytes([b]).decode(true, "replace")
            if "�" not in shown + was and ord(shown) < 0xD800 and ord(shown) > 0x7F and ord(was) > 0x9F and shown != was:
                assert table[ord(shown)] == ord(was)
        assert np.count_nonzero(table) <= 128
    bits = encodings._undoable(encodings.ONE_TO_ONE_NARROW)
    assert all(((bits >> i & 1) > 0).tolist() == (encodings._undo(*x) > 0).tolist() for i, x in enumerate(encodings.ONE_TO_ONE_NARROW))


def test_marks_are_found_from_their_first_characters():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("a甲 .．。…?？!”」»)\n  ;") for _ in range(r.randrange(30)))
        assert list(_marks(t)) == [m.span() for m in _MARK.finditer(t)]
