import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm.aliases import delete_hashes, map_names
from textloom.llm.copies import collapse_copies, flag_repeats
from textloom.llm.encodings import find_damage
from textloom.llm.leaks import Items, find_leaks, folded, grams
from textloom.llm.scans import SPACE, find_traces, fit, is_listing, mend
from textloom.llm.script import simplified
from textloom.llm.tokens import VOCABULARY, Lexicon, encode, load_ranks, merge_word

GROUPS = [
    ["GA-0616A 健康监测", "ga0616a健康监测 ", "【ＧＡ＿０６１６Ａ】健康·监测"],
    ["span=7.4m; Re=54.7; 批次=PG-4804F", "批次：PG4804F / re：54.7 / SPAN：7.4M", "{Re= 54.7 | span= 7.4m | 批次= pg-4804f}"],
    ["span=74m; Re=54.7; 批次=PG-4804F"], ["alpha=-9.7; Ma=2"], ["alpha=9.7; Ma=2"], [None, None], ["", "  "],
]


def test_singles_stay_behind_the_filters(spark):
    df = spark.range(6000).select(F.col("id").alias("node_no"), F.concat(F.lit("n"), F.when(F.col("id") % 100 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))).alias("name"), F.lit("x").alias("entity_type"))
    flagged = flag_repeats(df, "node_no", ("name", "entity_type"), max_log_bits=12)  # 15 slices of ten bits a key
    assert flagged.count() == 6000 and flagged.where("again").count() < 6000 * 0.1
    got = collapse_copies(df, max_log_bits=12)
    assert got.where("copies = 1").count() == 5940 and {(r.keep_no, r.copies) for r in got.where("copies > 1").collect()} == {(0, 60)}


@pytest.mark.parametrize("bits", [10, 20])
def test_copies(spark, bits):
    data, group = [], {}
    for g, names in enumerate(GROUPS):
        for n in names:
            group[len(data)] = g
            data.append((len(data), n, "Concept" if g % 2 else " CONCEPT", "x"))
    for i in range(400):
        group[len(data)] = 1000 + i % 150 if i >= 100 else 999
        data.append((len(data), f"Node {i % 150 if i >= 100 else 'hot'}" + " " * (i % 3), "Structure", "x"))
    df = spark.createDataFrame(data + data[:5], "node_no long, name string, entity_type string, keep_no string")
    got = {r[0]: (r[1], r[2]) for r in collapse_copies(df, max_log_bits=bits).collect()}
    for i in group:
        same = [j for j in group if group[j] == group[i]]
        assert got[i] == (min(same), len(same)), data[i]
    assert len(got) == len(data) and collapse_copies(df.limit(0)).count() == 0


HAVE = os.path.exists(VOCABULARY)


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50000), max_size=3), max_size=60))
@settings(max_examples=40, deadline=None)
def test_lexicon_is_exact(words):
    lex = Lexicon.build(sorted(words.items()))
    assert len(lex) == len(words)
    for w, ids in words.items():
        assert lex.find(w) == ids
    for w in (b"", b"\x00\x01\x02zz", *[w + b"!" for w in list(words)[:5]]):
        assert (lex.find(w) is None) == (w not in words)


def test_lexicon_shares_states():
    lex = Lexicon.build([(w.encode(), [i]) for i, w in enumerate(sorted(f"{a}{b}ation" for a in "abcdef" for b in "xyz"))])
    assert len(lex.base) < 20


@pytest.mark.skipif(not HAVE, reason="no vocabulary files")
def test_encoding_round_trip(spark):
    import tiktoken

    from textloom.llm.tokens import PATTERN

    ranks = load_ranks(VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = [None, "", " ", "<|endoftext|> hi", "𠮷野 🙂 é", "a  b\r\n\tc   ", "机翼的控制律。" * 20000, *["".join(r.choice("ab 机翼12.\n'é") for _ in range(r.randint(1, 60))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: list(x.ids) for x in encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert merge_word(ranks, "控制".encode()) == enc.encode_ordinary("控制")
    assert encode(df.limit(0)).count() == 0


def sentence(r):
    return "".join(r.choice("升力系数阻控制律飞行器机翼蒙皮应变温度压分布模型传感网络折叠展开") for _ in range(r.randint(20, 30))) + "。"


def test_leaks(spark):
    r = random.Random(3)
    items = [(i, "根据以下段落作答。\n" + "".join(sentence(r) for _ in range(8)), "qa") for i in range(6)] + [(90, None, "qa"), (91, "短", "qa")]
    body = [t.split("\n")[1] for _, t, _ in items[:6]]
    clean = ["".join(sentence(r) for _ in range(12)) for _ in range(40)]
    docs = clean + [clean[0] + body[0] + clean[1], body[1][: len(body[1]) * 2 // 3], "\n".join(body[2][i : i + 20] for i in range(0, len(body[2]), 20)), body[3][:30], None, "", clean[3] * 200 + body[4]]
    want = {(40, 0), (41, 1), (42, 2), (46, 4)}
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, share long")
    q = spark.createDataFrame(items, "item_id long, text string, task string")
    assert {(x.doc_id, x.item_id) for x in find_leaks(d, q).collect()} == want
    assert find_leaks(d.limit(0), q).count() == 0 and find_leaks(d, q.limit(0)).count() == 0


def test_leaks_reworded_tiny_and_in_blocks(spark):
    r = random.Random(9)
    words = [w for w in "lift drag wing control load path bench sensor fold hinge trim spar rib skin actuator gust margin mode sweep joint panel torque bearing damper".split()]
    filler = "north river garden window market yellow engine doctor paper winter bridge letter silver orange".split()
    text = lambda n: " ".join(r.choice(words) if i % 9 else f"{r.randint(100, 999)}.{r.randint(1, 9)}" for i in range(n))
    items = [(1, text(120)), (2, text(120)), (3, "机翼"), (4, "!?"), (5, " ".join(r.choice(words) for _ in range(3)))]
    changed = [w if i % 7 not in (0, 3) or any(c.isdigit() for c in w) else r.choice(filler) for i, w in enumerate(items[0][1].split())]
    numbers_gone = [w if not any(c.isdigit() for c in w) else "7" for w in changed]
    other = " ".join(r.choice(filler) for _ in range(400))
    docs = [(10, f"{other} {' '.join(changed)} {other}"), (11, f"{other} {' '.join(numbers_gone)} {other}"), (12, f"{other} {items[1][1]}"), (13, "折叠机翼。"), (14, f"{other} {items[4][1]} {other}"), (15, other)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ix = Items([1], [items[0][1]])
    f, _ = folded([docs[0][1]])
    term = ix.find(grams(f))
    assert ix.held(np.unique(term[term >= 0]))[0] < 0.4 * len(ix.terms[0])  # runs of letters alone would miss the reworded one
    want = {(10, 1), (12, 2), (13, 3), (14, 5)}
    for block in (1_000_000, 300):
        assert {(x.doc_id, x.item_id) for x in find_leaks(d, q, block_chars=block).collect()} == want


def test_leak_in_other_script(spark):
    r = random.Random(4)
    body = "".join(r.choice("升力系数阻尼控制律飞行器机翼蒙皮应变温压分布模型传感网络折叠结构驱动") for _ in range(120))
    to = {v: k for k, v in simplified(spark).items() if 0x4E00 <= k <= 0x9FFF and chr(k) in "數制飛機應變溫壓傳網絡疊結構驅動"}
    d = spark.createDataFrame([(1, body.translate(to)), (2, "".join(r.choice("甲乙丙丁戊") for _ in range(300)))], "doc_id long, text string")
    assert body.translate(to) != body
    assert [(x.doc_id, x.item_id) for x in find_leaks(d, spark.createDataFrame([(7, body)], "item_id long, text string")).collect()] == [(1, 7)]


def test_names(spark):
    ref = spark.createDataFrame([(1, "车轮驱动结构", "wheel drive structure", "WDS"), (2, "车轮结构", None, None), (3, "n" * 60 + "x" * 109, None, None), (4, None, "", None)],
                                "ref_id long, canonical string, name_en string, abbrev string")
    want = {0: ("車輪驅動結構", 1), 1: ("飛輪結構", -1), 2: ("亂縣結構", -1), 3: ("車輪結構", 2), 4: ("whele drive strcture", 1), 5: ("n" * 59 + "q" + "x" * 109, 3), 6: ("WDS", 1), 7: ("y" * 5000, -1),
            8: ("wheel", -1), 9: ("【车轮驱动结构】", 1), 10: ("structure, wheel drive", 1)}
    rows = [(i, v, "z") for i, (v, _) in want.items()] + [(0, "車輪驅動結構", "z"), (90, None, "z"), (91, " \u3000", "z")]
    df = spark.createDataFrame(rows, "alias_id long, alias string, ref_id string")
    assert {x.id: x.ref_id for x in map_names(df, ref, "alias_id", "alias").collect()} == {i: k for i, (_, k) in want.items()}
    assert {x.ref_id for x in map_names(df, ref.limit(0), "alias_id", "alias").collect()} == {-1}
    assert map_names(df.limit(0), ref, "alias_id", "alias").count() == 0


@given(st.text("abcdeé中", min_size=0, max_size=12), st.integers(1, 2))
@settings(max_examples=60, deadline=None)
def test_delete_hashes(s, depth):
    whole = lambda x: int(next(delete_hashes(x, 0))[0])
    want = {whole(s)} | {whole(s[:i] + s[i + 1 :]) for i in range(len(s))}
    if depth > 1:
        want |= {whole(s[:i] + s[i + 1 : j] + s[j + 1 :]) for i in range(len(s)) for j in range(i + 1, len(s))}
    assert {int(h) for part in delete_hashes(s, depth) for h in part} == want


def test_common_subsequence_is_exact():
    r = random.Random(1)
    it = Items([1], ["".join(r.choice("甲乙丙丁") for _ in range(60))])
    for _ in range(20):
        seq = [r.choice(it.terms[0].tolist() + [-1]) for _ in range(30)]
        a, b = it.terms[0].tolist(), seq
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert it.common(0, np.array(seq)) == t[-1][-1]


def test_scans(spark):
    r = random.Random(2)
    names = ["控制律", "试验平台", "线束接口", "飞行器"]
    s = lambda i: f"在第{i}次飞行中，带有冗余的{r.choice(names)}使升力系数提高了{i}%，这一结论得到重现。经过标定的{r.choice(names)}不适合低空滑翔。"
    rows = [("d", i, None, s(i), "标题") for i in range(300)] + [("e", i, 10 + i % 40, s(i), "标题") for i in range(200)]
    t = s(7)
    bad = [t[:20] + "\n" + t[20:], t[:9] + " ".join(t[9:20]) + t[20:], f"第 17 页 共 312 页\n{t}", "the reconfigu- ration of the wing"]
    good = ["（1）攻角为3度；\n（2）航程为4米；", "参数\t取值\n攻角\t45", None, "", " \n "]
    rows += [("f", i, 17, x, "标题") for i, x in enumerate(bad + good)]
    df = spark.createDataFrame(rows, "doc_id string, sentence_id int, page_no int, text string, title string")
    got = {(x.doc_id, x.sentence_id): x for x in find_traces(df).collect()}
    assert {k for k in got if k[0] == "f"} == {("f", i) for i in range(len(bad))}
    assert not [k for k in got if k[0] == "d"] and len([k for k in got if k[0] == "e"]) <= 2
    assert got["f", 0].mended == t
    assert find_traces(df.limit(0)).count() == 0


def scanned_table(spark, r):
    names = ["控制律", "试验平台", "线束接口", "飞行器", "传感网络", "升阻特性"]
    s = lambda i: f"在第{i}次飞行中，带有冗余的{r.choice(names)}使升力系数提高了{i}%，这一结论得到重现。经过标定的{r.choice(names)}不适合低空滑翔。"
    rows = [("d", i, None, s(i), "标题") for i in range(300)] + [("e", i, 10 + i % 40, s(i), "标题") for i in range(200)]
    clean = {("f", i): s(i) for i in range(60)}
    bad = {k: (t[:18] + "\n" + t[18:] if k[1] % 3 == 0 else t[:9] + " ".join(t[9:24]) + t[24:] if k[1] % 3 == 1 else t.replace("力", "刀", 1)) for k, t in clean.items()}
    rows += [(*k, 17, t, "标题") for k, t in bad.items()]
    rows += [("g", i, 12, s(i).replace("力", "刀", 1), "标题") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id string, sentence_id int, page_no int, text string, title string"), clean


def test_scans_are_the_taggers_decisions(spark):
    df, clean = scanned_table(spark, random.Random(6))
    got = {(x.doc_id, x.sentence_id): x.mended for x in find_traces(df).collect()}
    found = [k for k in clean if k in got]
    assert len(found) >= 0.95 * len(clean)
    assert sum(got[k] == clean[k] for k in found) >= 0.9 * len(found)  # the text before it was spoiled
    key, n, w, forms, taken = fit(df)
    keep = np.zeros_like(w)
    keep[:, 0] = 1
    assert find_traces(df, model=(key, n, keep, forms, taken)).count() == 0


def test_models_do_not_depend_on_partitions(spark):
    df, _ = scanned_table(spark, random.Random(8))
    seen = [sorted((x.doc_id, x.sentence_id, x.mended) for x in find_traces(df.repartition(n), check_damage=True).collect()) for n in (1, 8, 40)]
    assert seen[0] and seen[0] == seen[1] == seen[2]
    bad = df.where("doc_id = 'd'").withColumn("text", F.when(F.col("sentence_id") % 50 == 3, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text")))
    seen = [sorted((x.sentence_id, x.repaired) for x in find_damage(bad.repartition(n)).where("damaged > 0.5").collect()) for n in (1, 8, 200)]
    assert [i for i, _ in seen[0]] == list(range(3, 300, 50)) and seen[0] == seen[1] == seen[2]


def test_mend():
    assert mend("ab-\ncd\nef", [(2, 4), (3, 4), (6, SPACE)]) == "abcd ef"
    assert is_listing("1) a\n2) b") and not is_listing("a\nb") and not is_listing("1) a")
