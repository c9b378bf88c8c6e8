import pytest

from textloom.llm.aliases import ReferenceIndex, edit_distance, map_names
from textloom.llm.encodings import find_damage
from textloom.llm.script import simplified
from textloom.llm.sentences import gap_words, learn_abbreviations, split_offsets, split_sentences
from textloom.llm.spam import find_spam, shingles, strung

CASES = [
    ("攻角下降。是否够用?《能走多远？》一文给出上限。", [0, 5, 10]),
    ("“要不要再做一次？”负责人在会上问道。其余（见第12节。）沿用。", [0, 19]),
    ("结论有三：1.下降；2.可用；3.可省略。参见Fig. 7与Eq. (3)，变化。", [0, 21]),
    ("为0．37，即26．16％，满足．下一句｡", [0, 17]),
    ("Dr. Orvane signed sheet No. 26. The N.W.-style panel met on 4 Jan. 2031.At 0.5 N m. Done", [0, 32, 72, 84]),
    ('"Does it lock?" asked the reviewer. Seals, etc. were replaced. Hinges, etc. The end', [0, 36, 63, 76]),
    ("Logs are at http://a.example/run.5?mode=a.b for review. What failed?It did.", [0, 56, 68]),
    ("Die Messung vom 19. Mai ergab ca. 0,4 mm. „Hält es?“, fragte er. Ende z. B. hier.", [0, 42, 65]),
    ("परिणाम ठीक है। डॉ. ओरवन ने देखा। “क्या?” पूछा।", [0, 15, 33]),
    ("«Выдержит?» — спросил он. Узлы и т. д. до пуска. См. рис. 4.", [0, 26, 49]),
    ("ปีกพับได้ โครงสร้างดี", [0, 10]),
    ("「問題ない。」という返答。本当か？はい。", [0, 13, 17]),
    ("  第17章 故障注入", [2]),
    ("Well ... the unit stopped. V1.2.3 works", [0, 27]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_boundaries(text, want):
    assert split_offsets(text) == want


def test_gaps_by_words(spark):
    said = ["ปีกพับได้ทำงานตามปกติ", "โครงสร้างไม่มีรอยร้าว", "ทีมงานบันทึกผลไว้ครบถ้วน", "ระบบล็อกตอบสนองเร็วขึ้น", "ระบบล็อกทำงานตามปกติ", "โครงสร้างตอบสนองเร็วขึ้น", "ปีกพับได้ไม่มีรอยร้าว", "ทีมงานตอบสนองเร็วขึ้น"]
    rows = [("a", i, " ".join(said[(i * k) % 8] for k in range(1, 2 + i % 3))) for i in range(60)]
    inner = "ระบบ ล็อกทำงานตามปกติ"  # a gap inside a word that never closes a row, before one that never opens one
    rows += [("b", 0, inner), ("b", 1, f"{said[0]} {said[1]}"), ("b", 2, inner + " " + said[1])]
    df = spark.createDataFrame(rows, "doc_id string, sentence_id int, text string")
    words = gap_words(df)
    assert words.path("ระบบล็อกไม่มีรอยร้าว") == ("ระบบล็อก", "ไม่มีรอยร้าว")
    got = {(r.doc_id, r.sentence_id): r.starts for r in split_sentences(df).collect()}
    assert got["b", 0] == [0] and got["b", 1] == [0, len(said[0]) + 1] and got["b", 2] == [0, len(inner) + 1]
    assert split_offsets(inner) == [0, 5]  # without the dictionary every gap is an end
    assert all(len(v) == len(t.split()) for (d, i, t), v in ((r, got[r[0], r[1]]) for r in rows[:60]))


def test_lattice_of_marks():
    assert split_offsets("Ende. (Siehe unten. Und oben.) Neu.") == [0, 6, 31]
    long = "Das ist ein Satz. " * 20000
    assert len(split_offsets(long)) == 20000
    assert len(split_offsets("What? no. " * 5000)) < 10001


def test_learnt_abbreviations(spark):
    df = spark.createDataFrame([(f"Die Masse betr. {i} kg. Dann folgt ung. drei. Schluss folgt. Neu.",) for i in range(20)], "text string")
    known = learn_abbreviations(df)
    assert known["betr"] > 2 and known["ung"] > 2 and "folgt" not in known and "kg" not in known
    t = "Das betr. Teile ohne Last. Neu."
    assert split_offsets(t, None, {}) == [0, 10, 27] and split_offsets(t, None, known) == [0, 27]


def test_split_rows(spark):
    df = spark.createDataFrame([("a", 1, "A. b. C"), ("a", 2, None), ("a", 3, "  "), ("a", 4, "。" * 3), ("b", 1, "甲。" * 5000)], "doc_id string, sentence_id int, text string")
    got = {(r.doc_id, r.sentence_id): r.starts for r in split_sentences(df).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 1)} and len(got["b", 1]) == 5000
    assert split_sentences(df.limit(0)).count() == 0


REF = [(1, "推力矢量传力路径", "thrust vectoring load path", "TVLP"), (2, "双稳态锁定装置", "bistable locking device", "BLD"), (3, "柔性后缘线束接口", "compliant trailing edge harness interface", None)]


@pytest.mark.parametrize("value,ref", [
    ("推力矢量·传力路径", 1), ("推刀矢量传力路径", 1), ("推力矢量传路力径", 1), ("ＴＶＬＰ", 1), ("t.v.l.p.", 1), ("load path of thrust vectoring type", 1),
    ("load path, thrust vectoring", 1), ("Thrust_Vectoring_Load_Paths", 1), ("thrust vectoringload pth", 1), ("新型双稳态锁定装置（BLD）", 2), ("雙穩態鎖定裝置", 2),
    ("柔性後緣線束接口", 3), ("双稳态传力路径", -1), ("推力矢量锁定装置", -1), ("折纸构形传力路径", -1), ("tbd", -1), ("load path", -1), ("", -1), (None, -1),
])
def test_names(value, ref, spark):
    assert ReferenceIndex(REF, variants=simplified(spark)).lookup(value) == ref


def test_distance_matches_neighbourhood():
    assert edit_distance("abcd", "abdc", 2) == 0.8 and edit_distance("abbc", "abc", 2) == 0.7
    assert edit_distance("abcdef", "uvwxyz", 2) == float("inf")


def test_map_names(spark):
    ref = spark.createDataFrame([(*r, "Structure") for r in REF], "ref_id long, canonical string, name_en string, abbrev string, entity_type string")
    data = [(i, v, "x") for i, v in enumerate(["BLD", None, "  ", "tbd"] + ["推力矢量传力路径"] * 300)] + [(0, "BLD", "x")]
    got = {r.id: r.ref_id for r in map_names(spark.createDataFrame(data, "a long, alias string, canonical string"), ref, "a", "alias").collect()}
    assert got == {0: 2, 3: -1} | {i: 1 for i in range(4, 304)}
    assert map_names(spark.createDataFrame([], "a long, alias string"), ref, "a", "alias").count() == 0
    assert {r.ref_id for r in map_names(spark.createDataFrame(data, "a long, alias string, canonical string"), ref.limit(0), "a", "alias").collect()} == {-1}


def test_damage(spark):
    zh = [f"在第{i}次飞行中，带有冗余的控制律使升力系数提高了{i}%，这一结论得到重现。" for i in range(150)]
    fr = [f"Après l’étude numérique, le montage n° {i} s’écarte très peu du modèle, à charge réduite." for i in range(80)]
    bad = [zh[3].encode().decode("gbk", "replace"), zh[4].encode().decode("latin-1"), zh[5].encode("gbk").decode("latin-1"), fr[2].encode().decode("cp1252", "replace"),
           fr[7].encode().decode("mac_roman"), zh[8][:12] + zh[8][12:].encode().decode("cp437"), zh[9].encode("gbk").decode("utf-8", "replace")]
    texts = [*zh, *fr, *bad, None, "", "检查单标注□合格", "α ≤ 3°"]
    df = spark.createDataFrame([(f"d{i % 3}", i, t, i) for i, t in enumerate(texts)], "doc_id string, sentence_id int, text string, damaged int")
    got = {r.sentence_id: r for r in find_damage(df).where("damaged > 0.5").collect()}
    first = len(zh) + len(fr)
    assert set(got) == set(range(first, first + len(bad)))
    assert got[first + 1].repaired == zh[4] and got[first + 2].repaired == zh[5] and got[first + 4].repaired == fr[7] and got[first + 5].repaired == zh[8]
    assert find_damage(df.limit(0)).count() == 0


def test_damage_in_a_small_table(spark):
    r = __import__("random").Random(4)
    words = "крыло привод датчик профиль нагрузка скорость угол поток шарнир обшивка модель стенд испытание показало предел запас режим".split()
    rows = [("d", i, " ".join(r.choice(words) for _ in range(14)).capitalize() + ".") for i in range(200)]
    bad = {17: ("koi8-r", "cp1251"), 90: ("cp1251", "koi8-r"), 150: ("cp1251", "cp1252")}
    text = lambda i, t: t.encode(bad[i][0]).decode(bad[i][1]) if i in bad else t
    df = spark.createDataFrame([(d, i, text(i, t)) for d, i, t in rows], "doc_id string, sentence_id int, text string")
    got = {x.sentence_id: x.repaired for x in find_damage(df).where("damaged > 0.5").collect()}
    assert got == {i: rows[i][2] for i in bad}


LISTS = [
    "符号表\n" + "\n".join(f"{c}_{i}  攻角, m/s" for i, c in enumerate("ABCDEFGHJKLM")),
    "目录\n" + "\n".join(f"{i}.1 风洞吹风......{i}" for i in range(1, 20)),
    "References\n" + "\n".join(f"[{i}] Orvane K. On the drag rise. Notes, 20{i + 10}, 3(1), 3-11." for i in range(12)),
    "Glossary\n" + "\n".join(f"hinge type load model, see response time {i}" for i in range(12)),
    "\n".join(f"攻角\t{i}.5\t{i}\tkPa" for i in range(20)),
    "关键词：航程；模态测试；蒙皮；飞行\n在取消测试之后，控制律没有出现明显的偏移。",
    "aaaaaaaa" * 50, " " * 300 + "x",
]
SPAM = [
    "，".join(f"{c} 试验平台{k}" for c in ("石桥", "云泽", "南浦") for k in ("报价", "批发", "最新", "价格", "图片")),
    "\n".join(f"https://a{i}.example/tag/{i}" for i in range(12)),
    " ".join(f'<a href="http://h{i}.test/{i}">load model</a>' for i in range(9)),
    " ".join(f"【地面样机{i}】 ¥{i}99 #控制律{i} tag:飞行器{i}" for i in range(9)),
    " | ".join(f"Q-{i}81C spar frame supplier" for i in range(12)),
    "。".join(f"想买折叠翼控制律？折叠翼控制律{k}、折叠翼控制律{k}，{c}折叠翼控制律{k}" for c in ("石桥", "云泽") for k in ("报价", "批发", "最新", "价格")) + "。",
    " ".join(f"Our folding wing control law {k} is the folding wing control law {k} in {c}." for c in ("Norhaven", "Eastmoor") for k in ("price", "buy", "best")),
]


def test_strung():
    for t in LISTS:
        _, size, total = strung(t)
        assert size <= 0.3 * total, t[:40]
    for t in SPAM:
        _, size, total = strung(t)
        assert size > 0.7 * total, t[:40]


def test_spam_pages(spark):
    texts = LISTS + SPAM + [None, "", "  "]
    df = spark.createDataFrame([(i, t, f"h{i % 4}" if i % 5 else None, i) for i, t in enumerate(texts)], "doc_id long, text string, source string, density int")
    assert {r.doc_id for r in find_spam(df).collect()} == set(range(len(LISTS), len(LISTS) + len(SPAM)))
    assert find_spam(df.limit(0)).count() == 0
    both = [{(r.doc_id, r.stitched) for r in find_spam(df, max_log_bits=b).collect()} for b in (28, 5)]  # with the filter and without
    assert both[0] == both[1]


def test_shingles():
    doc, h = shingles(["a b c d e f", "x A b c d e", "12 a b c d", "甲乙丙丁戊己", ""])
    by = {i: set(h[doc == i].tolist()) for i in range(5)}
    assert len(by[0]) == 2 and len(by[0] & by[1]) == 1 and len(by[3]) == 2 and not by[4]
    assert len(shingles([])[0]) == 0
