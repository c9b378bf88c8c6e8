"""Sentences of texts in many scripts (problem 4).

Scripts with end marks: every mark that may end a sentence is a node of a lattice whose edges are the possible
sentences. A node's weight comes from the token before it (number, initial, title, abbreviation, unit), from what
follows and from the quotation or bracket it stands in; an edge costs what is odd about the sentence (no letter,
small initial, a bracket left open). The best path through all of a text's nodes is taken. Whether a token is an
abbreviation is learnt from what follows its points in the collection; the fixed lists are the prior.

Scripts without end marks (Thai, Lao, Khmer, Burmese): a dictionary is mined from the collection (frequent pieces
with different neighbours), each stretch between gaps is a lattice of its words, and a
gap is an end if the last word of the best path before it and the first one after it are such as close and open rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import scratch, stored

# Marks and abbreviations.
OPEN = {"(": ")", "（": "）", "[": "]", "［": "］", "《": "》", "〈": "〉", "「": "」", "『": "』", "【": "】", "“": "”", "„": "“", "«": "»", "‘": "’"}
BRACKETS = set("(（[［【")
TITLES = set("《〈")
CLOSERS = ")）]］》〉」』】”“»\"’"
FULL = ".．。｡।॥۔።"
ASK = "?？!！؟‽⁇⁈⁉"
BEFORE_NAME = frozenset("dr prof mr mrs ms mme mlle m st ing dipl fig figs eq eqs sect sec app tab no nr nos abb gl ver vol bd kap cf vgl z.b e.g i.e инж проф рис табл акад г см док д-р डॉ प्रो श्री".split())
BEFORE_NUMBER = BEFORE_NAME | frozenset("approx ca env vs p pp ok ок ca. jan feb mar apr jun jul aug sep sept oct nov dec bzw ex стр т".split())
MAY_END = frozenset("etc usw inc ltd co corp al a.m p.m jr sr u.a t.d т.д т.п др jan feb mar apr jun jul aug sep sept oct nov dec u.s e.v".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
JA_AFTER_QUOTE = "とっのはがをにでへもやか"
GAP_SCRIPTS = "฀-๿຀-໿ក-៿က-႟"

_MARK = re.compile(rf"(?:\.\.\.+|…+|[{FULL}{ASK}]+)[{FULL}{ASK}]*(?:[   ]?(?=»)|)[{re.escape(CLOSERS)}]*")
_STOP = re.compile(f"[…{FULL}{ASK}]")  # what a mark begins with
_GAP = re.compile(rf"(?<=[{GAP_SCRIPTS}])[  ]+(?=[{GAP_SCRIPTS}])")
_TOKEN = re.compile(r"[^\s(\[（「“\"«„,，;；:：]*$")
_RUN = re.compile(f"[{GAP_SCRIPTS}]+")
_RUN_END = re.compile(f"[{GAP_SCRIPTS}]+$")
_HAS_GAP = re.compile(f"[{GAP_SCRIPTS}]")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]$")
_LIST = re.compile(r"(?:^|[：；:;\n。！？]\s*)\d{1,2}$")
_PAIRED = re.compile(r"[()（）\[\]［］《》〈〉「」『』【】“”„«»\"]")
_OPENED = re.compile(r"[(（\[［《〈「『【“„«\"]")
_DEPTH = re.compile(r"[(\[（［【{)\]）］】}]")
_ENDED = re.compile(rf"[{FULL}{ASK}]\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_TAIL = re.compile(r"[A-Za-z\u00b5\u00c0-\u052f](?:[A-Za-z\u00b5\u00c0-\u052f]|\.|-)*$")
_LAST = re.compile(r"[.\-]")
_AFTER_NUMBER = re.compile(r"\d[  ]?$")
_UNIT = re.compile(r"(?:\d|[%°]|\d\s*[A-Za-zµ·/]+)\s*[A-Za-zµ·/]?$")
_ABBREVIATION = re.compile(r"(?:[^\W\d_]{1,2}\.\s?)*[^\W\d_]+$")


@lru_cache(maxsize=0x10000)
def _kind(ch: str) -> str:
    """h Han, k kana, d Devanagari, g a script without end marks, l cased letters, 9 digit, - other."""
    if "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿" or ch in "〆々":
        return "h"
    if "぀" <= ch <= "ヿ":
        return "k"
    if "ऀ" <= ch <= "ॿ":
        return "d"
    if _HAS_GAP.match(ch):
        return "g"
    return "l" if ch.isalpha() else "9" if ch.isdigit() else "-"


def _regions(text: str) -> list[tuple[int, int]]:
    """Matched pairs of brackets and quotation marks; an unmatched mark has none."""
    out, stack, straight = [], [], -1
    for m in _PAIRED.finditer(text):
        ch, i = m.group(), m.start()
        if ch == '"':
            if straight >= 0:
                out.append((straight, i))
                straight = -1
            else:
                straight = i
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == ch), None)
        if hit is not None and not (ch == "“" and stack[hit][2] != "„"):
            out.append((stack[hit][0], i))
            del stack[hit:]
        elif ch in OPEN:
            stack.append((i, OPEN[ch], ch))
    return out


def _weight(text: str, start: int, end: int, mark: str, regions: list[tuple[int, int]], abbreviations: dict[str, float]) -> float:
    """Log-odds, roughly, that a sentence ends at ``end``; marks at the end of the text always do.

    ``abbreviations``: how strongly the collection speaks for a token being one (for a listed one 4 are added)."""
    n = len(text)
    rest = end
    while rest < n and text[rest].isspace():
        rest += 1
    if rest >= n:
        return 9.0
    core = mark.rstrip(CLOSERS + "   ")
    closed = len(mark) > len(core)
    nxt, spaced = text[rest], rest > end
    prev = text[start - 1] if start else " "
    kp, kn = _kind(prev), _kind(nxt)
    if any(a < start and end <= b for a, b in regions):
        return -9.0  # within a bracket or quotation that goes on
    if core[:1] in "…" or core.startswith("..."):
        return 3.0 if (kn == "l" and nxt.isupper() and spaced) or nxt in "“「\n" else -5.0
    if nxt in ",，、;；:：)）]】" or nxt in FULL + ASK:
        return -9.0
    spaceless = kn in "hk" or (kn not in "ld" and kp in "hk")
    if closed:
        around = [a for a, b in regions if start <= b < end]
        opener = text[min(around)] if around else ""
        if opener in BRACKETS and text[: min(around)].strip() and not _ENDED.search(text[: min(around)]):
            return -9.0
        if opener in TITLES:
            return -6.0
        if kp in "hkd" or kn in "hkd":
            if core[-1] in ASK:
                return -4.0 if kn in "hkdl-9" else 3.0
            if nxt in JA_AFTER_QUOTE or nxt in "的—":
                return -6.0
            if kn in "hkd" or spaced:
                return 4.0
        if nxt in "—–-":
            return -5.0
    if core[0] in ASK or core[-1] in ASK:
        if kp not in "hkdg" and not spaced and nxt.isascii() and (nxt.isalnum() or nxt in "=&/_") and (nxt.islower() or nxt.isdigit()):
            return -8.0  # inside an address
        if kn == "l":
            return 5.0 if nxt.isupper() or kp in "hkd" else (-4.0 if spaced else -6.0)
        return 5.0
    if core[0] in "。｡।॥۔።":
        return 6.0
    # Points, of either width.
    token = _TOKEN.search(text, max(0, start - 24), start).group()
    wide = core[0] == "．"
    if kp == "9" and kn == "9" and not spaced:
        return -9.0
    if kp == "d" and not closed:
        return -6.0  # Devanagari ends with a danda; points are abbreviations
    word = token.lower().rstrip(".")
    if kp == "9":
        if _LIST.search(text, max(0, start - 6), start) and not wide:
            return -6.0
        if not token.replace(".", "").replace(",", "").isdigit():
            return 4.0 if not (nxt.islower() and kn == "l") else -6.0
        if kn == "l" and nxt.islower():
            return -6.0
        if kn == "l" and spaced and _WORD.match(text, rest).group().lower() in MONTHS:
            return -6.0
        return 4.0
    if kp == "l" or (token and token[-1:].isalpha() and kp != "h"):
        tail = _LATIN_TAIL.search(token)
        tail = tail.group() if tail else token
        word = tail.lower().rstrip(".")
        if not spaced and nxt.isascii() and (nxt.isalnum() and (nxt.islower() or nxt.isdigit()) or nxt in "-/_"):
            return -8.0  # names of files and sites, versions, Dr.-Ing.
        last = _LAST.split(word)[-1]
        if kn == "9" and (word in BEFORE_NUMBER or last in BEFORE_NUMBER):
            return -7.0
        name = tail[-len(last) :]
        if "." not in tail and kn not in "9-" and not nxt.islower() and _AFTER_NUMBER.search(text[max(0, start - len(tail) - 2) : start - len(tail)]):
            return 4.0  # a unit of measure
        joined = _before(text, start)
        listed = word in BEFORE_NAME or last in BEFORE_NAME or joined in MAY_END or word in MAY_END
        if not listed and abbreviations.get(word, 0.0) > 0:
            return -7.0 if kn == "9" or nxt.islower() or abbreviations[word] > 2 else 3.0
        if joined in MAY_END or word in MAY_END or last in ("etc", "usw"):
            return 3.0 if (kn in "lhk" and not nxt.islower()) or nxt in "“\"«„「" else -5.0
        small = last in ("m", "ms", "st") and not name[:1].isupper()  # units, not titles
        if not small and (word in BEFORE_NAME or last in BEFORE_NAME) and (word in BEFORE_NAME or len(word) < 8 or name[:1].isupper()):
            if not (word == "no" and spaced and kn == "l" and nxt.isupper()):
                return -7.0
        if _DOTTED.fullmatch(word) and len(last) == 1:
            unit = _UNIT.search(text[max(0, start - 9) : start - 1])
            if unit and kn != "9" and not (kn == "l" and nxt.islower()):
                return 4.0
            return -6.0
        if kn == "l":
            return 4.0 if not nxt.islower() else -6.0
        if nxt in "(（" and not spaceless:
            return -3.0 if last in ("fig", "eq", "gl", "abb", "tab") else 2.0
        return 4.0
    if kn == "l" and nxt.islower() and kp != "h":
        return -5.0
    return 4.0


def _before(text: str, start: int) -> str:
    """The abbreviation that ends at ``start``, over its inner spaces ("т. д" is "т.д")."""
    m = _ABBREVIATION.search(text[max(0, start - 12) : start])
    return re.sub(r"\s", "", m.group()).lower() if m else ""


# Vowels of Thai and Lao that stand before, and that stand after their consonant.
LEADING, TRAILING = "เแโใไເແໂໃໄ", "ะาำๅະາຳ"


@lru_cache(maxsize=4096)
def _joins(ch: str) -> bool:
    """Whether a character belongs to the one before it."""
    return ch in TRAILING or unicodedata.category(ch) in ("Mn", "Mc")


class GapWords:
    """The dictionary of the scripts without end marks and what it says about gaps.

    ``words``: how often each stands in the collection; ``opening`` and ``closing``: the log-odds that a word
    which opens (closes) a stretch opens (closes) a row, against its standing within one.
    """

    def __init__(self, words: dict[str, int], opening: dict[str, float] | None = None, closing: dict[str, float] | None = None):
        total = sum(words.values()) + 1.0
        self.cost = {w: math.log(total / n) for w, n in words.items()}
        self.longest = max(map(len, words), default=1)
        self.unknown = math.log(total) + 2.0
        self.opening, self.closing = opening or {}, closing or {}

    @lru_cache(maxsize=100_000)  # noqa: B019
    def path(self, run: str) -> tuple[str, ...]:
        """The best path through the word lattice of a stretch; what no word covers goes by single characters
        with the marks that belong to them."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == math.inf:
                continue
            j = i + 1
            while j < n and _joins(run[j]):
                j += 1
            if best[i] + self.unknown < best[j]:
                best[j], back[j] = best[i] + self.unknown, i
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = self.cost.get(run[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out = []
        while n > 0:
            out.append(run[back[n] : n])
            n = back[n]
        return tuple(reversed(out))

    def _paid(self, path: tuple[str, ...]) -> float:
        return sum(self.cost.get(w, self.unknown) for w in path)

    def ends(self, before: str, after: str) -> bool:
        """Whether the gap between two stretches ends a sentence: the odds of the word that closes the one and of
        the word that opens the other, less what the path saves if a word may run across the gap. Words never
        seen at a row's edge nor within a stretch say nothing."""
        a, b = self.path(before), self.path(after)
        if not a or not b:
            return True
        across = self._paid(a[-4:]) + self._paid(b[:4]) - self._paid(self.path("".join(a[-4:] + b[:4])))
        return self.closing.get(a[-1], 0.0) + self.opening.get(b[0], 0.0) - max(0.0, across) >= 0.0


def _best_path(text: str, nodes: list[tuple[int, float]]) -> list[int]:
    """The ends on the best path through the lattice of marks (end, weight), which begins and ends with the text.

    A sentence without letter or digit costs 4, one that begins small 1.5, one that leaves a bracket open 2. What a
    sentence costs depends on its beginning's depth and letters before it, so the best two beginnings of each depth
    (with different letter counts) are all that later nodes can want: one pass, however long the text."""
    opens, letters, at, depth = [0], [0], 0, 0
    starts = []
    nested = _DEPTH.search(text) is not None
    for end, _ in nodes:
        part = text[at:end]
        if nested:
            for m in _DEPTH.findall(part):
                depth += 1 if m in "([（［【{" else -1
        opens.append(depth)
        letters.append(letters[-1] + (any(map(str.isalnum, part))))
        at = end
        starts.append(end)
    begins: dict[int, list[tuple[float, int, int]]] = {0: [(0.0, 0, -1)]}  # depth -> (score, letters, node)
    back = []
    for i, (end, weight) in enumerate(nodes):
        here, many = opens[i + 1], letters[i + 1]
        score, of = max([(s - 2.0 * (d != here) - 4.0 * (n == many), k) for d, two in begins.items() for s, n, k in two])
        back.append(of)
        nxt = text[end : end + 4].lstrip()
        mine = (score + weight - 1.5 * nxt[:1].islower(), many, i)
        two = sorted([*begins.get(here, []), mine], reverse=True)
        begins[here] = [two[0], *[x for x in two[1:] if x[1] != two[0][1]][:1]]
    # The text's end is a node that every path takes.
    final = [(s - 4.0 * (n == letters[-1] and not any(map(str.isalnum, text[at:]))), k) for two in begins.values() for s, n, k in two]
    out, k = [], max(final)[1]
    while k >= 0:
        out.append(starts[k])
        k = back[k]
    return out[::-1]


def _marks(text: str) -> Iterator[tuple[int, int]]:
    """Where the marks of a text stand; between them only their first characters are looked for."""
    end = 0
    for stop in _STOP.finditer(text):
        if stop.start() >= end:
            start, end = _MARK.match(text, stop.start()).span()
            yield start, end


def split_offsets(text: str | None, gaps: GapWords | None = None, abbreviations: dict[str, float] | None = None) -> list[int]:
    """Code-point offsets at which the sentences of a text begin; none for a null or blank text.

    Without a dictionary (``gaps``) every gap of a script without end marks ends a sentence.
    """
    if text is None or not (body := text.strip()):
        return []
    first = text.index(body[0])
    regions = _regions(text) if _OPENED.search(text) else []
    closing = {b for _, b in regions}
    nodes, known = [], abbreviations or {}
    for start, end in _marks(text):
        for i in range(start, end):
            if text[i] in CLOSERS and i not in closing:  # it opens what follows, or stands alone
                end = i
                break
        w = _weight(text, start, end, text[start:end], regions, known)
        if w > -9.0 and (not nodes or nodes[-1][0] < end):
            nodes.append((end, w))
    cuts = [e for e, _ in nodes] if all(w >= 9.0 for _, w in nodes) else _best_path(text, nodes)
    if not text.isascii() and _HAS_GAP.search(text):
        at = 0
        for m in _GAP.finditer(text):
            if gaps is None or gaps.ends(_RUN_END.search(text, at, m.start()).group(), _RUN.match(text, m.end()).group()):
                cuts.append(m.end())
            at = m.end()
    out = [first]
    for c in sorted(cuts):
        while c < len(text) and text[c].isspace():
            c += 1
        if c < len(text) and c > out[-1]:
            out.append(c)
    return out


def learn_abbreviations(df: DataFrame, text_col: str = "text", least: int = 5) -> dict[str, float]:
    """For tokens of up to eight letters the log-odds that what follows their point goes on with the sentence (a small
    letter, digit or comma) rather than begins one, counted over all rows; of tokens that do so ``least`` times.
    Ends of rows don't count. The tokens are closed-class, so the table stays small."""
    hits = F.regexp_extract_all(F.col(text_col), F.lit(r"([\p{L}][\p{L}.\-]{0,7}\.\s?[\p{L}\p{N},;])"), F.lit(1))
    x = df.where(F.col(text_col).contains(".")).select(F.explode(hits).alias("x"))
    n = (x.select(F.lower(F.regexp_extract("x", r"^(.*?)\.\s?.$", 1)).alias("w"), F.col("x").rlike(r"\.\s?[\p{Ll}\p{N},;]$").alias("on"), F.col("x").rlike(r"\s.$").alias("spaced"))
         .where("spaced and length(w) > 0").groupBy("w").agg(F.sum(F.col("on").cast("int")).alias("on"), F.sum((~F.col("on")).cast("int")).alias("off")))
    got = n.where((F.col("on") >= least) & (F.col("on") > F.col("off"))).collect()
    return {r["w"]: math.log((r["on"] + 0.5) / (r["off"] + 0.5)) for r in got}


def mine_words(runs: DataFrame, most: int = 50_000, longest: int = 16, least: int = 3) -> dict[str, int]:
    """The words of stretches (run, n): pieces of at most ``longest`` characters that occur ``least`` times and have at
    least two different neighbours, or an edge, on either side, and stretches of up to four times that length that
    occur as often (set phrases); the ``most`` frequent (the dictionary's size)."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen: dict[tuple[str, str, str], int] = {}
            for run, n in zip(p["run"], p["n"], strict=True):
                t = f"^{run}$"
                good = [i for i in range(1, len(t)) if not _joins(t[i]) and t[i - 1] not in LEADING]
                for x, i in enumerate(good):
                    for j in good[x + 1 :]:
                        if j - i > longest:
                            break
                        k = (t[i:j], t[i - 1], t[j])
                        seen[k] = seen.get(k, 0) + n
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["w", "l", "r", "n"])

    pieces_of = runs.mapInPandas(cut, "w string, l string, r string, n long").groupBy("w").agg(
        F.sum("n").alias("n"), F.count_distinct("l").alias("nl"), F.count_distinct("r").alias("nr"), F.max(F.col("l") == "^").alias("first"), F.max(F.col("r") == "$").alias("last"))
    known = stored(pieces_of.where(F.col("n") >= least), scratch(runs.sparkSession, "words"))
    whole = runs.where((F.col("n") >= least) & F.length("run").between(longest + 1, 4 * longest)).select(F.col("run").alias("w"), "n")
    free = known.where("(nl >= 2 or first) and (nr >= 2 or last)").select("w", "n").unionByName(whole).orderBy(F.col("n").desc(), "w").limit(most)
    return {r["w"]: r["n"] for r in free.collect()}


def gap_words(df: DataFrame, text_col: str = "text") -> GapWords:
    """The dictionary of the scripts without end marks and the odds of its words at rows' edges.

    All rows count. Each different stretch between gaps is cut once, weighted by how often it occurs, so a
    hot row costs one. Two rounds: words by frequency, then their counts on best paths.
    """
    spark = df.sparkSession
    rows = df.where(F.col(text_col).rlike(f"[{GAP_SCRIPTS}]")).select(F.trim(F.col(text_col)).alias("t"))
    bare = rf"[{GAP_SCRIPTS}]+"
    every = rows.select(F.explode(F.regexp_extract_all("t", F.lit(f"({bare})"), F.lit(1))).alias("run"), F.regexp_extract("t", f"^({bare})", 1).alias("a"), F.regexp_extract("t", f"({bare})$", 1).alias("z"))
    counted = every.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("run") == F.col("a")).cast("long")).alias("opens"), F.sum((F.col("run") == F.col("z")).cast("long")).alias("closes"))
    counted = stored(counted, scratch(spark, "runs"))
    first = GapWords(mine_words(counted.select("run", "n")))
    sent = spark.sparkContext.broadcast(first)

    def on_paths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen: dict[str, list[int]] = {}
            for run, n, opens, closes in p[["run", "n", "opens", "closes"]].itertuples(index=False):
                path = sent.value.path(run)
                for i, w in enumerate(path):
                    x = seen.setdefault(w, [0, 0, 0, 0, 0])
                    x[0] += n
                    x[1] += opens if i == 0 else 0
                    x[2] += closes if i == len(path) - 1 else 0
                    x[3] += n if i > 0 else 0  # not first in its stretch
                    x[4] += n if i < len(path) - 1 else 0
            yield pd.DataFrame([(w, *x) for w, x in seen.items()], columns=["w", "n", "opens", "closes", "inner_o", "inner_c"])

    cols = ("n", "opens", "closes", "inner_o", "inner_c")
    got = (counted.mapInPandas(on_paths, "w string, " + ", ".join(f"{c} long" for c in cols)).groupBy("w").agg(*[F.sum(c).alias(c) for c in cols])
           .orderBy(F.col("n").desc(), "w").limit(2 * max(1, len(first.cost))).collect())
    odds = lambda edge, inner: math.log((edge + 0.5) / (inner + 0.5))
    words = dict.fromkeys(first.cost, 1) | {r["w"]: r["n"] for r in got}  # of words on no path one each
    return GapWords(words, {r["w"]: odds(r["opens"], r["inner_o"]) for r in got}, {r["w"]: odds(r["closes"], r["inner_c"]) for r in got})


def split_sentences(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "sentence_id"), text_col: str = "text", gaps: GapWords | None = None,
                    abbreviations: dict[str, float] | None = None) -> DataFrame:
    """The keys and starts ARRAY<INT>, offsets in code points of each row's sentences.

    Rows with a null or blank text are left out, repeated rows come out as often as they come in,
    texts are read whole, an empty table gives an empty result. Each row is split by itself, with the dictionary
    and the abbreviations learnt from all rows (unless given); both are sent once.
    """
    keys = list(keys)
    sent = df.sparkSession.sparkContext.broadcast((gap_words(df, text_col) if gaps is None else gaps, learn_abbreviations(df, text_col) if abbreviations is None else abbreviations))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", starts array<int>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            starts = [split_offsets(t, *sent.value) for t in p["text"]]
            if any(starts):
                some = [i for i, s in enumerate(starts) if s]
                yield p.iloc[some][keys].assign(starts=[starts[i] for i in some])

    return df.select(*keys, F.col(text_col).alias("text")).where("text is not null").mapInPandas(run, schema)
