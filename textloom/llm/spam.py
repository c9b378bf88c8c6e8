"""Pages of strung keywords, links and product tags (problem 10).

Two kinds of evidence are joined. List density: each line of a page is prose, a list that papers
have (contents, references, glossary, symbols, values, keywords), or strung phrases, links and
tags, or phrases that say themselves again within a few lines. Replication: five-word shingles of the strung part are exploded, the distinct hosts
that have each of them anywhere in their pages are counted, and a page is stitched if many of
its shingles stand on other hosts too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import key_filter, may_hold, pieces, scratch, stored

_URL = re.compile(r"(?:https?://|www\.)[!#-&*-;=?-Z\\^-~]+|(?<![\w.-])[a-z0-9-]{2,40}(?:\.[a-z0-9-]{1,40}){0,3}\.[a-z]{2,10}/[!#-&*-;=?-Z\\^-~]+", re.I)
_ANCHOR = re.compile(r"<a\s[^>]{0,300}>[^<]{0,300}</a>|\[[^\]\n]{1,80}\]\([^)\n]{4,120}\)", re.I)
_TAG = re.compile(r"(?:#|tag:)[^\s#，,、|/]{1,60}|[「【][^」】\n]{1,60}[」】]|[^\s★「」【】#]{1,40}★|[¥$€￥]\s?\d[\d.,]*")
_END = re.compile(r"[。！？!?｡।]+[”’」』）)\"]*|\.(?=[\s”\"’)»]|$|[A-ZÀ-ÞА-Я一-鿿])")
# Lists that papers have.
_CONTENTS = re.compile(r"(?:\.{3,}|…+|·{3,}|_{3,}|\s{3,})\s*(?:\d+|[ivxlc]+)\s*$")
_REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\(\d+\)|\d+\.)\s.*\b(?:1[89]|20)\d\d\b")
_SYMBOL = re.compile(r"^\s*\S{1,6}(?:\s{2,}|\t|\s*[=—–]\s*)\S.{0,60}[,，;；]\s*\S{1,12}\s*$")
_VALUES = re.compile(r"\t\s*[-+]?\d")
_GLOSS = re.compile(r"^\s*[^,，]{2,80}?(?:\s{2,}|[:：]\s+|\t)[^|#]{2,}$|^\s*[^,，:：]{2,80}, (?:see|cf\.|vgl\.|siehe|voir|v\.) .{2,}$")
_HEAD = re.compile(r"^\s*(?:关键词|关键字|キーワード|key ?words?|index terms|mots[- ]cl[ée]s|schlagw[oö]rter|schlüsselwörter|ключевые слова)\s*[:：]", re.I)
_CODE = re.compile(r"(?<!\w)[A-Z]{1,4}-?\d{2,6}[A-Z]?(?!\w)")
_LINE = re.compile(r"[^\r\n]+")
_CHUNK = re.compile(r"[,，、|/;；\n\t]+| {2,}|　+")


def _links(s: str) -> int:
    """Characters of the line's links."""
    n = sum(len(m.group()) for m in _ANCHOR.finditer(s)) if "<a" in s or "](" in s else 0
    return n or (sum(len(m.group()) for m in _URL.finditer(s)) if "/" in s or "www." in s else 0)


def _marks(s: str) -> int:
    """Characters of the line's tags and prices."""
    if not any(x in s for x in "#「【★¥$€￥") and "tag:" not in s:
        return 0
    return sum(len(m.group()) for m in _TAG.finditer(s))


def _sentences(line: str) -> list[str]:
    """The line's sentences; a run of short chunks is none, nor is a very long stretch without an end."""
    out, at = [], 0
    for m in _END.finditer(line):
        s, at = line[at : m.end()], m.end()
        if not 9 <= len(s) <= 500:
            continue
        n = sum(1 for c in _CHUNK.split(s) if c and not c.isspace())
        if n <= 3 or len(s) >= 9 * n and n < 9:
            out.append(s)
    return out


def _prose(line: str) -> int:
    """Characters of the line's sentences."""
    return sum(map(len, _sentences(line)))


def _without(line: str, sentences: list[str]) -> str:
    for s in sentences:
        line = line.replace(s, "\n", 1)
    return line


def _paper_list(lines: list[str]) -> set[int]:
    """Numbers of the lines that belong to lists as papers have them: at least three neighbours of one form,
    or a keyword line."""
    out, forms = set(), []
    for s in lines:
        f = 0
        if _CONTENTS.search(s):
            f = 1
        elif _REFERENCE.search(s):
            f = 2
        elif _VALUES.search(s):
            f = 3
        elif not _links(s) and not _marks(s):
            if _SYMBOL.search(s):
                f = 4
            elif _GLOSS.search(s) and len(_CHUNK.split(s.strip())) <= 4 and len(s) < 200:
                f = 5
        forms.append(f)
    i = 0
    while i < len(lines):
        if not forms[i]:
            if _HEAD.search(lines[i]):
                out.add(i)
            i += 1
            continue
        j = i
        while j < len(lines) and (forms[j] == forms[i] or forms[i] in (4, 5) and forms[j] in (4, 5)):
            j += 1
        if j - i >= 3 or forms[i] <= 3:
            out.update(range(i, j))
        i = max(j, i + 1)
    return out


def strung(text: str, echoing: set[int] | None = None) -> tuple[list[str], int, int]:
    """The strung lines of a page, their characters without white space, and all of the page's.

    A line is strung if links or tags make up most of it, if it says itself again (its number is in ``echoing``, see
    ``echoes``), or if it is one of many short phrases (in a row of lines or between separators) that are neither
    sentences nor a paper's list.
    """
    if echoing is None:
        echoing = echoes([text])[0]
    bare = lambda s: sum(map(len, s.split()))
    lines = [s for s in _LINE.findall(text) if s.strip()]
    total = sum(map(bare, lines))
    listed = _paper_list(lines)
    found, short, size = [], [], 0

    def settle() -> None:
        """Short lines in a row: wrapped prose, if joined they are sentences."""
        nonlocal size
        if len(short) >= 8:
            joined = [re.sub(r"\s+", " ", x) for x in ("".join(short), " ".join(short))]
            wrapped = max(map(_prose, joined))
            if wrapped < 0.4 * sum(map(len, short)):
                found.extend(short)
                size += sum(map(bare, short))
        short.clear()

    for i, s in enumerate(lines):
        linked, marked = _links(s), _marks(s)
        if linked + marked >= 0.4 * len(s) or linked and marked and len(_TAG.findall(s)) + len(_URL.findall(s)) >= 8 or i in echoing and i not in listed:
            found.append(s)
            size += bare(s)
            continue
        if i in listed:
            settle()
            continue
        sentences = _sentences(s)
        prose = sum(map(len, sentences))
        if prose >= 0.5 * len(s):
            rest = _without(s, sentences) if len(s) - prose > 200 else ""
            if len(rest) > 200 and len([c for c in _CHUNK.split(rest) if c.strip()]) >= 12:
                found.append(rest)
                size += bare(rest)
            settle()
            continue
        chunks = [c for c in _CHUNK.split(s) if c.strip()]
        if len(s) >= 160 or len(chunks) >= 8 and not _END.search(s):
            rest = _without(s, sentences)
            spaced = len(s.split()) if re.search("[一-鿿]", s) else 0
            if len(chunks) >= 8 or spaced >= 8 or _repeats(s) or len(set(_CODE.findall(s))) >= 8:
                found.append(rest)
                size += bare(rest)
            settle()
        else:
            short.append(s)
    settle()
    return found, size, total


def _repeats(s: str) -> bool:
    """Some stretch of the line, of six letters at least, stands in it four times or more."""
    words = re.findall(r"[^\W_]{2,}", s)
    if len(words) >= 8 and len(set(words)) <= 0.5 * len(words) and len(set("".join(words))) > 4:
        return True
    return False


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, first character (in all texts joined) and kind of every word: a Han or kana character (3), a
    number (2, every number is the same word) or a run of other letters (1)."""
    whole = "\x1e".join(t.replace("\x1e", " ").lower() for t in texts) + "\x1e"
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    han = (c >= 0x3005) & (c <= 0x9FFF)
    digit = (c >= 0x30) & (c <= 0x39) | (c >= 0xFF10) & (c <= 0xFF19)
    letter = (c >= 0x61) & (c <= 0x7A) | (c >= 0xC0) & (c < 0x2000) | (c > 0x9FFF) & ~digit
    kind = np.where(han, 3, np.where(digit, 2, np.where(letter, 1, 0))).astype(np.int8)
    new = (kind > 0) & ((kind == 3) | np.concatenate([[True], kind[1:] != kind[:-1]]))
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), at, kind[at]
    x = np.where(kind == 2, 0x30, c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x[(kind == 2) & ~new] = 0
    x ^= x >> np.uint64(33)
    pos = np.zeros(len(c), np.uint64)
    pos[at[0]:] = np.arange(at[0], len(c), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(c)))).astype(np.uint64)
    y = np.where(kind > 0, (x + pos) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    y ^= y >> np.uint64(31)
    return np.searchsorted(np.flatnonzero(c == 0x1E), at), np.add.reduceat(y, at), at, kind[at]


def _runs(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``size`` words from each word on, and whether they all are of its text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ word[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h, doc[:n] == doc[size - 1 :]


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` words."""
    doc, word, _, _ = words(texts)
    h, same = _runs(doc, word, size)
    return doc[: len(h)][same], h[same].view(np.int64)


def echoes(texts: list[str], reach: int = 200, share: float = 0.4) -> list[set[int]]:
    """For each text the numbers of its lines (blank ones left out) that say themselves again: so much of their runs of
    words (five characters of Han and kana, three other words) stood within the ``reach`` words before."""
    doc, word, at, kind = words(texts)
    out: list[set[int]] = [set() for _ in texts]
    if len(word) < 6:
        return out
    five, in_five = _runs(doc, word, 5)
    three, in_three = _runs(doc, word, 3)
    n = len(five)
    h, ok = np.where(kind[:n] == 3, five, three[:n]), np.where(kind[:n] == 3, in_five, in_three[:n])
    h = h ^ (doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (np.diff(order) <= reach)
    again &= ok
    total, echoed = np.bincount(doc[:n], minlength=len(texts)), np.bincount(doc[:n], again, len(texts))
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for d in np.flatnonzero(echoed >= 0.1 * np.maximum(1, total)).tolist():
        if echoed[d] < 6:
            continue
        starts = [m.start() for m in _LINE.finditer(texts[d]) if m.group().strip()]
        mine = np.flatnonzero(doc[:n] == d)
        line = np.searchsorted(starts, at[mine] - first[d], "right") - 1
        k = np.bincount(np.maximum(line, 0), minlength=len(starts))
        e = np.bincount(np.maximum(line, 0), again[mine], len(starts))
        out[d] = set(np.flatnonzero((e >= share * k) & (k >= 12)).tolist())
    return out


def find_spam(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.5,
              joint: float = 0.75, hosts: int = 2, max_log_bits: int = 28) -> DataFrame:
    """``id_col``, density (share of the page that is strung) and stitched (share of the strung shingles that at
    least ``hosts`` hosts have) of the pages whose density exceeds ``share`` and, with half of
    stitched, reaches ``joint``: phrases that other hosts have too decide where the list alone doesn't.

    Null and blank texts are no cases; a null host counts for no host; repeated rows count once;
    an empty table gives an empty result; long pages are read whole. All pages' shingles are
    counted; a Bloom filter of the strung pages' shingles (ten bits each, sent up to 2**max_log_bits bits, 32 MB; beyond
    that all shingles travel) lets only those travel that can matter, as (shingle, host) made distinct before the
    shuffle, so a host with a third of all pages sends each shingle once a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(host_col).alias("s")).where("t is not null")
    kind = docs.schema[id_col].dataType.simpleString()

    def candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids, hashes, density = [], [], []
            every = p["t"].tolist()
            for i, j in pieces(every):
                for d, t, again in zip(p["d"].iloc[i:j], every[i:j], echoes(every[i:j]), strict=True):
                    found, size, total = strung(t, again)
                    if total and size > share * total:
                        _, h = shingles(["\n".join(found)])
                        ids.append(d)
                        density.append(size / total)
                        hashes.append(np.unique(h).tolist())
            if ids:
                yield pd.DataFrame({"d": ids, "density": density, "h": hashes})

    cand = stored(rows.select("d", "t").mapInPandas(candidates, f"d {kind}, density double, h array<long>").dropDuplicates(["d"]), scratch(spark, "strung"))

    # Ten bits a shingle; where that is too much to send, all shingles travel, made distinct by task.
    total = cand.agg(F.sum(F.size("h"))).first()[0] or 0
    log_bits = max(10, math.ceil(math.log2(10 * total + 1)))
    sent = spark.sparkContext.broadcast(key_filter(cand, log_bits) if log_bits <= max_log_bits else None)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, waiting, many = sent.value, [], 0
        for p in parts:
            p = p[p["s"].notna()]
            code, names = pd.factorize(p["s"])
            host = pd.util.hash_array(np.asarray(names, dtype=object)).view(np.int64) if len(names) else np.zeros(0, np.int64)
            every = p["t"].tolist()
            for i, j in pieces(every, 1024):
                doc, h = shingles(every[i:j])
                hit = np.ones(len(h), bool) if bits is None else may_hold(bits, h, log_bits)
                if hit.any():
                    waiting.append(np.unique(np.stack([h[hit], host[code[i:j][doc[hit]]]]), axis=1))
                    many += waiting[-1].shape[1]
            if many > 500_000:
                u = np.unique(np.concatenate(waiting, axis=1), axis=1)
                yield pd.DataFrame({"h": u[0], "s": u[1]})
                waiting, many = [], 0
        if waiting:
            u = np.unique(np.concatenate(waiting, axis=1), axis=1)
            yield pd.DataFrame({"h": u[0], "s": u[1]})

    seen = rows.select("t", "s").mapInPandas(placed, "h long, s long").groupBy("h").agg(F.countDistinct("s").alias("n")).where(F.col("n") >= hosts).select("h")
    exploded = cand.select("d", F.explode("h").alias("h"))
    counted = exploded.join(seen, "h", "left_semi").groupBy("d").agg(F.count(F.lit(1)).alias("k"))
    stitched = cand.select("d", "density", F.size("h").alias("n")).join(counted, "d", "left").withColumn("stitched", F.coalesce("k", F.lit(0)) / F.greatest("n", F.lit(1)))
    return stitched.where(F.col("density") + 0.5 * F.col("stitched") >= joint).select(F.col("d").alias(id_col), "density", "stitched")
