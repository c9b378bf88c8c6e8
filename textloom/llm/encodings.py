"""Text read with a wrong character encoding (problem 2).

A chain is what happened to a text: its true encoding and the one it was read with. For each
chain the stretches of a row that could stem from it are undone, and the pair model of the
collection (how usual two neighbouring characters are) says how much likelier the undone form
is. Expectation-maximization over these weights learns how often each chain befell each source
(file) and, as a prior for sources with little evidence, each field; the posterior of a row
decides and repairs it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import SHARE, pieces, scratch, stored, usual

SEP = "\x1e"
# Texts in UTF-8 read with one byte, or with up to two bytes, a character.
ONE_BYTE = ("cp1252", "cp1251", "cp437", "mac_roman", "koi8-r", "cp850", "cp866", "cp1250")
TWO_BYTE = ("gbk", "big5", "cp949", "shift_jis", "euc_jp")
# Texts in an East Asian encoding read with one byte a character.
BYTES_OF = ("gbk", "euc_jp", "shift_jis", "big5", "cp949", "cp1251", "koi8-r")
# (true, read as) where one character stands for one character.
ONE_TO_ONE_NARROW = (
    ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859-7"),
)
ONE_TO_ONE_WIDE = (("gbk", "big5"), ("big5", "gbk"), ("gbk", "cp949"), ("gbk", "euc_jp"), ("euc_jp", "gbk"), ("cp949", "gbk"))
ONE_TO_ONE = ONE_TO_ONE_NARROW + ONE_TO_ONE_WIDE
CHAINS = ("lost", "stray", *(f"utf-8>{w}" for w in ONE_BYTE + TWO_BYTE), *(f"{t}>latin-1" for t in BYTES_OF), *(f"{t}>{w}" for t, w in ONE_TO_ONE))

_MULTI = rb"(?:[\xC3-\xDF][\x80-\xBF]|\xC2[\xA0-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xE0[\xA0-\xBF][\x80-\xBF]|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2})"
_UTF8 = re.compile(_MULTI + rb"+")
_UTF8_WIDE = re.compile(
    rb"(?:(?:[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xE0[\xA0-\xBF][\x80-\xBF])+" + _MULTI + rb"*)"
    rb"|(?:(?<=[\n\x1e-\x3e\x40-\x7e]{2})|(?<=\x1e))(?:[\xC3-\xC5][\x80-\xBF]|\xC2[\xA0-\xBF]|[\xCE\xCF][\x80-\xBF]|\xE2[\x80-\x89][\x80-\xBF])+(?=[A-Za-z0-9 \n,.;:)])"
)
_HIGH = re.compile("[\x80-\xff]{3,}")
# Replacement marks: that of Unicode, what became of it, and runs of question marks within text.
_LOST = re.compile("�|锟斤拷|ï¿½|\\?{3,}|(?<=[^\\W\\d])\\?{2}(?=[^\\W\\d])")
_STRAY = re.compile("[\x80-\x84\x86-\x9f\ue000-\uf8ff]")


@lru_cache(maxsize=64)
def _byte_of(codec: str) -> np.ndarray:
    """For each character its byte in a one-byte codec, or a question mark. What cp1252 leaves open
    are the control characters of Latin-1, as browsers and repair tools have it."""
    out = np.full(0x10000, 0x3F, np.uint8)
    out[:0x80] = np.arange(0x80)
    if codec == "cp1252":
        out[0x80:0xA0] = np.arange(0x80, 0xA0)
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(maxsize=64)
def _widths(codec: str) -> np.ndarray:
    """Bytes of each character in the codec; one for what it lacks (then a question mark)."""
    out = np.ones(0x10000, np.int8)
    for c in range(0x80, 0x10000):
        if not 0xD800 <= c < 0xE000:
            out[c] = len(chr(c).encode(codec, "replace"))
    return out


@lru_cache(maxsize=64)
def _undo(true: str, read: str) -> np.ndarray:
    """For each character what it was, or 0; only characters beyond ASCII."""
    out = np.zeros(0x10000, np.uint32)
    narrow = (true, read) in ONE_TO_ONE_NARROW  # then only what its bytes stand for
    for c in map(ord, set(bytes(range(0x80, 0x100)).decode(read, "ignore"))) if narrow else range(0x80, 0x10000):
        if c < 0x80 or 0xD800 <= c < 0xF900:
            continue
        try:
            was = chr(c).encode(read, "ignore").decode(true)
        except UnicodeDecodeError:
            continue
        if len(was) == 1 and ord(was) > 0x7F and ord(was) != c and not 0x80 <= ord(was) < 0xA0:
            out[c] = ord(was)
    return out


@lru_cache(maxsize=2)
def _undoable(chains: tuple[tuple[str, str], ...]) -> np.ndarray:
    """For each character the chains that can undo it, as bits."""
    out = np.zeros(0x10000, np.uint16)
    for i, (true, read) in enumerate(chains):
        out[_undo(true, read) > 0] |= 1 << i
    return out


@lru_cache(maxsize=1)
def _utf8_bits() -> tuple[np.ndarray, np.ndarray]:
    """For each character the one-byte codecs in which it is a lead byte, or a later byte, of UTF-8, as bits."""
    lead, later = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint8)
    for i, w in enumerate(ONE_BYTE):
        b = _byte_of(w)
        lead[(b >= 0xC2) & (b <= 0xF0)] |= 1 << i
        later[(b & 0xC0) == 0x80] |= 1 << i
    return lead, later


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def pairs_of(c: np.ndarray) -> np.ndarray:
    """Each two neighbours as one number."""
    return (c[:-1].astype(np.int64) << 21) | c[1:]


def pair_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """pair, n: neighbouring characters over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple] = []

        def merge(parts: list[tuple]) -> tuple:
            k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        for b in batches:
            c = codes(SEP.join(t for t in b.column(0).to_pylist() if t))
            if len(c) > 1:
                p = pairs_of(c)
                p = p[(c[:-1] != 0x1E) & (c[1:] != 0x1E)]
                waiting.append(np.unique(p, return_counts=True))
            if len(waiting) >= 16:
                kept = merge([kept, *waiting])
                waiting = []
        kept = merge([kept, *waiting]) if waiting else kept
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["pair", "n"])

    return df.select(F.col(text_col).alias("t")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class PairModel:
    """Log share of each pair of neighbours, in a hash table of tagged slots; unseen pairs have the floor."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, log_slots: int = 22):
        log_slots = max(log_slots, (4 * len(pair)).bit_length())
        self.shift = np.uint64(64 - log_slots)
        self.total = float(max(1, n.sum()))
        self.floor = np.float32(np.log(max(0.3 / self.total, 0.5 * SHARE)))
        self.rare = max(-13.0, float(self.floor) + 1.5)  # in a small collection only what it has once, or never
        self.score = np.full(1 << log_slots, self.floor, np.float32)
        self.tag = np.zeros(1 << log_slots, np.uint16)
        order = np.lexsort((pair, n))  # of two pairs in one slot the usual one stays
        slot, tag = self._place(pair[order])
        self.score[slot] = np.log(n[order] / self.total)
        self.tag[slot] = tag

    def _place(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> self.shift).astype(np.int64), ((h & np.uint64(0xFFFE)) | np.uint64(1)).astype(np.uint16)

    def of(self, c: np.ndarray) -> np.ndarray:
        return self.of_pairs(pairs_of(c))

    def of_pairs(self, pair: np.ndarray) -> np.ndarray:
        slot, tag = self._place(pair)
        s = self.score[slot]
        s[self.tag[slot] != tag] = self.floor
        return s

    def segments(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean score and number of pairs of each string."""
        if not parts:
            return np.zeros(0, np.float32), np.zeros(0, np.int64)
        c = codes(SEP.join(parts))
        s = self.of(c).astype(np.float64) if len(c) > 1 else np.zeros(0)
        use = (c[:-1] != 0x1E) & (c[1:] != 0x1E)
        at = np.cumsum(c == 0x1E)[:-1]
        n = np.bincount(at[use], minlength=len(parts))
        return np.bincount(at[use], s[use], len(parts)) / np.maximum(n, 1), n


def _letter(c: np.ndarray) -> np.ndarray:
    return ((c | 0x20) >= 0x61) & ((c | 0x20) <= 0x7A) | (c >= 0xC0) & (c < 0x250)


def _tried(text: str | bytes, pattern: re.Pattern, places: np.ndarray) -> list[re.Match]:
    """The matches of a pattern that can begin at some places only."""
    out, end = [], 0
    for p in places.tolist():
        if p >= end and (m := pattern.match(text, p)):
            out.append(m)
            end = m.end()
    return out


def _wide_matches(raw: np.ndarray) -> list[re.Match]:
    """Matches of UTF-8 in the bytes of a two-byte codec, tried only where bytes of the right kinds follow each other."""
    if len(raw) < 3:
        return [m for m in [_UTF8_WIDE.search(raw.tobytes())] if m]
    cont = (raw & 0xC0) == 0x80
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xF0) & cont[1:])
    if len(lead):
        padded = np.concatenate([raw, np.zeros(6, np.uint8)])
        more = np.concatenate([cont, np.zeros(6, bool)])
        three = (padded[lead] >= 0xE0) & more[lead + 2]
        lead = lead[three | ((lead > 0) & (raw[np.maximum(lead - 1, 0)] < 0x80))]
    return _tried(raw.tobytes(), _UTF8_WIDE, lead) if len(lead) else []


def find_stretches(texts: list[str], model: PairModel, least: float = 4.0) -> list[tuple[int, int, int, str, str, float]]:
    """(row, start, end, chain, what it was, gain) of every stretch that some chain explains better by
    at least ``least`` nats. Pairs below the model's ``rare`` mark a row for the one-to-one chains. What a lost
    character stood for is unknown, so its stretch stays as it is."""
    whole = SEP.join(t.replace(SEP, " ") for t in texts)
    c = codes(whole)
    if not len(c):
        return []
    row_end = np.concatenate([np.flatnonzero(c == 0x1E), [len(c)]])
    row_start = np.concatenate([[0], row_end[:-1] + 1])
    cand: list[tuple[int, int, str, str]] = []  # char start, end, chain, repaired
    out = []
    row_of = lambda p: int(np.searchsorted(row_end, p))
    for m in _tried(whole, _LOST, np.flatnonzero((c == 0xFFFD) | (c == 0x951F) | (c == 0xEF) | (c == 0x3F))):
        r = row_of(m.start())
        out.append((r, m.start() - int(row_start[r]), m.end() - int(row_start[r]), "lost", m.group(), 50.0))
    bmp = np.minimum(c, 0xFFFF)
    high = c > 0x7F
    if not high.any():
        return out
    covered = bytearray(len(c))  # by long well-formed stretches; other codecs needn't explain their parts
    lead, later = _utf8_bits()
    pairs = lead[bmp[:-1]] & later[bmp[1:]]
    begins = np.flatnonzero(pairs)
    of = pairs[begins]
    for i, w in enumerate(ONE_BYTE):
        places = begins[(of >> i & 1) > 0]
        for m in _tried(_byte_of(w)[bmp].tobytes(), _UTF8, places) if len(places) else ():
            s, e = m.span()
            if covered[s] and covered[e - 1]:
                continue
            cand.append((s, e, f"utf-8>{w}", m.group().decode("utf-8", "replace")))
            if e - s >= 8:
                covered[s:e] = b"\1" * (e - s)
    s0 = model.of(c)
    odd = (s0 < model.rare) & (high[:-1] | high[1:])
    odd_before = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    for w in TWO_BYTE:
        text = whole.encode(w, "replace")
        found = _wide_matches(np.frombuffer(text, np.uint8))
        if not found:
            continue
        ends = np.cumsum(_widths(w)[bmp], dtype=np.int32)
        if ends[-1] != len(text):
            ends = np.cumsum([len(ch.encode(w, "replace")) for ch in whole], dtype=np.int32)
        span = np.array([m.span() for m in found], np.int32)
        s, e = np.searchsorted(ends, span[:, 0], "right"), np.searchsorted(ends, span[:, 1], "right")
        strange = odd_before[np.minimum(e, len(odd))] > odd_before[np.maximum(s - 1, 0)]  # some pair is unusual
        use = (e > s) & strange
        s, e, chain = s[use], e[use], f"utf-8>{w}"
        from_, to = np.where(s > 0, ends[s - 1], 0), ends[e - 1]
        for s_, e_, b0, b1 in zip(s.tolist(), e.tolist(), from_.tolist(), to.tolist(), strict=True):
            got = text[b0:b1].decode("utf-8", "ignore")
            if got:
                cand.append((s_, e_, chain, got))
    for m in _HIGH.finditer(whole):
        raw = m.group().encode("latin-1")
        for t in BYTES_OF:
            got = raw.decode(t, "ignore")
            if got and len(got.encode(t, "ignore")) >= 0.8 * len(raw):
                cand.append((m.start(), m.end(), f"{t}>latin-1", got))
    if cand:
        more = []
        formed = [e - s if chain[6:] in ONE_BYTE and chain.startswith("utf-8>") else 0 for s, e, chain, _ in cand]
        for s, e, chain, got in cand:  # read wrongly twice
            if chain.startswith("utf-8>") and len(got) > 1:
                w = chain[6:]
                raw = _byte_of(w)[np.minimum(codes(got), 0xFFFF)].tobytes() if w in ONE_BYTE else got.encode(w, "replace")
                again = raw.decode("utf-8", "ignore")
                if len(again) < len(got) and len(again.encode()) >= 0.85 * len(raw) - 2:
                    more.append((s, e, chain, again))
                    formed.append(e - s + len(got) if w in ONE_BYTE else 0)
        cand += more
        edge = lambda i: whole[i] if 0 <= i < len(whole) and whole[i] != SEP else ""
        b, n = model.segments([f"{edge(s - 1)}{got}{edge(e)}" for s, e, _, got in cand])
        # What stands there, with its neighbours.
        first, end = np.array([x[0] for x in cand]), np.array([x[1] for x in cand])
        size = end - first + 1
        pair = np.repeat(first - 1 - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        of = np.repeat(np.arange(len(cand)), size)
        inner = (pair >= 0) & (pair < len(s0))
        pair, of = pair[inner], of[inner]
        inner = (c[pair] != 0x1E) & (c[pair + 1] != 0x1E)
        pair, of = pair[inner], of[inner]
        a = np.bincount(of, s0[pair].astype(np.float64), len(cand)) / np.maximum(np.bincount(of, minlength=len(cand)), 1)
        # That a stretch is well-formed UTF-8 hardly happens by chance in one-byte encodings.
        gain = (b - a) * n + 2.0 * np.array(formed)
        for i in [i for i, g in enumerate((gain >= least).tolist()) if g or "�" in cand[i][3]]:
            (s, e, chain, got), g = cand[i], gain[i]
            sure = "�" in got and chain.startswith("utf-8>") and chain[6:] in TWO_BYTE + ("cp1252",)
            if g >= least or sure:
                r = row_of(s)
                out.append((r, s - int(row_start[r]), e - int(row_start[r]), chain, got, float(max(g, 20.0 if sure else g))))
    # One-to-one chains, over rows with unusual pairs beyond ASCII.
    if odd.any():
        n_odd = np.bincount(np.searchsorted(row_end, np.flatnonzero(odd)), minlength=len(texts))
        for some, chains in ((n_odd > 0, ONE_TO_ONE_NARROW), (n_odd > 2, ONE_TO_ONE_WIDE)):
            inside = np.repeat(some, row_end - row_start + 1)[: len(c)]
            keep = np.flatnonzero(inside)
            k, kept = bmp[keep], c[keep]
            which = _undoable(chains)[k]
            able = np.flatnonzero(which)
            which = which[able]
            for chain, (t, w) in enumerate(chains):
                at = able[(which >> chain & 1) > 0]
                if not len(at):
                    continue
                table = _undo(t, w)
                # Runs of characters that the chain can undo, with one neighbour at either side.
                first = np.concatenate([[True], np.diff(at) > 1])
                a, z = at[first], at[np.concatenate([first[1:], [True]])] + 1
                if chains is ONE_TO_ONE_WIDE:
                    long = z - a >= 3
                    a, z = a[long], z[long]
                    if not len(a):
                        continue
                # Each run's pairs, from the one with its left neighbour to the one with its right.
                lo, hi = np.maximum(a - 1, 0), np.minimum(z, len(k) - 1)
                size = np.maximum(hi - lo, 1)
                first_of = np.cumsum(size) - size
                use = np.minimum(np.repeat(lo - first_of, size) + np.arange(int(size.sum())), max(0, len(k) - 2))
                if len(k) > 1:
                    u, v = table[k[use]], table[k[use + 1]]
                    new = model.of_pairs((np.where(u > 0, u, kept[use]).astype(np.int64) << 21) | np.where(v > 0, v, kept[use + 1]))
                    old = s0[keep[use]]
                    apart = np.flatnonzero(keep[use + 1] - keep[use] != 1)  # rows left out between
                    old[apart] = model.of_pairs((kept[use[apart]].astype(np.int64) << 21) | kept[use[apart] + 1])
                    gain = np.add.reduceat((new - old).astype(np.float64), first_of)
                else:
                    gain = np.zeros(len(a))
                if chains is ONE_TO_ONE_NARROW:
                    # A small Greek letter that stands alone is a symbol; box drawing within text is not.
                    before, after = kept[np.maximum(a - 1, 0)], kept[np.minimum(z, len(kept) - 1)]
                    o = kept[a]
                    alone = (z - a == 1) & ~_letter(before) & ~_letter(after)
                    gain = gain - 3.0 * (alone & (o >= 0x3AC) & (o < 0x3CF)) + 3.0 * ((o >= 0x2500) & (o < 0x25A0))
                for i in np.flatnonzero(gain >= least):
                    s, e = int(keep[a[i]]), int(keep[z[i] - 1]) + 1
                    r = row_of(s)
                    got = table[k[a[i] : z[i]]].astype("<u4").tobytes().decode("utf-32-le", "replace")
                    out.append((r, s - int(row_start[r]), e - int(row_start[r]), f"{t}>{w}", got, float(gain[i])))
    # Control and private characters that no chain explains are a wrong decoder's all the same.
    spans: dict[int, list[tuple[int, int]]] = {}
    for m in _STRAY.finditer(whole):
        if not spans:
            for r, s, e, *_ in out:
                spans.setdefault(r, []).append((s, e))
        r = row_of(m.start())
        at = m.start() - int(row_start[r])
        if not any(s <= at < e for s, e in spans.get(r, ())):
            out.append((r, at, at + 1, "stray", m.group(), 12.0))
    return out


def undo(text: str, stretches: list[tuple]) -> str:
    """The text with its stretches (start, end, chain, was, gain) undone, the best first, none overlapping."""
    taken: list[tuple] = []
    for x in sorted(stretches, key=lambda x: (-x[4], x[0], -x[1])):
        if x[2] not in ("lost", "stray") and all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
            taken.append(x)
    for s, e, _, was, _ in sorted(taken, reverse=True):
        text = text[:s] + was + text[e:]
    return text


EVIDENCE = "chains array<struct<chain:string,llr:double>>, repaired string"


def _evidence(rows: DataFrame, keys: list[str], sent, only_found: bool = True) -> DataFrame:
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", text string, field string, " + EVIDENCE

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PairModel(*sent.value)
        for whole in parts:
            every = whole["text"].tolist()
            for at, end in pieces(every, 4096):
                p, texts = whole.iloc[at:end], every[at:end]
                by: dict[int, list[tuple]] = {}
                for r, *x in find_stretches(texts, model):
                    by.setdefault(r, []).append(tuple(x))
                hit = sorted(by)
                if not hit:
                    continue
                out = p.iloc[hit].reset_index(drop=True)
                chains, fixed = [], []
                for r in hit:
                    sums: dict[str, float] = {}
                    for x in by[r]:
                        sums[x[2]] = sums.get(x[2], 0.0) + x[4]
                    chains.append([{"chain": k, "llr": min(v, 500.0)} for k, v in sorted(sums.items())])
                    fixed.append(undo(texts[r], by[r]))
                yield out.assign(chains=chains, repaired=fixed)

    return rows.select(*keys, "text", "field").mapInPandas(run, schema)


def _posterior(evidence: DataFrame, sizes: DataFrame, keys: list[str], source: str, n_rows: dict[str, int], rounds: int, strength: float) -> DataFrame:
    """Expectation-maximization over chain shares; adds ``damaged`` (posterior) and ``chain`` (the likeliest).

    A round's expected counts per source, field and chain are a stored table; the shares of each whole field (its
    pool) are one number a chain and come to the driver.
    """
    spark = evidence.sparkSession
    llr = F.least(F.col("x.llr"), F.lit(300.0))
    long = evidence.select(*keys, "field", F.explode("chains").alias("x")).select(*keys, "field", "x.chain", llr.alias("llr"))
    w = Window.partitionBy(*keys)

    def scored(prior) -> DataFrame:
        odds = F.col("prior") * F.exp("llr")
        return prior.withColumn("odds", odds).withColumn("p", F.col("odds") / (1 + F.sum("odds").over(w)))

    got = scored(long.withColumn("prior", F.lit(0.001)))
    for _ in range(rounds - 1):
        sums = stored(got.groupBy(source, "field", "chain").agg(F.sum("p").alias("s")), scratch(spark, "shares"))
        pool = {f"{r['field']}/{r['chain']}": r["s"] / max(1, n_rows.get(r["field"], 0)) for r in sums.groupBy("field", "chain").agg(F.sum("s").alias("s")).collect()}
        if not pool:
            break
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(pool.items()) for x in kv])[F.concat_ws("/", "field", "chain")], F.lit(1e-6))
        local = sums.join(sizes, [source, "field"]).select(source, "field", "chain", ((F.col("s") + strength * share) / (F.col("n_source") + strength)).alias("local"))
        got = scored(long.join(local, [source, "field", "chain"], "left").withColumn("prior", F.coalesce("local", share)))
    return got.groupBy(*keys).agg(F.sum("p").alias("damaged"), F.max_by("chain", "p").alias("chain"))


def find_damage(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "sentence_id"), source: str = "doc_id", text_col: str = "text",
                rounds: int = 3, strength: float = 50.0, background: DataFrame | None = None, field: Column | None = None) -> DataFrame:
    """Rows whose text some chain explains: the keys, text, repaired, chain and the posterior ``damaged``.

    Rows without any such stretch are left out (their posterior is below 1/1000). Null texts are no
    cases, repeated rows count once, an empty table gives an empty result, long texts are read
    whole. ``chain`` is "lost" where replacement marks show that characters are gone; these stay.
    The pair model (the pairs of a least share of all, so at most 8 million of 16 bytes) is fitted on all texts; after a first round the
    pairs of damaged rows are taken out of it by their posterior, and the rows with evidence
    are weighed again. ``rounds`` of expectation-maximization learn the chains of each source
    with ``strength`` rows' worth of the whole field's shares. ``background``: texts of the same kind
    to fit the pair model on, where ``df`` is a selection of suspects. ``field``: a string column that parts the rows into
    fields with shares of their own (few values); one field if not given.
    """
    spark = df.sparkSession
    keys = list(keys)
    rows = df.select(*keys, F.col(text_col).alias("text"), (F.lit("") if field is None else F.coalesce(field, F.lit(""))).alias("field")).where("text is not null")
    known = usual(pair_counts(rows if background is None else background.select(F.col(text_col).alias("text"))), "pairs")
    counts = known.toArrow()
    pair, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    sent = spark.sparkContext.broadcast((pair, n))
    first = stored(_evidence(rows, keys, sent), scratch(spark, "evidence")).dropDuplicates(keys)
    sizes = rows.groupBy(source, "field").agg(F.count(F.lit(1)).alias("n_source"))
    sizes = stored(sizes, scratch(spark, "sources"))
    n_rows = {r["field"]: r["n"] for r in sizes.groupBy("field").agg(F.sum("n_source").alias("n")).collect()}
    post = _posterior(first, sizes, keys, source, n_rows, rounds, strength)
    bad = stored(first.join(post, keys), scratch(spark, "first-round"))
    gone = pair_counts(bad.where("damaged > 0.5").select("text")).join(known.select("pair"), "pair", "left_semi").toArrow()
    order = np.argsort(pair)
    at = order[np.minimum(np.searchsorted(pair[order], gone["pair"].to_numpy()), max(0, len(pair) - 1))] if len(pair) else np.zeros(0, np.int64)
    same = pair[at] == gone["pair"].to_numpy() if len(pair) else np.zeros(0, bool)
    left = n.copy()
    left[at[same]] = np.maximum(0, left[at[same]] - gone["n"].to_numpy()[same])
    sent = spark.sparkContext.broadcast((pair[left > 0], left[left > 0]))
    sure = F.exists("chains", lambda x: x["llr"] >= 60.0)  # beyond what the model's second state can change
    columns = [*keys, "text", "field", "chains", "repaired"]
    weighed = bad.where(sure).select(*columns).unionByName(_evidence(bad.where(~sure), keys, sent).select(*columns))
    again = stored(weighed, scratch(spark, "evidence"))
    post = _posterior(again, sizes, keys, source, n_rows, rounds, strength)
    return again.drop("chains", "field").join(post, keys)
